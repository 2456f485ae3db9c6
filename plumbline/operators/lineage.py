"""Licences, provenance of models and datasets, ancestors, and the release tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from urllib.parse import quote

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import _c
from ..sources.tables import union_all
from .scale import attach, materialise, task_count

# Licences that allow redistribution of rows and derived weights, their published spelling, and aliases.
CANONICAL = {"apache-2.0": "Apache-2.0", "mit": "MIT", "bsd": "BSD", "cc0-1.0": "CC0-1.0", "cc-by-3.0": "CC-BY-3.0", "cc-by-4.0": "CC-BY-4.0",
             "cc-by-sa": "CC-BY-SA", "cc-by-sa-3.0": "CC-BY-SA-3.0", "cc-by-sa-4.0": "CC-BY-SA-4.0", "oanc": "OANC"}
ALIASES = {"cc0:-public-domain": "cc0-1.0", "cc0": "cc0-1.0"}
GATED_USES = ["train", "teacher"]
WHOLE = 256 << 20  # files up to this size are one value
PIECE = 8 << 20


def _lookup(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def licence_key(col) -> Column:
    k = F.regexp_replace(F.lower(F.trim(_c(col))), "[ _]", "-")
    return F.coalesce(F.try_element_at(_lookup(ALIASES), k), k)


def permissive(col) -> Column:
    return F.coalesce(licence_key(col).isin(list(CANONICAL)), F.lit(False))


def licence_names(col) -> Column:
    """Published names of an array of licences joined by AND; an unknown one stops the job."""
    def name(x):
        known = F.try_element_at(_lookup(CANONICAL), licence_key(x))
        return F.coalesce(known, F.raise_error(F.concat(F.lit("licence_not_permitted:"), F.coalesce(x, F.lit("none")))).cast("string"))
    return F.array_join(F.transform(_c(col), name), " AND ")


def organisation(col) -> Column:
    return F.when(F.contains(_c(col), F.lit("/")), F.lower(F.substring_index(_c(col), "/", 1)))


def closure(edges: DataFrame) -> DataFrame:
    """(start, end, depth): every pair joined by a path of (child, parent) edges, at its smallest depth.

    Path doubling: a pair at a depth between m + 1 and 2 m is one at depth m exactly, followed by one of at most m. Every round
    joins the two, keeps what is new and writes only that; rounds grow with the logarithm of the depth, and a cycle ends by itself.
    """
    named = edges.where("child IS NOT NULL AND parent IS NOT NULL").select(F.col("child").alias("start"), F.col("parent").alias("end")).distinct()
    known, reach = [materialise(named.withColumn("depth", F.lit(1)), "paths")], 1
    while True:
        pairs = union_all(*known)
        far = known[-1].where(F.col("depth") == reach).select("start", F.col("end").alias("via"))
        on = pairs.select(F.col("start").alias("via"), "end", "depth")
        found = far.join(on, "via").groupBy("start", "end").agg((F.min("depth") + reach).alias("depth"))
        new = materialise(found.join(pairs.select("start", "end"), ["start", "end"], "left_anti"), "paths")
        if new.isEmpty():
            return pairs
        known.append(new)
        reach *= 2


def ancestors(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(hub_id, ancestor, depth): every ancestor over (child, parent) edges once, at its smallest depth."""
    paths = closure(edges).select(F.col("start").alias("hub_id"), F.col("end").alias("ancestor"), "depth")
    return paths.join(roots.select("hub_id").distinct(), "hub_id", "left_semi")


def model_problems(models: DataFrame, edges: DataFrame, approved: DataFrame) -> DataFrame:
    """(kind, name, problem, value) of gated models: no_hub_id, organisation, ancestor, licence, with the value that fails."""
    gated = models.where(F.col("use").isin(GATED_USES)).withColumn("org", organisation("hub_id"))
    orgs = approved.select("org").distinct()
    traced = gated.where(F.coalesce("hub_id", F.lit("")) != "")
    out = gated.where(F.coalesce("hub_id", F.lit("")) == "").select("name", F.lit("no_hub_id").alias("problem"), F.lit(None).cast("string").alias("value"))
    out = out.unionByName(traced.join(orgs, "org", "left_anti").select("name", F.lit("organisation").alias("problem"), F.col("hub_id").alias("value")))
    up = ancestors(edges, traced).withColumn("org", organisation("ancestor")).join(orgs, "org", "left_anti")
    out = out.unionByName(up.join(traced.select("hub_id", "name"), "hub_id").select("name", F.lit("ancestor").alias("problem"), F.col("ancestor").alias("value")))
    out = out.unionByName(traced.where(~permissive("license")).select("name", F.lit("licence").alias("problem"), F.coalesce("license", F.lit("none")).alias("value")))
    return out.select(F.lit("model").alias("kind"), "name", "problem", "value")


def dataset_problems(datasets: DataFrame) -> DataFrame:
    """(kind, name, problem, value) of gated datasets, one row per failing licence; license is an array with one per task of a collection."""
    none = F.array(F.lit(None).cast("string"))
    held = F.when(F.size(F.coalesce("license", F.array())) == 0, none).otherwise(F.col("license"))
    rows = datasets.where(F.col("use").isin(GATED_USES)).select("name", F.explode(held).alias("licence")).where(~permissive("licence")).distinct()
    return rows.select(F.lit("dataset").alias("kind"), "name", F.lit("licence").alias("problem"), F.coalesce("licence", F.lit("none")).alias("value"))


def task_problems(collection: DataFrame) -> DataFrame:
    """(task, problem, value) of a collection (task, license): every task without a permissive licence of its own."""
    return collection.where(~permissive("license")).select("task", F.lit("licence").alias("problem"), F.coalesce("license", F.lit("none")).alias("value")).distinct()


def with_source_metadata(rows: DataFrame, registry: DataFrame, spread: Sequence[str] = ("row_id",)) -> DataFrame:
    """Rows with their source's registry entry; a source without one stops the job."""
    meta = registry.select(F.col("name").alias("source"), "organisation", F.col("license").alias("source_license"), F.lit(True).alias("_known"))
    j = attach(rows, meta, ["source"], "left", spread=spread)
    check = F.when(F.col("_known"), F.col("organisation")).otherwise(F.raise_error(F.concat(F.lit("source has no registry entry: "), F.col("source"))).cast("string"))
    return j.withColumn("organisation", check).drop("_known")


def public_rows(rows: DataFrame, excluded_tasks: Sequence[str] = ()) -> DataFrame:
    """Release rows: one schema, free-form fields as JSON text, published licence names; rows of excluded tasks left out."""
    kept = rows.where(~F.coalesce(F.col("provenance.task").isin(list(excluded_tasks)), F.lit(False))) if excluded_tasks else rows
    prov = F.struct(*[F.col(f"provenance.{c}").alias(c) for c in rows.schema["provenance"].dataType.fieldNames() if c not in ("origin", "license")])
    asked = [F.col("task_type").alias("type"), F.col("instructions")]
    by_key = F.to_json(F.struct(*asked, F.map_from_entries(F.transform("options", lambda o: F.struct(o["key"], o["text"]))).alias("criteria")))
    in_order = F.to_json(F.struct(*asked, F.transform("options", lambda o: o["text"]).alias("criteria")))
    question = F.when(F.col("task_type") == "score", in_order).otherwise(by_key)  # an ordinal's criteria are a list of levels
    dist = lambda c: F.to_json(F.map_from_arrays(F.transform("options", lambda o: o["key"]), F.col(c)))
    extra = [dist(c).alias(c) for c in ("target", "teacher_calibrated") if c in rows.columns]
    plain = [c for c in ("gold_weight", "teacher", "teacher_conflict") if c in rows.columns]
    return kept.select("row_id", "family", "task_type", "state", question.alias("question"), "gold", *plain, "holdout_family", *extra,
                       licence_names(F.array("provenance.license")).alias("license"), F.to_json(prov).alias("provenance"))


def release_statistics(rows: DataFrame, excluded_tasks: Sequence[str] = ()) -> DataFrame:
    """Rows by type, source and licence, held-out and in total, by one grouping-sets aggregate."""
    tagged = rows.select("task_type", F.col("provenance.source").alias("source"), licence_names(F.array("provenance.license")).alias("license"),
                         F.coalesce("holdout_family", F.lit(False)).alias("held"), F.coalesce(F.col("provenance.task").isin(list(excluded_tasks)), F.lit(False)).alias("excluded"))
    sets = [[F.col("task_type")], [F.col("source")], [F.col("license")], []]
    agg = tagged.groupingSets(sets, F.col("task_type"), F.col("source"), F.col("license")).agg(
        F.count_if(~F.col("excluded")).alias("n"), F.count_if("excluded").alias("n_excluded"), F.count_if(F.col("held") & ~F.col("excluded")).alias("n_holdout"), F.grouping_id().alias("gid"))
    what = F.when(F.col("gid") == 3, F.lit("task_type")).when(F.col("gid") == 5, F.lit("source")).when(F.col("gid") == 6, F.lit("license")).otherwise(F.lit("total"))
    return agg.select(what.alias("what"), F.coalesce("task_type", "source", "license", F.lit("all")).alias("value"), "n", "n_excluded", "n_holdout")


def attribution(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows per source with its organisation and licence; the counts join the registry, not the rows."""
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    return with_source_metadata(counts, registry, ["source"]).select("source", "rows", "organisation", F.col("source_license").alias("license"))


def _digests(frames):
    """Digests of large files, read piece by piece by the task that owns them."""
    for frame in frames:
        done = []
        for path in frame["path"]:
            system, inside = pafs.FileSystem.from_uri(quote(re.sub("^s3a:", "s3:", re.sub("^file:/+", "file:///", path)), safe=":/@"))
            digest = hashlib.sha256()
            with system.open_input_stream(inside, compression=None) as data:
                while piece := data.read(PIECE):
                    digest.update(piece)
            done.append(digest.hexdigest())
        yield frame.assign(sha256=done)


def file_manifest(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """Name, size and sha256 of every file under a path, whatever its size.

    Spark's reader hands over files of up to `whole` bytes as one value; larger ones are listed without their content and read
    through Arrow's file systems in pieces of PIECE bytes, each by the task that owns it. The reader passes over empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select("path", "length")
    large = large.repartition(task_count(large), "path").mapInPandas(_digests, "path string, length bigint, sha256 string")
    return small.unionByName(large).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), "sha256")
