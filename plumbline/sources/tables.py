"""Readers for landed tables and JSON-lines files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def land(df: DataFrame, root: str, config: str, split: str) -> None:
    """Write one split of one configuration of a data set as root/config=.../split=..., replacing that split alone, with a line of the manifest."""
    part = f"config={config}/split={split}"
    df.write.mode("overwrite").parquet(f"{root}/{part}")
    told = df.sparkSession.read.schema(df.schema).parquet(f"{root}/{part}").agg(F.count(F.lit(1)).alias("rows"))
    columns = F.lit(",".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields))
    told.select(F.lit(config).alias("config"), F.lit(split).alias("split"), "rows", columns.alias("columns")).write.mode("overwrite").json(f"{root}/_manifest/{part.replace('/', '_')}")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """config, split, rows, columns of everything landed under root."""
    return spark.read.schema("config string, split string, rows bigint, columns string").json(f"{root}/_manifest/*")


def landed(spark: SparkSession, root: str, config: str, splits: list[str] | None = None) -> DataFrame:
    """One configuration of a landed data set, some of its splits or all, with the columns config and split.

    Both name folders, so only those of the wanted splits are listed and read. A configuration or split that the manifest does
    not name stops the job, and so do splits of different columns; a split without rows is read as none.
    """
    have = {r.split: r.columns for r in manifest(spark, root).where(F.col("config") == config).select("split", "columns").collect()}  # a few splits
    wanted = sorted(have) if splits is None else list(dict.fromkeys(splits))
    missing = [s for s in wanted if s not in have]
    if missing or not wanted:
        raise ValueError(f"configuration {config!r} has no split {missing or 'at all'}")
    if len({have[s] for s in wanted}) > 1:
        raise ValueError(f"the splits of configuration {config!r} differ in their columns")
    schema = T.StructType([*T.StructType.fromDDL(", ".join(f"`{c.split(' ', 1)[0]}` {c.split(' ', 1)[1]}" for c in _fields(have[wanted[0]]))).fields, T.StructField("config", T.StringType()), T.StructField("split", T.StringType())])
    return spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/config={config}/split={s}" for s in wanted])


def _fields(columns: str) -> list[str]:
    """The entries of a manifest's column list, cut at commas outside of brackets."""
    out, depth = [""], 0
    for c in columns:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> DataFrame:
    """JSON lines under a fixed schema; blank lines are skipped and a broken line is kept in _corrupt_record.

    file_path and line_order (file, place of the split, place in the split) tell where a record stands.
    """
    fixed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if "_corrupt_record" not in fixed.fieldNames():
        fixed = T.StructType([*fixed.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(paths).where(F.trim("value") != "")
    parsed = F.from_json("value", fixed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    return lines.select(parsed.alias("r"), place.alias("line_order")).select("r.*", F.col("line_order.file").alias("file_path"), "line_order")


def write_jsonl(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if gzip else "none").json(path)


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken rows) of a JSON-lines read."""
    good = df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return good, df.where(F.col("_corrupt_record").isNotNull())


def read_predictions(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """Every run under root/<run_id>/predictions.jsonl (plain or gzip), with run_id from the folder; smoke runs left out.

    One record per run and case: the last line of a case wins.
    """
    rows = read_jsonl(spark, [f"{root}/*/predictions.jsonl*"], schema)
    run = F.regexp_extract("file_path", r"/([^/]+)/predictions\.jsonl", 1)
    runs = rows.withColumn("run_id", run).where(~F.col("run_id").startswith("smoke")).drop("file_path")
    whole = runs.where("case_id IS NOT NULL")
    return last_wins(whole, ["run_id", "case_id"], "line_order").drop("line_order").unionByName(runs.where("case_id IS NULL").drop("line_order"))


def answered(df: DataFrame) -> DataFrame:
    """Answered yes/no and choice records of runs that hold one record per case."""
    return df.where((F.col("task_type") != "score") & ~failed("error") & F.col("pred").isNotNull())


def failed(error: str) -> Column:
    """A record failed if its error is neither null nor empty."""
    return F.coalesce(F.col(error) != "", F.lit(False))


def last_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key: the one with the highest `order`. Pre-aggregated on the map side."""
    rest = [c for c in df.columns if c not in key]
    top = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return top.select(*key, "_r.*")


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def splits(frames: dict[str, DataFrame], idx: str, name: str = "source_row") -> DataFrame:
    """Union of splits whose rows are numbered from zero each: the id carries the split's name."""
    return union_all(*[df.withColumn(name, F.concat(F.lit(split), F.col(idx).cast("string"))) for split, df in frames.items()])
