"""Decision rows, evaluation cases and prediction runs derived from the driver's tables.

The probabilities are synthetic, not a model's: option k of a case weighs (1 + s * [k is gold] + u)^4, u a hash fraction of
run, case and option, s the strength of the run. The same arithmetic is written in SQL in plans/oracle.py.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_fraction, hash_order
from ..functions.options import OPTION, keys_of, option_array, renumbered
from ..functions.probability import argmax, expected_level, let, normalise
from ..functions.text import NO_TEXT, YES_TEXT
from ..operators.scale import TASK_ROWS, new_path, spread_rows
from .tables import table, union_all

RUNS = {"base": 0.25, "tuned": 0.45, "wide": 0.3}
TEACHER = "teacher"
TEACHER_STRENGTH = 0.4
DEV_SHARE = 0.4
DOCUMENT_ROWS, CASE_ROWS = 20_000, TASK_ROWS // 2  # of one task: texts in a join, cases that are drawn for every run

LANGS = ["de", "en", "es", "fr"]
LANG_TEXT = ["German", "English", "Spanish", "French"]
TOPICS = [f"topic_{i}" for i in range(10)]
LEVELS = ["urgent", "high", "medium", "unspecified", "low"]
YES_NO = ["false", "true"]


def _options():
    """The four option lists: yes/no, language, topic, priority level."""
    return (option_array(YES_NO, [NO_TEXT, YES_TEXT]), option_array(LANGS, LANG_TEXT),
            option_array(TOPICS, ["Class " + t[-1] for t in TOPICS]), option_array([str(i) for i in range(5)], LEVELS))


def _prov(source, license_, generator=None, task=None, hub=None, row=None):
    s = lambda x: x if not (x is None or isinstance(x, str)) else F.lit(x).cast("string")
    return F.struct(s(source).alias("source"), s(hub).alias("hub_id"), s(license_).alias("license"), F.lit("driver table").alias("origin"),
                    s(generator).alias("generator"), s(task).alias("task"), s(row).alias("source_row"))


def _flag(cond):
    return F.when(cond, F.lit("true")).otherwise(F.lit("false"))


def _json(**fields):
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


_WRITTEN: dict[tuple[str, str, str, int], str] = {}


def _files(spark: SparkSession, d: str) -> int:
    """A number for the names, sizes and times of the files the derived tables are made of."""
    jvm = spark.sparkContext._jvm
    seen = []
    for name in ("documents", "labels", "orders", "embeddings"):
        path = jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(seen)))


def written(spark: SparkSession, d: str, name: str, build) -> DataFrame:
    """A derived input table, written to the shared folder the first time a session asks for it.

    Runs and label files are inputs of the operators, so they are derived once and read afterwards, like any landed table.
    Tables that were rewritten under the same path (other files, sizes or times) are derived anew.
    """
    key = (spark.sparkContext.applicationId, d, name, _files(spark, d))
    if key in _WRITTEN:
        try:
            return spark.read.parquet(_WRITTEN[key])
        except AnalysisException:  # the shared folder was cleaned meanwhile: derive it again
            pass
    path = new_path(spark, name)
    build().write.parquet(path)
    _WRITTEN[key] = path
    return spark.read.parquet(path)


def judged_documents(spark: SparkSession, d: str) -> DataFrame:
    """labels joined to documents; one row per doc_id on both sides. The narrow side is hashed, so that no texts are sorted."""
    return spread_rows(table(spark, d, "documents"), "doc_id", rows=DOCUMENT_ROWS).join(table(spark, d, "labels").hint("shuffle_hash"), "doc_id")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spread_rows(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Typed training rows of five kinds: two yes/no, two choice, one ordinal."""
    noul, lang, topic, score = _options()
    docs, judged = table(spark, d, "documents"), judged_documents(spark, d)
    orders, emb = _orders(spark, d), table(spark, d, "embeddings")

    def rows(df, row_id, family, task_type, state, ask, options, gold, prov):
        return df.select(row_id.alias("row_id"), family.alias("family"), F.lit(task_type).alias("task_type"), state.alias("state"),
                         F.lit(ask).alias("instructions"), options.alias("options"), gold.alias("gold"),
                         F.size(options).alias("n_options"), F.lit(False).alias("holdout_family"), prov.alias("provenance"))

    doc = F.col("doc_id").cast("string")
    return union_all(
        rows(docs, F.concat(F.lit("lang-"), doc), F.concat(F.lit("sni_lang_"), F.col("source")), "choice", _json(text=F.col("text")),
             "In which language is the text in the state written?", lang, F.col("lang"),
             _prov(F.lit("driver documents"), "CC BY 4.0", task=F.concat(F.lit("lang_"), F.col("source")), row=doc)),
        rows(judged, F.concat(F.lit("toxic-"), doc), F.concat(F.lit("syn_"), F.col("source")), "noul", _json(text=F.col("text")),
             "Is the text in the state toxic?", noul, _flag(F.col("toxic") == 1),
             _prov(F.lit("synthetic"), "Apache 2.0", generator="driver", row=doc)),
        rows(judged, F.concat(F.lit("quality-"), doc), F.lit("civil_toxicity"), "noul", _json(text=F.col("text")),
             "Is the text in the state of good quality?", noul, _flag(F.col("quality") == 1),
             _prov(F.lit("driver labels"), "CC0: Public Domain", row=doc)),
        rows(emb, F.concat(F.lit("topic-"), F.col("vec_id").cast("string")), F.lit("dbpedia_topic"), "choice",
             _json(vector=F.col("vec_id")), "Which class does the record belong to?", topic, F.concat(F.lit("topic_"), F.col("label").cast("string")),
             _prov(F.lit("driver embeddings"), "cc-by-sa-3.0", row=F.col("vec_id").cast("string"))),
        rows(orders, F.concat(F.lit("priority-"), F.col("o_orderkey").cast("string")), F.concat(F.lit("train_priority_"), F.col("o_orderstatus")),
             "score", _json(status=F.col("o_orderstatus"), total=F.col("o_totalprice")), "Rate the priority of the order in the state.", score,
             (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("string"),
             _prov(F.lit("rule generator"), "MIT", generator="driver orders", row=F.col("o_orderkey").cast("string"))),
    )


def drawn_probs(run, strength, case_id, keys, gold):
    """The synthetic distribution of one case under one run."""
    def weight(k):
        v = F.lit(1.0) + F.when(k == gold, strength).otherwise(F.lit(0.0)) + hash_fraction(F.concat_ws(":", run, case_id, k))
        return let(v, lambda x: x * x * x * x)
    return normalise(F.transform(keys, weight))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """The label file of all decision rows."""
    return written(spark, d, "labels", lambda: teacher_labels(decisions(spark, d)))


def teacher_labels(rows: DataFrame, teacher: str = TEACHER, strength: float = TEACHER_STRENGTH) -> DataFrame:
    """Label rows (row_id, probs, ...) for decision rows; about one row in a hundred carries an error."""
    keys = keys_of("options")
    p = drawn_probs(F.lit(teacher), F.lit(strength), F.col("row_id"), keys, F.col("gold"))
    failed = hash_fraction(F.concat_ws(":", F.lit(teacher), F.col("row_id"), F.lit("err"))) < 0.01
    return rows.select(
        "row_id", "family", F.lit(teacher).alias("teacher"), F.lit("table").alias("backend"),
        F.when(~failed, F.map_from_arrays(keys, p)).alias("probs"), F.lit(1.0).alias("label_mass"), F.lit(1).alias("llm_calls"),
        F.length("state").cast("bigint").alias("input_tokens"),
        (F.lit(20.0) + hash_fraction(F.concat_ws(":", F.col("row_id"), F.lit("ms"))) * 200.0).alias("latency_ms"),
        F.when(failed, F.lit("timeout")).alias("error"), F.lit(0).cast("bigint").alias("load_order"))


def cases(spark: SparkSession, d: str) -> DataFrame:
    """The case file."""
    return written(spark, d, "cases", lambda: derived_cases(spark, d))


def spread_cases(spark: SparkSession, d: str) -> DataFrame:
    """The cases over tasks of CASE_ROWS rows, for passes that compute much from each: a split of the file holds millions."""
    return spread_rows(cases(spark, d), "case_id", "family_id", "slice", "gold", rows=CASE_ROWS)


def derived_cases(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation cases over the same tables; a choice case also has a twin with its options in another order."""
    noul, lang, topic, score = _options()
    docs, judged = table(spark, d, "documents"), judged_documents(spark, d)
    orders, emb = _orders(spark, d), table(spark, d, "embeddings")

    def rows(df, family_id, slice_, task_type, options, gold):
        return df.select(family_id.alias("family_id"), slice_.alias("slice"), F.lit(task_type).alias("task_type"),
                         options.alias("options"), gold.alias("gold"))

    doc = F.col("doc_id").cast("string")
    base = union_all(
        rows(docs, F.concat(F.lit("lang-"), doc), F.lit("lang"), "choice", lang, F.col("lang")),
        rows(judged, F.concat(F.lit("toxic-"), doc), F.concat(F.lit("toxic_"), F.col("lang")), "noul", noul, _flag(F.col("toxic") == 1)),
        rows(judged, F.concat(F.lit("quality-"), doc), F.concat(F.lit("quality_"), F.col("lang")), "noul", noul, _flag(F.col("quality") == 1)),
        rows(emb, F.concat(F.lit("topic-"), F.col("vec_id").cast("string")), F.concat(F.lit("topic_"), (F.col("label") % 4).cast("string")),
             "choice", topic, F.concat(F.lit("topic_"), F.col("label").cast("string"))),
        rows(orders, F.concat(F.lit("priority-"), F.col("o_orderkey").cast("string")), F.concat(F.lit("priority_"), F.col("o_orderstatus")),
             "score", score, (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("string")),
    )
    kinds = F.when(F.col("task_type") == "choice", F.array(F.lit("none"), F.lit("permuted"))).otherwise(F.array(F.lit("none")))
    both = base.withColumn("perturbation", F.explode(kinds)).withColumn("case_id", F.concat_ws("-", "family_id", "perturbation"))
    tagged = F.transform("options", lambda o: F.struct(hash_order("permute", "family_id", o["key"]).alias("h"), o.alias("o")))
    mixed = renumbered(F.transform(F.array_sort(tagged), lambda t: t["o"])).cast(OPTION)
    return both.select(
        "case_id", "family_id", "slice", F.lit("derived").alias("source"), "task_type", "perturbation",
        F.when(F.col("perturbation") == "permuted", mixed).otherwise(F.col("options")).alias("options"), F.size("options").alias("n_options"), "gold",
        F.lit(False).alias("truncated"),
        F.when(hash_fraction(F.concat(F.lit("suite:"), F.col("family_id"))) < DEV_SHARE, F.lit("dev")).otherwise(F.lit("test")).alias("suite"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """One prediction record per run and case."""
    return written(spark, d, "predictions", lambda: drawn_predictions(spread_cases(spark, d), RUNS))


def drawn_predictions(of: DataFrame, runs: dict[str, float]) -> DataFrame:
    table_of_runs = F.explode(F.array(*[F.struct(F.lit(r).alias("run_id"), F.lit(s).alias("strength")) for r, s in runs.items()]))
    base = of.withColumn("_run", table_of_runs)
    c = F.col
    keys = keys_of("options")
    failed = hash_fraction(F.concat_ws(":", c("_run.run_id"), c("case_id"), F.lit("err"))) < 0.01
    p = drawn_probs(c("_run.run_id"), c("_run.strength"), c("case_id"), keys, c("gold"))
    rows = base.select(
        c("_run.run_id").alias("run_id"), "suite", "case_id", "family_id", "slice", "source", "task_type", "perturbation", "n_options", "gold",
        "truncated", keys.alias("option_keys"), F.when(~failed, p).alias("probs"), F.when(failed, F.lit("timeout")).alias("error"),
        (F.lit(20.0) + hash_fraction(F.concat_ws(":", c("_run.run_id"), c("case_id"), F.lit("ms"))) * 200.0).alias("latency_ms"),
        (F.lit(50) + F.length("case_id")).cast("bigint").alias("input_tokens"))
    return with_answers(rows)


def with_answers(rows: DataFrame) -> DataFrame:
    """pred, p_true, confidence and expected level out of a distribution. A tie goes to the option presented first, for
    yes/no to true."""
    noul = F.col("task_type") == "noul"
    true_at = (F.array_position("option_keys", F.lit("true")) - 1).cast("int")
    p_true = F.when(noul, F.get("probs", true_at))
    pred = F.when(noul, F.when(p_true >= 0.5, F.lit("true")).when(p_true < 0.5, F.lit("false"))).otherwise(F.get("option_keys", argmax("probs")))
    return (rows.withColumn("p_true", p_true)
            .withColumn("pred", F.when(F.col("probs").isNotNull(), pred))
            .withColumn("confidence", F.when(noul, F.greatest(F.col("p_true"), F.lit(1.0) - F.col("p_true"))).otherwise(F.array_max("probs")))
            .withColumn("expected_level", F.when(F.col("task_type") == "score", expected_level("option_keys", "probs"))))
