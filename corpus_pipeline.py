"""The corpus pipeline: five stages, each a function (spark, docs, sf_dir) whose rows are written and read again as the next one's docs.

quality -> near duplicates -> repeated passages -> benchmark decontamination -> byte-level BPE. All stages but the last return
the columns of the documents; where a stage changes a text it sets n_chars anew. Rows without id are judged by their text alone:
they pass the stages that compare documents. Null texts count as empty; an empty table gives an empty table; other columns are
carried, whatever their names. No stage is expressible in SQL as a whole (a trained network comes first), so
there is no ORACLE_SQL; tests/llm checks invariants of the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontam, neardup, quality, repeats
from plumbline.llm.common import even, materialise, table

ORACLE_SQL = None
REJECT = 0.3
SCORE = "_quality_score"


def _restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from doc_id, text and `carried`, with n_chars of the new text."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return df.select([own[c].alias(c) if own.get(c) is not None else F.col("carried").getField(c).alias(c) for c in docs.columns])


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches REJECT; rows that share an id are judged one by one, empty texts like any other."""
    weights = quality.model(docs, table(spark, sf_dir, "labels"))
    name = SCORE
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    return quality.scored(even(docs, "doc_id"), weights, name).where(F.col(name) >= REJECT).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), the one with the smallest id.

    Rows equal in id and text are one document; rows that share only the id stay or go together.
    """
    found = neardup.near_duplicates(docs, width=5, percent=80)
    gone = found.where("NOT kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    twice = materialise(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if not twice.limit(1).count():
        return kept
    once = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).union(once.select(docs.columns))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 100-byte strings that also start earlier; what the removal empties goes.

    A character of which only some bytes were removed is removed.
    """
    left = repeats.remove_repeats(docs, texts=True)
    left = left.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    return _restored(left.where((F.col("n_removed") == 0) | (F.trim("text") != "")), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of words inside benchmark windows; documents that are mostly such runs, or emptied by it, go.

    Null and empty texts have no words and stay as they are.
    """
    clean = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _restored(clean.where(~F.col("dropped") & ((F.col("n_hit") == 0) | (F.trim("text") != ""))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source (null where docs has none), n_tokens, ids, and the text decoded from the ids (null: empty)."""
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.round_trip(docs, path)
    own = [(F.col(f"carried.{c}") if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in ("lang", "source")]
    return both.select("doc_id", *own, F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                       F.decode("bytes", "UTF-8").alias("text"))


STAGES = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
