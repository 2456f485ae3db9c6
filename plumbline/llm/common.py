"""Reading the tables, the operators' narrow views of them, and the registry of this subpackage's queries."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..operators.scale import materialise, shared_folder
from ..sources.tables import table

CACHES: list[tuple[str, dict]] = []  # (module, what it keeps in a worker process)
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20  # texts are long: a batch is bounded by bytes
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}  # freed arrays go back
ROOT = str(Path(__file__).resolve().parents[2])
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

__all__ = ["QUERIES", "ORACLE", "query", "table", "materialise", "shared_folder", "narrow", "in_arrow", "fields", "carried", "task_count", "even"]


def query(sql: str | None = None, name: str | None = None):
    def wrap(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLE[name or fn.__name__] = sql
        return fn
    return wrap


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names, so that no other column of the input can clash with them."""
    return df.select([df[c].alias(new) for new, c in columns.items()])


def _bytes(setting: str) -> int:
    return int(setting.rstrip("bB"))


def _forget(owner: str) -> None:
    """A worker process serves many operators: what others keep between tasks is dropped before this one's memory grows."""
    held = [(name, cache) for name, cache in CACHES if name != owner and cache]
    for _, cache in held:
        cache.clear()
    if held:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where there is another C library
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def _apply(batches: Iterable[pa.RecordBatch], fn, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    _forget(getattr(fn, "__module__", ""))
    for out in fn(batches):
        yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def in_arrow(df: DataFrame, fn, schema: str | StructType) -> DataFrame:
    """mapInArrow with a function from batches to lists of columns in the order of `schema`."""
    spark, env = df.sparkSession, df.sparkSession.sparkContext.environment
    for k, v in WORKER_MEMORY.items():
        env.setdefault(k, v)
    if _bytes(spark.conf.get(BATCH)) > BATCH_BYTES:
        spark.conf.set(BATCH, BATCH_BYTES)
    if ROOT not in env.get("PYTHONPATH", ""):  # Python workers of a local session find this package wherever it was started
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    from pyspark.sql.pandas.types import to_arrow_schema
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return df.mapInArrow(partial(_apply, fn=fn, schema=to_arrow_schema(kind)), kind)


def fields(ddl: str, *more: StructField) -> StructType:
    return StructType([*StructType.fromDDL(ddl).fields, *more])


def carried(df: DataFrame, *apart: str) -> Column:
    """All columns but those apart as one struct `carried`, which an operator passes through untouched."""
    rest = [df[c] for c in df.columns if c not in apart]
    return (F.struct(*rest) if rest else F.struct(F.lit(None).cast("string").alias("none"))).alias("carried")


def task_count(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def even(df: DataFrame, *ids: str) -> DataFrame:
    """A table that arrives in fewer splits than there are cores is dealt over them by its ids; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *[F.col(c) for c in ids]) if df.rdd.getNumPartitions() < cores else df
