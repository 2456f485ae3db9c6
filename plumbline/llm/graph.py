"""Connected components of a link table by alternating large and small stars, every round a pair of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import attach
from .common import materialise


def _large(links: DataFrame) -> DataFrame:
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return attach(both.where("v > u"), least, ["u"], spread=["v"]).select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small(links: DataFrame) -> DataFrame:
    least = materialise(links.groupBy("hi").agg(F.min("lo").alias("m")), "least")
    moved = attach(links, least, ["hi"], spread=["lo"], ready=True).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every linked node but the smallest of each component, which is the component's name.

    The rounds grow with the logarithm of the longest chain; only link rows move, and the driver sees a few counts a round. The
    links of a hub meet its smallest neighbour by a broadcast of checked size or over salted tasks, never all in one.
    """
    now = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct()
    now = materialise(now, "links")
    while True:
        tops = now.groupBy("hi").agg(F.count(F.lit(1)).alias("n"))
        loose = tops.where("n > 1").limit(1).count()
        if not loose and not now.select(F.col("lo").alias("hi")).distinct().join(tops, "hi", "left_semi").limit(1).count():
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        now = materialise(_small(_large(now)), "links")
