"""Connected components by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batch import materialised


def _large(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(least, both["a"] == least["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    return (
        down.join(least, down["a"] == least["u"]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        .filter("a <> b").distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """node, root of every node of links (a, b): root is the smallest node that is reachable. Each round is stored; rounds grow with the logarithm of the nodes."""
    state = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    e = materialised(links.filter("a <> b").select("a", "b").distinct())
    was = None
    while True:
        e = materialised(_small(_large(e)))
        now = state(e)
        if now == was or now[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        was = now
