"""Connected components of an edge table, by alternating star contractions on Spark.

Each round hooks every node's larger neighbours, then its smaller ones, to the least node in reach, and
writes the edges to the shared folder. A node's edges are sorted in one task, with the least first, and pass
through it as a stream that can spill; they are pairs of keys, never texts. Nothing is collected but two
numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretrace.llm.common import discard, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge: root is the least node of its component. No edges, no rows."""
    now = stored(_oriented(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if not mark["n"] or mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        last, before = now, mark
        now = stored(_small_star(_large_star(last)), "edges")
        discard(last)


def _oriented(edges: DataFrame) -> DataFrame:
    """a > b, each edge once."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _least():
    """The least of a node's neighbours, which is the first in order."""
    return F.min("b").over(Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hooked = both.withColumn("m", F.least(_least(), F.col("a")))
    return hooked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    hooked = edges.withColumn("m", _least())
    moved = hooked.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(hooked.filter("b = m").select("a", "b")).distinct()
