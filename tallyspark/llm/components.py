"""Connected components of a graph that is held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import forget, sized, stored


#: Parts into which the neighbours of a node are dealt.
SALTS = 8


def _joined(edges: DataFrame, low: DataFrame) -> DataFrame:
    """`edges` with `m` of their node `u`; a node of many edges is dealt over several tasks."""
    salted = edges.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS)))
    return salted.join(low.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), ["u", "salt"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(`node`, `component`): the smallest node reachable, for each node with an edge to another.

    `edges` has two long columns.  Each round hangs every node, with all its neighbours, onto the
    smallest of them (a star), first towards larger neighbours, then towards smaller ones; the
    number of rounds grows with the logarithm of the longest path.  A round groups by node with
    partial minima, and joins those minima back, where adaptive execution can split a node of very
    many edges; its shuffles have as many partitions as the edges need.  Each round is written to the shared folder.  Loops, repeated edges and
    nulls in `edges` are dropped; without edges the result is empty.
    """
    a, b = (F.col(c) for c in edges.toDF("__a", "__b").columns)
    now = stored(
        edges.toDF("__a", "__b").where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    seen = _mark(now)
    with sized(edges.sparkSession, 2 * SALTS * seen[0]):
        return _smallest(now, seen)


def _mark(edges: DataFrame) -> Row:
    """The number of the edges and two sums of their hashes: equal sets of edges have equal ones."""
    return edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _smallest(now: DataFrame, seen: Row) -> DataFrame:
    while True:
        both = now.union(now.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = _joined(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _joined(large, low).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = stored(small.select("e.u", "e.v").where("u != v").distinct())
        mark = _mark(after)
        if mark == seen:
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(after.select(F.col("v"), F.col("v")).distinct())
        forget(now)
        now, seen = after, mark
