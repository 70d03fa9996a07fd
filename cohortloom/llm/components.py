"""Connected components of a graph of links, in alternating star steps; no part of the graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (large) or smaller neighbours to the least node around it."""
    if large:
        around = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    linked = around.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link: root is the least node that can be reached.

    edges: (a, b), two columns of one integer type. Self-links and repeats are allowed; rows with a null are no link.
    An empty table gives an empty one.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, mark = None, _mark(now)
    while mark != before and mark[0]:
        last, now = now, materialize(_star(_star(now, large=True), large=False))
        before, mark = mark, _mark(now)
        discard(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
