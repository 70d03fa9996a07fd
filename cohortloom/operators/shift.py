"""Distances between sources' feature distributions, and stability of rankings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.vectors import squared_distance


def centroid_distances(features: DataFrame) -> DataFrame:
    """(a, b, distance) between the mean vectors of each pair of sources; features is (source, id, gene, value)."""
    m = features.groupBy("source", "gene").agg(F.avg("value").alias("m"))
    pairs = m.select(F.col("source").alias("a"), "gene", F.col("m").alias("x")).join(m.select(F.col("source").alias("b"), "gene", F.col("m").alias("y")), "gene").where("a < b")
    return pairs.groupBy("a", "b").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("distance"))


def covariances(features: DataFrame) -> DataFrame:
    """(source, g, h, cov): sample covariances of each pair of genes g <= h; 0 for a single row. features is wide: (source, x array<double>).

    Each task sums the products of the centred rows it reads, and gives one row for each source, gene and task, whatever the
    rows. Means are a vector a source, of which there are few.
    """
    pos = features.select("source", F.posexplode("x").alias("k", "v")).groupBy("source", "k").agg(F.avg("v").alias("m"))
    means = pos.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("mean"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for source, part in batch.groupby("source"):
                x = np.array(part["x"].tolist(), float) - np.array(part["mean"].iloc[0], float)
                n, gram = sums.get(source, (0, 0.0))
                sums[source] = (n + len(x), gram + x.T @ x)
        for source, (n, gram) in sums.items():
            yield pd.DataFrame({"source": source, "g": range(len(gram)), "n": n, "row": [gram[g, g:].tolist() for g in range(len(gram))]})

    parts = features.join(F.broadcast(means), "source").select("source", "x", "mean").mapInPandas(run, "source string, g int, n long, row array<double>")
    each = parts.select("source", "g", "n", F.posexplode("row").alias("o", "s")).groupBy("source", "g", (F.col("g") + F.col("o")).alias("h")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return each.select("source", "g", "h", F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1)).otherwise(0.0).alias("cov"))


def coral_distances(features: DataFrame, dims: int) -> DataFrame:
    """(a, b, distance): squared Frobenius norm of the covariances' difference over 4 d^2."""
    c = covariances(features)
    pairs = c.select(F.col("source").alias("a"), "g", "h", F.col("cov").alias("x")).join(c.select(F.col("source").alias("b"), "g", "h", F.col("cov").alias("y")), ["g", "h"]).where("a < b")
    gap = (F.col("x") - F.col("y")) * (F.col("x") - F.col("y")) * F.when(F.col("g") == F.col("h"), 1).otherwise(2)
    return pairs.groupBy("a", "b").agg((F.sum(gap) / (4.0 * dims * dims)).alias("distance"))


def _within(points: DataFrame, x: str, y: str) -> DataFrame:
    """All pairs of points of sources x and y, as (d2). Sizes are for summaries of subjects, not of cells; the work is their product."""
    a, b = points.where(F.col("source") == x).select(F.col("x").alias("u")), points.where(F.col("source") == y).select(F.col("x").alias("v"))
    return a.crossJoin(b).select(squared_distance(F.col("u"), F.col("v")).alias("d2"))


def energy_distance(points: DataFrame, x: str, y: str) -> DataFrame:
    """One row: 2 E|X-Y| - E|X-X'| - E|Y-Y'| over all pairs, a point with itself included."""
    mean = lambda p, q, name: _within(points, p, q).agg(F.avg(F.sqrt(F.col("d2") + 1e-12)).alias(name))
    return mean(x, y, "xy").crossJoin(mean(x, x, "xx")).crossJoin(mean(y, y, "yy")).select((2 * F.col("xy") - F.col("xx") - F.col("yy")).alias("energy"))


def mmd(points: DataFrame, x: str, y: str) -> DataFrame:
    """One row (bandwidth, mmd): biased V-statistic with an RBF kernel; the bandwidth is the root of the lower median of distinct pairs' squared distances."""
    both = points.where(F.col("source").isin(x, y))
    a, b = both.select(F.col("id").alias("i"), F.col("x").alias("u")), both.select(F.col("id").alias("j"), F.col("x").alias("v"))
    upper = a.join(b, F.col("i") < F.col("j")).select(squared_distance(F.col("u"), F.col("v")).alias("d2"))
    width = upper.agg(F.sqrt(F.expr("percentile_disc(0.5) within group (order by d2)")).alias("w")).select(F.when(F.col("w") > 0, F.col("w")).otherwise(1.0).alias("bandwidth"))
    k = F.exp(-F.col("d2") / (2 * F.col("bandwidth") * F.col("bandwidth")))
    mean = lambda p, q, name: _within(points, p, q).crossJoin(F.broadcast(width)).groupBy("bandwidth").agg(F.avg(k).alias(name))
    return mean(x, x, "xx").join(mean(y, y, "yy"), "bandwidth").join(mean(x, y, "xy"), "bandwidth").select("bandwidth", (F.col("xx") + F.col("yy") - 2 * F.col("xy")).alias("mmd"))


def spearman_ordinal(pairs: DataFrame) -> DataFrame:
    """One row: rank correlation of (key, a, b) with ordinal ranks, ties in key order. For rankings of modules or genes."""
    ranks = pairs.select(F.row_number().over(Window.orderBy("a", "key")).alias("ra"), F.row_number().over(Window.orderBy("b", "key")).alias("rb"))
    n = F.count("*")
    return ranks.agg((1 - 6 * F.sum((F.col("ra") - F.col("rb")) * (F.col("ra") - F.col("rb"))) / (n * (n * n - 1))).alias("rho"))


def top_k_overlap(rankings: DataFrame, k: int) -> DataFrame:
    """(a, b, overlap) of each pair of runs in (run, key, score): shared keys among the k best, over k or what there is."""
    best = rankings.withColumn("r", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("score"), "key"))).where(F.col("r") <= k)
    sets = best.groupBy("run").agg(F.collect_set("key").alias("keys"))
    a, b = sets.select(F.col("run").alias("a"), F.col("keys").alias("x")), sets.select(F.col("run").alias("b"), F.col("keys").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (F.size(F.array_intersect("x", "y")) / F.least(F.lit(k), F.size("x"), F.size("y"))).alias("overlap"))


def selection_frequency(rankings: DataFrame, k: int) -> DataFrame:
    """(key, frequency): in what share of runs a key is among the k best."""
    best = rankings.withColumn("r", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("score"), "key"))).where(F.col("r") <= k)
    n = rankings.agg(F.count_distinct("run").alias("n"))
    return best.groupBy("key").agg(F.count("*").alias("c")).join(F.broadcast(n)).select("key", (F.col("c") / F.col("n")).alias("frequency"))
