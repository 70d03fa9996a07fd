"""Bootstrap and permutation as sums a task; subjects are resampled, never cells.

A resample is a weight for each row: Poisson(1), drawn by a hash of the row's key and the resample's number. That is what drawing n of n
rows with replacement tends to, without the draws having to meet the rows; the total of a resample varies by about sqrt(n), and
statistics divide by it. So a task adds up all resamples of its own rows in arrays of n_boot numbers, and rows are never
repeated, numbered or shuffled once a resample. Results do not depend on partitions, beyond the order of floating sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.invariance import array_sum

#: 2^32 times the distribution function of Poisson(1), as far as it is under 1.
POISSON = [int(2**32 * sum(exp(-1) / factorial(i) for i in range(k + 1))) for k in range(12)]
#: Rows whose weights are in memory at once, groups whose sums are, rows of a block of a permutation, the share of rows from which on a value counts as frequent.
CHUNK, GROUPS, BLOCK, FREQUENT = 512, 256, 4096, 1 / 1024


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers in which every bit depends on all."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def hashes(high: np.ndarray, low: np.ndarray, repeats: int, seed: int) -> np.ndarray:
    """(rows, repeats) of 32-bit hashes of keyed rows; high and low are 32 bits each of a key's md5."""
    of = _mixed((np.arange(repeats, dtype=np.uint64) * np.uint64(1000003) + np.uint64(seed)).astype(np.uint32))
    return _mixed(_mixed(high.astype(np.uint32)[:, None] ^ of) ^ low.astype(np.uint32)[:, None])


def weights(high: np.ndarray, low: np.ndarray, n_boot: int, seed: int) -> np.ndarray:
    """(rows, n_boot): how often each resample has each row."""
    return np.searchsorted(np.array(POISSON, np.uint32), hashes(high, low, n_boot, seed), side="right").astype(float)


def keyed(rows: DataFrame, key: str, *columns: Column) -> DataFrame:
    """(columns, high, low): the first two 32 bits of the key's md5."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    return rows.select(*columns, *(F.conv(F.substring(digest, at, 8), 16, 10).cast("long").alias(c) for at, c in ((1, "high"), (9, "low"))))


def resampled_sums(rows: DataFrame, key: str, value: Column, by: Column, n_boot: int, seed: int) -> DataFrame:
    """(g, w array, s array): of every group, the total weight and the weighted sum of the value in each resample; null values take no part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def out() -> pd.DataFrame:
            made = pd.DataFrame({"g": list(sums), "v": [v.ravel() for v in sums.values()]})
            sums.clear()
            return made

        for batch in batches:
            for g, part in batch.groupby("g"):
                if g not in sums and len(sums) == GROUPS:
                    yield out()
                own = sums.setdefault(g, np.zeros((2, n_boot)))
                for at in range(0, len(part), CHUNK):
                    chunk = part.iloc[at : at + CHUNK]
                    w = weights(chunk["high"].to_numpy(), chunk["low"].to_numpy(), n_boot, seed)
                    own[0] += w.sum(axis=0)
                    own[1] += chunk["v"].to_numpy() @ w
        if sums:
            yield out()

    parts = keyed(rows.withColumns({"_g": by.cast("string"), "_v": value.cast("double")}).where("_g is not null and _v is not null"), key, F.col("_g").alias("g"), F.col("_v").alias("v"))
    summed = parts.mapInPandas(run, "g string, v array<double>").groupBy("g").agg(array_sum("v").alias("v"))
    return summed.select("g", F.slice("v", 1, n_boot).alias("w"), F.slice("v", n_boot + 1, n_boot).alias("s"))


def interval(values: DataFrame, alpha: float = 0.05, value: str = "value", by: list[str] = ()) -> DataFrame:
    """(by, mean, lo, hi, n_defined) over the resamples' values, of which a group has n_boot; undefined ones are left out."""
    return values.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, alpha / 2).alias("lo"), F.percentile(value, 1 - alpha / 2).alias("hi"), F.count(value).alias("n_defined"))


def _means(sums: DataFrame) -> DataFrame:
    """(g, value): a row a resample; null where it is empty."""
    each = sums.select("g", F.explode(F.arrays_zip("w", "s")).alias("x"))
    return each.select("g", F.when(F.col("x.w") > 0, F.col("x.s") / F.col("x.w")).alias("value"))


def bootstrap_mean(rows: DataFrame, key: str, value: str, n_boot: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """One row: percentile interval of the resampled mean; null under two rows."""
    means = _means(resampled_sums(rows, key, F.col(value), F.lit("all"), n_boot, seed))
    enough = rows.agg((F.count(value) >= 2).alias("enough"))
    return interval(means, alpha).join(F.broadcast(enough)).select(*(F.when(F.col("enough"), F.col(c)).alias(c) for c in ("mean", "lo", "hi")), "n_defined")  # one row each


def grouped_bootstrap(rows: DataFrame, key: str, value: Column, by: str, n_boot: int, seed: int, least: int = 10, alpha: float = 0.05) -> DataFrame:
    """(by, n, estimate, lo, hi, status): resampled within groups of at least `least` rows; smaller ones are not_evaluable, null groups are left out."""
    keyed_rows = rows.select(F.col(by).alias("_by"), F.col(key).alias("_key"), value.cast("double").alias("_value")).where("_by is not null")
    sizes = keyed_rows.groupBy("_by").agg(F.count("*").alias("n"), F.avg("_value").alias("estimate"))
    ci = interval(_means(resampled_sums(keyed_rows, "_key", F.col("_value"), F.col("_by"), n_boot, seed)), alpha, by=["g"]).select("g", "lo", "hi")
    ok, both = F.col("n") >= least, sizes.join(ci, sizes["_by"].cast("string") == ci["g"], "left")
    return both.select(F.col("_by").alias(by), "n", *(F.when(ok, F.col(c)).alias(c) for c in ("estimate", "lo", "hi")), F.when(ok, "ok").otherwise("not_evaluable").alias("status"))


def bootstrap_auroc(rows: DataFrame, key: str, n_boot: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """One row: percentile interval of the AUROC over resampled subjects, exactly, ties half; resamples of one class are undefined. Null probabilities take no part.

    Rows are shuffled once, to ranges of probability that hold about as many rows each, where a task goes up its range in order with running sums of all
    resamples; what lies below a range comes from the sums of the ranges. A value that a large share of rows has is a range of its own, in which all pairs are
    ties, so it needs no order and its rows are summed where they are. The sums of the ranges, of which a task has one and one more a frequent value, meet in
    one task, in order.
    """
    base = keyed(rows.where("y_prob is not null"), key, (F.col("y_true") == 1).alias("y"), F.col("y_prob").cast("double").alias("p"))
    n = base.count()
    often = sorted(r["p"] for r in base.groupBy("p").count().where(F.col("count") > max(64, int(n * FREQUENT))).select("p").collect())  # 1 / FREQUENT at most
    place = F.lit(0)
    if often:
        values = F.array(*map(F.lit, often))
        place = F.aggregate(values, F.lit(0), lambda k, v: k + F.when(v < F.col("p"), 2).when(v == F.col("p"), 1).otherwise(0))  # odd: at a frequent value
    ranged = base.withColumn("k", place)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums (positives, negatives, pairs in order) of a task's rows of each k, in order of p where their order counts, and the least p."""
        at, low, value, own, tied = None, None, None, np.zeros((3, n_boot)), np.zeros((2, n_boot))

        def close_value() -> None:
            own[2] += tied[0] * (own[1] + tied[1] / 2)
            own[:2] += tied
            tied[:] = 0

        for batch in batches:
            for lo in range(0, len(batch), CHUNK):
                chunk = batch.iloc[lo : lo + CHUNK]
                w = weights(chunk["high"].to_numpy(), chunk["low"].to_numpy(), n_boot, seed)
                for k, p, y, v in zip(chunk["k"], chunk["p"], chunk["y"], w, strict=True):
                    if k != at or p != value:
                        close_value()
                        if k != at:
                            if at is not None:
                                yield pd.DataFrame({"k": [at], "p": [low], "v": [own.ravel()]})
                                own[:] = 0
                            at, low = k, p
                        value = p
                    tied[0 if y else 1] += v
        if at is not None:
            close_value()
            yield pd.DataFrame({"k": [at], "p": [low], "v": [own.ravel()]})

    columns, schema = ("k", "p", "y", "high", "low"), "k int, p double, v array<double>"
    apart = ranged.where("k % 2 = 0").select(*columns).repartitionByRange("k", "p").sortWithinPartitions("k", "p").mapInPandas(run, schema)
    # a task may come upon several frequent values by turns; each turn gives sums of its own
    together = ranged.where("k % 2 = 1").select(*columns).mapInPandas(run, schema).groupBy("k", "p").agg(array_sum("v").alias("v"))

    def up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, n_boot))
        for batch in batches:
            for k, v in zip(batch["k"], batch["v"], strict=True):
                pos, neg, pairs = np.array(v).reshape(3, n_boot)
                total[2] += (pos * neg / 2 if k % 2 else pairs) + pos * total[1]
                total[:2] += pos, neg
        pairs = total[0] * total[1]
        yield pd.DataFrame({"value": np.where(pairs > 0, total[2] / np.maximum(1.0, pairs), np.nan)})

    values = apart.unionAll(together).repartition(1).sortWithinPartitions("k", "p").mapInPandas(up, "value double")  # a row a range
    return interval(values.select(F.nanvl("value", F.lit(None)).alias("value")), alpha)


def permutation_null(rows: DataFrame, key: str, x: str, y: str, n: int, seed: int) -> DataFrame:
    """One row: Pearson r of x and y, and the share of n permutations of y with at least that |r|; rows with a null x or y take no part.

    Rows fall to blocks of BLOCK or so by a hash of their key, and y is permuted within blocks: a subgroup of all permutations, chosen without the values, under
    which the test is as exact as under all. Up to BLOCK rows there is one block, so all permutations can come. Rows are shuffled once; a
    task orders a block by a hash for each permutation and adds up products. Null where x or y has no spread.
    """
    base = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = base.agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c")).first()
    blocks, spread = max(1, -(-m["n"] // BLOCK)), float(np.sqrt((m["vx"] or 0.0) * (m["vy"] or 0.0)))
    scale = m["n"] * spread
    cells = keyed(base, key, F.col(key).cast("string").alias("key"), (F.col(x) - F.lit(m["x"])).alias("x"), (F.col(y) - F.lit(m["y"])).alias("y"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["high", "key"], kind="stable")
        h, values = hashes(frame["high"].to_numpy(), frame["low"].to_numpy(), n, seed), frame["y"].to_numpy()
        return pd.DataFrame({"v": [[float(frame["x"].to_numpy() @ values[np.argsort(h[:, b], kind="stable")]) for b in range(n)]]})

    sums = cells.withColumn("block", F.col("low") % blocks).groupBy("block").applyInPandas(run, "v array<double>").groupBy(F.lit(0).alias("_")).agg(array_sum("v").alias("v"))
    r = F.lit(m["c"] / spread if scale > 0 else None).cast("double")
    return sums.select(r.alias("r"), (F.aggregate("v", F.lit(0.0), lambda a, v: a + F.when(F.abs(v / scale) >= F.abs(r), 1.0).otherwise(0.0)) / n if scale > 0 else F.lit(None).cast("double")).alias("p_value"))


def seed_summary(metrics: DataFrame) -> DataFrame:
    """(mean, std, median, iqr, n_undefined) over repeats of the mean over folds; the deviation is of the population."""
    per = metrics.groupBy("seed").agg(F.avg("metric").alias("m"))
    return per.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.percentile("m", 0.5).alias("median"), (F.percentile("m", 0.75) - F.percentile("m", 0.25)).alias("iqr"), F.count_if(F.col("m").isNull()).alias("n_undefined"))
