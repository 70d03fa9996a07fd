"""Classification and probability metrics as aggregations; everything may be grouped by further columns.

Curves are built over distinct probabilities, so a group's windows hold one row a distinct value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.vectors import linspace


def confusion(rows: DataFrame, classes: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, y_true, y_pred, n) over the full grid of (label) classes."""
    grid = classes.select(F.col("label").alias("y_true")).crossJoin(classes.select(F.col("label").alias("y_pred")))  # K x K
    if by:
        grid = rows.select(*by).distinct().join(F.broadcast(grid))
    n = rows.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))
    return grid.join(n, [*by, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_class(confused: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, label, precision, recall, f1, support) with 0 where a denominator is 0."""
    true = confused.groupBy(*by, F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("tp"))
    pred = confused.groupBy(*by, F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, both = F.col("tp"), F.col("support") + F.col("predicted")
    return true.join(pred, [*by, "label"]).select(*by, "label", ratio(tp, F.col("predicted")).alias("precision"), ratio(tp, F.col("support")).alias("recall"), ratio(2 * tp, both).alias("f1"), "support")


def classification_summary(classes: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, macro_f1, weighted_f1, balanced_accuracy, accuracy, n, n_absent) of per_class() rows: balanced over classes that occur."""
    support = F.col("support")
    return classes.groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"), F.coalesce(F.sum(F.col("f1") * support) / F.nullif(F.sum(support), F.lit(0)), F.lit(0.0)).alias("weighted_f1"),
        F.avg(F.when(support > 0, F.col("recall"))).alias("balanced_accuracy"), (F.sum(F.col("recall") * support) / F.nullif(F.sum(support), F.lit(0))).alias("accuracy"), F.sum(support).alias("n"), F.count_if(support == 0).alias("n_absent"))


def at_threshold(rows: DataFrame, t: float | Column, by: list[str] = ()) -> DataFrame:
    """(by, sensitivity, specificity, ppv, npv, accuracy, n): null where only one class occurs, ratios of nothing 0."""
    y, p = F.col("y_true") == 1, F.col("y_prob") >= t
    agg = rows.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    both = (tp + fn > 0) & (fp + tn > 0)
    ratio = lambda a, b: F.when(both, F.when(b > 0, a / b).otherwise(0.0))
    return agg.select(*by, ratio(tp, tp + fn).alias("sensitivity"), ratio(tn, tn + fp).alias("specificity"), ratio(tp, tp + fp).alias("ppv"), ratio(tn, tn + fn).alias("npv"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), (tp + fp + fn + tn).alias("n"))


#: Ranges of probability that running sums are cut into; a power of two, so that a range is exact.
RANGES = 1 << 16


def curve(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, t, p, q, tp, fp, pos, neg): of each distinct probability t, how many of each class are at it, and at or above it.

    Running sums go over the values of a range of probability; what lies above a range comes from the sums of the ranges, of
    which there are RANGES at most. So no window holds all distinct values.
    """
    by = list(by)
    each = rows.groupBy(*by, F.col("y_prob").alias("t")).agg(F.count_if(F.col("y_true") == 1).alias("p"), F.count_if(F.col("y_true") != 1).alias("q"))
    each = each.withColumn("_r", F.greatest(F.lit(0), F.least(F.lit(RANGES), F.floor(F.col("t") * RANGES))))
    ranges = each.groupBy(*by, "_r").agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    above, whole = Window.partitionBy(*by).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    zero = lambda x: F.coalesce(x, F.lit(0))
    ranges = ranges.select(*by, "_r", zero(F.sum("_p").over(above)).alias("_a"), zero(F.sum("_q").over(above)).alias("_b"), F.sum("_p").over(whole).alias("pos"), F.sum("_q").over(whole).alias("neg"))
    down = Window.partitionBy(*by, "_r").orderBy(F.desc("t"))
    inside = each.select(*by, "_r", "t", "p", "q", F.sum("p").over(down).alias("_tp"), F.sum("q").over(down).alias("_fp"))
    return inside.join(ranges, [*by, "_r"]).select(*by, "t", "p", "q", (F.col("_a") + F.col("_tp")).alias("tp"), (F.col("_b") + F.col("_fp")).alias("fp"), "pos", "neg")


def threshold_counts(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """(t, tp, fp) for each of a few thresholds, in their order from 1: rows are counted by interval first, and the grid meets the intervals."""
    k = sum((F.col("y_prob") >= t).cast("int") for t in thresholds)
    counts = rows.groupBy(k.alias("k")).agg(F.count_if(F.col("y_true") == 1).alias("p"), F.count_if(F.col("y_true") != 1).alias("q"))
    grid = rows.sparkSession.range(1, len(thresholds) + 1).select(F.col("id").cast("int").alias("t"))
    return grid.join(F.broadcast(counts), F.col("k") >= F.col("t"), "left").groupBy("t").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("q"), F.lit(0)).alias("fp"))


def ranking_metrics(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, auroc, auprc): Mann-Whitney with ties at half, and step-wise average precision; null where one class occurs."""
    c = curve(rows, by)
    both = (F.max("pos") > 0) & (F.max("neg") > 0)
    # every positive at t beats the negatives below t, and half of those at t
    wins = F.sum(F.col("p") * (F.col("neg") - F.col("fp") + F.col("q") / 2))
    ap = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return c.groupBy(*by).agg(F.when(both, wins / (F.max("pos") * F.max("neg"))).alias("auroc"), F.when(both, ap / F.max("pos")).alias("auprc"))


def loss_metrics(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, brier, log_loss)."""
    y, p = F.col("y_true").cast("double"), F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("y_prob")))
    return rows.groupBy(*by).agg(F.avg((F.col("y_prob") - y) * (F.col("y_prob") - y)).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def bin_index(p: Column, bins: int = 10) -> Column:
    """Bin of [lo, hi) edges evenly spaced from 0 to 1 as doubles, the last closed."""
    edges = linspace(0.0, 1.0, bins + 1)
    out = F.lit(bins - 1)
    for k in range(bins - 2, -1, -1):
        out = F.when(p < edges[k + 1], k).otherwise(out)
    return out


def reliability(rows: DataFrame, bins: int = 10, by: list[str] = ()) -> DataFrame:
    """(by, bin, n, mean_prob, observed) of bins that hold rows."""
    return rows.groupBy(*by, bin_index(F.col("y_prob"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("y_prob").alias("mean_prob"), F.avg(F.col("y_true").cast("double")).alias("observed"))


def calibration_error(rows: DataFrame, bins: int = 10, by: list[str] = ()) -> DataFrame:
    """(by, ece): mean gap of probability and frequency over bins, weighted by rows."""
    gap = F.sum(F.col("n") * F.abs(F.col("mean_prob") - F.col("observed"))) / F.sum("n")
    return reliability(rows, bins, by).groupBy(*by).agg(gap.alias("ece"))


def best_candidate(scores: DataFrame) -> DataFrame:
    """The candidate of (candidate, metric) with the largest mean; nulls are left out, ties go to the smaller name."""
    means = scores.where("metric is not null").groupBy("candidate").agg(F.avg("metric").alias("mean_metric"))
    return means.orderBy(F.desc(F.round("mean_metric", 12)), "candidate").limit(1)
