"""Subject-level splits, folds, caps and draws. Every shuffle is an order by md5, so partitions don't matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.draws import draw, draw_u32, draw_unit


def _half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("long")


def train_val_test(subjects: DataFrame, train: float, val: float, seed: int, min_val: int = 1) -> DataFrame:
    """(subject_id, label, split): classes of at least 3 subjects split by themselves, smaller ones pooled.

    A null label is a class of its own. A class gives at least one subject to train and min_val to val, and one is left for test.
    The last subject of a class may hold any share of the rows. A class may hold most subjects: they are numbered by ranges of their draws.
    """
    n = subjects.groupBy(F.col("label").alias("_label")).agg(F.count("*").alias("n"))
    stratum = F.when(F.col("n") >= 3, F.coalesce(F.col("label").cast("string"), F.lit("~null"))).otherwise("~pool")
    strata = subjects.join(F.broadcast(n), F.col("label").eqNullSafe(F.col("_label"))).select("subject_id", "label", stratum.alias("stratum"))
    sizes = strata.groupBy("stratum").agg(F.count("*").alias("n"))  # a row a class
    drawn = numbered(strata.withColumn("h", draw(seed, "split", "subject_id")), "subject_id", ["stratum"])
    ranked = drawn.withColumn("k", F.col("k") + 1).join(F.broadcast(sizes), "stratum")
    pool = F.col("stratum") == "~pool"
    n_train = F.when(pool, _half_even(F.col("n") * train)).otherwise(F.least(F.greatest(F.lit(1), _half_even(F.col("n") * train)), F.col("n") - 2))
    n_val = F.when(pool, F.least(_half_even(F.col("n") * val), F.col("n") - F.col("n_train"))).otherwise(F.least(F.greatest(F.lit(min_val), _half_even(F.col("n") * val)), F.col("n") - F.col("n_train") - 1))
    placed = ranked.withColumn("n_train", n_train).withColumn("n_val", n_val)
    return placed.select("subject_id", "label", F.when(F.col("k") <= F.col("n_train"), "train").when(F.col("k") <= F.col("n_train") + F.col("n_val"), "val").otherwise("test").alias("split"))


def grouped_folds(subjects: DataFrame, folds: int, seed: int) -> DataFrame:
    """(subject_id, label, fold): subjects in class order, drawn within, dealt round-robin across classes.

    The number of folds is at most the smallest class and at least 2. Numbers are ranks within a class, by ranges of the draws, and
    starts of the classes, so no window holds a whole class.
    """
    sizes = subjects.groupBy(F.col("label").cast("string").alias("cls")).agg(F.count("*").alias("n"))
    starts = sizes.select("cls", (F.sum("n").over(Window.orderBy("cls")) - F.col("n")).alias("start"))  # a row a class
    k = sizes.agg(F.greatest(F.lit(2), F.least(F.lit(folds), F.min("n"))).alias("k"))
    rows = numbered(subjects.select("subject_id", "label", F.col("label").cast("string").alias("cls"), draw(seed, "fold", "subject_id").alias("h")), "subject_id", ["cls"]).withColumnRenamed("k", "rank")
    return rows.join(F.broadcast(starts), "cls").join(F.broadcast(k)).select("subject_id", "label", F.pmod(F.col("start") + F.col("rank"), F.col("k")).cast("int").alias("fold"))


def cap_rows(rows: DataFrame, by: str, key: str, most: int, seed: int) -> DataFrame:
    """At most `most` rows of each group, drawn without replacement."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(draw(seed, "cap", key), key))
    return rows.withColumn("_k", k).where(F.col("_k") <= most).drop("_k")


def selection_probabilities(subjects: DataFrame, how: str, by: str = "label") -> DataFrame:
    """(by, p) over observed classes: uniform, natural (in proportion to subjects) or inverse_subject_frequency."""
    n = subjects.groupBy(by).agg(F.count_distinct("subject_id").alias("n"))
    w = {"uniform": F.lit(1.0), "natural": F.col("n").cast("double"), "inverse_subject_frequency": 1.0 / F.col("n")}[how]
    weighted = n.withColumn("w", w)
    return weighted.join(F.broadcast(weighted.agg(F.sum("w").alias("s")))).select(by, (F.col("w") / F.col("s")).alias("p"))


def balanced_draws(rows: DataFrame, probabilities: DataFrame, draws: int, seed: int) -> DataFrame:
    """(i, label, subject_id, cell_id): class by its probability, subject and cell uniform, with replacement, draw by draw.

    rows: (label, subject_id, cell_id). Indexes are per class and per subject; a draw looks its row up by equality.
    """
    cdf = probabilities.select("label", F.sum("p").over(Window.orderBy("label")).alias("hi"), (F.sum("p").over(Window.orderBy("label")) - F.col("p")).alias("lo"))  # a row a class
    subjects = rows.select("label", "subject_id").distinct()
    subjects = ordered(subjects, "subject_id", ["label"]).withColumnRenamed("k", "s")
    n_subjects = subjects.groupBy("label").agg(F.count("*").alias("n_s"))
    cells = ordered(rows.select("label", "subject_id", "cell_id"), "cell_id", ["label", "subject_id"]).withColumnRenamed("k", "c")
    n_cells = rows.groupBy("label", "subject_id").agg(F.count("*").alias("n_c"))
    spark = rows.sparkSession
    d = spark.range(draws).select(F.col("id").alias("i"), draw_unit(seed, "class", "id").alias("u"), draw_u32(seed, "subject", "id").alias("us"), draw_u32(seed, "cell", "id").alias("uc"))
    d = d.join(F.broadcast(cdf), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).join(F.broadcast(n_subjects), "label").withColumn("s", F.col("us") % F.col("n_s"))
    d = d.join(subjects, ["label", "s"]).join(n_cells, ["label", "subject_id"]).withColumn("c", F.col("uc") % F.col("n_c"))
    return d.join(cells, ["label", "subject_id", "c"]).select("i", "label", "subject_id", "cell_id")


def permuted(rows: DataFrame, key: str, value: str, seed: int) -> DataFrame:
    """(key, value) with the values dealt anew: the k-th key gets the value at the k-th place of a draw.

    Both orders number all rows, which one window would do in one task; they are numbered by ranges of a hash instead.
    """
    hashed = rows.select(key, value, draw(seed, "permute", key).alias("h"))
    a = numbered(rows.select(key).withColumn("h", F.md5(F.col(key).cast("string"))), key).select(key, "k")
    b = numbered(hashed, key).select(F.col(value), "k")
    return a.join(b, "k").select(key, value)


def numbered(rows: DataFrame, key: str, by: list[str] = ()) -> DataFrame:
    """rows with k from 0 in the order of (h, key), h a hex digest, within each group: ranks within its first three digits, and their starts."""
    return _numbered(rows.withColumn("_p", F.substring("h", 1, 3)), ["h", key], list(by))


def ordered(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """rows with k from 0 in the order of key within each group: of a number, ranks within 4,096 ranges of its values, and their starts; of other keys, ranks in a window a group."""
    if rows.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long", "double"):
        return rows.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1)
    x = F.col(key).cast("double")
    ends = rows.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))  # one row
    place = F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * 4096)
    return _numbered(rows.crossJoin(F.broadcast(ends)).withColumn("_p", F.coalesce(place, F.lit(-1))).drop("_lo", "_hi"), [key], by)


def _numbered(parts: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """parts with k from 0 within each group: ranks within its ranges _p, which come in order, and their starts, 4,096 rows or so a group."""
    starts = parts.groupBy(*by, "_p").agg(F.count("*").alias("_n")).select(*by, "_p", (F.sum("_n").over(Window.partitionBy(*by).orderBy("_p")) - F.col("_n")).alias("_s"))
    ranked = parts.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order)) - 1)
    joined = ranked.join(starts, [*by, "_p"]) if by else ranked.join(F.broadcast(starts), "_p")
    return joined.withColumn("k", F.col("_s") + F.col("_r")).drop("_p", "_s", "_r")


def overlapping(assignment: DataFrame) -> DataFrame:
    """Subjects that more than one split has."""
    return assignment.groupBy("subject_id").agg(F.count_distinct("split").alias("n")).where("n > 1").select("subject_id")


def fingerprint(rows: DataFrame, config: str, *columns: str) -> DataFrame:
    """One row: SHA-256 over the sorted rows' digests and the configuration.

    Rows are digested in parallel and meet in 4,096 partial digests, so no task or driver sees them all.
    """
    digest = rows.select(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns)), 256).alias("d"))
    parts = digest.groupBy(F.substring("d", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
    return parts.agg(F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list(F.concat("p", "d"))), ""), F.lit(config)), 256).alias("fingerprint"))


def parameter_grid(spark, grid: dict[str, list]) -> DataFrame:
    """Every combination, a row each, keys in order."""
    out = None
    for name in sorted(grid):
        values = spark.createDataFrame([(v,) for v in grid[name]], [name])
        out = values if out is None else out.crossJoin(values)
    return out


def oof_problems(subjects: DataFrame, predictions: DataFrame) -> DataFrame:
    """(subject_id, problem) of out-of-fold rows: duplicate, missing, unexpected, leaked (predicted by the fold it was trained in), not_finite."""
    n = predictions.groupBy("subject_id").agg(F.count("*").alias("n"), F.max(F.col("fold") != F.col("subject_fold")).alias("leak"), F.max(F.isnan("p") | F.col("p").isNull()).alias("bad"))
    both = subjects.select("subject_id", F.lit(1).alias("known")).join(n, "subject_id", "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "unexpected").when(F.col("n") > 1, "duplicate").when(F.col("leak"), "leaked").when(F.col("bad"), "not_finite")
    return both.select("subject_id", problem.alias("problem")).where("problem is not null")
