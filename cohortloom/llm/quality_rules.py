"""Quality rules by robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Counts of each whole text give a vector: the logarithm of the mean length of words, and the arcsine of the root of the shares of symbols among
characters, of repeated lines among lines and of repeated words among words. Of each language and source the half of the vectors
with the smallest covariance determinant is sought by concentration steps: distances from an estimate, the half that is
nearest, the estimate of that half. A reweighted estimate of all that lie near then says how far (Mahalanobis) a vector is out.

Vectors are whole multiples of 1 / SCALE, so all sums are exact longs and results do not depend on partitions. A step orders
rows by bins of their distances (1/64 of a doubling; the bin in which the half ends counts in part), so no group is sorted or gathered: a step shuffles
a row a bin. Groups under LEAST rows are estimated together with those of their language, and where these are too few, with all such.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import exp, gamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import discard_since, map_text, materialize, written
from cohortloom.llm.words import word_chunks

NAMES = ("word_length", "symbols", "duplicate_lines", "repeated_words")
P, SCALE, BINS = len(NAMES), 256, 64
#: The least spread of each part of the vector that counts: what is constant in most texts must not make a little of it an outlier.
FLOORS = (0.06, 0.03, 0.25, 0.25)
#: Parts of which less than usual is no fault.
ONE_SIDED = (False, True, True, True)
#: Rows for an estimate of its own, most concentration steps, rows of a group that a key of a join may stand for (a share of 1 / SALTS).
LEAST, STEPS, SALTS = 200, 12, 32
#: Chances, by chi squared, that a vector of the core lies within the reweighting and the rejection distance.
NEAR, KEEP = 0.975, 0.9999
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in b"#*$%&|<>")
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """How many words lie in a window of three that comes twice or more; ids number the words' forms."""
    if len(ids) < 3:
        return 0
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    pair = a * distinct + b  # under 2^63: both are under the words of a text
    if distinct >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, times = np.unique(pair * distinct + c, return_inverse=True, return_counts=True)
    again = times[at] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k : len(ids) - 2 + k] |= again
    return int(inside.sum())


def text_counts(text: str) -> tuple[int, ...]:
    """COUNTS of a text; n_lines are those with a word."""
    data = text.encode("utf-8", "surrogatepass")
    forms: dict[bytes, int] = {}
    parts = [np.fromiter((forms.setdefault(w, len(forms)) for w in words), np.int64, len(words)) for words in word_chunks(data)]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    seen, lines, repeats = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            repeats += line in seen
            seen.add(line)
    spaces = len(data) - len(data.translate(None, _SPACES))
    return len(ids), len(text) - spaces, len(data.translate(None, _NOT_SYMBOLS)), repeats, repeated_words(ids, len(forms)), lines


def _counting() -> Callable:
    names = [c.split()[0] for c in COUNTS.split(", ")]
    return lambda texts: dict(zip(names, zip(*map(text_counts, texts), strict=True), strict=True)) if texts else {n: [] for n in names}


def chi_squared(x: float, dof: int) -> float:
    """Its distribution function, by the series of the incomplete gamma function."""
    a, y = dof / 2, x / 2
    term = total = 1 / a
    k = 1
    while term > 1e-17 * total:
        term *= y / (a + k)
        total += term
        k += 1
    return min(1.0, total * y**a * exp(-y) / gamma(a)) if y > 0 else 0.0


def chi_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_squared(mid, dof) < p else (low, mid)
    return high


def consistency(share: float) -> float:
    """What the covariance of the nearest share of normal vectors is short of the whole one's."""
    return share / chi_squared(chi_quantile(share, P), P + 2) if share < 1 else 1.0


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> Column:
    """The statistics as whole multiples of 1 / SCALE, of a row with COUNTS and a word."""
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.lit(1), F.col(b)))))
    parts = (F.log(F.greatest(F.lit(1), F.col("word_chars")) / F.greatest(F.lit(1), F.col("n_words"))), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"))
    return F.array(*(F.round(x * SCALE).cast("long") for x in parts))


def estimate(n: float, sums: np.ndarray, products: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, precision, determinant) of n vectors with those sums and sums of products (of multiples of 1 / SCALE), spreads floored."""
    mean = sums / n / SCALE
    cov = (products / n / SCALE**2 - np.outer(mean, mean)) * consistency(share)
    floor = np.square(FLOORS)
    cov = cov + np.diag(np.maximum(0, floor - np.diag(cov)) + 0.01 * floor)
    return mean, np.linalg.inv(cov), float(np.linalg.det(cov))


def _upper() -> list[tuple[int, int]]:
    return [(j, k) for j in range(P) for k in range(j, P)]


def _squared(products: np.ndarray) -> np.ndarray:
    out = np.zeros((P, P))
    for (j, k), v in zip(_upper(), products, strict=True):
        out[j, k] = out[k, j] = v
    return out


def _distance(clip: bool = False) -> Column:
    """Squared Mahalanobis distance of x from (mean, precision); clip: of one-sided parts only what is over the mean."""
    d = [F.col("x")[j] / SCALE - F.col("mean")[j] for j in range(P)]
    if clip:
        d = [F.greatest(F.lit(0.0), x) if one else x for x, one in zip(d, ONE_SIDED, strict=True)]
    terms = [F.col("precision")[P * j + k] * d[j] * d[k] * (1 if j == k else 2) for j, k in _upper()]
    return F.greatest(F.lit(0.0), sum(terms[1:], terms[0]))


def _spread(params: DataFrame) -> DataFrame:
    """A row for each salt, so that a group's rows meet its parameters in SALTS places."""
    return params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


SUMS = ("n", *(f"s{j}" for j in range(P)), *(f"q{j}{k}" for j, k in _upper()))


def _summed() -> list[Column]:
    w, x = F.col("w"), F.col("x")
    return [F.sum(w).alias("n"), *(F.sum(w * x[j]).alias(f"s{j}") for j in range(P)), *(F.sum(w * x[j] * x[k]).alias(f"q{j}{k}") for j, k in _upper())]


PARAMS = "grp string, start int, h long, mean array<double>, precision array<double>, det double, change double"


def concentrated(cells: DataFrame, params: DataFrame) -> DataFrame:
    """PARAMS after a concentration step: of the h rows of each group that are nearest by each of its estimates."""
    near = cells.join(_spread(params.select("grp", "start", "mean", "precision")), ["grp", "salt"])
    bins = near.withColumn("bin", F.floor(F.log2(_distance() + 2.0**-20) * BINS)).groupBy("grp", "start", "bin").agg(*_summed())
    counted = bins.join(params.select("grp", "start", "h", F.col("det").alias("before")), ["grp", "start"])
    upto = F.sum("n").over(Window.partitionBy("grp", "start").orderBy("bin"))  # a row a bin: a few thousand at most
    placed = counted.withColumn("upto", upto)
    whole, cut = F.col("upto") <= F.col("h"), (F.col("upto") > F.col("h")) & (F.col("upto") - F.col("n") < F.col("h"))
    halves = placed.groupBy("grp", "start", "h", "before").agg(*(F.coalesce(F.sum(F.when(whole, F.col(c))), F.lit(0)).alias(c) for c in SUMS), *(F.coalesce(F.sum(F.when(cut, F.col(c))), F.lit(0)).alias(f"cut_{c}") for c in SUMS), F.sum("n").alias("all"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                part = (r.h - r.n) / r.cut_n if r.cut_n else 0.0
                v = np.array([float(getattr(r, c)) + part * float(getattr(r, f"cut_{c}")) for c in SUMS])
                mean, precision, det = estimate(v[0], v[1 : P + 1], _squared(v[P + 1 :]), r.h / r.all)
                rows.append((r.grp, r.start, r.h, mean.tolist(), precision.ravel().tolist(), det, abs(det / r.before - 1)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARAMS.split(", ")])

    return halves.mapInPandas(run, PARAMS)


def _middle(counts: DataFrame, value: str) -> DataFrame:
    """(grp, dim, middle): the lower median of each part; counts is (grp, dim, value, w), a row a value."""
    over = Window.partitionBy("grp", "dim")
    ranked = counts.withColumn("upto", F.sum("w").over(over.orderBy(value))).withColumn("all", F.sum("w").over(over))
    return ranked.where(2 * F.col("upto") >= F.col("all")).groupBy("grp", "dim").agg(F.min(value).alias("middle"))


def first_estimates(cells: DataFrame) -> DataFrame:
    """PARAMS of two starts a group: medians with median absolute deviations, and medians with the floors as spreads."""
    values = cells.select("grp", "w", F.posexplode("x").alias("dim", "value")).groupBy("grp", "dim", "value").agg(F.sum("w").alias("w"))
    middles = _middle(values, "value")
    away = values.join(middles, ["grp", "dim"]).select("grp", "dim", F.abs(F.col("value") - F.col("middle")).alias("away"), "w").groupBy("grp", "dim", "away").agg(F.sum("w").alias("w"))
    both = middles.join(_middle(away, "away").withColumnRenamed("middle", "mad"), ["grp", "dim"]).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("dim", "middle", "mad"))).alias("d"))  # a row a part
    sizes = cells.groupBy("grp").agg(F.sum("w").alias("n"))
    starts = both.join(sizes, "grp").select("grp", F.expr(f"(n + {P} + 1) div 2").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("start"), F.transform("d.middle", lambda m: m / SCALE).alias("mean"), "d")
    floors = F.array(*map(F.lit, FLOORS))
    spread = F.zip_with("d.mad", floors, lambda m, f: F.when(F.col("start") == 0, F.greatest(1.4826 * m / SCALE, f)).otherwise(f))
    wide = starts.withColumn("spread", spread)
    precision = F.array(*(1 / (F.col("spread")[j] * F.col("spread")[j]) if j == k else F.lit(0.0) for j in range(P) for k in range(P)))
    return wide.select("grp", "start", "h", "mean", precision.alias("precision"), F.aggregate("spread", F.lit(1.0), lambda a, b: a * b * b).alias("det"), F.lit(1.0).alias("change"))


def robust_estimates(cells: DataFrame) -> DataFrame:
    """(grp, mean, precision): the reweighted estimate of each group of cells (grp, salt, x, w)."""
    params = materialize(first_estimates(cells))
    for _ in range(STEPS):
        params = materialize(concentrated(cells, params))
        change = params.agg(F.max("change").alias("c")).first()["c"]
        if change is None or change < 1e-9:
            break
    best = params.groupBy("grp").agg(F.min_by(F.struct("mean", "precision"), F.struct("det", "start")).alias("b")).select("grp", "b.*")
    near = cells.join(_spread(best), ["grp", "salt"]).where(_distance() <= chi_quantile(NEAR, P)).groupBy("grp").agg(*_summed())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                v = np.array([float(getattr(r, c)) for c in SUMS])
                mean, precision, _ = estimate(v[0], v[1 : P + 1], _squared(v[P + 1 :]), NEAR)
                rows.append((r.grp, mean.tolist(), precision.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["grp", "mean", "precision"])

    return near.mapInPandas(run, "grp string, mean array<double>, precision array<double>")


def groups(counted: DataFrame) -> DataFrame:
    """(lang, source, grp): by whose estimate each language and source is judged."""
    sizes = counted.groupBy("lang", "source").agg(F.sum("w").alias("n"))
    small = F.col("n") < LEAST
    pools = sizes.where(small).groupBy("lang").agg(F.sum("n").alias("pool"))
    name = F.when(~small, F.to_json(F.array("lang", "source"))).when(F.col("pool") >= LEAST, F.to_json(F.array("lang"))).otherwise("[]")
    return sizes.join(pools, "lang", "left").select("lang", "source", name.alias("grp"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, distance), a row a row of docs.

    Whole texts of any length; a null text is empty and fails the base rules, a null lang or source is the empty string; repeated rows and ties
    fare alike; an empty table gives none; other columns are ignored. Estimates are of all rows that pass the base rules. distance is null for
    the rest; a row is kept where its square is within the KEEP quantile of chi squared.
    """
    spark, mark = docs.sparkSession, written()
    texts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    counted = map_text(texts, _counting, COUNTS, drop_text=True).withColumn("base_failed", base_failed())
    rows = materialize(counted.withColumn("x", vector()).withColumn("salt", F.pmod(F.xxhash64("x", "doc_id"), F.lit(SALTS)).cast("int")))
    # copies have one vector, so they are counted, not carried
    weighed = materialize(rows.where("not base_failed").groupBy("lang", "source", "salt", "x").agg(F.count("*").alias("w")))
    named = materialize(groups(weighed))
    cells = materialize(weighed.join(_spread(named), ["lang", "source", "salt"]).select("grp", "salt", "x", "w"))
    final = materialize(named.join(robust_estimates(cells), "grp").select("lang", "source", "mean", "precision"))
    judged = rows.join(_spread(final), ["lang", "source", "salt"], "left")
    squared = F.when(~F.col("base_failed"), _distance(clip=True))
    out = judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (squared <= chi_quantile(KEEP, P))).alias("kept"), "n_lines", F.sqrt(squared).alias("distance"))
    out = materialize(out)
    discard_since(spark, mark, but=1)
    return out
