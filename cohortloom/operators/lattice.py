"""Many logistic models in one pass: a lattice of (outer fold, inner fold, penalty) is fitted by batched Newton steps.

A row belongs to a model's training rows by its fold numbers alone, so models are never joined to rows: each task adds up, for every
model, gradient and Hessian of its own rows, and a step shuffles a row a model and task. The number of jobs is that of the steps, however
many models there are. What a driver holds is the lattice: a matrix a model, whose bytes are checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.draws import draw
from cohortloom.functions.layout import gathered_if_small
from cohortloom.operators import metrics
from cohortloom.operators.cohorts import ContractError
from cohortloom.operators.invariance import array_sum, matrix
from cohortloom.operators.splits import grouped_folds, numbered

#: Bytes of all models' Hessians, which a task and the driver hold.
MOST_BYTES = 1 << 28


@dataclass(frozen=True)
class Cell:
    """A model of the lattice: trained on rows outside the outer fold and, unless inner is None, outside that inner fold of the rest; balanced: classes weigh alike."""

    outer: int
    inner: int | None
    penalty: float
    balanced: bool = True

    def split(self) -> tuple[int, int | None]:
        return self.outer, self.inner


def nested_folds(subjects: DataFrame, outer: int, inner: int, seed: int) -> DataFrame:
    """(subject_id, fold, inner): grouped outer folds, and for each outer fold the inner fold of a subject outside it, null in its own.

    inner[o] numbers folds of the subjects outside o, in class order and drawn within as grouped_folds() does; all outer folds are one plan. A subject
    that an outer fold holds has no inner fold there, so nothing held out can reach a choice. Fewer subjects of a class than folds give fewer folds, two at least.
    """
    first = grouped_folds(subjects.select("subject_id", "label"), outer, seed)
    many = first.agg((F.max("fold") + 1).alias("outers"))  # one row
    rest = first.crossJoin(F.broadcast(many)).select("subject_id", F.col("label").cast("string").alias("cls"), "fold", F.explode(F.sequence(F.lit(0), F.col("outers") - 1)).alias("outer")).where("fold <> outer")
    sizes = rest.groupBy("outer", "cls").agg(F.count("*").alias("n"))  # a row a fold and class
    starts = sizes.select("outer", "cls", (F.sum("n").over(Window.partitionBy("outer").orderBy("cls")) - F.col("n")).alias("start"))
    most = sizes.groupBy("outer").agg(F.greatest(F.lit(2), F.least(F.lit(inner), F.min("n"))).alias("k"))
    ranked = numbered(rest.withColumn("h", draw(seed, "fold", "subject_id")), "subject_id", ["outer", "cls"]).withColumnRenamed("k", "rank")
    dealt = ranked.join(F.broadcast(starts), ["outer", "cls"]).join(F.broadcast(most), "outer")
    place = dealt.select("subject_id", "outer", F.pmod(F.col("start") + F.col("rank"), F.col("k")).cast("int").alias("i"))
    by = place.groupBy("subject_id").agg(F.map_from_entries(F.collect_list(F.struct("outer", "i"))).alias("m"))  # an entry an outer fold
    return first.join(by, "subject_id").crossJoin(F.broadcast(many)).select("subject_id", "fold", F.transform(F.sequence(F.lit(0), F.col("outers") - 1), lambda o: F.try_element_at("m", o)).alias("inner"))


def _held(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Outer fold of each row, and its inner folds (rows, outer folds), -1 where there is none."""
    inner = [[-1 if i is None or i != i else int(i) for i in x] if x is not None else [] for x in batch["inner"]]
    return batch["fold"].to_numpy(int), np.array(inner, int).reshape(len(batch), -1)


def _trains(split: tuple[int, int | None], fold: np.ndarray, inner: np.ndarray) -> np.ndarray:
    outside = fold != split[0]
    return outside if split[1] is None else outside & (inner[:, split[0]] != split[1])


@dataclass
class Scaling:
    """Of the training rows of a split: mean, deviation (1 where all are alike) and the weight of each class, inverse to its rows; None if one class is missing."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: tuple[float, float]


def scalings(rows: DataFrame, splits: list[tuple[int, int | None]], dims: int) -> dict[tuple, Scaling | None]:
    """By split, from one pass over rows (y, x, fold, inner)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(splits), 2 + 2 * dims))
        for batch in batches:
            x, y, held = matrix(batch["x"]), batch["y"].to_numpy(float), _held(batch)
            for k, s in enumerate(splits):
                at = _trains(s, *held)
                sums[k] += np.concatenate([[at.sum(), y[at].sum()], x[at].sum(axis=0), (x[at] ** 2).sum(axis=0)])
        yield pd.DataFrame({"k": range(len(splits)), "v": list(sums)})

    found = rows.select("y", "x", "fold", "inner").mapInPandas(run, "k int, v array<double>").groupBy("k").agg(array_sum("v").alias("v")).collect()
    out: dict[tuple, Scaling | None] = dict.fromkeys(splits)
    for r in found:
        n, ones = r["v"][:2]
        if 0 < ones < n:
            v = np.array(r["v"][2:])
            mean = v[:dims] / n
            variance = np.maximum(0.0, v[dims:] - n * mean**2) / (n - 1)
            deviation = np.where(variance > 1e-20 * np.maximum(1.0, mean**2), np.sqrt(variance), 1.0)
            out[splits[r["k"]]] = Scaling(mean, deviation, (n / (2 * (n - ones)), n / (2 * ones)))
    return out


def newton(rows: DataFrame, models: list[Cell], dims: int, steps: int = 8, tolerance: float = 1e-8) -> dict[Cell, np.ndarray | None]:
    """Coefficients (intercept, then of scaled features) of every model; None where its training rows lack a class.

    Each minimises the mean log loss, class-weighted if it is balanced, plus penalty / 2 times the squared coefficients, without the intercept, from zero. Steps end early when
    no coefficient moves by more than the tolerance. rows: (y, x, fold, inner) of finite numbers.
    """
    if len(models) * (dims + 1) ** 2 * 8 > MOST_BYTES:
        raise ContractError(f"{len(models)} models of {dims} features are too many for one lattice")
    splits = sorted({m.split() for m in models}, key=lambda s: (s[0], -1 if s[1] is None else s[1]))
    scale = scalings(rows, splits, dims)
    live = [m for m in models if scale[m.split()]]
    beta = np.zeros((len(live), dims + 1))
    of = {s: [k for k, m in enumerate(live) if m.split() == s] for s in splits}
    for _ in range(steps if live else 0):

        def run(batches: Iterator[pd.DataFrame], beta: np.ndarray = beta) -> Iterator[pd.DataFrame]:
            g, h, w = np.zeros_like(beta), np.zeros((len(live), dims + 1, dims + 1)), np.zeros(len(live))
            for batch in batches:
                x, y, held = matrix(batch["x"]), batch["y"].to_numpy(float), _held(batch)
                for s, members in of.items():
                    if not members:
                        continue
                    at, c = _trains(s, *held), scale[s]
                    z = np.hstack([np.ones((int(at.sum()), 1)), (x[at] - c.mean) / c.deviation])
                    by_class = np.where(y[at] == 1, c.weights[1], c.weights[0])
                    for k in members:  # models of a split share its scaled rows
                        weight = by_class if live[k].balanced else np.ones(len(z))
                        p = 1 / (1 + np.exp(-(z @ beta[k])))
                        g[k] += z.T @ (weight * (p - y[at]))
                        h[k] += (z * (weight * p * (1 - p))[:, None]).T @ z
                        w[k] += weight.sum()
            for k in range(len(live)):
                yield pd.DataFrame({"k": [k], "v": [np.concatenate([[w[k]], g[k], h[k].ravel()])]})

        summed = rows.select("y", "x", "fold", "inner").mapInPandas(run, "k int, v array<double>").groupBy("k").agg(array_sum("v").alias("v")).collect()
        moved = np.zeros_like(beta)
        for r in summed:
            v, m = np.array(r["v"]), live[r["k"]]
            ridge = np.concatenate([[0.0], np.full(dims, m.penalty)])
            slope, curve = v[1 : dims + 2] / v[0] + ridge * beta[r["k"]], v[dims + 2 :].reshape(dims + 1, dims + 1) / v[0] + np.diag(ridge)
            moved[r["k"]] = np.linalg.lstsq(curve, slope, rcond=None)[0]
        beta = beta - moved
        if np.abs(moved).max() < tolerance:
            break
    found: dict[Cell, np.ndarray | None] = dict.fromkeys(models)
    for k, m in enumerate(live):
        c = scale[m.split()]
        raw = beta[k, 1:] / c.deviation
        found[m] = np.concatenate([[beta[k, 0] - raw @ c.mean], raw])  # of features as they come
    return found


def predictions(rows: DataFrame, fitted: dict[Cell, np.ndarray | None]) -> DataFrame:
    """(subject_id, model, fold, y, y_prob): every row by every model that holds it out, model the place in fitted; undefined models give none.

    A model without inner fold predicts its outer fold, one with an inner fold those of its outer fold's rest that this inner fold has.
    """
    models = [(k, m, b) for k, (m, b) in enumerate(fitted.items()) if b is not None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, held = matrix(batch["x"]), _held(batch)
            for k, m, b in models:
                at = held[0] == m.outer if m.inner is None else (held[0] != m.outer) & (held[1][:, m.outer] == m.inner)
                if at.any():
                    yield pd.DataFrame({"subject_id": batch["subject_id"][at].astype(str), "model": k, "fold": batch["fold"][at], "y": batch["y"][at], "y_prob": 1 / (1 + np.exp(-(x[at] @ b[1:] + b[0])))})

    return rows.select("subject_id", "y", "x", "fold", "inner").mapInPandas(run, "subject_id string, model int, fold int, y double, y_prob double")


def scores(predicted: DataFrame) -> dict[int, float]:
    """AUROC by model; models whose held-out rows lack a class are left out."""
    ranked = metrics.ranking_metrics(predicted.withColumnRenamed("y", "y_true"), ["model"])
    return {r["model"]: r["auroc"] for r in ranked.collect() if r["auroc"] is not None}


def nested_selection(rows: DataFrame, penalties: list[float], dims: int, steps: int = 8) -> tuple[DataFrame, DataFrame]:
    """(choices, predictions): for each outer fold the penalty with the best mean inner AUROC, chosen without its rows, and its out-of-fold predictions.

    rows: (subject_id, y of 0 and 1, x array<double>, fold, inner) as nested_folds() deals them. choices: (outer, penalty, inner_score, n_defined, auroc): undefined inner
    folds are left out of a mean; where no penalty has a defined score the first is taken and inner_score is null. Ties go to the first. Two lattices are fitted: all
    inner models, then one model an outer fold; jobs do not grow with folds or penalties.
    """
    rows = rows.select(F.col("subject_id").cast("string").alias("subject_id"), F.col("y").cast("double").alias("y"), "x", "fold", "inner").persist()
    try:
        shape = rows.agg(F.max("fold").alias("outer"), F.max(F.array_max("inner")).alias("inner")).first()
        if shape["outer"] is None:
            raise ContractError("no rows to select on")
        grid = [Cell(o, i, p) for o in range(shape["outer"] + 1) for i in range((shape["inner"] or 0) + 1) for p in penalties]
        scored = scores(predictions(rows, newton(rows, grid, dims, steps)))
        chosen: list[tuple[Cell, float | None, int]] = []
        for o in range(shape["outer"] + 1):
            best: tuple[float | None, float, int] = (None, penalties[0], 0)
            for p in penalties:
                defined = [scored[k] for k, m in enumerate(grid) if (m.outer, m.penalty) == (o, p) and k in scored]
                mean = float(np.mean(defined)) if defined else None
                if mean is not None and (best[0] is None or round(mean, 12) > round(best[0], 12)):
                    best = mean, p, len(defined)
            chosen.append((Cell(o, None, best[1]), best[0], best[2]))
        final = newton(rows, [c for c, *_ in chosen], dims, steps)
        predicted = predictions(rows, final)
        outer = scores(predicted)
    finally:
        rows.unpersist()
    table = [(c.outer, float(c.penalty), mean, n, outer.get(k)) for k, (c, mean, n) in enumerate(chosen)]
    return rows.sparkSession.createDataFrame(table, "outer int, penalty double, inner_score double, n_defined int, auroc double"), predicted


def out_of_fold(rows: DataFrame, penalty: float, dims: int, steps: int = 8) -> DataFrame:
    """predictions() of rows (subject_id, y of 0 and 1, x array<double>, fold), each by the balanced model of the other folds; all folds are fitted together.

    The rows are kept while the models are fitted, so how they came about is worked out once, not once a step. A fold whose rest lacks a class has no predictions.
    """
    dealt = rows.select("subject_id", F.col("y").cast("double").alias("y"), "x", "fold", F.array(F.lit(None).cast("int")).alias("inner"))
    laid = dealt.persist()
    try:
        small = gathered_if_small(laid, 8 * (dims + 8))
        folds = sorted(r["fold"] for r in small.select("fold").distinct().collect())  # a row a fold
        fitted = newton(small, [Cell(k, None, penalty) for k in folds], dims, steps)
    finally:
        laid.unpersist()
    return predictions(dealt, fitted)


def held_out_sources(rows: DataFrame, arms: dict[str, bool], penalty: float, dims: int, steps: int = 8) -> DataFrame:
    """(arm, source, n, auroc, balanced_accuracy, change): every arm refitted without each source and judged on it; change of balanced accuracy is against the first arm.

    rows: (subject_id, y of 0 and 1, x array<double>, source); arms: by name, whether classes weigh alike in training. All arms and sources are one lattice. A source
    whose rest lacks a class has no row, one that lacks a class itself null metrics. Rows without a source are an error.
    """
    from cohortloom.operators.invariance import vocabulary

    names = vocabulary(rows, 2)
    place = F.array_position(F.array(*map(F.lit, names)), F.col("source")).cast("int") - 1
    dealt = rows.select("subject_id", F.col("y").cast("double").alias("y"), "x", place.alias("fold"), F.array_repeat(F.lit(None).cast("int"), len(names)).alias("inner")).persist()
    try:
        models = [Cell(o, None, penalty, balanced) for balanced in dict.fromkeys(arms.values()) for o in range(len(names))]
        predicted = predictions(dealt, newton(dealt, models, dims, steps)).withColumnRenamed("y", "y_true").persist()
        at = metrics.at_threshold(predicted, 0.5, ["model"]).select("model", "n", ((F.col("sensitivity") + F.col("specificity")) / 2).alias("balanced_accuracy"))
        found = {r["model"]: r for r in at.join(metrics.ranking_metrics(predicted, ["model"]), "model").collect()}  # a row a model
        predicted.unpersist()
    finally:
        dealt.unpersist()
    out, base = [], next(iter(arms.values()))
    for arm, balanced in arms.items():
        for o, name in enumerate(names):
            r, first = (found.get(models.index(Cell(o, None, penalty, b))) for b in (balanced, base))
            if r:
                change = None if r["balanced_accuracy"] is None else r["balanced_accuracy"] - first["balanced_accuracy"]
                out.append((arm, name, r["n"], r["auroc"], r["balanced_accuracy"], change))
    return rows.sparkSession.createDataFrame(out, "arm string, source string, n long, auroc double, balanced_accuracy double, change double")
