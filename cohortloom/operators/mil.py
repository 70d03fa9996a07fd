"""Gated-attention multiple-instance learning, trained by Spark: bags are never gathered.

A subject's vector is the softmax-weighted mean of its cells. Each round takes two passes over the cells: one sums, per subject, the
exponentials of the scores and what they weigh; with a subject's vector and error known, the other sums the gradient. Both
sums are made per task first, so a subject with a third of all cells costs as much as its rows. Parameters (a few
thousand numbers) travel with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.vectors import dot


@dataclass
class GatedAttention:
    """score = w . (tanh(V x) * sigmoid(U x)); logit = c . z + b, z the attention-weighted mean of x."""

    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: float

    @classmethod
    def start(cls, dims: int, hidden: int, seed: int = 0) -> GatedAttention:
        r = np.random.default_rng(seed)
        return cls(r.normal(size=(hidden, dims)) / np.sqrt(dims), r.normal(size=(hidden, dims)) / np.sqrt(dims), r.normal(size=hidden) / np.sqrt(hidden), np.zeros(dims), 0.0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip((np.tanh(x @ self.v.T) / (1 + np.exp(-x @ self.u.T))) @ self.w, -30, 30)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.v.ravel(), self.u.ravel(), self.w, self.c, [self.b]])

    def with_flat(self, p: np.ndarray) -> GatedAttention:
        h, d = self.v.shape
        a = np.split(p, [h * d, 2 * h * d, 2 * h * d + h, 2 * h * d + h + d])
        return GatedAttention(a[0].reshape(h, d), a[1].reshape(h, d), a[2], a[3], float(a[4][0]))


def subject_vectors(cells: DataFrame, model: GatedAttention) -> DataFrame:
    """(subject_id, norm, z): sums of exp(score) and the weighted mean of x; cells is (subject_id, x array<double>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["x"].tolist(), float).reshape(len(batch), -1)
            e = np.exp(model.scores(x))
            who, at = np.unique(batch["subject_id"].to_numpy(str), return_inverse=True)
            sums = np.zeros((len(who), x.shape[1]))
            np.add.at(sums, at, e[:, None] * x)
            yield pd.DataFrame({"subject_id": who, "norm": np.bincount(at, e, len(who)), "s": list(sums)})

    dims = len(model.c)
    parts = cells.select("subject_id", "x").mapInPandas(run, "subject_id string, norm double, s array<double>")
    sums = parts.groupBy("subject_id").agg(F.sum("norm").alias("norm"), *(F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(dims)))
    return sums.select("subject_id", "norm", F.array(*(F.col(f"s{k}") / F.col("norm") for k in range(dims))).alias("z"))


def attention(cells: DataFrame, model: GatedAttention) -> DataFrame:
    """(subject_id, cell_id, e): what each cell weighs, before it is divided by its subject's sum."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["x"].tolist(), float).reshape(len(batch), len(model.c))
            yield pd.DataFrame({"subject_id": batch["subject_id"], "cell_id": batch["cell_id"], "e": np.exp(model.scores(x))})

    return cells.select("subject_id", F.col("cell_id").cast("long").alias("cell_id"), "x").mapInPandas(run, "subject_id string, cell_id long, e double")


def predict(cells: DataFrame, model: GatedAttention) -> DataFrame:
    """(subject_id, y_prob)."""
    terms = [F.col("z")[k] * float(c) for k, c in enumerate(model.c)]
    logit = sum(terms[1:], terms[0]) + model.b
    return subject_vectors(cells, model).select("subject_id", (1 / (1 + F.exp(-logit))).alias("y_prob"))


def gradient(cells: DataFrame, outcomes: DataFrame, model: GatedAttention) -> np.ndarray:
    """Of the mean cross-entropy over subjects with a known outcome (subject_id, y)."""
    known = outcomes.where("y is not null")
    both = subject_vectors(cells, model).join(known, "subject_id")
    terms = [F.col("z")[k] * float(c) for k, c in enumerate(model.c)]
    error = (1 / (1 + F.exp(-(sum(terms[1:], terms[0]) + model.b))) - F.col("y")).alias("error")
    subjects = both.select("subject_id", "norm", "z", error)
    dims = len(model.c)
    head = subjects.agg(F.count("*").alias("n"), F.sum("error").alias("b"), *(F.sum(F.col("error") * F.col("z")[k]).alias(f"c{k}") for k in range(dims))).first()
    n = max(1, head["n"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * model.v.size + len(model.w))
        for batch in batches:
            x, z = (np.array(batch[c].tolist(), float).reshape(len(batch), -1) for c in ("x", "z"))
            t, g = np.tanh(x @ model.v.T), 1 / (1 + np.exp(-x @ model.u.T))
            s = (t * g) @ model.w
            a = np.exp(np.clip(s, -30, 30)) / batch["norm"].to_numpy()
            ds = np.where(np.abs(s) < 30, batch["error"].to_numpy() * a * ((x - z) @ model.c), 0.0)  # beyond, the score is clipped and has no slope
            dv, du = (ds[:, None] * model.w * g * (1 - t * t)).T @ x, (ds[:, None] * model.w * t * g * (1 - g)).T @ x
            total += np.concatenate([dv.ravel(), du.ravel(), (ds[:, None] * t * g).sum(axis=0)])
        yield pd.DataFrame({"g": [total.tolist()]})

    rows = cells.select("subject_id", "x").join(subjects, "subject_id").select("x", "norm", "z", "error")
    parts = rows.mapInPandas(run, "g array<double>").select(F.posexplode("g").alias("k", "g")).groupBy("k").agg(F.sum("g").alias("g")).collect()
    out = np.zeros(2 * model.v.size + len(model.w))
    for r in parts:
        out[r["k"]] = r["g"]
    return np.concatenate([out, [head[f"c{k}"] or 0.0 for k in range(dims)], [head["b"] or 0.0]]) / n


def fit(cells: DataFrame, outcomes: DataFrame, dims: int, hidden: int = 8, rounds: int = 30, rate: float = 0.1, seed: int = 0) -> GatedAttention:
    """Adam on the whole data; each round is two passes over the cells, which are kept in memory or on disk meanwhile."""
    model = GatedAttention.start(dims, hidden, seed)
    cells = cells.select(F.col("subject_id").cast("string").alias("subject_id"), "x").persist()
    p, m, v = model.flat(), 0.0, 0.0
    for k in range(1, rounds + 1):
        g = gradient(cells, outcomes, model)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        model = model.with_flat(p)
    cells.unpersist()
    return model


def dropout_report(cells: DataFrame, model: GatedAttention, passes: int, drop: float, seed: int = 0) -> DataFrame:
    """(subject_id, mean, variance): over passes, each with its own inputs dropped from the classifier; population variance."""
    masks = [np.random.default_rng((seed, k)).random(len(model.c)) >= drop for k in range(passes)]
    weights = F.array(*(F.array(*(F.lit(float(c)) for c in model.c * mask / (1 - drop))) for mask in masks))
    # subjects are pooled once; a mask touches the classifier alone
    each = subject_vectors(cells, model).select("subject_id", "z", F.explode(weights).alias("c"))
    out = each.select("subject_id", (1 / (1 + F.exp(-(dot(F.col("z"), F.col("c")) + model.b)))).alias("y_prob"))
    return out.groupBy("subject_id").agg(F.avg("y_prob").alias("mean"), F.var_pop("y_prob").alias("variance"))
