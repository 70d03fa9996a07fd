"""Penalties on how much subjects' representations tell of their sources, and their gradients, from sums by source.

A penalty sees subjects as (source, z). What it needs of all of them are sums over each source, made per task first: moments for
correlation alignment, means of random Fourier features for the maximum mean discrepancy, the head's own gradient for the adversarial
one. With those the gradient of a subject's z needs nothing but its own row, so no pairs of subjects are ever formed. Sources are a
vocabulary that is fixed before training; a name outside it is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.parse import is_placeholder
from cohortloom.operators.cohorts import ContractError, require_none
from cohortloom.operators.models import STRATEGIES

#: Most sources whose sums a driver holds.
MOST_SOURCES = 1000


def array_sum(values: str) -> Column:
    """Aggregate: the sum of arrays of one length, place by place."""
    return vector_to_array(Summarizer.sum(array_to_vector(values)))


def array_total(rows: DataFrame, values: str, size: int) -> np.ndarray:
    """The sum of an array column over all rows, zeros of that size where there are none."""
    nothing = rows.sparkSession.createDataFrame([([0.0] * size,)], f"{values} array<double>")  # a sum of no rows is an error
    return np.array(rows.where(F.col(values).isNotNull()).select(values).unionAll(nothing).agg(array_sum(values).alias(values)).first()[values])


@dataclass(frozen=True)
class Settings:
    """What a strategy is trained with. weight scales its penalty, reversal the adversary's reversed gradient; the first `warmup` rounds go without penalty."""

    strategy: str = "erm"
    weight: float = 0.0
    reversal: float = 1.0
    warmup: int = 0
    features: int = 64
    seed: int = 0

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ContractError(f"no strategy {self.strategy}")
        if self.weight < 0 or self.reversal < 0 or self.warmup < 0 or self.features < 1:
            raise ContractError("weights, reversal and warm-up are not negative, and there is a feature at least")


def vocabulary(subjects: DataFrame, least: int = 1) -> list[str]:
    """The sources of (source) in order; blank or placeholder names, fewer than `least` or more than MOST_SOURCES are an error."""
    names = require_none(subjects.select("source").distinct(), is_placeholder(F.col("source")), "subjects without a source")
    found = sorted(r["source"] for r in names.limit(MOST_SOURCES + 1).collect())
    if not least <= len(found) <= MOST_SOURCES:
        raise ContractError(f"{len(found)} sources, where {least} to {MOST_SOURCES} can be told apart")
    return found


def sums_by_source(subjects: DataFrame, sources: list[str], make: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> dict[str, np.ndarray]:
    """Of each source, the sum over its subjects (source, z) of make(z, index of source), a row each."""
    index = {s: k for k, s in enumerate(sources)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z, at = matrix(batch["z"]), indices(batch["source"], index)
            rows = make(z, at)
            for s in np.unique(at):
                yield pd.DataFrame({"source": [sources[s]], "v": [rows[at == s].sum(axis=0)]})

    parts = subjects.select("source", "z").mapInPandas(run, "source string, v array<double>")
    return {r["source"]: np.array(r["v"]) for r in parts.groupBy("source").agg(array_sum("v").alias("v")).collect()}


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def indices(names: pd.Series, index: dict[str, int]) -> np.ndarray:
    unknown = sorted(set(names) - set(index))
    if unknown:
        raise ContractError(f"sources {unknown[:5]} are not in the vocabulary")
    return np.array([index[s] for s in names], int)


@dataclass
class NoPenalty:
    """Plain training, and training on balanced sources: no penalty on representations."""

    loss: float = 0.0
    head: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def gradient(self, z: np.ndarray, source: np.ndarray) -> np.ndarray:
        return np.zeros_like(z)


class Coral(NoPenalty):
    """Mean over pairs of sources of the squared Frobenius norm between covariances, over 4 d^2; a source of one subject has covariance 0."""

    def __init__(self, subjects: DataFrame, sources: list[str], dims: int):
        super().__init__()
        at = np.triu_indices(dims)
        sums = sums_by_source(subjects, sources, lambda z, _: np.hstack([np.ones((len(z), 1)), z, (z[:, :, None] * z[:, None, :])[:, *at]]))
        self.n, self.mean, cov = np.zeros(len(sources)), np.zeros((len(sources), dims)), np.zeros((len(sources), dims, dims))
        for k, s in enumerate(sources):
            if s in sums:
                v = sums[s]
                self.n[k], self.mean[k] = v[0], v[1 : dims + 1] / v[0]
                square = np.zeros((dims, dims))
                square[at] = v[dims + 1 :]
                square = square + np.triu(square, 1).T
                if v[0] > 1:
                    cov[k] = (square - v[0] * np.outer(self.mean[k], self.mean[k])) / (v[0] - 1)
        pairs = list(combinations(np.flatnonzero(self.n > 0), 2))
        self.slope = np.zeros_like(cov)
        for i, j in pairs:
            d = cov[i] - cov[j]
            self.loss += (d**2).sum() / (4 * dims**2) / len(pairs)
            self.slope[i] += d / (2 * dims**2) / len(pairs)
            self.slope[j] -= d / (2 * dims**2) / len(pairs)

    def gradient(self, z: np.ndarray, source: np.ndarray) -> np.ndarray:
        away = (z - self.mean[source]) / np.maximum(1, self.n[source] - 1)[:, None]
        return 2 * np.einsum("njk,nk->nj", self.slope[source], away)


def frequencies(features: int, dims: int, seed: int) -> np.ndarray:
    """(features, dims) standard normal draws by md5 of seed, feature and dimension (Box and Muller)."""

    def unit(tag: str, f: int, k: int) -> int:
        return int(hashlib.md5(f"{seed}|{tag}|{f}|{k}".encode()).hexdigest()[:8], 16)

    return np.array([[np.sqrt(-2 * np.log((unit("radius", f, k) + 1) / 4294967297)) * np.cos(2 * np.pi * unit("angle", f, k) / 4294967296) for k in range(dims)] for f in range(features)])


class Mmd(NoPenalty):
    """Mean over pairs of sources of the squared distance between mean random Fourier features, which estimate a Gaussian kernel.

    Its bandwidth is the root mean square distance of all pairs of subjects, which follows from moments (1 where they coincide); as a
    constant it has no gradient. Time and memory are linear in subjects.
    """

    def __init__(self, subjects: DataFrame, sources: list[str], dims: int, features: int, seed: int):
        super().__init__()
        moments = sum(sums_by_source(subjects, sources, lambda z, _: np.hstack([np.ones((len(z), 1)), z, (z**2).sum(axis=1, keepdims=True)])).values(), np.zeros(dims + 2))
        n = moments[0]
        spread = 2 * n / (n - 1) * max(0.0, moments[-1] / n - (moments[1:-1] ** 2).sum() / n**2) if n > 1 else 0.0
        self.bandwidth = np.sqrt(spread) if spread > 1e-12 else 1.0
        self.omega = frequencies(features, dims, seed) / self.bandwidth
        sums = sums_by_source(subjects, sources, lambda z, _: np.hstack([np.ones((len(z), 1)), self._features(z)]))
        self.n, mean = np.zeros(len(sources)), np.zeros((len(sources), 2 * features))
        for k, s in enumerate(sources):
            if s in sums:
                self.n[k], mean[k] = sums[s][0], sums[s][1:] / sums[s][0]
        pairs = list(combinations(np.flatnonzero(self.n > 0), 2))
        self.slope = np.zeros_like(mean)
        for i, j in pairs:
            d = mean[i] - mean[j]
            self.loss += (d**2).sum() / len(pairs)
            self.slope[i] += 2 * d / len(pairs)
            self.slope[j] -= 2 * d / len(pairs)

    def _features(self, z: np.ndarray) -> np.ndarray:
        u = z @ self.omega.T
        return np.hstack([np.cos(u), np.sin(u)]) / np.sqrt(len(self.omega))

    def gradient(self, z: np.ndarray, source: np.ndarray) -> np.ndarray:
        u, s = z @ self.omega.T, self.slope[source] / self.n[source][:, None] / np.sqrt(len(self.omega))
        half = len(self.omega)
        return (s[:, half:] * np.cos(u) - s[:, :half] * np.sin(u)) @ self.omega


class Adversary(NoPenalty):
    """Mean cross-entropy of a linear head that tells sources; the head learns by its gradient, representations by its reverse, times `reversal`."""

    def __init__(self, subjects: DataFrame, sources: list[str], dims: int, weights: np.ndarray, bias: np.ndarray, reversal: float):
        super().__init__()
        if len(sources) < 2:
            raise ContractError("an adversary needs two sources")
        self.weights, self.bias, self.reversal = weights, bias, reversal

        def rows(z: np.ndarray, at: np.ndarray) -> np.ndarray:
            p = self._probabilities(z)
            own = np.arange(len(at)), at
            d = p.copy()
            d[own] -= 1
            hit = p.argmax(axis=1) == at
            return np.hstack([np.ones((len(z), 1)), -np.log(np.maximum(p[own], 1e-300))[:, None], hit[:, None], (d[:, :, None] * z[:, None, :]).reshape(len(z), -1), d])

        total = sum(sums_by_source(subjects, sources, rows).values(), np.zeros(3 + weights.size + len(bias)))
        self.n = max(1.0, total[0])
        self.loss, self.accuracy, self.head = total[1] / self.n, total[2] / self.n, total[3:] / self.n

    def _probabilities(self, z: np.ndarray) -> np.ndarray:
        logits = z @ self.weights.T + self.bias
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def gradient(self, z: np.ndarray, source: np.ndarray) -> np.ndarray:
        d = self._probabilities(z)
        d[np.arange(len(source)), source] -= 1
        return -self.reversal * (d @ self.weights) / self.n


def penalty(settings: Settings, subjects: DataFrame, sources: list[str], dims: int, weights: np.ndarray | None = None, bias: np.ndarray | None = None) -> NoPenalty:
    """The strategy's penalty at the representations of subjects (source, z); weights and bias are the adversary's head."""
    if settings.strategy == "coral":
        return Coral(subjects, sources, dims)
    if settings.strategy == "mmd":
        return Mmd(subjects, sources, dims, settings.features, settings.seed)
    if settings.strategy == "domain_adversarial":
        return Adversary(subjects, sources, dims, weights, bias, settings.reversal)
    return NoPenalty()


def representation_gradients(subjects: DataFrame, found: NoPenalty, sources: list[str]) -> DataFrame:
    """(subject_id, g): the penalty's gradient by each subject's z; subjects is (subject_id, source, z)."""
    index = {s: k for k, s in enumerate(sources)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"subject_id": batch["subject_id"], "g": list(found.gradient(matrix(batch["z"]), indices(batch["source"], index)))})

    return subjects.select("subject_id", "source", "z").mapInPandas(run, "subject_id string, g array<double>")
