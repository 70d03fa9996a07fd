"""Module projection and two-level attention over cells and cell types, trained by Spark under a source strategy.

A cell's genes go through a masked projection (only pairs of a gene and a module it belongs to have a weight) and a tanh. Attention
pools a subject's cells within each type, then its types, so a common type doesn't drown others; cells without a type are a
type of their own. A bag is never gathered: each pass over the cells makes sums by (subject, type) per task first, a second level has
a row a subject and type, and the chain rule goes back the same way, from subjects to types to cells. The parameters travel with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.layout import PART
from cohortloom.operators.cohorts import ContractError, require_none
from cohortloom.operators.invariance import NoPenalty, Settings, array_sum, array_total, indices, matrix, penalty, vocabulary

#: Places in which a subject's cells meet its representation, so that one with a third of all cells doesn't wait in one task.
SALTS = 16
#: What blocks of cells share and are dealt by, the cells that a block has at most, and bytes of cells in a partition at least (if there are several) and unpacked at once.
LAID, BLOCK, LEAST_PART, CHUNK = ("subject_id", "cell_type_id", "salt"), 256, 2 << 20, 4 << 20
#: Beyond this a score is clipped and has no slope.
MOST_SCORE = 30.0


@dataclass
class Gate:
    """score(h) = w . (tanh(V h) * sigmoid(U h))."""

    v: np.ndarray
    u: np.ndarray
    w: np.ndarray

    def parts(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, g = np.tanh(h @ self.v.T), 1 / (1 + np.exp(-h @ self.u.T))
        return t, g, (t * g) @ self.w

    def weights(self, h: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(self.parts(h)[2], -MOST_SCORE, MOST_SCORE))

    def back(self, h: np.ndarray, ds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gradient by h, by v, u and w in one row) for gradients ds by the scores."""
        t, g, s = self.parts(h)
        ds = np.where(np.abs(s) < MOST_SCORE, ds, 0.0)[:, None]
        a, b = ds * self.w * g * (1 - t * t), ds * self.w * t * g * (1 - g)
        return a @ self.v + b @ self.u, np.concatenate([(a.T @ h).ravel(), (b.T @ h).ravel(), (ds * t * g).sum(axis=0)])

    def size(self) -> int:
        return self.v.size + self.u.size + self.w.size


@dataclass
class PathwayAttention:
    """Weights of pairs (module_of, gene_of), a bias a module, gates of cells and of types, a linear classifier, and a head that tells sources."""

    genes: int
    module_of: np.ndarray
    gene_of: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    cell_gate: Gate
    type_gate: Gate
    c: np.ndarray
    b: float
    sources: list[str] = field(default_factory=list)
    head: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    head_bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def start(cls, genes: int, members: list[tuple[int, int]], hidden: int, sources: list[str] = (), seed: int = 0) -> PathwayAttention:
        """members: (module, gene) pairs by number. A module without genes, or a gene that is not there, is an error."""
        pairs = sorted(set(members))
        m, g = np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
        if not len(m) or set(m) != set(range(m.max() + 1)) or g.min() < 0 or g.max() >= genes:
            raise ContractError("modules are numbered from 0, each has a gene, and genes are of the panel")
        r, k = np.random.default_rng(seed), int(m.max()) + 1
        gate = lambda: Gate(*(r.normal(size=(hidden, k)) / np.sqrt(k) for _ in range(2)), r.normal(size=hidden) / np.sqrt(hidden))
        return cls(genes, m, g, r.normal(size=len(m)) / np.sqrt(np.bincount(m)[m]), np.zeros(k), gate(), gate(), r.normal(size=k) / np.sqrt(k), 0.0, list(sources), r.normal(size=(len(sources), k)) / np.sqrt(k), np.zeros(len(sources)))

    def projection(self) -> np.ndarray:
        dense = np.zeros((len(self.bias), self.genes))
        dense[self.module_of, self.gene_of] = self.weights
        return dense

    def flat(self) -> np.ndarray:
        gates = [x.ravel() for g in (self.cell_gate, self.type_gate) for x in (g.v, g.u, g.w)]
        return np.concatenate([self.weights, self.bias, *gates, self.c, [self.b], self.head.ravel(), self.head_bias])

    def with_flat(self, p: np.ndarray) -> PathwayAttention:
        shapes = [self.weights.shape, self.bias.shape, *(x.shape for g in (self.cell_gate, self.type_gate) for x in (g.v, g.u, g.w)), self.c.shape, (1,), self.head.shape, self.head_bias.shape]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        x = [part.reshape(s) for part, s in zip(np.split(p, ends[:-1]), shapes, strict=True)]
        return replace(self, weights=x[0], bias=x[1], cell_gate=Gate(*x[2:5]), type_gate=Gate(*x[5:8]), c=x[8], b=float(x[9][0]), head=x[10], head_bias=x[11])


def _cells(cells: DataFrame, *carried: str) -> DataFrame:
    return cells.select(F.col("subject_id").cast("string").alias("subject_id"), F.coalesce(F.col("cell_type_id").cast("int"), F.lit(-1)).alias("cell_type_id"), "x", *carried)


def _prepared(cells: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Cells of subjects with an outcome row, with their y (NaN if unknown), source and salt."""
    rows = outcomes.select(F.col("subject_id").cast("string").alias("subject_id"), F.coalesce(F.col("y").cast("double"), F.lit(float("nan"))).alias("y"), F.coalesce("source", F.lit("")).alias("source"))
    one = require_none(rows.groupBy("subject_id").agg(F.count("*").alias("n"), F.max("y").alias("y"), F.max("source").alias("source")), F.col("n") > 1, "subjects with several outcomes")
    salt = F.pmod(F.xxhash64("subject_id", "x"), F.lit(SALTS)).cast("int")
    return _cells(cells).join(one.drop("n"), "subject_id").withColumn("salt", salt)


@dataclass
class Laid:
    """Cells in blocks (subject_id, cell_type_id, salt, y, source, x binary), their outcomes, subjects with a known outcome by source, and rows a subject and type."""

    blocks: DataFrame
    outcomes: DataFrame
    known: dict[str, int]
    types: int

    def parts(self, values: int) -> int:
        """Partitions for a row a subject and type with so many doubles."""
        return 1 + self.types * (8 * values + 64) // PART


@contextmanager
def laid_out(cells: DataFrame, outcomes: DataFrame, genes: int) -> Iterator[Laid]:
    """Blocks of cells with the same subject, type and salt, kept in memory or on disk meanwhile and dealt by these once, into partitions by their size.

    A cell's salt hangs on its values, so which task a cell goes to does not depend on how cells met in blocks.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, keys = _values(batch.column("x"), genes), [batch.column(c) for c in LAID]
            if not len(x):
                continue
            codes = np.array([keys[0].dictionary_encode().indices.to_numpy(), *(c.to_numpy() for c in keys[1:])])
            change = np.r_[True, (codes[:, 1:] != codes[:, :-1]).any(axis=0)]
            run = np.flatnonzero(change)[np.cumsum(change) - 1]
            at = np.flatnonzero((np.arange(len(x)) - run) % BLOCK == 0)
            data = [x[i:j].tobytes() for i, j in zip(at, [*at[1:], len(x)], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in (*LAID, "y", "source")), pa.array(data, pa.binary())], [*LAID, "y", "source", "x"])

    prepared = _prepared(cells, outcomes)
    size = prepared.count() * 8 * genes
    parts = 1 + max(size // PART, min(size // LEAST_PART, cells.sparkSession.sparkContext.defaultParallelism))
    packed = prepared.select(*LAID, "y", "source", "x").sortWithinPartitions(*LAID).mapInArrow(pack, "subject_id string, cell_type_id int, salt int, y double, source string, x binary")
    blocks = packed.repartition(parts, *LAID).persist()
    try:
        subjects = blocks.groupBy("subject_id", "y", "source").agg(F.count_distinct("cell_type_id").alias("t"))
        found = subjects.groupBy("source").agg(F.count_if(~F.isnan("y")).alias("n"), F.sum("t").alias("t")).collect()  # a row a source
        yield Laid(blocks, outcomes, {r["source"]: r["n"] for r in found if r["n"]}, sum(r["t"] for r in found))
    finally:
        blocks.unpersist()


def _values(x: pa.ListArray, genes: int) -> np.ndarray:
    flat = x.flatten()
    if x.null_count or flat.null_count or (x.value_lengths().to_numpy() != genes).any() or not np.isfinite(flat.to_numpy()).all():
        raise ContractError(f"cells have {genes} finite values each")
    return flat.to_numpy().reshape(-1, genes)


def _lists(rows: np.ndarray) -> pa.ListArray:
    rows = rows.reshape(len(rows), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


def _unpacked(batch: pa.RecordBatch, genes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(some blocks, cells of each, their values), a few MB at a time."""
    if batch.num_rows:
        n = pc.binary_length(batch.column("x")).to_numpy() // (8 * genes)
        step = (np.cumsum(n) - n) * 8 * genes // CHUNK
        at = np.flatnonzero(np.r_[True, step[1:] != step[:-1]])
        for i, j in zip(at, [*at[1:], len(n)], strict=True):
            part = batch.slice(i, j - i)
            yield part, n[i:j], np.frombuffer(b"".join(part.column("x").to_pylist()), float).reshape(-1, genes)


def _inputs(batch: pd.DataFrame, genes: int) -> np.ndarray:
    x = matrix(batch["x"])
    if x.shape[1] != genes or not np.isfinite(x).all():
        raise ContractError(f"cells have {genes} finite values each")
    return x


def type_vectors(cells: DataFrame, model: PathwayAttention, carried: tuple[str, ...] = ()) -> DataFrame:
    """(subject_id, cell_type_id, carried, norm, t): sums of exp(score) of a type's cells and their weighted mean; cells is (subject_id, cell_type_id, x array<double>).

    A null type is -1, a type of its own. Cells of another number of genes, or with values that are not finite, are an error.
    carried are columns that depend on the subject alone.
    """
    keys = ["subject_id", "cell_type_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = model.projection().T
        for batch in batches:
            h = np.tanh(_inputs(batch, model.genes) @ p + model.bias)
            e = model.cell_gate.weights(h)
            first = ~batch.duplicated(keys)
            sums = np.zeros((int(first.sum()), 1 + h.shape[1]))
            np.add.at(sums, batch.groupby(keys, sort=False).ngroup().to_numpy(), np.hstack([e[:, None], e[:, None] * h]))
            yield batch.loc[first, [*keys, *carried]].assign(s=list(sums))

    base = _cells(cells, *carried)
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    parts = base.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in (*keys, *carried)) + ", s array<double>")
    summed = parts.groupBy(*keys, *carried).agg(array_sum("s").alias("s"))
    return summed.select(*keys, *carried, F.col("s")[0].alias("norm"), F.transform(F.slice("s", 2, len(model.bias)), lambda x: x / F.col("s")[0]).alias("t"))


def subject_vectors(cells: DataFrame, model: PathwayAttention, carried: tuple[str, ...] = ()) -> DataFrame:
    """(subject_id, carried, types, attention, z): types is an array of (cell_type_id, norm, t), attention what each weighs, z their weighted mean."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {c: batch[c] for c in ("subject_id", *carried, "types")} | {"attention": [], "z": []}
            for types in batch["types"]:
                t = np.array([x["t"] for x in types])
                a = model.type_gate.weights(t)
                a = a / a.sum()
                out["attention"].append(a)
                out["z"].append(a @ t)
            yield pd.DataFrame(out)

    types = type_vectors(cells, model, carried).groupBy("subject_id", *carried).agg(F.array_sort(F.collect_list(F.struct("cell_type_id", "norm", "t"))).alias("types"))  # a row a type
    kinds = {f.name: f.dataType.simpleString() for f in types.schema.fields}
    return types.mapInPandas(run, "".join(f"{c} {kinds[c]}, " for c in ("subject_id", *carried)) + "types array<struct<cell_type_id int, norm double, t array<double>>>, attention array<double>, z array<double>")


def predict(cells: DataFrame, model: PathwayAttention) -> DataFrame:
    """(subject_id, y_prob)."""
    terms = [F.col("z")[k] * float(c) for k, c in enumerate(model.c)]
    return subject_vectors(cells, model).select("subject_id", (1 / (1 + F.exp(-(sum(terms[1:], terms[0]) + model.b)))).alias("y_prob"))


@dataclass
class Step:
    """Task loss, penalty before its weight, and the gradient by flat()."""

    loss: float
    penalty: NoPenalty
    gradient: np.ndarray


def gradient(cells: DataFrame, outcomes: DataFrame, model: PathwayAttention, settings: Settings = Settings(), penalised: bool = True) -> Step:  # noqa: B008
    """Of the mean cross-entropy over subjects with a known outcome plus the strategy's weighted penalty over all of outcomes (subject_id, y, source).

    source_balanced weighs subjects so that each source counts alike: what draws of a source, then of a subject, expect.
    Subjects without an outcome row take no part. penalised is false during warm-up.
    """
    with laid_out(cells, outcomes, model.genes) as laid:
        return _steps(laid, [model], [settings], [penalised])[0]


@dataclass
class _Pooled:
    """Of rows a subject and type: norm, mean t and attention, and of subjects the representation z, under one model."""

    norm: np.ndarray
    t: np.ndarray
    attention: np.ndarray
    z: np.ndarray


def _pooled(types: pa.ListArray, models: list[PathwayAttention]) -> tuple[pa.StructArray, np.ndarray, list[_Pooled]]:
    """(rows a subject and type, the subject of each by number, a _Pooled a model); types are lists of (cell_type_id, s), s the sums of all models."""
    rows, n, k = types.flatten(), types.value_lengths().to_numpy(), len(models[0].c)
    s, of, out = rows.field("s").flatten().to_numpy().reshape(len(rows), len(models), 1 + k), np.repeat(np.arange(len(n)), n), []
    at = np.cumsum(n) - n
    for i, model in enumerate(models):
        t = s[:, i, 1:] / s[:, i, :1]
        a = model.type_gate.weights(t)
        a = a / np.add.reduceat(a, at)[of]
        out.append(_Pooled(s[:, i, 0], t, a, np.add.reduceat(a[:, None] * t, at)))
    return rows, of, out


def _subjects(laid: Laid, models: list[PathwayAttention]) -> DataFrame:
    """(subject_id, y, source, types, z): z has the representations under all models, one after the other; one pass over the cells serves them all."""
    genes, k = models[0].genes, len(models[0].c)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projections, names = [m.projection().T for m in models], ["subject_id", "cell_type_id", "y", "source"]
        for batch in batches:
            for part, n, x in _unpacked(batch, genes):
                found = []
                for model, p in zip(models, projections, strict=True):
                    h = np.tanh(x @ p + model.bias)
                    e = model.cell_gate.weights(h)[:, None]
                    found.append(np.add.reduceat(np.hstack([e, e * h]), np.cumsum(n) - n))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), _lists(np.hstack(found))], [*names, "s"])

    def represent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = np.hstack([x.z for x in _pooled(batch.column("types"), models)[2]])
                yield pa.RecordBatch.from_arrays([*batch.columns, _lists(z)], [*batch.schema.names, "z"])

    parts = laid.blocks.select("subject_id", "cell_type_id", "y", "source", "x").mapInArrow(sums, "subject_id string, cell_type_id int, y double, source string, s array<double>")
    summed = parts.repartition(laid.parts(len(models) * (3 * k + 2)), "subject_id").groupBy("subject_id", "cell_type_id", "y", "source").agg(array_sum("s").alias("s"))
    types = summed.groupBy("subject_id", "y", "source").agg(F.collect_list(F.struct("cell_type_id", "s")).alias("types"))  # a row a type
    return types.mapInArrow(represent, "subject_id string, y double, source string, types array<struct<cell_type_id int, s array<double>>>, z array<double>")


def _of(subjects: DataFrame, i: int, k: int) -> DataFrame:
    """(source, z) under the i-th of the models."""
    return subjects.select("source", F.slice("z", i * k + 1, k).alias("z"))


def _steps(laid: Laid, models: list[PathwayAttention], strategies: list[Settings], penalised: list[bool]) -> list[Step]:
    total, k, known = max(1, sum(laid.known.values())), len(models[0].c), laid.known
    shares = [{s: 1 / (len(known) * n) if x.strategy == "source_balanced" else 1 / total for s, n in known.items()} for x in strategies]
    weights = [x.weight if on else 0.0 for x, on in zip(strategies, penalised, strict=True)]
    subjects = _subjects(laid, models).persist()
    try:
        found = [penalty(x, _of(subjects, i, k), m.sources, k, m.head, m.head_bias) if w else NoPenalty() for i, (x, m, w) in enumerate(zip(strategies, models, weights, strict=True))]
        return _backwards(laid, subjects, models, shares, weights, found)
    finally:
        subjects.unpersist()


def _backwards(laid: Laid, subjects: DataFrame, models: list[PathwayAttention], shares: list[dict[str, float]], weights: list[float], found: list[NoPenalty]) -> list[Step]:
    one, arms = models[0], len(models)
    k, index, gates = len(one.c), {s: i for i, s in enumerate(one.sources)}, one.type_gate.size()
    width, low = gates + k + 2, len(one.weights) + k + one.cell_gate.size()  # by the types' gate, c and b, and the loss; by all below

    def to_types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = np.zeros((arms, width)), ["subject_id", "cell_type_id", "v", "g"]
        for batch in batches:
            if not batch.num_rows:
                continue
            (rows, of, pooled), y, sources, out = _pooled(batch.column("types"), models), batch.column("y").to_numpy(), batch.column("source").to_pylist(), []
            known = ~np.isnan(y)
            for i, (model, x) in enumerate(zip(models, pooled, strict=True)):
                s = np.array([shares[i].get(c, 0.0) for c in sources])
                p = 1 / (1 + np.exp(-(x.z @ model.c + model.b)))
                error = np.where(known, s * (p - np.nan_to_num(y)), 0.0)
                dz = error[:, None] * model.c
                if weights[i]:
                    dz = dz + weights[i] * found[i].gradient(x.z, indices(sources, index))
                through, gate = model.type_gate.back(x.t, x.attention * ((x.t - x.z[of]) * dz[of]).sum(axis=1))
                loss = np.where(known, -s * np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-300, None)), 0.0).sum()
                own[i] += np.concatenate([gate, error @ x.z, [error.sum(), loss]])
                out += [x.norm[:, None], x.t, x.attention[:, None] * dz[of] + through]
            yield pa.RecordBatch.from_arrays([batch.column("subject_id").take(pa.array(of)), rows.field("cell_type_id"), _lists(np.hstack(out)), pa.nulls(len(of), pa.list_(pa.float64()))], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.float64())), _lists(own.reshape(1, -1))], names)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, projections = np.zeros((arms, low)), [m.projection().T for m in models]
        for batch in batches:
            for part, n, x in _unpacked(batch, one.genes):
                v = part.column("v").flatten().to_numpy().reshape(len(n), arms, 1 + 2 * k).repeat(n, axis=0)
                for i, (model, p) in enumerate(zip(models, projections, strict=True)):
                    h, norm, t, dt = np.tanh(x @ p + model.bias), v[:, i, 0], v[:, i, 1 : 1 + k], v[:, i, 1 + k :]
                    a = model.cell_gate.weights(h) / norm
                    through, by_gate = model.cell_gate.back(h, a * ((h - t) * dt).sum(axis=1))
                    pre = (a[:, None] * dt + through) * (1 - h * h)
                    own[i] += np.concatenate([(pre.T @ x)[model.module_of, model.gene_of], pre.sum(axis=0), by_gate])
        yield pa.RecordBatch.from_arrays([_lists(own.reshape(1, -1))], ["g"])

    back = subjects.select("subject_id", "types", "y", "source").mapInArrow(to_types, "subject_id string, cell_type_id int, v array<double>, g array<double>").persist()
    try:
        top = array_total(back, "g", arms * width).reshape(arms, -1)
        met = back.where("g is null").drop("g").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        parts = laid.blocks.select(*LAID, "x").join(met, list(LAID)).select("x", "v").mapInArrow(to_cells, "g array<double>")
        below = array_total(parts, "g", arms * low).reshape(arms, -1)
    finally:
        back.unpersist()
    heads = [w * f.head if len(f.head) else np.zeros(m.head.size + len(m.head_bias)) for m, w, f in zip(models, weights, found, strict=True)]
    return [Step(float(top[i][-1]), found[i], np.concatenate([below[i], top[i][:-1], heads[i]])) for i in range(arms)]


def fit(cells: DataFrame, outcomes: DataFrame, model: PathwayAttention, settings: Settings = Settings(), rounds: int = 20, rate: float = 0.05) -> tuple[PathwayAttention, list[dict]]:  # noqa: B008
    """(model, a dict of round, loss and penalty for each round before its step) by Adam on the whole data under the strategy.

    Other strategies than plain training need every subject's source, of the model's vocabulary. Each round is two passes over the cells, which are laid out once and kept in memory or on disk meanwhile: a round shuffles sums alone.
    """
    with laid_out(cells, outcomes, model.genes) as laid:
        return fit_strategies(laid, model, [settings], rounds, rate)[0]


def fit_strategies(laid: Laid, model: PathwayAttention, strategies: list[Settings], rounds: int = 20, rate: float = 0.05) -> list[tuple[PathwayAttention, list[dict]]]:
    """fit() from the same start under each strategy. A round's two passes serve all strategies, so passes and jobs over the cells do not grow with these."""
    if any(x.strategy != "erm" for x in strategies) and vocabulary(laid.outcomes, 2) != sorted(model.sources):
        raise ContractError("sources of the outcomes are not the model's vocabulary")
    p = np.array([model.flat()] * len(strategies))
    models, m, v, histories = [model] * len(strategies), 0.0, 0.0, [[] for _ in strategies]
    for k in range(1, rounds + 1):
        steps = _steps(laid, models, strategies, [k > x.warmup for x in strategies])
        for history, step in zip(histories, steps, strict=True):
            history.append({"round": k, "loss": step.loss, "penalty": step.penalty.loss})
        g = np.array([step.gradient for step in steps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        p = p - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        models = [model.with_flat(x) for x in p]
    return list(zip(models, histories, strict=True))


def source_report(cells: DataFrame, outcomes: DataFrame, model: PathwayAttention, settings: Settings = Settings()) -> dict[str, float]:  # noqa: B008
    """loss, and coral and mmd distances between sources at the model's representations: what a strategy changed is seen before and after."""
    with laid_out(cells, outcomes, model.genes) as laid:
        return source_reports(laid, [model], settings)[0]


def source_reports(laid: Laid, models: list[PathwayAttention], settings: Settings = Settings()) -> list[dict[str, float]]:  # noqa: B008
    """source_report() of each model, in one pass over the cells."""
    sources, k = vocabulary(laid.outcomes, 2), len(models[0].c)
    subjects = _subjects(laid, models).persist()
    try:
        losses = []
        for i, model in enumerate(models):
            terms = [F.col("z")[i * k + j] * float(c) for j, c in enumerate(model.c)]
            p = 1 / (1 + F.exp(-(sum(terms[1:], terms[0]) + model.b)))
            losses.append(F.avg(-F.log(F.greatest(F.when(F.col("y") == 1, p).otherwise(1 - p), F.lit(1e-300)))))
        found = subjects.where("not isnan(y)").agg(*losses).first()
        return [{"loss": found[i]} | {s: penalty(replace(settings, strategy=s), _of(subjects, i, k), sources, k).loss for s in ("coral", "mmd")} for i in range(len(models))]
    finally:
        subjects.unpersist()
