"""Hard negatives by blocked products of matrices: anchors' blocks are broadcast against blocks of candidates.

Two passes over the candidates. The first keeps, for every anchor, the best rows of its label in each task, which merge into the best
of all. The second keeps, for every anchor and positive, the best rows of other labels in the window of scores that the
positive opens. Products are float64 matrix products, exact while no score reaches 2^53; beyond it they are products of 64-bit
integers. Blocks of candidates and waves of anchors are bounded in bytes; only the best of each task are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import discard, discard_since, materialize, written

#: Bytes of a block of candidates, of a wave of anchors and of the scores of a block that are in memory at once; waves whose results are written together.
BLOCK_BYTES, WAVE_BYTES, SCORE_BYTES, WAVES_AT_ONCE = 1 << 21, 1 << 24, 1 << 25, 8
BEST = "anchor_id long, place int, vec_id long, score long"


def labelled_vectors(table: DataFrame, id_column: str, label: str, vector: str, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of each component. Rows without id, label, vector or components, or with a null or non-finite component, are left out."""
    x = F.col(vector)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    rows = table.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(finite)
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("long")).alias("v"))


class Best:
    """The k best (score, id) of each of n rows, higher scores and then smaller ids first; places that nothing fills hold the bottom."""

    def __init__(self, n: int, k: int, dtype: type):
        self.bottom = -np.inf if dtype is np.float64 else np.iinfo(np.int64).min
        self.scores, self.ids = np.full((n, k), self.bottom, dtype), np.full((n, k), np.iinfo(np.int64).max)

    def merge(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in a block's scores (n, b), what does not count being at the bottom; ids in rising order, so ties keep the smaller."""
        k = self.scores.shape[1]
        rows = np.flatnonzero(((scores >= self.scores[:, -1:]) & (scores > self.bottom)).any(axis=1))
        if not len(rows):
            return
        s = scores[rows]
        least = np.partition(s, -k, axis=1)[:, -k:].min(axis=1, keepdims=True) if s.shape[1] > k else np.full((len(rows), 1), self.bottom, s.dtype)
        over = s > least
        tied = (s == least) & (s > self.bottom)
        take = over | (tied & (np.cumsum(tied, axis=1) <= k - over.sum(axis=1, keepdims=True)))
        r, c = np.nonzero(take)
        place = np.arange(len(r)) - np.searchsorted(r, r)
        new_s, new_i = np.full((len(rows), k), self.bottom, s.dtype), np.full((len(rows), k), np.iinfo(np.int64).max)
        new_s[r, place], new_i[r, place] = s[r, c], ids[c]
        all_s, all_i = np.hstack([self.scores[rows], new_s]), np.hstack([self.ids[rows], new_i])
        order = np.argsort(all_i, axis=1, kind="stable")
        order = np.take_along_axis(order, np.argsort(-np.take_along_axis(all_s, order, 1) if s.dtype == np.float64 else ~np.take_along_axis(all_s, order, 1), axis=1, kind="stable"), 1)[:, :k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _by_size(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(dims, rows with it)."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        yield int(d), np.flatnonzero(sizes == d)


def _scan(wave, block_rows: dict[int, int], exact: bool, k: int, windows: bool) -> Callable:
    """A task's pass over its candidates. wave: a broadcast list of (dims, ids, labels, matrix, low, high), the last two (anchors, places) where there are windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.float64 if exact else np.int64
        anchors = {d: (ids, labels, m.astype(kind), low, high) for d, ids, labels, m, low, high in wave.value}
        best = {d: [Best(len(a[0]), k, kind) for _ in range(a[3].shape[1] if windows else 1)] for d, a in anchors.items()}
        waiting: dict[int, list] = {}

        def block(d: int) -> None:
            ids, labels, c = (np.concatenate(x) for x in zip(*waiting.pop(d), strict=True))
            order = np.argsort(ids, kind="stable")
            ids, labels, c = ids[order], labels[order], c[order].astype(kind)
            own, own_label, matrix, low, high = anchors[d]
            step = max(1, SCORE_BYTES // (8 * len(ids)))
            for at in range(0, len(own), step):
                part = slice(at, at + step)
                scores = matrix[part] @ c.T
                same = labels == own_label[part, None]
                bottom = best[d][0].bottom
                scores[(same if windows else ~same) | (ids == own[part, None])] = bottom
                for place, kept in enumerate(best[d]):
                    view = Best.__new__(Best)
                    view.bottom, view.scores, view.ids = bottom, kept.scores[part], kept.ids[part]
                    s = scores
                    if windows:
                        s = np.where((scores >= low[part, place, None]) & (scores <= high[part, place, None]), scores, bottom)
                    view.merge(s, ids)

        for batch in batches:
            for d, at in _by_size(batch.column("v")):
                if d not in anchors:
                    continue
                rows = batch.take(pa.array(at)) if len(at) < batch.num_rows else batch
                ids, labels, c = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("v"), d)
                for lo in range(0, len(ids), block_rows[d]):
                    to = lo + block_rows[d]
                    waiting.setdefault(d, []).append((ids[lo:to], labels[lo:to], c[lo:to]))
                    if sum(len(x[0]) for x in waiting[d]) >= block_rows[d]:
                        block(d)
        for d in list(waiting):
            block(d)
        for d, kept in best.items():
            for place, b in enumerate(kept):
                r, c = np.nonzero(b.scores > b.bottom)
                for lo in range(0, len(r), 1 << 16):
                    i, j = r[lo : lo + (1 << 16)], c[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(anchors[d][0][i]), pa.array(np.full(len(i), place, np.int32)), pa.array(b.ids[i, j]), pa.array(b.scores[i, j].astype(np.int64))], ["anchor_id", "place", "vec_id", "score"])

    return run


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and place over all tasks, with rank from 1."""
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _pass(vectors: DataFrame, anchors: DataFrame, waves: int, shape: tuple[int, bool], k: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """Candidates against every wave of anchors (wave, vec_id, label, v, and positives where low and high open windows), merged over tasks."""
    dims, exact = shape
    context, found, held, mark = vectors.sparkSession.sparkContext, None, [], written()
    for w in range(waves):
        table = anchors.where(F.col("wave") == w).drop("wave").toArrow().combine_chunks()  # bounded: see hard_negatives()
        sets = []
        if table.num_rows:
            batch = table.to_batches()[0]
            for d, at in _by_size(batch.column("v")):
                rows = batch.take(pa.array(at))
                lows = highs = None
                if low is not None:
                    scores = rows.column("positives").to_pylist()
                    places = max(map(len, scores))
                    # an empty window where there are fewer positives; integer bounds, so that no product is rounded
                    lows, highs = np.ones((len(at), places), np.int64), np.zeros((len(at), places), np.int64)
                    for i, row in enumerate(scores):
                        lows[i, : len(row)], highs[i, : len(row)] = [-(-low * s // 100) for s in row], [high * s // 100 for s in row]
                sets.append((d, rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("v"), d), lows, highs))
        wave = context.broadcast(sets)
        held.append(wave)
        block_rows = {d: max(1, BLOCK_BYTES // (8 * d)) for d, *_ in sets}
        scanned = vectors.mapInArrow(_scan(wave, block_rows, exact, k, low is not None), BEST)
        found = scanned if found is None else found.unionAll(scanned)
        if w % WAVES_AT_ONCE == WAVES_AT_ONCE - 1 and w < waves - 1:
            found = materialize(found)
    out = materialize(_best_of(found, k))
    discard_since(vectors.sparkSession, mark, but=1)
    for wave in held:
        wave.destroy()
    return out


def hard_negatives(vectors: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, wave_rows: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors: (vec_id long, label long, v array<long>). Anchors: rows that satisfy is_anchor; an id that comes in several rows counts as an anchor with its
    smallest label and vector. A positive is one of the `positives` best rows of the anchor's label with another id; a negative of it one
    of the `negatives` best rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score, so a positive of a
    negative score has none. Ties go to the smaller vec_id; repeated rows count as often as they come, a repeated positive has its negatives as
    often. Vectors of another dimension than an anchor's don't meet it. An empty table, no anchor, or no partner gives no rows. Scores that a long may not
    hold are an error.

    A wave holds at most WAVE_BYTES of anchors (or wave_rows), which is checked before it is broadcast; a task holds a wave, a block and the best so far.
    """
    shape = vectors.agg(F.max(F.size("v")).alias("dims"), F.max(F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double")))).alias("most")).first()
    dims = max(1, shape["dims"] or 1)
    top = dims * (shape["most"] or 0.0) ** 2
    if top * 100 >= 2.0**63:
        raise ValueError(f"components up to {shape['most']:.3g} in {dims} dimensions: a hundred times their products does not fit a long")
    exact = top < 2.0**53
    wave_rows = wave_rows or max(1, WAVE_BYTES // (8 * (dims + 4 * (positives + negatives))))
    anchors = materialize(vectors.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.label", "a.v"))
    waves = max(1, -(-anchors.count() * 5 // (4 * wave_rows)))
    while True:  # ids are dealt by hash, so a wave may come out larger than the average
        dealt = anchors.withColumn("wave", F.pmod(F.xxhash64("vec_id"), F.lit(waves)))
        if (dealt.groupBy("wave").count().agg(F.max("count").alias("n")).first()["n"] or 0) <= wave_rows:
            break
        waves *= 2
    best = _pass(vectors, dealt, waves, (dims, exact), positives)
    ranked = best.select(F.col("anchor_id"), (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    scores = ranked.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))  # at most `positives`
    opened = materialize(dealt.join(scores, dealt["vec_id"] == scores["anchor_id"]).select("wave", "vec_id", "label", "v", F.col("p.positive_score").alias("positives")))
    hard = _pass(vectors, opened, waves, (dims, exact), negatives, low, high)
    discard(anchors, opened)
    joined = hard.select("anchor_id", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(ranked, ["anchor_id", "place"])
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
