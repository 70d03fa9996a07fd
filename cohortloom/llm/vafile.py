"""Exact top-k inner products by vector-approximation files.

The file: every block of vectors is quantised, each dimension's range over the block being cut into 32 cells of which a vector keeps
the number, three to 16 bits, with the block's corner and cell widths. It is written once, and is all that is scanned: a block's cells bound its
products with a query from both sides. A first scan finds, for each query, the kth largest lower bound over all blocks; a
second lists the vectors whose upper bound reaches it. Exact vectors are then read by row, in the order of the bounds: the
FIRST best of each query, whose kth product is exact, and after them only those whose bound still reaches that. What is left can hold none of the k best.
Blocks and waves of queries are bounded in bytes, whatever the dimension; a wave is broadcast to all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import discard_since, materialize, written
from cohortloom.llm.negatives import Best

#: Bytes of the exact vectors of a block, of the queries of a wave, and of the bounds in memory at once; most rows of a block and a wave; waves written together.
BLOCK_BYTES, WAVE_BYTES, BOUND_BYTES, BLOCK_ROWS, WAVE, WAVES_AT_ONCE = 1 << 24, 1 << 24, 1 << 25, 4096, 65536, 8
#: Bits of a cell number, cell numbers in 16 bits, and exact vectors of a query that are read first, as a multiple of k.
CELL_BITS, IN_16, FIRST = 5, 3, 4
FILE = "dims int, ids array<bigint>, rows array<bigint>, low array<bigint>, width array<bigint>, cells binary"


def packed(codes: np.ndarray) -> bytes:
    """Cell numbers (rows, dims), three to 16 bits."""
    n, dims = codes.shape
    wide = np.zeros((n, -(-dims // IN_16) * IN_16), np.uint16)
    wide[:, :dims] = codes
    return sum(wide[:, k::IN_16] << np.uint16(CELL_BITS * k) for k in range(IN_16)).astype("<u2").tobytes()


def unpacked(cells: bytes, dims: int) -> np.ndarray:
    words = np.frombuffer(cells, "<u2").reshape(-1, -(-dims // IN_16))
    out = np.empty((len(words), words.shape[1] * IN_16), np.uint16)
    for k in range(IN_16):
        out[:, k::IN_16] = (words >> np.uint16(CELL_BITS * k)) & np.uint16((1 << CELL_BITS) - 1)
    return out[:, :dims]


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(low, width, cells) of a block: the vectors are at low + width * cell in each dimension, and less than a width beyond."""
    low = vectors.min(axis=0)
    width = np.maximum(1, -(-(vectors.max(axis=0) - low + 1) // (1 << CELL_BITS)))
    return low, width, packed((vectors - low) // width)


class Bounds:
    """Products of a block's cells with queries: no exact product is under lower() or over upper()."""

    def __init__(self, dims: int, low: np.ndarray, width: np.ndarray, cells: bytes):
        self.corners = unpacked(cells, dims).astype(float) * width + low
        self.beyond = (width - 1).astype(float)

    def both(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, vectors) lower and upper bounds."""
        at = queries @ self.corners.T
        rounding = 1e-12 * (np.abs(queries) @ np.abs(self.corners).max(axis=0)) if len(self.corners) else np.zeros(len(queries))
        under, over = np.minimum(queries, 0) @ self.beyond - rounding, np.maximum(queries, 0) @ self.beyond + rounding
        return at + under[:, None], at + over[:, None]


def integer_vectors(table: DataFrame, id_column: str, vector: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; rows with a null or non-finite component, or without id, are left out."""
    x = F.col(vector)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    return table.where(F.col(id_column).isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(finite).select(
        F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("long")).alias("v"))


def distinct_enough(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among the k best of some query: of equal vectors, k rows of each of the k + 1 smallest ids.

    A query ranks equal vectors by id and leaves out one id, its own, so the others have k before them whatever it asks for.
    """
    same = np.unique(vectors, axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    s, i = same[order], ids[order]
    new_vector = np.concatenate([[True], s[1:] != s[:-1]])
    new_id = new_vector | np.concatenate([[True], i[1:] != i[:-1]])
    starts = np.flatnonzero(new_id)
    of_id = np.cumsum(new_id) - 1
    within = np.arange(len(i)) - starts[of_id]
    nth_id = of_id - of_id[np.flatnonzero(new_vector)][np.cumsum(new_vector) - 1]
    return np.sort(order[(within < k) & (nth_id <= k)])


def approximation(rows: DataFrame, block_rows: int, k: int) -> DataFrame:
    """FILE of rows (vec_id, row, v): blocks of one dimension each, of at most block_rows vectors, of a task's rows in their order; see distinct_enough()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def block(d: int) -> pa.RecordBatch:
            ids, at, v = (np.concatenate(x) for x in zip(*waiting.pop(d), strict=True))
            kept = distinct_enough(ids, v, k)
            ids, at, v = ids[kept], at[kept], v[kept]
            low, width, cells = quantised(v)
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (ids, at, low, width)), pa.array([cells], pa.binary())], [c.split()[0] for c in FILE.split(", ")])

        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for d in map(int, np.unique(sizes)):
                part = batch.take(pa.array(np.flatnonzero(sizes == d)))
                ids, at, v = part.column("vec_id").to_numpy(), part.column("row").to_numpy(), part.column("v").flatten().to_numpy().reshape(-1, d)
                for lo in range(0, len(ids), block_rows):
                    have = sum(len(x[0]) for x in waiting.get(d, []))
                    to = lo + block_rows
                    if have + len(ids[lo:to]) > block_rows:
                        yield block(d)
                    waiting.setdefault(d, []).append((ids[lo:to], at[lo:to], v[lo:to]))
        for d in list(waiting):
            yield block(d)

    return rows.select("vec_id", "row", "v").mapInArrow(run, FILE)


def _scan(wave, k: int, listing: bool) -> Callable:
    """A task's pass over its blocks. wave: a broadcast list of (dims, ids, queries, least): without listing, the k best lower bounds of each query; with it, all rows whose upper bound reaches least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {d: (ids, q.astype(float), least) for d, ids, q, least in wave.value}
        best = {} if listing else {d: Best(len(x[0]), k, np.float64) for d, x in sets.items()}
        for batch in batches:
            for b in range(batch.num_rows):
                block = {c.split()[0]: batch.column(c.split()[0])[b] for c in FILE.split(", ")}
                d = block["dims"].as_py()
                if d not in sets:
                    continue
                ids, rows, low, width = (block[c].values.to_numpy() for c in ("ids", "rows", "low", "width"))
                bounds, (own, queries, least) = Bounds(d, low, width, block["cells"].as_py()), sets[d]
                order = np.argsort(rows)
                step = max(1, BOUND_BYTES // (16 * len(ids)))
                for at in range(0, len(own), step):
                    part = slice(at, at + step)
                    lower, upper = bounds.both(queries[part])
                    other = own[part, None] != ids
                    if listing:
                        i, j = np.nonzero(other & (upper >= least[part, None]))
                        if len(i):
                            yield pa.RecordBatch.from_arrays([pa.array(own[part][i]), pa.array(rows[j]), pa.array(upper[i, j])], ["query_id", "row", "bound"])
                    else:
                        view = Best.__new__(Best)
                        view.bottom, view.scores, view.ids = best[d].bottom, best[d].scores[part], best[d].ids[part]
                        view.merge(np.where(other, lower, view.bottom)[:, order], rows[order])
        for d, kept in best.items():
            i, j = np.nonzero(kept.scores > kept.bottom)
            yield pa.RecordBatch.from_arrays([pa.array(sets[d][0][i]), pa.array(kept.ids[i, j]), pa.array(kept.scores[i, j])], ["query_id", "row", "bound"])

    return run


def _over_waves(file: DataFrame, queries: DataFrame, waves: int, k: int, listing: bool) -> DataFrame:
    """(query_id, row, bound) of a scan of the file for every wave of queries (wave, vec_id, v, least)."""
    context, found, held = file.sparkSession.sparkContext, None, []
    for w in range(waves):
        batch = queries.where(F.col("wave") == w).toArrow().combine_chunks()  # at most a wave: see exact_top_k()
        sets = []
        for part in batch.to_batches()[:1]:
            sizes = part.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for d in map(int, np.unique(sizes)):
                rows = part.take(pa.array(np.flatnonzero(sizes == d)))
                sets.append((d, rows.column("vec_id").to_numpy(), rows.column("v").flatten().to_numpy().reshape(-1, d), rows.column("least").to_numpy(zero_copy_only=False)))
        held.append(context.broadcast(sets))
        scanned = file.mapInArrow(_scan(held[-1], k, listing), "query_id long, row long, bound double")
        found = scanned if found is None else found.unionAll(scanned)
        if w % WAVES_AT_ONCE == WAVES_AT_ONCE - 1 and w < waves - 1:
            found = materialize(found)
    if not listing:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "row"))
        found = found.withColumn("rank", rank).where(F.col("rank") == k).select("query_id", "row", "bound")
    out = materialize(found)
    for wave in held:
        wave.destroy()
    return out


def _products(candidates: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, row, vec_id, score): exact vectors of candidates (query_id, row), read by row."""
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    met = candidates.select("query_id", "row").join(rows, "row").join(q, "query_id")
    return met.select("query_id", "row", "vec_id", F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b).alias("score"))


def exact_top_k(vectors: DataFrame, is_query: str, k: int = 5, wave: int | None = None, block_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products over all vectors with another id.

    vectors: (vec_id long, v array<long>). Queries: rows that satisfy is_query; a query id that comes in several rows counts with
    its smallest vector. Ties go to the smaller vec_id. Vectors of another dimension than a query's don't meet it. Fewer candidates give
    fewer rows; no query gives none, nor does an empty table. Repeated rows are candidates as often as they come, but rows of the query's id are
    all its own. Products that a long may not hold are an error, not a wrong score. wave and block_rows are from bytes unless given.
    """
    spark, mark = vectors.sparkSession, written()
    shape = vectors.agg(F.max(F.size("v")).alias("dims"), F.max(F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double")))).alias("most")).first()
    dims = max(1, shape["dims"] or 1)
    if dims * (shape["most"] or 0.0) ** 2 >= 2.0**62:
        raise ValueError(f"components up to {shape['most']:.3g} in {dims} dimensions: their products do not fit a long")
    wave = wave or max(1, min(WAVE, WAVE_BYTES // (8 * dims)))
    block_rows = block_rows or max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dims)))
    rows = materialize(vectors.select("vec_id", "v", F.monotonically_increasing_id().alias("row")))
    file = materialize(approximation(rows, block_rows, k))
    queries = materialize(vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
    waves = max(1, -(-queries.count() * 5 // (4 * wave)))
    while True:  # ids are dealt by hash, so a wave may come out larger than the average
        dealt = queries.withColumn("wave", F.pmod(F.xxhash64("vec_id"), F.lit(waves)))
        if (dealt.groupBy("wave").count().agg(F.max("count").alias("n")).first()["n"] or 0) <= wave:
            break
        waves *= 2
    least = _over_waves(file, dealt.withColumn("least", F.lit(float("-inf"))), waves, k, False)
    # fewer than k candidates: all of them are listed
    sought = materialize(dealt.join(least.select(F.col("query_id").alias("vec_id"), F.col("bound").alias("least")), "vec_id", "left").fillna(float("-inf"), ["least"]))
    listed = _over_waves(file, sought, waves, k, True)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "row"))
    ranked = materialize(listed.withColumn("place", order))
    first = materialize(_products(ranked.where(F.col("place") <= FIRST * k), rows, queries))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    certain = first.withColumn("rank", place).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    # a bound is a double, so it is compared with a double; beyond the bound of the kth exact product nothing can enter
    later = ranked.where(F.col("place") > FIRST * k).join(certain, "query_id").where(F.col("bound") >= F.col("kth").cast("double") * F.when(F.col("kth") > 0, 1 - 1e-12).otherwise(1 + 1e-12))
    out = first.unionAll(_products(later, rows, queries)).withColumn("rank", place).where(F.col("rank") <= k)
    out = materialize(out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    discard_since(spark, mark, but=1)
    return out
