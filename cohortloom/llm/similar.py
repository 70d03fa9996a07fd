"""Near duplicates by their sets of shingles, found with SimHash and with minima of hashes, and decided by the sets themselves.

A set's SimHash print is linked by anchor-point covering, as in simhash.py; that finds close texts, but of pairs just at the
similarity sought it misses many. So minima of hashes follow: two texts agree in one minimum with a chance that is their
Jaccard similarity, however few shingles they have and however often a line is repeated. They are candidates where they
agree in all minima of a band.

A first pass takes few links a text (its closest in blocks of a band, never all pairs), checks them, and joins what holds.
A second pass is complete: it goes only over bands in which different components meet, and finds all pairs of different
components there. Their sets come to the cell and are compared in it, and a cell gives at most a link for each two groups
that it joins. So rows stay linear in the texts, also where many are candidates of each other and not similar.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import discard, discard_since, map_text, materialize, whole_text, written
from cohortloom.llm.components import components
from cohortloom.llm.shingles import BANDS, ROWS, band_keys, fewest, minima, orders, shared_counts, shingle_hashes
from cohortloom.llm.simhash import links, majority_bits

#: Texts of a side of a cell of the second pass, and shingles that count as one text more.
SIDE, HEAVY = 4096, 512
#: Texts of a block of the first pass, and bands that it looks at.
BLOCK, FIRST_BANDS = 512, 8


def _set(text: str, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, name, size, fp, least) of texts with words: name is 128 bits of the set, fp its SimHash print, least its minima."""

    def make():
        import xxhash

        factors = orders()

        def work(texts: list[str]) -> dict:
            sets = [_set(t, shingle) for t in texts]
            fp = np.array([majority_bits(s) for s in sets], np.uint64).view(np.int64)
            return {"name": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "size": [len(s) for s in sets], "fp": fp, "least": [minima(s, factors).tobytes() for s in sets]}

        return work

    return map_text(texts, make, "name binary, size int, fp long, least binary", drop_text=True).where("size > 0")


def keys(nodes: DataFrame, carried: list[str], bands: int = BANDS) -> DataFrame:
    """(key, ...carried): a row for each of the first so many bands of each node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                found = band_keys(_minima_of(part["least"].tolist()))[:, :bands]
                yield pd.DataFrame({"key": found.ravel(), **{c: np.repeat(part[c].to_numpy(), bands) for c in carried}})

    return nodes.select("least", *carried).mapInPandas(run, "key long, " + ", ".join(f"{c} long" for c in carried))


def _minima_of(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<u2").reshape(len(rows), BANDS * ROWS)


def _by_cell(names: list[str], out: list[str], work: Callable[[dict], tuple]):
    """Applies work to the columns of each cell of rows that come sorted by the columns `names`; a task holds a batch and a cell."""

    def each(rows: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        columns = {c: _minima_of(rows[c].tolist()) if c == "least" else rows[c].to_numpy() for c in rows}
        found = [work({c: x[lo:hi] for c, x in columns.items()}) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        return pd.DataFrame({c: np.concatenate([f[k] for f in found]) for k, c in enumerate(out)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            ids = rows[names].to_numpy()
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist()]
            if len(cuts) > 1:
                yield each(rows.iloc[: cuts[-1]], cuts)
            rest = rows.iloc[cuts[-1] :]
        if rest is not None and len(rest):
            yield each(rest, [0, len(rest)])

    return run


def closest(nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): for each node, in each of the first bands, the node of its block whose minima agree most, if they agree as at the similarity.

    Bands with many nodes are dealt into blocks, others in each band; so there are at most FIRST_BANDS rows a node.
    """
    likely = round(similarity * BANDS * ROWS)

    def work(block: dict) -> tuple:
        node, least = block["node"], block["least"]
        if len(node) <= 32:
            agree = (least[:, None] == least[None]).sum(axis=2)
        else:
            agree = np.zeros((len(node), len(node)), np.int16)
            for k in range(BANDS * ROWS):
                agree += least[:, k, None] == least[None, :, k]
        agree[node[:, None] == node[None, :]] = -1
        best = agree.argmax(axis=1)
        ok = agree[np.arange(len(node)), best] >= likely
        return node[ok], node[best[ok]]

    keyed = keys(nodes, ["node"], FIRST_BANDS)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = keyed.join(shared, "key").select("node", "key", F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("block"))
    rows = dealt.join(nodes.select("node", "least"), "node").select("key", "block", "node", "least").repartition("key", "block").sortWithinPartitions("key", "block")
    return rows.mapInPandas(_by_cell(["key", "block"], ["a", "b"], work), "a long, b long")


def cells(nodes: DataFrame) -> DataFrame:
    """(key, u, v, part, node): where the nodes (node, size, group, least) of different groups that share a band meet.

    Of a band the largest group is one side and all others are the other, each cut in parts: parts of the others meet each
    other and those of the largest group, whose nodes don't meet each other. A cell is the parts u and v.
    """
    keyed = keys(nodes.withColumn("weight", 1 + F.floor(F.col("size") / HEAVY)), ["node", "group", "weight"])
    groups = keyed.groupBy("key", "group").agg(F.sum("weight").alias("w"))
    sides = groups.groupBy("key").agg(F.max_by("group", F.struct("w", "group")).alias("largest"), F.max("w").alias("large"), F.sum("w").alias("all"), F.count("*").alias("n")).where("n > 1")
    sides = sides.select("key", "largest", F.ceil((F.col("all") - F.col("large")) / SIDE).cast("int").alias("others"), F.ceil(F.col("large") / SIDE).cast("int").alias("parts"))
    is_large, pick = F.col("group") == F.col("largest"), F.xxhash64("node")
    part = F.when(is_large, F.col("others") + F.pmod(pick, "parts")).otherwise(F.pmod(pick, "others")).cast("int")
    dealt = keyed.join(sides, "key").withColumn("part", part)
    below = F.sequence(F.lit(0), F.when(is_large, F.col("others") - 1).otherwise(F.col("part")))  # cells in which it is the second side, or the only one
    above = F.when(is_large, F.array().cast("array<int>")).otherwise(F.sequence(F.col("part") + 1, F.col("others") + F.col("parts") - 1))
    pair = lambda u, v: F.struct(u.cast("int").alias("u"), v.cast("int").alias("v"))
    met = F.concat(F.transform(below, lambda u: pair(u, F.col("part"))), F.transform(above, lambda v: pair(F.col("part"), v)))
    return dealt.select("key", "part", "node", F.explode(met).alias("c")).select("key", "c.u", "c.v", "part", "node")


def _sides(cell: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(cell["part"] == cell["u"][0]), np.flatnonzero(cell["part"] == cell["v"][0])


def with_candidates(met: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The rows of cells() that have a candidate in their cell, and (group): another group's node whose minima agree often enough. A pair counts in its first band."""
    least_agreed, out = fewest(similarity), ["key", "u", "v", "part", "node", "group"]

    def work(cell: dict) -> tuple:
        size, group, minimum = cell["size"], cell["group"], cell["least"]
        bands, (left, right) = band_keys(minimum), _sides(cell)
        at = int(np.argwhere(bands == cell["key"][0])[0, 1])
        has, step = np.zeros(len(size), bool), max(1, 2_000_000 // max(1, len(right)))
        for lo in range(0, len(left), step):
            mine = left[lo : lo + step]
            wanted = group[mine][:, None] != group[right]
            wanted &= np.minimum(size[mine][:, None], size[right]) >= similarity * np.maximum(size[mine][:, None], size[right]) - 1e-9
            for k in range(at):
                wanted &= bands[mine, k][:, None] != bands[right, k]
            i, j = np.nonzero(wanted)
            for some in range(0, len(i), 200_000):
                a, b = mine[i[some : some + 200_000]], right[j[some : some + 200_000]]
                ok = (minimum[a] == minimum[b]).sum(axis=1) >= least_agreed
                has[a[ok]] = has[b[ok]] = True
        return tuple(cell[c][has] for c in out)

    rows = met.join(nodes.select("node", "size", "group", "least"), "node").repartition("key", "u", "v").sortWithinPartitions("key", "u", "v")
    return rows.select(*out, "size", "least").mapInPandas(_by_cell(["key", "u", "v"], out, work), "key long, u int, v int, part int, node long, group long")


def joins(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): of the rows of cells with their sets (shingles array<long>), similar pairs of different groups, one for each two groups that a cell joins."""

    def work(cell: dict) -> tuple:
        node, group, sets = cell["node"], cell["group"].copy(), [np.asarray(s, np.int64) for s in cell["shingles"]]
        size, (left, right), out = np.array([len(s) for s in sets]), _sides(cell), []
        step = max(1, 4_000_000 // max(1, len(right)))
        for lo in range(0, len(left), step):
            mine = left[lo : lo + step]
            open_ = (group[mine][:, None] != group[right]).any(axis=1)
            mine = mine[open_]
            if not len(mine):
                continue
            shared = shared_counts(sets, mine, right)
            ok = shared >= similarity * (size[mine][:, None] + size[right] - shared) - 1e-6
            for i in np.flatnonzero(ok.any(axis=1)).tolist():
                near = right[ok[i]]
                found, first = np.unique(group[near], return_index=True)
                for g, j in zip(found.tolist(), near[first].tolist(), strict=True):
                    if g != group[mine[i]]:
                        out.append((node[mine[i]], node[j]))
                        group[group == g] = group[mine[i]]
        found = np.array(out, np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    return rows.select("key", "u", "v", "part", "node", "group", "shingles").repartition("key", "u", "v").sortWithinPartitions("key", "u", "v").mapInPandas(_by_cell(["key", "u", "v"], ["a", "b"], work), "a long, b long")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of documents that are near another: sets of shingles of a Jaccard similarity of at least `similarity`.

    docs: doc_id, text; other columns are ignored. Null and empty texts, texts without words and rows without doc_id take no
    part; rows of one doc_id stand or fall together; repeated rows and equal sets are one node. An empty table gives none.
    A pair at exactly 0.8 is overlooked about once in 250,000 (by calculation): it shares no band, or its minima agree too
    seldom; above that less often. No size, length or number of partners is a limit: large bands are dealt into cells.
    """
    spark, mark = docs.sparkSession, written()
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    found = materialize(sketches(texts, shingle))
    nodes = materialize(found.groupBy("name").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("size", "fp", "least"))))
    same = found.join(nodes.where("n > 1").select("name", "node"), "name").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    def make():
        return lambda texts: {"shingles": [_set(t, shingle).view(np.int64) for t in texts]}

    def with_sets(rows: DataFrame) -> DataFrame:
        """Rows (node, ...) with the sets of their documents."""
        near = texts.join(rows.select(F.col("node").alias("doc_id")).distinct(), "doc_id")
        return rows.join(map_text(near, make, "shingles array<long>", drop_text=True).withColumnRenamed("doc_id", "node"), "node")

    # few links a node, checked pair by pair
    points = nodes.groupBy("fp").agg(F.min("node").alias("node")).select(F.lit(0).cast("long").alias("print"), "fp", "node")
    covered = links(points, 1).select("a", "b")
    equal = nodes.join(points.select("fp", F.col("node").alias("b")), "fp").select(F.col("node").alias("a"), "b")
    pairs = covered.unionAll(equal).unionAll(closest(nodes, similarity)).where("a <> b")
    pairs = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sets = with_sets(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct())
    a, b = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    close = materialize(pairs.join(a, "a").join(b, "b").where(_enough(F.col("x"), F.col("y"), similarity)).select("a", "b"))
    discard(pairs)
    # what they have not joined is held against every candidate of other components
    grouped = materialize(nodes.join(components(close).withColumnsRenamed({"root": "group"}), "node", "left").withColumn("group", F.coalesce("group", "node")))
    rest = materialize(joins(with_sets(materialize(with_candidates(cells(grouped), grouped, similarity))), similarity))
    out = components(close.unionAll(rest).unionAll(same)).withColumnsRenamed({"node": "doc_id", "root": "component_id"})
    discard_since(spark, mark, but=1)
    return out


def _enough(x: Column, y: Column, similarity: float) -> Column:
    shared = F.size(F.array_intersect(x, y))
    return shared >= F.lit(similarity) * (F.size(x) + F.size(y) - shared) - 1e-6
