"""SimHash near-duplicates by anchor-point covering.

A fingerprint of 64 bits is cut into three blocks (21, 21 and 22 bits). Of two fingerprints that differ in at most t bits,
some block differs in at most t/3, and some two blocks together in at most 2t/3. The anchors of a block are the 4,096 words
of the binary Golay code (23, 12), whose covering radius is 3. Two values that differ in b bits have a point between them,
b/2 away from either (rounded down for one), and that point an anchor within 3. So every fingerprint is replicated to
all anchors within the covering radius plus its part of the block's threshold, and those within the smaller radius are
compared with all at that anchor. With 4 bits and one block that is the home anchor against anchors within 4.

order 1 uses one block a table (12 key bits, 16 rows a fingerprint), order 2 the product code of two blocks (24 key bits,
29 rows); both find every pair. Work goes over distinct fingerprints. Anchors with many rows are dealt out as a grid of
cells, so no task holds more than a cell's inner rows, and a row gives links to its closest rows and to each group of linked
rows it joins, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import map_text, materialize, whole_text
from cohortloom.llm.components import components
from cohortloom.llm.shingles import shingle_hashes

BITS, THRESHOLD = 64, 4
#: First bit and width of each block.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
#: Inner rows and rows of a cell.
CELL_INNER, CELL_ROWS = 8192, 65536
#: Distinct fingerprints beyond which two blocks make the key.
ORDER_2_FROM = 50_000_000

def majority_bits(hashes: np.ndarray) -> int:
    """A bit is 1 if over half of the hashes have it."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(bit) for bit in np.flatnonzero(2 * ones > len(hashes)))


def fingerprint(text: str, shingle: int = 4) -> int:
    """SimHash of one text, 0 to 2^64 - 1; without words 0."""
    return majority_bits(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fingerprints as signed longs."""

    def make():
        return lambda texts: {"fp": np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)}

    return map_text(docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")), make, "fp long", drop_text=True)


def _syndromes(values: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit values by the generator."""
    rest = values.copy()
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GOLAY << (bit - 11))
    return rest


def cosets(radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the 2,048 syndromes, the error patterns of weight at most radius: where they begin, patterns, weights."""
    patterns = np.array([sum(1 << b for b in c) for w in range(radius + 1) for c in combinations(range(23), w)], dtype=np.int64)
    weights = np.repeat(np.arange(radius + 1), [len(list(combinations(range(23), w))) for w in range(radius + 1)])
    syndromes = _syndromes(patterns)
    order = np.lexsort((weights, syndromes))
    return np.searchsorted(syndromes[order], np.arange(2049)), patterns[order], weights[order]


def _spread(values: np.ndarray, table: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, anchors and weights of all anchors near each 23-bit value."""
    begins, patterns, weights = table
    s = _syndromes(values)
    counts = begins[s + 1] - begins[s]
    rows = np.repeat(np.arange(len(values)), counts)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins[s], counts)
    return rows, (values[rows] ^ patterns[at]) >> 11, weights[at]


def anchors(points: DataFrame, order: int, threshold: int = THRESHOLD) -> DataFrame:
    """(key, inner, fp, node) and group, if points has it: a row for each anchor that a fingerprint is compared at; inner is true within the smaller radius."""
    carried = _carried(points)
    budget = order * threshold // 3
    inner, outer = budget // 2, budget - budget // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = cosets(3 + outer)
        for batch in batches:
            for part in range(0, len(batch), 2048):
                own = {c: batch[c].to_numpy()[part : part + 2048] for c in ("print", *carried)}
                kind, fp = own.pop("print"), own["fp"]
                near = [_spread((fp.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1), table) for first, width in BLOCKS]
                for k, chosen in enumerate(combinations(range(3), order)):
                    rows, key, weight = near[chosen[0]]
                    over = np.maximum(weight - 3, 0)
                    for other in chosen[1:]:
                        rows2, key2, weight2 = near[other]
                        begins = np.searchsorted(rows2, np.arange(len(fp) + 1))
                        counts = (begins[1:] - begins[:-1])[rows]
                        left = np.repeat(np.arange(len(rows)), counts)
                        at = np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins[:-1][rows], counts)
                        both = over[left] + np.maximum(weight2[at] - 3, 0)
                        left, at, over = left[both <= outer], at[both <= outer], both[both <= outer]
                        rows, key = rows[left], key[left] * 4096 + key2[at]
                    yield pd.DataFrame({"key": key + (k << 24) + (kind[rows] << 26), "inner": over <= inner, **{c: x[rows] for c, x in own.items()}})

    return points.select("print", *carried).mapInPandas(run, "key long, inner boolean, " + ", ".join(f"{c} long" for c in carried))


def _carried(points: DataFrame) -> list[str]:
    return [c for c in ("fp", "node", "group") if c in points.columns]


class _Cell:
    """The inner rows of a cell and the groups that links have made of them; others are shown to it in batches.

    Rows of one `own` value are not compared. Without a number of partners every pair within the threshold is found.
    """

    def __init__(self, threshold: int, partners: int | None):
        self.threshold, self.partners, self.found = threshold, partners, {}
        self.fp, self.node, self.own, self.group = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))

    def add(self, fp: np.ndarray, node: np.ndarray, own: np.ndarray) -> None:
        start = len(self.fp)
        self.fp, self.node, self.own = np.concatenate([self.fp, fp]), np.concatenate([self.node, node]), np.concatenate([self.own, own])
        self.group = np.concatenate([self.group, np.arange(start, start + len(fp))])

    def show(self, fp: np.ndarray, node: np.ndarray, own: np.ndarray) -> Iterator[pd.DataFrame]:
        """Links of the rows to inner rows, as many as there are or enough to go on with."""
        step = max(1, 4_000_000 // max(1, len(self.fp)))
        for at in range(0, len(fp), step):
            apart = np.bitwise_count(fp[at : at + step, None] ^ self.fp[None, :])
            apart[own[at : at + step, None] == self.own[None, :]] = 255
            if self.partners is None:
                i, h = np.nonzero(apart <= self.threshold)
                me, other = node[at + i], self.node[h]
                yield pd.DataFrame({"a": np.maximum(me, other), "b": np.minimum(me, other), "apart": apart[i, h].astype(np.int64)}).drop_duplicates()
            else:
                self._closest(apart, node[at : at + step])
                if len(self.found) > 100_000:
                    yield self.links()

    def _closest(self, apart: np.ndarray, node: np.ndarray) -> None:
        """Link each row to its closest inner rows, and to one of each group within the threshold that it is not in yet."""
        for i in np.flatnonzero((apart <= self.threshold).any(axis=1)).tolist():
            near = np.flatnonzero(apart[i] <= self.threshold)
            near = near[np.argsort(apart[i, near], kind="stable")]
            kept = near[: self.partners].tolist()
            groups, first = np.unique(self.group[near], return_index=True)
            if len(groups) > 1:
                kept += near[first].tolist()
                self.group[np.isin(self.group, groups)] = groups[0]
            me = int(node[i])
            for h in kept:
                other = int(self.node[h])
                self.found[max(me, other), min(me, other)] = int(apart[i, h])

    def links(self) -> pd.DataFrame:
        out, self.found = [(a, b, w) for (a, b), w in self.found.items()], {}
        return pd.DataFrame(out, columns=["a", "b", "apart"], dtype="int64")


def _comparing(threshold: int, partners: int | None, own_column: str):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by cell, inner rows first; the others are streamed past the cell's inner rows."""
        name, cell = None, _Cell(threshold, partners)
        for batch in batches:
            ids = batch[["key", "s", "r"]].to_numpy()
            inner, fp, node, own = batch["inner"].to_numpy(bool), batch["fp"].to_numpy().view(np.uint64), batch["node"].to_numpy(), batch[own_column].to_numpy()
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if tuple(ids[lo]) != name:
                    if cell.found:
                        yield cell.links()
                    name, cell = tuple(ids[lo]), _Cell(threshold, partners)
                mine = inner[lo:hi]
                cell.add(fp[lo:hi][mine], node[lo:hi][mine], own[lo:hi][mine])
                if len(cell.fp):
                    yield from cell.show(fp[lo:hi], node[lo:hi], own[lo:hi])
        if cell.found:
            yield cell.links()

    return compare


def links(points: DataFrame, order: int, threshold: int = THRESHOLD, partners: int | None = 1) -> DataFrame:
    """(a, b, apart): nodes of fingerprints within the threshold, enough of them to connect all that are connected.

    At each anchor a row is linked to its `partners` closest rows besides; without a number to all, where points has a
    column group to all of other groups.

    points: (print, fp, node), one row a distinct fingerprint (of each group); only those of one print are compared.
    """
    carried = _carried(points)
    rows = anchors(points, order, threshold)
    sizes = rows.groupBy("key").agg(F.count_if("inner").alias("inner"), F.count("*").alias("all"))
    heavy = sizes.where((F.col("inner") > CELL_INNER) | (F.col("all") > CELL_ROWS)).select(
        "key", F.greatest(F.lit(1), F.ceil(F.col("inner") / CELL_INNER)).cast("int").alias("k"), F.ceil(F.col("all") / CELL_ROWS).cast("int").alias("m"))
    if order == 1:  # no more keys than 3 x 4,096 a print
        heavy = F.broadcast(heavy)
    rows = rows.join(heavy, "key", "left").withColumns({"k": F.coalesce("k", F.lit(1)), "m": F.coalesce("m", F.lit(1))})
    # in a grid, an inner row also goes to the other rows' cells, to meet inner rows there
    also = F.when(F.col("inner") & (F.col("k") * F.col("m") > 1), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.col("inner")))
    rows = rows.withColumn("inner", F.explode(also)).withColumn("pick", F.xxhash64("fp"))
    rows = rows.withColumn("s", F.when(F.col("inner"), F.array(F.pmod("pick", "k").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.withColumn("r", F.when(F.col("inner"), F.sequence(F.lit(0), F.col("m") - 1)).otherwise(F.array(F.pmod(F.shiftright("pick", 20), F.col("m")).cast("int"))))
    rows = rows.select("key", F.explode("s").alias("s"), "r", "inner", *carried).select("key", "s", F.explode("r").alias("r"), "inner", *carried)
    return rows.repartition("key", "s", "r").sortWithinPartitions("key", "s", "r", F.desc("inner")).mapInPandas(_comparing(threshold, partners, carried[-1]), "a long, b long, apart long")


def near_duplicates(docs: DataFrame, shingle: int = 4, order: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text; other columns are ignored).

    component_id: the least doc_id in reach over links of at most 4 differing bits. Null text counts as empty; texts
    without words have fingerprint zero, linked like any other. Repeated rows give repeated rows. A null doc_id never
    becomes a component's id unless its component has no other. Texts of any length are read whole, one at a time. An empty table gives
    none. Memory: a cell of an anchor in a task.
    """
    prints = materialize(fingerprints(docs, shingle))
    points = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null").select(F.lit(0).cast("long").alias("print"), "fp", "node"))
    roots = components(links(points, _order(points) if order is None else order).select("a", "b"))
    found = points.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(found, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _order(points: DataFrame) -> int:
    return 1 if points.count() < ORDER_2_FROM else 2
