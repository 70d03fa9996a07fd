"""Shards of nearly equal size by minimax contiguous partition.

Documents with equal text stay together. Groups are ordered by the hash of their text, and runs of that order make up a
fixed number of atoms, so what the search looks at is bounded however large the corpus is. Atoms larger than a fair share
come first in the order, the largest at its head, then the others by hash. Shards are contiguous runs of that order. The
smallest shard capacity at which greedy filling needs no more than the given shards is found by binary search; as a large
atom fills a shard by itself, whatever the order, it is one run, and the search is over the others and the shards left.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import materialize, whole_text

SHARDS, ATOMS, CELL_ROWS = 40, 1 << 15, 1024


def needed(prefix: list[int], capacity: int) -> list[int]:
    """For each atom, how many shards of at most that capacity the atoms from it on need, filled greedily."""
    out = [0] * len(prefix)
    for i in range(len(prefix) - 2, -1, -1):
        out[i] = 1 + out[bisect_right(prefix, prefix[i] + capacity) - 1]
    return out


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity at which `shards` contiguous runs hold all sizes."""
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    low, high = max([0, *sizes]), prefix[-1]
    while low < high:
        middle = (low + high) // 2
        at = count = 0
        while at < len(sizes) and count <= shards:
            at, count = bisect_right(prefix, prefix[at] + middle) - 1, count + 1
        low, high = (low, middle) if at == len(sizes) and count <= shards else (middle + 1, high)
    return low


def cut(sizes: list[int], shards: int) -> list[int]:
    """The shard of each atom: contiguous, none over the smallest capacity, each cut where it comes nearest to a fair share."""
    capacity, prefix = smallest_capacity(sizes, shards), [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    need, out, at = needed(prefix, capacity), [], 0
    for shard in range(shards):
        after = shards - shard - 1
        last = bisect_right(prefix, prefix[at] + capacity) - 1
        fair = prefix[at] + (prefix[-1] - prefix[at]) / (after + 1)
        ends = [e for e in {bisect_right(prefix, fair) - 1, bisect_right(prefix, fair), last} if at <= e <= last and need[e] <= after]
        end = min(ends, key=lambda e: (abs(prefix[e] - fair), -e)) if after else len(sizes)
        out += [shard] * (end - at)
        at = end
    return out


def assign(atoms: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Shard of each (atom, size): those over a fair share of what is left come first and alone, the largest at the head, the rest by cut(), in the given order."""
    alone, rest = [], list(atoms)
    while len(alone) < shards - 1 and rest:
        total, large = sum(s for _, s in rest), max(rest, key=lambda x: x[1])
        if large[1] * (shards - len(alone)) <= total:
            break
        alone.append(large[0])
        rest.remove(large)
    out = {a: k for k, a in enumerate(alone)}
    return out | {a: len(alone) + k for (a, _), k in zip(rest, cut([s for _, s in rest], shards - len(alone)), strict=True)}


def shard(docs: DataFrame, shards: int = SHARDS, atoms: int = ATOMS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs (doc_id, text; others are ignored).

    size: UTF-8 bytes of the text plus 16, a null text none. Null and empty texts count as equal. slot numbers a shard's
    rows from 0 without gaps: by atom, then in cells of about cell_rows rows, so that no window holds a whole shard.
    Texts of any length count whole. Repeated rows and null ids are rows like others; which of wholly equal rows comes first makes no difference. An empty
    table gives an empty one. The driver sees a sum for each atom.
    """
    spark = docs.sparkSession
    text = whole_text()
    rows = materialize(docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(atoms)).cast("int").alias("atom")))
    sums = rows.groupBy("atom").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).orderBy("atom").collect()
    found = assign([(r["atom"], r["size"]) for r in sums], shards)
    plan = spark.createDataFrame([(r["atom"], found[r["atom"]], -(-r["rows"] // cell_rows)) for r in sums], "atom int, shard int, cells int")
    dealt = rows.join(F.broadcast(plan), "atom").withColumn("cell", F.pmod(F.xxhash64("doc_id", "size"), F.col("cells")).cast("int"))
    # equal rows are one with a count, so that no window holds a row's repeats
    dealt = dealt.groupBy("atom", "shard", "cell", "doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    cells = dealt.groupBy("shard", "atom", "cell").agg(F.sum("copies").alias("rows"))
    order = Window.partitionBy("shard").orderBy("atom", "cell")
    starts = cells.select("atom", "cell", (F.sum("rows").over(order) - F.col("rows")).alias("start"))
    upto = F.sum("copies").over(Window.partitionBy("atom", "cell").orderBy("doc_id", "size", "text_crc32"))
    placed = dealt.withColumn("upto", upto).join(starts, ["atom", "cell"])
    slot = F.explode(F.sequence(F.col("start") + F.col("upto") - F.col("copies"), F.col("start") + F.col("upto") - 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
