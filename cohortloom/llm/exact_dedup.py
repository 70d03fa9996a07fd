"""Exact duplicates by deterministic block naming.

Each text, lower-cased in A-Z, is cut into blocks of fixed size, and every block gets an integer name; then each
document's adjacent names are paired and the pairs named in turn, until every document is one name. A name is a 64-bit
hash and a rank: at each level the distinct (hash, content) rows are sorted out by hash, and of contents that share a
hash, each gets its rank in sorted order. So equal names mean equal contents, whatever the hash does, and names do not
depend on partitions. Distinct contents are pre-aggregated before they are shuffled: a text with a third of all rows
costs its naming once, and no row goes back to a document by a join, as documents compute their names themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import discard, materialize, whole_text

BLOCK_CHARS = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalized(text: str = "text") -> Column:
    """The text with A-Z lower-cased and nothing else changed; null counts as empty."""
    return F.translate(whole_text(text), UPPER, LOWER)


def blocks(text: Column, size: int) -> Column:
    """The text in blocks of `size` characters, the last shorter; an empty text is one empty block."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), 0))


def shared_hashes(named: DataFrame) -> DataFrame:
    """(h): hashes that several contents of (h, content) have."""
    return named.distinct().groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")


def clashes(named: DataFrame, shared: DataFrame) -> DataFrame:
    """(h, content, r): the rank r, over 0, of every content that shares its hash with a smaller one."""
    rank = F.row_number().over(Window.partitionBy("h").orderBy("content")) - 1
    return named.join(shared, "h", "left_semi").distinct().withColumn("r", rank.cast("int")).where("r > 0")


def name_all(rows: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """rows with their column contents (array<string>) replaced by names (array<struct<h, r>>).

    Where no hash is shared, as is usual, all ranks are 0. Else ranks come from the table of clashes by a join, however many there are.
    """
    named = rows.select(F.explode("contents").alias("content")).select(hashed(F.col("content")).cast("long").alias("h"), "content")
    shared = materialize(shared_hashes(named))
    if shared.isEmpty():
        discard(shared)
        return rows.withColumn("names", F.transform("contents", lambda c: F.struct(hashed(c).cast("long").alias("h"), F.lit(0).alias("r")))).drop("contents")
    found = materialize(clashes(named, shared))
    keyed = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    each = keyed.select("row", F.posexplode("contents").alias("at", "content")).withColumn("h", hashed(F.col("content")).cast("long"))
    named = each.join(found, ["h", "content"], "left").select("row", F.struct("at", F.struct("h", F.coalesce("r", F.lit(0)).alias("r")).alias("name")).alias("x"))
    names = named.groupBy("row").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]).alias("names"))
    empty = F.array().cast("array<struct<h:bigint,r:int>>")
    return keyed.join(names, "row", "left").withColumn("names", F.coalesce("names", empty)).drop("row", "contents")


def _pair(names: Column, i: Column) -> Column:
    x, y = F.get(names, 2 * i), F.get(names, 2 * i + 1)
    return F.concat_ws(" ", x["h"], x["r"], y["h"], y["r"])


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, text_sha256, n_blocks, h, r) for every row: (n_blocks, h, r) is the identity of its text."""
    text = docs.select(F.col("doc_id").cast("long"), normalized().alias("text")).select("doc_id", F.sha2("text", 256).alias("text_sha256"), blocks(F.col("text"), block_chars).alias("contents"))
    now = materialize(name_all(text.withColumn("n_blocks", F.size("contents")), hashed))
    done, longest = now.where("n_blocks = 1"), now.agg(F.max("n_blocks")).first()[0] or 1
    now, size = now.where("n_blocks > 1"), F.size("names")
    while longest > 1:
        pairs = F.transform(F.sequence(F.lit(0), F.floor(size / 2).cast("int") - 1), lambda i: _pair(F.col("names"), i))
        odd = F.when(size % 2 == 1, F.slice("names", -1, 1)).otherwise(F.slice("names", 1, 0))
        rows = now.select("doc_id", "text_sha256", "n_blocks", odd.alias("last"), pairs.alias("contents"))
        now, longest = materialize(name_all(rows, hashed).withColumn("names", F.concat("names", "last")).drop("last")), (longest + 1) // 2
        done, now = done.unionByName(now.where(size == 1)), now.where(size > 1)
    return done.select("doc_id", "text_sha256", "n_blocks", F.col("names")[0]["h"].alias("h"), F.col("names")[0]["r"].alias("r"))


def exact_duplicates(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs (doc_id, text; other columns are ignored).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest doc_id of each
    group is kept; of repeated rows with that id, one. Rows with a null doc_id are kept, one of them, only in a group
    without other ids. Texts of any length are cut into blocks and read whole. An empty table gives an empty one.
    """
    rows = identities(docs, block_chars)
    # equal rows are one with a count, so that the join below meets each (text, doc_id) once
    rows = materialize(rows.groupBy("doc_id", "text_sha256", "n_blocks", "h", "r").agg(F.count("*").alias("copies")))
    groups = rows.groupBy(F.col("n_blocks").alias("g_n"), F.col("h").alias("g_h"), F.col("r").alias("g_r")).agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = materialize(groups.where("group_size > 1"))  # a shuffle of its own on either side lets skewed groups be split
    same = (F.col("n_blocks") == F.col("g_n")) & (F.col("h") == F.col("g_h")) & (F.col("r") == F.col("g_r"))
    joined = rows.join(groups, same, "left").withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return joined.select("doc_id", "keep_id", F.coalesce("group_size", F.lit(1)).alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
