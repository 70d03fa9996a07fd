"""Chat formatting by quotation linking.

Lines that begin with quote marks are parsed into levels. Runs of one level are passages. A passage is hashed twice, as one
text and as a sequence of lines (white space and case normalised, blank lines left out), and joined to the hashes of what
earlier messages of the conversation wrote: their whole text, paragraphs, lines, and every run of as many lines as some
passage has. Of the outermost level that some earlier message wrote a passage of, the latest such message is what a message
replies to; without one, it replies to the turn before. A reply to the turn before goes on with its thread, another reply
opens one. Messages come out without quotes, with their place in a pre-order walk of the tree of replies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import map_text, materialize

TURNS_A_BLOCK = 4096
MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
#: Modulus and base of the hash of line sequences.
PRIME, BASE = 2**127 - 1, 0x9E3779B97F4A7C15F39CC0605CEDC834


def normalized(passage: str) -> str:
    return " ".join(passage.split()).lower()


def runs(text: str) -> list[tuple[int, str]]:
    """(level, text) of the runs of lines of one quote level, in order, without their marks."""
    if ">" not in text:
        return [(0, text)]
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = MARKS.match(line)
        level, body = (m[1].count(">"), line[m.end() :]) if m else (0, line)
        if out and out[-1][0] == level:
            out[-1][1].append(body)
        else:
            out.append((level, [body]))
    return [(level, "\n".join(lines)) for level, lines in out]


def text_hash(passage: str) -> bytes:
    import xxhash

    return b"t" + xxhash.xxh3_128_digest(passage.encode("utf-8", "surrogatepass"))


def line_hashes(text: str) -> list[int]:
    """A number for each line that is not blank."""
    import xxhash

    return [xxhash.xxh3_128_intdigest(x.encode("utf-8", "surrogatepass")) for line in text.split("\n") if (x := normalized(line))]


def run_hashes(lines: list[int], n: int) -> Iterator[bytes]:
    """A name of every run of n lines, in time linear in the lines."""
    lead, value = pow(BASE, n - 1, PRIME), 0
    for k, x in enumerate(lines):
        if k >= n:
            value = (value - lines[k - n] * lead) % PRIME
        value = (value * BASE + x) % PRIME
        if k >= n - 1:
            yield b"l" + n.to_bytes(8, "big") + value.to_bytes(16, "big")


def parsed(messages: DataFrame) -> DataFrame:
    """messages with their text, in which quoted lines are left out, and passages: (level, lines, hashes) of each quoted run that has words."""

    def make():
        def work(texts: list[str]) -> dict:
            own, passages = [], []
            for text in texts:
                found = runs(text)
                own.append(re.sub(r"\n{3,}", "\n\n", "\n".join(t for level, t in found if not level)).strip(" "))
                mine = []
                for level, t in found:
                    if level and (lines := line_hashes(t)):
                        mine.append({"level": level, "lines": len(lines), "hashes": [text_hash(normalized(t)), next(run_hashes(lines, len(lines)))]})
                passages.append(mine)
            return {"text": own, "passages": passages}

        return work

    return map_text(messages, make, "text string, passages array<struct<level:int,lines:int,hashes:array<binary>>>")


def wrote(said: DataFrame) -> DataFrame:
    """(conv_id, turn, hash) of what messages (conv_id, turn, text, lengths) wrote: whole text, paragraphs, lines, and runs of as many lines as `lengths` has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[str, list] = {"conv_id": [], "turn": [], "hash": []}
            for conv, turn, text, lengths in zip(batch["conv_id"], batch["turn"], batch["text"], batch["lengths"], strict=True):
                lines = line_hashes(text)
                names = {text_hash(x) for part in (text, *re.split(r"\n\s*\n", text), *text.split("\n")) if (x := normalized(part))}
                for n in lengths:
                    if n <= len(lines):
                        names.update(run_hashes(lines, int(n)))
                for column, values in (("conv_id", [conv] * len(names)), ("turn", [turn] * len(names)), ("hash", names)):
                    found[column].extend(values)
                if len(found["hash"]) > 50_000:
                    yield pd.DataFrame(found)
                    found = {"conv_id": [], "turn": [], "hash": []}
            yield pd.DataFrame(found)

    return said.select("conv_id", "turn", "text", "lengths").mapInPandas(run, "conv_id long, turn long, hash binary")


def block(turn: str) -> Column:
    return F.floor(F.col(turn) / TURNS_A_BLOCK)


def latest_sources(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(conv_id, turn, level, source): the last turn before each quoting one that wrote the hash, by running maxima in blocks of turns.

    A passage that many turns quote and write costs a row for each, not for each pair.
    """
    known = sources.join(quotes.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    both = quotes.select("conv_id", "hash", "turn", "level", F.lit(None).cast("long").alias("source")).unionAll(known.select("conv_id", "hash", "turn", F.lit(None).cast("int"), F.col("turn")))
    both = both.withColumn("block", block("turn"))
    inside = F.max("source").over(Window.partitionBy("conv_id", "hash", "block").orderBy("turn", F.col("source").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    blocks = both.groupBy("conv_id", "hash", "block").agg(F.max("source").alias("last"))
    across = F.max("last").over(Window.partitionBy("conv_id", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    found = both.withColumn("inside", inside).where("level is not null").join(blocks.select("conv_id", "hash", "block", across.alias("across")), ["conv_id", "hash", "block"])
    return found.select("conv_id", "turn", "level", F.coalesce("inside", "across").alias("source")).where("source is not null")


def threads(turns: DataFrame, linked: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, thread, place): the thread of each turn of (conv_id, turn), and its place there; linked is (conv_id, turn, source)."""
    placed = turns.withColumn("block", block("turn"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    sizes = placed.groupBy("conv_id", "block").agg(F.max("turn").alias("last"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block")
    sizes = sizes.select("conv_id", "block", F.lag("last").over(before).alias("across"), (F.sum("n").over(before) - F.col("n")).alias("start"))
    nodes = placed.withColumns({"inside": F.lag("turn").over(inside), "k": F.row_number().over(inside)}).join(sizes, ["conv_id", "block"])
    nodes = nodes.select("conv_id", "turn", "block", (F.col("start") + F.col("k")).alias("rank"), F.coalesce("inside", "across").alias("previous")).join(linked, ["conv_id", "turn"], "left")
    opens = F.col("previous").isNull() | (F.col("source").isNotNull() & (F.col("source") != F.col("previous")))
    nodes = nodes.select("conv_id", "turn", "block", "rank", F.coalesce("source", "previous").alias("parent_turn"), F.when(opens, F.struct("turn", "rank")).alias("opened"))
    running = F.max("opened").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    blocks = nodes.groupBy("conv_id", "block").agg(F.max("opened").alias("last"))
    across = F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1))
    out = nodes.withColumn("inside", running).join(blocks.select("conv_id", "block", across.alias("across")), ["conv_id", "block"]).withColumn("at", F.coalesce("inside", "across"))
    return out.select("conv_id", "turn", "parent_turn", F.col("at.turn").alias("thread"), (F.col("rank") - F.col("at.rank")).alias("place"))


def walk(nodes: DataFrame) -> DataFrame:
    """(conv_id, thread, first, above): the position of each thread's first turn in the pre-order walk, and the replies above it.

    nodes is what threads() gives; of a turn's replies the earlier come first. Threads stay whole in the walk, and those that
    a thread's later turns opened come before those of its earlier turns. The walk is an Euler tour of the threads, down and
    up, ranked by pointer jumping. Conversations of one thread need none.
    """
    lengths = nodes.groupBy("conv_id", "thread").agg(F.count("*").alias("length"))
    opened = nodes.where("turn = thread").select("conv_id", "thread", F.col("parent_turn").alias("source")).join(lengths, ["conv_id", "thread"])
    source = nodes.select("conv_id", F.col("turn").alias("source"), F.col("thread").alias("up"), (F.col("place") + 1).alias("rise"))
    tree = materialize(opened.join(source, ["conv_id", "source"], "left"))
    branched = tree.where("up is not null")
    tree = tree.join(branched.select("conv_id").distinct(), "conv_id", "left_semi")
    siblings = branched.withColumn("following", F.lead("thread").over(Window.partitionBy("conv_id", "up").orderBy(F.desc("source"), "thread")))
    first = branched.groupBy("conv_id", F.col("up").alias("thread")).agg(F.min(F.struct(-F.col("source"), F.col("thread").alias("child")))["child"].alias("child"))
    down = tree.join(first, ["conv_id", "thread"], "left").select("conv_id", (F.col("thread") * 2).alias("e"), F.coalesce(F.col("child") * 2, F.col("thread") * 2 + 1).alias("next"), "length", F.coalesce("rise", F.lit(0)).alias("rise"))
    up = siblings.select("conv_id", (F.col("thread") * 2 + 1).alias("e"), F.coalesce(F.col("following") * 2, F.col("up") * 2 + 1).alias("next"), F.lit(0).alias("length"), (-F.col("rise")).alias("rise"))
    end = tree.where("up is null").select("conv_id", (F.col("thread") * 2 + 1).alias("e"), F.lit(None).cast("long").alias("next"), F.lit(0).alias("length"), F.lit(0).alias("rise"))
    sums = _suffix_sums(materialize(down.unionAll(up).unionAll(end)))
    total = nodes.groupBy("conv_id").agg(F.count("*").alias("turns"))
    ranked = sums.where("e % 2 = 0").select("conv_id", (F.col("e") / 2).cast("long").alias("thread"), "length", "rise").join(total, "conv_id")
    own = branched.select("conv_id", "thread", F.col("rise").alias("own"))
    return ranked.join(own, ["conv_id", "thread"], "left").select("conv_id", "thread", (F.col("turns") - F.col("length")).alias("first"), (F.coalesce("own", F.lit(0)) - F.col("rise")).alias("above"))


def _suffix_sums(chain: DataFrame) -> DataFrame:
    """chain (conv_id, e, next, length, rise) with length and rise summed from each e to the end: each round doubles the way, and takes only rows that have not come to it."""
    done, active = chain.where("next is null"), chain.where("next is not null")
    while active.limit(1).count():
        ahead = done.unionByName(active).select("conv_id", F.col("e").alias("next"), F.col("next").alias("next2"), F.col("length").alias("length2"), F.col("rise").alias("rise2"))
        jumped = materialize(active.join(ahead, ["conv_id", "next"]).select("conv_id", "e", F.col("next2").alias("next"), (F.col("length") + F.col("length2")).alias("length"), (F.col("rise") + F.col("rise2")).alias("rise")))
        done, active = done.unionByName(jumped.where("next is null")), jumped.where("next is not null")
    return done


def link_quotations(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, parent_turn, quotes, thread, depth, position) for every message.

    conversations: conv_id, turn, role, text; other columns are ignored. text comes without quoted lines, quotes counts the
    quoted passages, thread is the turn that opened the message's thread, depth counts the replies above it, position is its
    place from 0 in the conversation's reply order: no reply precedes what it replies to. Null and empty texts count as
    empty; very long ones are read once for each length of a quoted passage in the conversation. Rows with a null conv_id or
    turn have no parent, are their own thread and take no part. Repeated (conv_id, turn) share all but role and text; an
    empty table gives an empty one.
    """
    columns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = materialize(parsed(columns))
    known = rows.where("conv_id is not null and turn is not null")
    passages = known.where(F.size("passages") > 0).select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.level", "p.lines", F.explode("p.hashes").alias("hash"))
    lengths = passages.groupBy("conv_id").agg(F.collect_set("lines").alias("lengths"))
    found = latest_sources(passages.select("conv_id", "turn", "level", "hash").distinct(), wrote(known.join(lengths, "conv_id")).distinct())
    linked = found.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "source"))["source"].alias("source"))
    nodes = materialize(threads(known.select("conv_id", "turn").distinct(), linked))
    placed = nodes.join(walk(nodes), ["conv_id", "thread"], "left").select(
        "conv_id", "turn", "parent_turn", "thread", (F.coalesce("above", F.lit(0)) + F.col("place")).cast("int").alias("depth"), (F.coalesce("first", F.lit(0)) + F.col("place")).alias("position"))
    return rows.join(placed, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "parent_turn", F.size("passages").alias("quotes"), F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("position", F.lit(0)).cast("long").alias("position"))
