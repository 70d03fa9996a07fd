"""Batches drawn class, subject, cell, with a hard cap on what a subject gives to a batch.

Draws are sequential only within a batch: a subject that has given its capacity leaves its class, a class without subjects leaves the
batch, and what is left is drawn from as before. So a batch is a row and is drawn by itself; what it needs to know is how many subjects
of each class have which capacity, a few numbers a class, as subjects are numbered in the order of their capacities. Cells are
looked up by (subject, place) afterwards. Every draw is an md5 of seed, epoch, batch and place, so partitions do not matter.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from hashlib import md5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.draws import draw_u32
from cohortloom.operators.cohorts import ContractError
from cohortloom.operators.splits import _numbered, ordered

#: Most distinct (class, capacity) pairs that a task holds.
MOST_LEVELS = 100_000


def _unit(seed: int, tag: str, epoch: int, batch: int, i: int) -> int:
    return int(md5(f"{seed}|{tag}|{epoch}|{batch}|{i}".encode()).hexdigest()[:8], 16)


def remaining(place: int, taken: list[int]) -> int:
    """The number at that place among those from 0 that are not taken, taken being in order."""
    for t in taken:
        if t > place:
            break
        place += 1
    return place


def draw_batch(size: int, batch: int, levels: list[tuple], seed: int, epoch: int) -> list[tuple[int, int, int]]:
    """(class, subject number, its how manieth draw in the batch) of each draw; levels: (probability, capacities, subjects up to each capacity) a class, in order."""
    gone: list[list[int]] = [[] for _ in levels]
    used: dict[tuple[int, int], int] = {}
    out = []
    for i in range(size):
        open_ = [c for c, (p, _, upto) in enumerate(levels) if p > 0 and len(gone[c]) < upto[-1]]
        total, u, c = sum(levels[c][0] for c in open_), _unit(seed, "class", epoch, batch, i) / 4294967296, open_[-1]
        at = 0.0
        for c in open_:
            at += levels[c][0] / total
            if u < at:
                break
        _, capacities, upto = levels[c]
        s = remaining(_unit(seed, "subject", epoch, batch, i) % (upto[-1] - len(gone[c])), gone[c])
        n = used[c, s] = used.get((c, s), 0) + 1
        out.append((c, s, n - 1))
        if n == capacities[bisect_right(upto, s)]:
            insort(gone[c], s)
    return out


def batch_sizes(batch_size: int, batches: int | None, samples: int | None) -> tuple[int, int]:
    """(batches, size of the last): of so many batches, or of exactly so many samples, the last batch being the rest."""
    if (batches is None) == (samples is None):
        raise ContractError("either batches or samples of an epoch are given")
    if batch_size <= 0 or (batches or samples) <= 0:
        raise ContractError("sizes are positive")
    if batches:
        return batches, batch_size
    n = -(-samples // batch_size)
    return n, samples - (n - 1) * batch_size


def capped_batches(rows: DataFrame, probabilities: DataFrame, batch_size: int, cap: int, replacement: bool, seed: int, batches: int | None = None, samples: int | None = None, by: str = "label", epoch: int = 0) -> DataFrame:
    """(batch, i, by, subject_id, cell_id): batches of exactly their size, in which no subject gives more than cap cells.

    rows: (by, subject_id, cell_id), a cell once, a subject in one class; probabilities: (by, p) as selection_probabilities() gives. With replacement a subject's
    capacity in a batch is cap and cells may repeat; without, it is at most its cells, and no cell comes twice in a batch. Capacity begins anew with each batch.
    A subject or class whose capacity is used up is left out for the rest of the batch, classes' probabilities being taken anew over the rest. Capacities that cannot
    fill a batch, classes without a probability, or subjects of two classes are an error, before anything is drawn. An epoch has draws of its own. Null classes and subjects
    take no part.
    """
    n_batches, last = batch_sizes(batch_size, batches, samples)
    if cap <= 0:
        raise ContractError("the cap is positive")
    rows = rows.where(F.col(by).isNotNull() & F.col("subject_id").isNotNull()).select(F.col(by).alias("_class"), "subject_id", "cell_id")
    counts = rows.groupBy("_class", "subject_id").agg(F.count("*").alias("n"))
    capacity = F.lit(cap).cast("long") if replacement else F.least(F.lit(cap).cast("long"), F.col("n"))
    sized = counts.withColumn("capacity", capacity)
    if sized.groupBy("subject_id").count().where("count > 1").limit(1).count():
        raise ContractError("subjects of several classes")
    found = sized.groupBy("_class", "capacity").agg(F.count("*").alias("n")).orderBy("_class", "capacity").limit(MOST_LEVELS + 1).collect()  # classes x cap
    if len(found) > MOST_LEVELS:
        raise ContractError("too many classes and capacities")
    p = {r[by]: r["p"] for r in probabilities.select(by, "p").collect()}  # a row a class
    classes = sorted({r["_class"] for r in found})
    if not set(classes) <= set(p):
        raise ContractError("classes without a probability")
    levels = []
    for c in classes:
        capacities, upto = [], []
        for r in found:
            if r["_class"] == c:
                capacities.append(r["capacity"])
                upto.append((upto[-1] if upto else 0) + r["n"])
        levels.append((float(p[c]), capacities, upto))
    room = sum(k * (b - a) for pr, ks, ups in levels if pr > 0 for k, a, b in zip(ks, [0, *ups], ups))
    if room < (batch_size if n_batches > 1 else last):
        raise ContractError(f"all capacities together are {room}, which does not fill a batch")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for b in part["id"].tolist():
                drawn = draw_batch(batch_size if b < n_batches - 1 else last, b, levels, seed, epoch)
                yield pd.DataFrame({"batch": b, "i": range(len(drawn)), "c": [x[0] for x in drawn], "s": [x[1] for x in drawn], "use": [x[2] for x in drawn]})

    spark = rows.sparkSession
    drawn = spark.range(n_batches).mapInPandas(run, "batch long, i int, c int, s long, use int")
    # subjects in the order of capacity and then of a hash, in ranges of both
    hashed = sized.withColumn("h", F.md5(F.col("subject_id").cast("string")))
    numbers = _numbered(hashed.withColumn("_p", F.concat(F.lpad(F.col("capacity").cast("string"), 10, "0"), F.substring("h", 1, 3))), ["h", "subject_id"], ["_class"]).select("_class", "subject_id", "n", F.col("k").alias("s"))
    place = spark.createDataFrame(list(enumerate(classes)), f"c int, _class {rows.schema['_class'].dataType.simpleString()}")
    met = drawn.join(F.broadcast(place), "c").join(numbers, ["_class", "s"])
    u = draw_u32(seed, "cell", F.lit(epoch), "batch", "i")
    if replacement:
        chosen = met.withColumn("k", u % F.col("n"))
    else:  # of a subject's draws in a batch, each takes one of the places that are left
        draws = met.groupBy("_class", "batch", "subject_id", "n").agg(F.array_sort(F.collect_list(F.struct("use", "i", u.alias("u")))).alias("draws"))  # at most cap
        left = lambda taken, r: F.aggregate(F.array_sort(taken), r, lambda v, t: F.when(t <= v, v + 1).otherwise(v))
        picks = F.aggregate("draws", F.array().cast("array<bigint>"), lambda taken, d: F.concat(taken, F.array(left(taken, d["u"] % (F.col("n") - F.size(taken))))))
        chosen = draws.withColumn("picks", picks).select("_class", "batch", "subject_id", F.explode(F.arrays_zip(F.col("draws.i").alias("i"), F.col("picks").alias("k"))).alias("x")).select("_class", "batch", "subject_id", "x.i", "x.k")
    cells = ordered(rows, "cell_id", ["_class", "subject_id"])
    return chosen.join(cells, ["_class", "subject_id", "k"]).select("batch", "i", F.col("_class").alias(by), "subject_id", "cell_id")


def batch_report(drawn: DataFrame, by: str = "label") -> DataFrame:
    """(batch, n, n_classes, n_subjects, most_of_a_subject, repeated_cells): what a caller checks a batch by."""
    subjects = drawn.groupBy("batch", by, "subject_id").agg(F.count("*").alias("k"), F.count_distinct("cell_id").alias("d"))
    return subjects.groupBy("batch").agg(F.sum("k").alias("n"), F.count_distinct(by).alias("n_classes"), F.count("*").alias("n_subjects"), F.max("k").alias("most_of_a_subject"), F.sum(F.col("k") - F.col("d")).alias("repeated_cells"))
