"""How filters interact: what each removes, repeats and costs in every order, by the removal polynomial of each part.

Documents are counted by the set of filters they fail (a mask). Of a part with n[m] documents of mask m, the multilinear
extension of "documents removed by a set of filters" is f(x) = sum of n[m] (1 - product over i in m of (1 - x_i)), a polynomial with
a coefficient for each set of filters. At a corner (a set's indicator) it says how many documents that set removes, so corners give
what survives each step of an order. The integral over t of its i-th partial derivative at (t, ..., t) is filter i's Shapley value, taken
here in exact rationals; times the number of orders it is what the filter removes, summed over all orders.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import map_text, materialize
from cohortloom.llm.words import word_chunks

#: The filters in order of their bits: too few words, too few distinct ones, too many capitals, markup characters, copies.
LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
SYMBOLS = re.compile(r"[#$%&*|]")
_NOT_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)


def text_mask(text: str, data: bytes) -> int:
    """Bits of the filters among A to D that a text fails; data is its UTF-8."""
    n, distinct = 0, set()
    for words in word_chunks(data):
        n += len(words)
        distinct.update(words)
    capitals = len(data.translate(None, _NOT_CAPITALS))
    fails = (n < 50, 100 * len(distinct) < 65 * n, 100 * capitals > 5 * len(text), SYMBOLS.search(text) is not None)
    return sum(1 << k for k, failed in enumerate(fails) if failed)


def _masks() -> Callable:
    def work(texts: list[str]) -> dict:
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        return {"mask": [text_mask(t, b) for t, b in zip(texts, data, strict=True)], "digest": [hashlib.sha256(b).digest() for b in data]}

    return work


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail, at most 32 rows a part.

    A null text is empty, a null source the empty string. Filter E fails a row whose text, by its SHA-256, a smaller doc_id has anywhere; a row
    without id neither fails it nor makes others fail. Rows that share an id share the fate of that id's text. A document is good or toxic
    if any label of its id says so. Repeated rows are counted before they meet anything, so they don't gather in a task; a text's copies meet
    by (text, doc_id).
    """
    texts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")
    rows = materialize(map_text(texts, _masks, "mask int, digest binary", drop_text=True))
    named, nameless = rows.where("doc_id is not null"), rows.where("doc_id is null").select("part", "mask", F.lit(1).cast("long").alias("n"), F.lit(False).alias("is_good"), F.lit(False).alias("is_toxic"))
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    each = named.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    held = each.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    mask = F.when(F.col("is_first"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(F.lit(COPY)))
    masked = held.select("part", mask.alias("mask"), "n", "is_good", "is_toxic").unionAll(nameless)
    return masked.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("is_good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("is_toxic"), F.col("n")).otherwise(0)).alias("toxic"))


class RemovalPolynomial:
    """Coefficients, by set of filters, of the multilinear extension of how many documents a set of filters removes."""

    def __init__(self, counts: dict[int, int], filters: int):
        self.filters = filters
        subsets = range(1, 1 << filters)
        above = {t: sum(n for m, n in counts.items() if m & t == t) for t in subsets}
        self.coefficients = {t: c if t.bit_count() % 2 else -c for t, c in above.items() if c}

    def corner(self, chosen: int) -> int:
        """Its value at the indicator of a set: the documents that fail any filter of it."""
        return sum(c for t, c in self.coefficients.items() if t & ~chosen == 0)

    def shapley(self, k: int) -> Fraction:
        """The integral of the k-th partial derivative along the diagonal: a term c x^T gives c t^(|T| - 1), which integrates to c / |T|."""
        return sum((Fraction(c, t.bit_count()) for t, c in self.coefficients.items() if t >> k & 1), Fraction(0))


def order_steps(counts: dict[int, tuple[int, int, int]], letters: str = LETTERS) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of a part with counts by mask of (n, good, toxic)."""
    every, good, toxic = (RemovalPolynomial({m: c[k] for m, c in counts.items()}, len(letters)) for k in range(3))
    n, whole = sum(c[0] for c in counts.values()), (1 << len(letters)) - 1
    corners = {s: (every.corner(s), good.corner(s), toxic.corner(s)) for s in range(whole + 1)}
    alone = [corners[whole][0] - corners[whole & ~(1 << k)][0] for k in range(len(letters))]
    shapley = [every.shapley(k) * factorial(len(letters)) for k in range(len(letters))]
    if any(s.denominator != 1 for s in shapley):
        raise ArithmeticError("removals over all orders are whole numbers")
    out = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, k in enumerate(order, 1):
            after = before | 1 << k
            removed, good_lost, toxic_lost = (a - b for a, b in zip(corners[after], corners[before], strict=True))
            out.append(("".join(letters[i] for i in order), step, n - corners[after][0], removed, corners[1 << k][0] - removed, alone[k], good_lost, toxic_lost, int(shapley[k])))
            before = after
    return out


STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, ...) as STEPS says, for every part and order: 600 rows a part with five filters, zeros included; an empty table gives none.

    counts: (part, mask, n, good, toxic), bit k of a mask for letter k. A part's polynomial has 32 coefficients, whatever its documents.
    """
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # a row a mask

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STEPS.split(", ")]
        for batch in batches:
            for part, cells in zip(batch["part"], batch["cells"], strict=True):
                steps = order_steps({c["mask"]: (c["n"], c["good"], c["toxic"]) for c in cells}, letters)
                yield pd.DataFrame([(part, *s) for s in steps], columns=names)

    return parts.mapInPandas(run, STEPS)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions() of mask_counts(): whole texts of any length, nulls as stated there, columns beside the named ones ignored."""
    return interactions(mask_counts(docs, labels))
