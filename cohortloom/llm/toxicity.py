"""Toxicity by a weighted finite-state pattern grammar.

A lexicon reads words as classes: insult, threat, intent, target, object, negation, report and other. Five transducers are
composed into one machine that reads a clause: negation and report turn what stands in their scope into other symbols,
threat joins a verb to its intent and object, insult finds whom it is aimed at, and the last gives every matched pattern its
weight. A document's score is a logistic curve of its patterns' sums. The lexicon's insult and threat stems and the
weights of the arcs are learned from labelled rows; the closed classes and the weights' priors are fixed. Where data have no
case of a pattern, its prior stands, so an isolated word counts for less than one that is aimed at somebody.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import crf
from cohortloom.llm.common import labelled_sample, map_text, materialize

#: Bounds of what is fitted: labelled rows of each class, characters of a row, stems, stem lengths.
PER_CLASS, MAX_CHARS, MAX_STEMS, STEMS = 3000, 40_000, 2000, range(3, 13)
#: Evidence (log-likelihood ratio) and log-odds that make a stem; share of its uses as threats that makes it one.
LEAST_EVIDENCE, LEAST_ODDS, ROUNDS, THREAT_SHARE = 30.0, 3.0, 8, 0.5
#: Symbols that the lexicon gives.
INSULT, THREAT, INTENT, TARGET, OBJECT, NOT, SAID, OTHER = "insult", "threat", "intent", "target", "object", "not", "said", "other"
#: Symbols of matched patterns: an insult at somebody, the target after an insult, an insult or threat denied or reported, a threat to somebody.
AIMED, AIM, NEGATED, REPORTED, THREATENS = "aimed", "aim", "negated", "reported", "threatens"
SYMBOLS = (INSULT, THREAT, INTENT, TARGET, OBJECT, NOT, SAID, OTHER, AIMED, AIM, NEGATED, REPORTED, THREATENS)
#: Words of the closed classes in English, German, French and Spanish, first insults and threats.
WORDS = {
    NOT: "not never no don't doesn't isn't aren't wasn't won't nicht kein keine nie niemals pas jamais ne nunca jamás ni",
    SAID: "said says say wrote writes claimed claims called reported quoted sagte sagt schrieb behauptete dit disait écrit dijo dice escribió afirmó",
    INTENT: "will i'll we'll gonna going shall want werde werden wir'll vais allons veux voy vamos quiero",
    TARGET: "you your you're yourself u du ihr tu vous tú usted ustedes vosotros he she they his their",
    OBJECT: "him her them dich dir euch ihn toi te ti os",
    THREAT: "kill hurt destroy murder stab shoot beat töten umbringen schlagen tuer frapper matar golpear",
    INSULT: "idiot stupid moron loser scum worthless pathetic disgusting trash clown idiota imbécile dumm trottel estúpido imbécil",
}
#: Features of the curve, with the prior of their weights and its precision (fixed values): the constant first.
FEATURES = ("insult", "aimed", "negated", "reported", "threat")
PRIOR, PRECISION = np.array([-4.0, 2.6, 3.0, 0.0, 0.3, 6.0]), np.array([0.01, 0.05, 2.0, 8.0, 8.0, 2.0])
#: Sums of patterns count to this; log-odds of an aimed insult or threat by itself, at least; score from which a text counts as toxic.
MOST, CLEAR, CUT = 4.0, 1.0, 0.7
WORD, CLAUSE = re.compile(r"[\w'’]+"), re.compile(r"[.!?;:\n]+")


@dataclass
class Machine:
    """Deterministic weighted transducer: arcs[state, symbol] = (state, output, weight); missing symbols loop as themselves."""

    start: object
    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def compose(self, other: Machine, symbols: tuple[str, ...]) -> Machine:
        """The machine that reads with self and passes its output to other; only states in reach are made."""
        out = Machine((self.start, other.start))
        todo, seen = [out.start], {out.start}
        while todo:
            a, b = pair = todo.pop()
            for symbol in symbols:
                a2, between, w = self.step(a, symbol)
                b2, last, w2 = other.step(b, between)
                out.arcs[pair, symbol] = ((a2, b2), last, w + w2)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return out


def negation(scope: int = 3) -> Machine:
    """An insult or threat within so many words after a negation is denied."""
    m = Machine(0)
    for left in range(scope + 1):
        m.arcs[left, NOT] = (scope, NOT, 0.0)
        for symbol in (INTENT, TARGET, OBJECT, SAID, OTHER):
            m.arcs[left, symbol] = (max(0, left - 1), symbol, 0.0)
        for symbol in (INSULT, THREAT) if left else ():
            m.arcs[left, symbol] = (left, NEGATED, 0.0)
    return m


def report() -> Machine:
    """After a word of saying, insults and threats are somebody else's."""
    return Machine("own", {("own", SAID): ("said", SAID, 0.0), **{("said", s): ("said", REPORTED, 0.0) for s in (INSULT, THREAT)}})


def threat(scope: int = 3) -> Machine:
    """A verb of harm with an object in the next words, or after an intent and an object; else the verb is a word like others."""
    m = Machine("start")
    for state, symbol, to in (("start", INTENT, "intent"), ("start", OBJECT, "object"), ("intent", OBJECT, "both"), ("object", INTENT, "both")):
        m.arcs[state, symbol] = (to, symbol, 0.0)
    for state in ("start", "intent", "object", *range(1, scope + 1)):
        m.arcs[state, THREAT] = (scope, OTHER, 0.0)
    m.arcs["both", THREAT] = ("start", THREATENS, 0.0)
    for left in range(1, scope + 1):
        for symbol in (TARGET, OBJECT):
            m.arcs[left, symbol] = ("start", THREATENS, 0.0)
        for symbol in (INSULT, INTENT, NOT, SAID, OTHER, NEGATED, REPORTED):
            m.arcs[left, symbol] = (left - 1 or "start", symbol, 0.0)
    return m


def insult() -> Machine:
    """An insult in a clause with a target, before or after it, is aimed."""
    m = Machine("none", {("none", INSULT): ("hit", INSULT, 0.0), ("target", INSULT): ("target", AIMED, 0.0)})
    for symbol in (TARGET, OBJECT):
        m.arcs["none", symbol] = ("target", symbol, 0.0)
        m.arcs["hit", symbol] = ("target", AIM, 0.0)
    m.arcs["none", THREATENS] = m.arcs["hit", THREATENS] = ("target", THREATENS, 0.0)
    return m


def weighing(w: np.ndarray) -> Machine:
    """Patterns with their weights, w being those of PRIOR's order."""
    return Machine(0, {(0, s): (0, s, float(x)) for s, x in ((INSULT, w[1]), (AIMED, w[1] + w[2]), (AIM, w[2]), (NEGATED, w[3]), (REPORTED, w[4]), (THREATENS, w[5]))})


def grammar(w: np.ndarray = PRIOR) -> Machine:
    out = negation()
    for m in (report(), threat(), insult(), weighing(w)):
        out = out.compose(m, SYMBOLS)
    return out


#: What a pattern adds to which feature.
COUNTS = {INSULT: (0,), AIMED: (0, 1), AIM: (1,), NEGATED: (2,), REPORTED: (3,), THREATENS: (4,)}


@dataclass
class ToxicityModel:
    """stems and threats: beginnings of words with their strength; weights: constant and one for each of FEATURES."""

    stems: dict[str, float]
    threats: dict[str, float]
    weights: np.ndarray
    machine: Machine
    classes: dict[str, str]
    lengths: tuple[int, ...]

    def read(self, word: str) -> tuple[str, float]:
        """(symbol, strength) of a word: closed classes first, then the longest stem that it begins with."""
        if word in self.classes:
            return self.classes[word], 1.0
        for n in self.lengths:
            if len(word) >= n:
                if (x := self.stems.get(word[:n])) is not None:
                    return INSULT, x
                if (x := self.threats.get(word[:n])) is not None:
                    return THREAT, x
        return OTHER, 0.0

    def clauses(self, text: str) -> list[tuple[int, int, float, list[float]]]:
        """(start, end, weight, sums) of every clause of the lower-cased text in which a pattern matches; sums has a place for each of FEATURES."""
        low, out = text.lower(), []
        read = {w: x for w in set(WORD.findall(low)) if (x := self.read(w))[0] != OTHER}
        if not any(s in (INSULT, THREAT) for s, _ in read.values()):
            return out
        at = 0
        for end in [*(m.start() for m in CLAUSE.finditer(low)), len(low)]:
            words = [read.get(w, (OTHER, 0.0)) for w in WORD.findall(low, at, end)]
            if any(s in (INSULT, THREAT) for s, _ in words):
                state, total, sums = self.machine.start, 0.0, [0.0] * len(FEATURES)
                for symbol, strength in words:
                    state, pattern, weight = self.machine.step(state, symbol)
                    total += weight * strength
                    for k in COUNTS.get(pattern, ()):
                        sums[k] += strength
                if any(sums):
                    out.append((at, end, max(0.0, total), sums))
            at = end
        return out

    def features(self, clauses: list[tuple]) -> list[float]:
        return [min(MOST, sum(c[3][k] for c in clauses)) for k in range(len(FEATURES))]

    def score(self, clauses: list[tuple]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1:] @ np.array(self.features(clauses)), -30, 30))))


def model_of(stems: dict[str, float], threats: dict[str, float] | None = None, weights: np.ndarray = PRIOR) -> ToxicityModel:
    """A model with these stems and log-odds beside the first insults and threats."""
    classes = {w: c for c in (TARGET, OBJECT, NOT, SAID, INTENT, THREAT) for w in WORDS[c].split()}
    strength = lambda odds: float(np.clip(odds / 5, 1.0, 1.2))
    known = {w: 1.0 for w in WORDS[INSULT].split()} | {s: strength(x) for s, x in stems.items()}
    harms = {s: strength(x) for s, x in (threats or {}).items()}
    return ToxicityModel({s: x for s, x in known.items() if s not in harms}, harms, weights, grammar(weights), classes, tuple(sorted({len(s) for s in [*known, *harms]}, reverse=True)))


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Beginnings of words that mark label 1 in (text, y), with their log-odds, at most MAX_STEMS.

    Stems are taken in rounds, those of at least half the best evidence first; the next round looks only at texts that
    hold none of them, so that what merely stands beside an insult, or in copies of one text, is no evidence.
    """
    texts = materialize(sample.groupBy("text").agg(F.max("y").alias("y")))
    n = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    stems: dict[str, float] = {}
    for _ in range(ROUNDS if len(n) == 2 else 0):
        found = _stem_round(texts, stems, n)
        if not found or len(stems) >= MAX_STEMS:
            break
        stems |= found
    return stems


def _stem_round(texts: DataFrame, stems: dict[str, float], n: dict[int, int]) -> dict[str, float]:
    taken, closed = dict(stems), {w for c in (TARGET, OBJECT, NOT, SAID, INTENT) for w in WORDS[c].split()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(batch["text"], batch["y"], strict=True):
                words = {w.strip("'’") for w in WORD.findall(text.lower())} - closed
                begins = {w[:k] for w in words for k in STEMS if k <= len(w)}
                if begins.isdisjoint(taken):
                    counts[int(y)].update(begins)
            names = counts[0].keys() | counts[1].keys()
            yield pd.DataFrame([(s, counts[1][s], counts[0][s]) for s in names], columns=["stem", "bad", "good"])

    counts = texts.mapInPandas(run, "stem string, bad long, good long").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share, both = F.lit(n[1] / (n[0] + n[1])), F.col("bad") + F.col("good")
    part = lambda k, p: F.when(k > 0, k * F.log(k / (both * p))).otherwise(0.0)
    odds = F.log((F.col("bad") + 0.5) / (n[1] + 1)) - F.log((F.col("good") + 0.5) / (n[0] + 1))
    scored = counts.where("bad >= 4").select("stem", odds.alias("odds"), (2 * (part(F.col("bad"), share) + part(F.col("good"), 1 - share))).alias("evidence"))
    rows = scored.where((F.col("evidence") >= LEAST_EVIDENCE) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("evidence"), F.desc(F.length("stem")), "stem").limit(MAX_STEMS).collect()
    found: dict[str, float] = {}
    covered: set[str] = set()
    for r in rows:
        s = r["stem"]
        if r["evidence"] >= rows[0]["evidence"] / 2 and s not in covered and not any(s[:k] in found for k in STEMS):
            # a longer stem of nearly the same evidence, if it is surer
            longer = [t for t in rows if t["stem"].startswith(s) and t["evidence"] >= 0.95 * r["evidence"]]
            best = max(longer, key=lambda t: (t["odds"], len(t["stem"])))
            s = best["stem"]
            found[s] = float(best["odds"])
            covered.update(s[:k] for k in range(1, len(s)))
    return found


def threat_stems(sample: DataFrame, stems: dict[str, float]) -> dict[str, float]:
    """Those of the learned stems that stand, in toxic texts, mostly in clauses with an intent before them and somebody to harm."""
    model = model_of(stems)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            uses, harms = Counter(), Counter()
            for text in batch["text"][batch["y"] == 1]:
                for clause in CLAUSE.split(text.lower()):
                    words = [(w, model.read(w)[0]) for w in WORD.findall(clause)]
                    symbols = [s for _, s in words]
                    for k, (w, s) in enumerate(words):
                        if s == INSULT:
                            stem = next(w[:n] for n in model.lengths if w[:n] in model.stems)
                            uses[stem] += 1
                            harms[stem] += INTENT in symbols[:k] and bool({TARGET, OBJECT} & set(symbols))
            yield pd.DataFrame([(s, uses[s], harms[s]) for s in uses], columns=["stem", "uses", "harms"])

    counts = sample.select("text", "y").mapInPandas(run, "stem string, uses long, harms long").groupBy("stem").agg(F.sum("uses").alias("uses"), F.sum("harms").alias("harms"))
    found = counts.where((F.col("harms") >= THREAT_SHARE * F.col("uses")) & (F.col("uses") >= 4)).select("stem").collect()  # of at most MAX_STEMS
    return {r["stem"]: stems[r["stem"]] for r in found if r["stem"] in stems}


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the curve by penalised likelihood around the priors, within what the patterns mean.

    The constant is moved, by at most 1, to where `CUT` parts the sample with the best F1. An aimed insult or a threat is
    enough by itself; what is denied counts for at most 0.3 of an insult, what is reported for 0.5.
    """
    w = crf.logistic(x, y, PRECISION, PRIOR)
    z = w[0] + x @ w[1:]
    values = np.unique(z)
    f1 = [2 * y[z >= v].sum() / ((z >= v).sum() + y.sum()) for v in values]
    best = values[int(np.argmax(f1))]
    w[0] += np.clip(np.log(CUT / (1 - CUT)) + 1e-3 - best, -1, 1)
    w[1] = max(w[1], 0.5)
    w[2] = max(w[2], 0.5, CLEAR - w[0] - w[1])
    w[3], w[4] = min(w[3], 0.3 * w[1]), min(w[4], 0.5 * w[1])
    w[5] = max(w[5], CLEAR - w[0])
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows that `keep` admits; without both classes the first words and the priors hold."""
    sample = materialize(labelled_sample(docs, labels, label, keep, per_class, max_chars).select("doc_id", "text", "y"))
    stems = learn_stems(sample)
    model = model_of(stems, threat_stems(sample, stems) if stems else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(model.features(model.clauses(t)), y) for t, y in zip(batch["text"], batch["y"], strict=True)], columns=["x", "y"])

    rows = sorted((tuple(r["x"]), r["y"]) for r in sample.select("text", "y").mapInPandas(run, "x array<double>, y int").collect())
    if len({y for _, y in rows}) == 2:
        model.weights = fit_weights(np.array([x for x, _ in rows]), np.array([y for _, y in rows], float))
        model.machine = grammar(model.weights)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs (with a column text) with the columns score, from 0 to 1, and clauses: (start, end, weight) of each that matched.

    Null and empty texts hold no clause; very long ones are read whole; an empty table gives none; repeated rows and nulls in
    other columns pass through. A column of docs that is named score or clauses is replaced.
    """

    def make():
        def work(texts: list[str]) -> dict:
            found = [model.clauses(t) for t in texts]
            return {"score": [model.score(x) for x in found], "clauses": [[{"start": a, "end": b, "weight": w} for a, b, w, _ in x] for x in found]}

        return work

    return map_text(docs, make, "score double, clauses array<struct<start:int,end:int,weight:double>>")
