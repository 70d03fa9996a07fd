"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of its neighbours; a document's quality is the mean of
its lines' forward-backward marginals, weighted by length, put through a fitted logistic curve. Labels exist for documents
only: lines begin with their document's label, and between fits lines of bad documents that look good change sides.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import crf
from cohortloom.llm.common import labelled_sample, map_text

#: Bounds of the sample that is fitted: rows of each class, characters and lines of a row. So the driver gets 2 x 1,500 x 200 lines at most, 130 MB.
PER_CLASS, MAX_CHARS, MAX_LINES = 1500, 40_000, 200
#: Refits, rounds of the first fit and of others, and lines of a sequence in fitting (scoring takes all lines of a text as one).
REFITS, ROUNDS, REFIT_ROUNDS, WINDOW = 2, 100, 40, 16
#: Frequent words of the four languages (fixed values).
COMMON = frozenset(
    "the of and to in is it that for was on are as with this be by at from or an a un une le la les des de du et en est que qui pour dans sur par au avec ce se"
    " der die das und in zu den von mit ist des auf für im dem nicht ein eine sich als auch el los las y es con por una del al no su para lo".split()
)
N_OWN = 17


def _classes() -> np.ndarray:
    """Class of each code point: 0 lower, 1 upper, 2 digit, 3 space, 4 plain punctuation, 5 '!', 6 other signs, 7 letters beyond ASCII."""
    out = np.full(0x10000, 7, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        out[c] = 1 if kind == "Lu" else 2 if kind[0] == "N" else 3 if ch.isspace() else 5 if ch == "!" else 4 if ch in ".,;:?'\"()-" else 6 if kind[0] in "PSC" else 0 if c < 128 else 7
    return out


def line_features(text: str, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines, 3 x N_OWN + 3) and lengths of the lines that hold more than white space; none for an empty text."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    if not lines:
        return np.zeros((0, 3 * N_OWN + 3)), np.zeros(0)
    lengths = np.array([len(x) for x in lines])
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = classes[np.minimum(points, 0xFFFF)]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    share = np.stack([np.add.reduceat((kinds == k).astype(np.int32), starts) for k in range(8)], axis=1) / lengths[:, None]
    own, seen = np.zeros((len(lines), N_OWN)), Counter()
    for k, line in enumerate(lines):
        words = line.lower().split()
        counts = Counter(words)
        n, body = len(words), line.strip()
        own[k, 8:] = (
            np.log1p(lengths[k]), len(counts) / n, max(counts.values()) / n, sum(counts[w] for w in counts.keys() & COMMON) / n,
            min(20.0, lengths[k] / n), body[-1] in ".?!…\"'", body[0].isupper(), seen[line] > 0, np.log1p(n))
        seen[line] += 1
    own[:, :8] = share
    edge = np.zeros((1, N_OWN))
    last = len(lines) - 1
    place = np.array([[k == 0, k == last, lengths[k] / lengths.sum()] for k in range(len(lines))], float)
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), place]), lengths


@dataclass
class QualityModel:
    """chain: the fitted field, None where there was nothing to fit; curve: constant and slope of the final logistic curve."""

    chain: crf.Chain | None
    curve: tuple[float, float]
    empty: float

    def lines(self, text: str, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginal of `good` and length of each line."""
        x, lengths = line_features(text, classes)
        if not len(x) or self.chain is None:
            return np.full(len(x), 0.5), lengths
        return crf.marginals(self.chain, self.chain.emissions(x)), lengths

    def score(self, text: str, classes: np.ndarray) -> float:
        good, lengths = self.lines(text, classes)
        if not len(good):
            return self.empty
        mean = float(good @ lengths / lengths.sum())
        mean = min(max(mean, 1e-4), 1 - 1e-4)
        return float(1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * np.log(mean / (1 - mean))))))


def fit_quality(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS, max_lines: int = MAX_LINES) -> QualityModel:
    """Fit on a bounded sample: at most per_class rows of each class, each of at most max_chars characters and max_lines lines, and only rows that `keep` admits.

    Features are made in tasks; the driver gets them and fits. A sample with one class, or none, gives a model that scores
    every document alike.
    """
    sample = labelled_sample(docs, labels, label, keep, per_class, max_chars).where(F.length("text") - F.length(F.replace("text", F.lit("\n"))) < max_lines)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = _classes()
        for batch in batches:
            found = [(*line_features(t, classes), int(y)) for t, y in zip(batch["text"], batch["y"], strict=True)]
            yield pd.DataFrame([(i, x.astype(np.float32).tobytes(), n.astype(np.int64).tobytes(), y) for i, (x, n, y) in zip(batch["doc_id"], found, strict=True)], columns=["doc_id", "x", "n", "y"])

    rows = sorted((r["doc_id"], bytes(r["x"]), bytes(r["n"]), r["y"]) for r in sample.mapInPandas(run, "doc_id long, x binary, n binary, y int").collect())
    blank = [y for *_, x, _, y in rows if not x]
    rows = [(np.frombuffer(x, np.float32).reshape(-1, 3 * N_OWN + 3), np.frombuffer(n, np.int64), y) for _, x, n, y in rows if x]
    classes_seen = {y for *_, y in rows}
    prior = sum(y for *_, y in rows) / max(1, len(rows)) if len(classes_seen) == 1 else 0.5
    empty = float((sum(blank) + prior) / (len(blank) + 1))
    if len(classes_seen) < 2:
        p = min(max(prior, 0.01), 0.99)
        return QualityModel(None, (float(np.log(p / (1 - p))), 1.0), empty)
    x, sizes = np.vstack([r[0] for r in rows]), [len(r[0]) for r in rows]
    doc = np.repeat([y for *_, y in rows], sizes)
    lines, cuts, chain = doc.copy(), np.cumsum([0, *sizes]), None
    for _ in range(1 + REFITS):
        chain = crf.fit(x, lines, sizes, rounds=ROUNDS if chain is None else REFIT_ROUNDS, begin=chain, window=WINDOW)
        good = np.concatenate([crf.marginals(chain, chain.emissions(x[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)])
        lines = np.where(doc == 1, 1, good > 0.5).astype(int)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):  # some line must be bad
            if rows[k][2] == 0 and lines[a:b].all():
                lines[a + int(good[a:b].argmin())] = 0
    means = np.array([good[a:b] @ r[1] / r[1].sum() for r, a, b in zip(rows, cuts, cuts[1:], strict=False)])
    means = np.clip(means, 1e-4, 1 - 1e-4)
    curve = crf.logistic(np.log(means / (1 - means))[:, None], np.array([y for *_, y in rows], float))
    return QualityModel(chain, (float(curve[0]), float(max(curve[1], 0.05))), empty)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs (with a column text) with the column score, from 0 to 1, of every whole text.

    Null and empty texts get the share of good ones among such rows of the sample; very long texts are read whole, line by
    line; repeated rows and nulls in other columns pass through; an empty table gives none. A column of docs that is named
    score is replaced.
    """

    def make():
        classes = _classes()
        return lambda texts: {"score": [model.score(t, classes) for t in texts]}

    return map_text(docs, make, "score double")
