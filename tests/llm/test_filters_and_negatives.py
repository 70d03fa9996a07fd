"""Filter audit, quality rules and hard negatives against brute force, and their cases: nulls, ties, repeats, empty tables, long texts, extra columns."""

import collections
import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import filter_audit, negatives, quality_rules, words

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, n long, x double, salt string, grp string"


def docs_of(spark, rows):
    """Documents of (doc_id, text, lang, source), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "p", 3, 7, 0.5, "s", "g") for r in rows], DOCS)


def corpus():
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(160):
        text = " ".join(r.choice(vocabulary[: r.choice((8, 300))]) for _ in range(r.randint(20, 150)))
        text = text.upper() if r.random() < 0.2 else text
        rows.append((k, text + (" 5%" if r.random() < 0.3 else ""), r.choice(("en", "de", None)), r.choice(("a", "b", "", None))))
    copies = [(200 + k, rows[k % 7][1], "en", "a") for k in range(60)]
    odd = [(300, None, None, None), (301, "", "en", "b"), (None, rows[0][1], "en", "a"), (None, None, "en", "a"), (302, "    " * 60, "en", "b"), (303, "long word\n" * 20_000, "de", "a"), (304, "\U0001f600 " * 70, "en", "a")]
    return [*rows, *copies, *odd, copies[0], copies[0]]


# words


def test_chunks_hold_every_word_once(monkeypatch):
    monkeypatch.setattr(words, "CHUNK", 5)
    for text in ("", " ", "a", "abcdefghijk l", " a\tbb\x0bccc\x0cdddddd\r\n e ", " x y \x1cz", "é" * 9 + " " + "ü" * 9):
        assert [w.decode() for chunk in words.word_chunks(text.encode()) for w in chunk] == WORD.findall(text)


# filter audit


def audited(rows, labels):
    """The audit, order by order and row by row."""
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in range(2))
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    failing = collections.defaultdict(list)
    for i, text, _, source in rows:
        t = text or ""
        w = WORD.findall(t)
        marks = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        failing[source or ""].append(({f for f, failed in marks.items() if failed}, i in good, i in toxic))
    out = {}
    for part, docs in failing.items():
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def test_audit_against_applying_every_order(spark):
    rows = corpus()
    labels = [(k, k % 3 % 2, k % 5 % 2) for k in range(0, 240, 2)] + [(4, 1, 0), (4, None, 1), (None, 1, 1), (999, 1, 1)]
    made = filter_audit.filter_audit(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in made.collect()}
    assert made.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got == audited(rows, labels) and {p for p, *_ in got} == {"a", "b", ""}


def test_audit_of_empty_tables(spark):
    docs, labels = docs_of(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs, labels).count() == 0
    assert filter_audit.filter_audit(docs_of(spark, [(None, None, None, None)]), labels).where("shapley in (0, 120)").count() == 600


@pytest.mark.parametrize("seed", range(4))
def test_polynomial_against_averages_over_orders(seed):
    r = random.Random(seed)
    counts = {m: r.randrange(20) for m in range(8) if r.random() < 0.8}
    f = filter_audit.RemovalPolynomial(counts, 3)
    removed = lambda s: sum(n for m, n in counts.items() if m & s)
    assert all(f.corner(s) == removed(s) for s in range(8))
    for k in range(3):
        gains = [removed(sum(1 << i for i in o[: o.index(k) + 1])) - removed(sum(1 << i for i in o[: o.index(k)])) for o in itertools.permutations(range(3))]
        assert f.shapley(k) == Fraction(sum(gains), 6)
    assert sum(f.shapley(k) for k in range(3)) == removed(7)


# quality rules


def counted(text):
    t = text or ""
    w = WORD.findall(t)
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    inside = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), len(lines)


def test_counts_against_counting_one_by_one():
    texts = [r[1] for r in corpus()] + ["a b c a b c", "a b a b a b a", "x\nx\n \nx \n", "a b", "a a a", "# <b> & |", "\n\n\n"]
    assert all(quality_rules.text_counts(t or "") == counted(t) for t in texts)


def test_long_vocabularies_share_no_windows():
    ids = np.random.default_rng(1).integers(0, 5, 400)
    assert quality_rules.repeated_words(ids, 5) == quality_rules.repeated_words(ids, 1 << 21)


def test_chi_squared():
    assert all(abs(quality_rules.chi_squared(x, 4) - (1 - math.exp(-x / 2) * (1 + x / 2))) < 1e-12 for x in (0.1, 3.0, 23.5, 60.0))
    assert abs(quality_rules.chi_quantile(0.975, 4) - 11.1433) < 1e-3 and abs(quality_rules.chi_quantile(0.95, 1) - 3.8415) < 1e-3


def judged(rows):
    """quality_rules() on arrays: rows of (lang, source, counts); returns kept."""
    q, p = quality_rules, quality_rules.P
    failed = [c[0] < 50 or 100 * c[4] > 50 * c[0] for *_, c in rows]
    share = lambda a, b: math.asin(math.sqrt(min(1, a / max(1, b))))
    half_up = lambda v: math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1)
    x = np.array([[half_up(v * q.SCALE) for v in (math.log(max(1, c[1]) / max(1, c[0])), share(c[2], c[1]), share(c[3], c[5]), share(c[4], c[0]))] for *_, c in rows], float)
    sizes = collections.Counter((r[0], r[1]) for r, f in zip(rows, failed) if not f)
    pools = collections.Counter()
    for (lang, _), n in sizes.items():
        pools[lang] += n if n < q.LEAST else 0
    group = [(r[0], r[1]) if sizes[r[0], r[1]] >= q.LEAST else (r[0],) if pools[r[0]] >= q.LEAST else () for r in rows]
    kept = [False] * len(rows)
    for g in set(group):
        at = [k for k, h in enumerate(group) if h == g and not failed[k]]
        if not at:
            continue
        v = x[at]
        h, best = (len(v) + p + 1) // 2, None
        middle = np.sort(v, axis=0)[(len(v) - 1) // 2]
        mad = np.sort(np.abs(v - middle), axis=0)[(len(v) - 1) // 2]
        for start in range(2):
            spread = np.maximum(1.4826 * mad / q.SCALE, q.FLOORS) if start == 0 else np.array(q.FLOORS)
            mean, precision, det = middle / q.SCALE, np.diag(1 / spread**2), np.prod(spread**2)
            for _ in range(q.STEPS):
                d = v / q.SCALE - mean
                bins = np.floor(np.log2(np.maximum(0, np.einsum("ij,jk,ik->i", d, precision, d)) + 2.0**-20) * q.BINS)
                weight, left = np.zeros(len(v)), h
                for b in np.unique(bins):
                    inside = bins == b
                    weight[inside] = min(1.0, left / inside.sum())
                    left = max(0, left - inside.sum())
                before = det
                mean, precision, det = q.estimate(h, weight @ v, (v * weight[:, None]).T @ v, h / len(v))
                if abs(det / before - 1) < 1e-9:
                    break
            if best is None or det < best[0]:
                best = det, mean, precision
        d = v / q.SCALE - best[1]
        near = v[np.einsum("ij,jk,ik->i", d, best[2], d) <= q.chi_quantile(q.NEAR, p)]
        mean, precision, _ = q.estimate(len(near), near.sum(axis=0), near.T @ near, q.NEAR)
        d = np.where(q.ONE_SIDED, np.maximum(0, v / q.SCALE - mean), v / q.SCALE - mean)
        for k, s in zip(at, np.einsum("ij,jk,ik->i", d, precision, d)):
            kept[k] = bool(s <= q.chi_quantile(q.KEEP, p))
    return failed, kept


@pytest.fixture(scope="module")
def mixed(spark):
    """Three languages and sources of which one is hot, with junk, copies and texts that fail the base rules."""
    r = random.Random(9)
    rows = []
    for k in range(700):
        lang, source = ("en", "hot") if k % 3 else (r.choice(("en", "de", None)), r.choice(("a", "b", None)))
        vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(200)]
        w = [r.choice(vocabulary) for _ in range(r.randint(30, 160))]
        if k % 11 == 0:
            w = [x + "#%|" for x in w]
        if k % 17 == 0:
            w = w[:40] * 3
        rows.append((k, " ".join(x + ("\n" if r.random() < 0.1 else "") for x in w), lang, source))
    copies = [(1000 + k, rows[1][1], "en", "hot") for k in range(150)]
    return [*rows, *copies, rows[2], (2000, None, None, None), (2001, "", "de", "a"), (None, rows[5][1], "en", "hot"), (2002, "one two three four\n" * 9000, "en", "a")]


def test_rules_against_estimating_by_hand(spark, mixed):
    got = quality_rules.quality_rules(docs_of(spark, mixed)).collect()
    counts = [counted(r[1]) for r in mixed]
    failed, kept = judged([(r[2] or "", r[3] or "", c) for r, c in zip(mixed, counts)])
    want = collections.Counter((r[0], *c[:5], f, k) for r, c, f, k in zip(mixed, counts, failed, kept))
    assert collections.Counter(tuple(r)[:8] for r in got) == want
    junk = [k for r, f, k in zip(mixed, failed, kept) if not f and "#%|" in (r[1] or "")]
    clean = [k for r, f, k in zip(mixed, failed, kept) if not f and "#" not in (r[1] or "")]
    assert len(junk) > 30 and not any(junk) and all(clean)


def test_rules_do_not_depend_on_partitions(spark, mixed):
    a, b = (sorted(map(str, quality_rules.quality_rules(docs_of(spark, mixed).repartition(n)).collect())) for n in (1, 7))
    assert a == b


def test_rules_of_empty_tables(spark):
    assert quality_rules.quality_rules(docs_of(spark, [])).count() == 0
    rows = quality_rules.quality_rules(docs_of(spark, [(1, None, None, None), (None, "few words", "en", "a")])).collect()
    assert sorted((r["n_words"], r["base_failed"], r["kept"], r["distance"]) for r in rows) == [(0, True, False, None), (2, True, False, None)]


# hard negatives


def mined(rows, positives=5, negatives_=5):
    """(anchor, positive, rank, negative, scores), row by row."""
    rows = [(i, y, v) for i, y, v in rows if None not in (i, y, v) and v and all(x is not None and math.isfinite(x) for x in v)]
    rows = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows]
    anchors = {}
    for i, y, v in rows:
        if i % 100 == 0:
            anchors[i] = min((y, v), anchors.get(i, (y, v)))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, y) for i, y, w in rows if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            hard = [(n, i) for n, i, y in scored if y != label and 80 * -s <= 100 * -n <= 100 * -s][:negatives_]
            out += [(a, p, k, i, -s, -n) for k, (n, i) in enumerate(hard, 1)]
    return sorted(out)


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, score long, place string")


@pytest.mark.parametrize(("wave", "block"), [(None, 1 << 21), (2, 100)])
def test_negatives_against_all_pairs(spark, monkeypatch, wave, block):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", block)
    monkeypatch.setattr(negatives, "SCORE_BYTES", block)
    monkeypatch.setattr(negatives, "WAVES_AT_ONCE", 2)
    r = random.Random(2)
    rows = [(k * 10, r.randrange(3), [r.randint(-2, 6) / 4 for _ in range(4)]) for k in range(150)]
    rows += [(5000 + k, k % 3, [1.0, 1.0, 1.0, 1.0]) for k in range(40)] + [rows[3], rows[20], rows[20]]  # ties and repeats
    rows += [(None, 1, [1.0] * 4), (7, None, [1.0] * 4), (8, 1, None), (9, 1, [1.0, None, 1.0, 1.0]), (11, 1, [float("nan")] * 4), (12, 0, [float("inf")] * 4), (13, 1, []), (14, 1, [2.0] * 3), (15, 0, [2.0] * 3), (6000, 1, [2.0] * 3), (-100, 2, [0.0] * 4), (-300, 1, [-1.0] * 4)]
    vectors = negatives.labelled_vectors(vectors_of(spark, rows).repartition(3), "vec_id", "label", "embedding")
    got = negatives.hard_negatives(vectors, "vec_id % 100 = 0", wave_rows=wave)
    assert sorted(map(tuple, got.collect())) == mined(rows) and len(mined(rows)) > 100


def test_negatives_of_large_components_and_empty_tables(spark):
    big = 2.0**18
    rows = [(100 * k, k % 2, [big + k / 256, big - k / 128]) for k in range(12)]
    vectors = negatives.labelled_vectors(vectors_of(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>")), "vec_id", "label", "embedding")
    assert vectors.agg(F.max(F.array_max("v"))).first()[0] ** 2 * 2 > 2**53
    exact = [(i, y, [float(np.float32(x)) for x in v]) for i, y, v in rows]
    assert sorted(map(tuple, negatives.hard_negatives(vectors, "vec_id % 100 = 0").collect())) == mined(exact)
    assert negatives.hard_negatives(vectors.where("false"), "vec_id % 100 = 0").count() == 0
    assert negatives.hard_negatives(vectors, "false").count() == 0
    with pytest.raises(ValueError, match="fit a long"):
        negatives.hard_negatives(vectors.withColumn("v", F.array(F.lit(1 << 40))), "true")
