"""The corpus operators against brute force, and their cases: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import collections
import hashlib
import html.parser
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import bpe, chat, components, crf, exact_dedup, html_extract, packing, quality, sharding, similar, simhash, toxicity, vafile
from cohortloom.llm.common import fold

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, fp long"


def docs_of(spark, texts):
    """Documents with nulls in other columns, and columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, None, None, 0.5, "k", 1) for i, t in texts], DOCS)


def some_texts(seed=1, n=60):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(n)]
    near = []
    for t in base[:20]:
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    return base + near + base[:5] + [base[0].upper(), "", None, " \n\t", "a", "ein wort", "long " * 30_000, "é" * 5000, "\U0001f600 x", "<|endoftext|> literal"]


@pytest.fixture(scope="module")
def corpus(spark):
    texts = list(enumerate(some_texts()))
    return docs_of(spark, [*texts, texts[3], (None, "no id"), (None, None)])


def brute_components(points, near):
    parent = {p: p for p in points}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(points), 2):
        if near(a, b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {p: root(p) for p in points}


# components


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {k: 0 for k in range(31)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 toxicity


def scored(m, text):
    return m.score(m.clauses(text))


def test_grammar_scores_clauses_not_words():
    m = toxicity.model_of({"grumf": 4.0}, {"zork": 4.0})
    for x in ("an idiot", "grumfen"):  # fixed and learned
        alone, aimed, denied, told = (scored(m, t) for t in (x, f"you are {x}", f"you are not {x}", f"he said you are {x}"))
        assert aimed >= 0.7 > alone > max(denied, told) and scored(m, f"{x}, you") == aimed
    assert scored(m, "not at all, ever so often an idiot") == scored(m, "an idiot") < scored(m, "an idiot and a moron")
    for x in ("I will kill you", "ich werde dich töten", "je vais te tuer", "I will zork them", "they zork you"):
        assert scored(m, x) >= 0.7, x
    for x in ("kill the process", "I will kill time", "I will not kill you", "she said I will kill you", "nice day", "", "will you zork"):
        assert scored(m, x) < 0.3, x
    assert scored(m, "You are nice. Idiot.") < scored(m, "You are an idiot.")
    assert len(m.clauses("You idiot. Fine day. Stupid fool!")) == 2 and all(w > 0 for *_, w, _ in m.clauses("You idiot. Stupid fool!"))


def test_closed_words_stay_what_they_are():
    m = toxicity.model_of({"not": 5.0, "you": 5.0})
    assert m.read("not") == (toxicity.NOT, 1.0) and m.read("you") == (toxicity.TARGET, 1.0) and m.read("notched")[0] == toxicity.INSULT


def test_weights_and_threats_are_learned(spark):
    r, rows = random.Random(4), []
    filler = lambda n: " ".join(f"w{r.randrange(200)}" for _ in range(n))
    for k in range(300):
        bad = k % 3 == 0
        what = r.choice([f"you are grumf{k % 5}", f"I will zork{k % 5} you"]) if bad else r.choice(["you are fine", "I will see you", "nothing"])
        rows.append((k, f"{filler(12)}. {what}. {filler(9)}", int(bad)))
    docs, labels = docs_of(spark, [(k, t) for k, t, _ in rows]), spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    m = toxicity.fit_toxicity(docs, labels, F.lit(True))
    assert any(s.startswith("zork") for s in m.threats) and any(s.startswith("grumf") for s in m.stems) and not any(s.startswith("zork") for s in m.stems)
    assert scored(m, "you are grumf1") >= 0.7 > scored(m, "you are not grumf1") and scored(m, "he said you are grumf1") < 0.7
    assert scored(m, "I will zork1 you") >= 0.7 > scored(m, "I will not zork1 you") and scored(m, "zork1 the process") < 0.3


def test_no_pattern_weighs_what_it_does_not_mean():
    x = np.array([[1.0, 0, 0, 0, 0]] * 50 + [[0, 0, 1.0, 0, 0]] * 50 + [[0.0] * 5] * 100)  # as if what is denied were toxic too
    w = toxicity.fit_weights(x, np.array([1.0] * 100 + [0.0] * 100))
    assert w[3] <= 0.3 * w[1] and w[4] <= 0.5 * w[1] and w[0] + w[1] + w[2] >= 1 and w[0] + w[5] >= 1


def test_scores_replace_columns_of_their_names(spark):
    df = spark.createDataFrame([(1, "you idiot", 9.0, "x"), (2, None, None, None)], "doc_id long, text string, score double, clauses string")
    out = toxicity.score_toxicity(df, toxicity.model_of({}))
    assert sorted(out.columns) == ["clauses", "doc_id", "score", "text"] and {r["doc_id"]: r["score"] >= 0.7 for r in out.collect()} == {1: True, 2: False}
    good = quality.score_quality(df, quality.QualityModel(None, (0.0, 1.0), 0.5))
    assert sorted(good.columns) == ["clauses", "doc_id", "score", "text"] and {r["score"] for r in good.collect()} == {0.5}


def test_composition_equals_running_one_after_the_other():
    a = toxicity.Machine(0, {(0, "not"): (1, "not", 0.5), (1, "insult"): (0, "other", -1.0)})
    b = toxicity.Machine("x", {("x", "other"): ("y", "said", 2.0), ("y", "insult"): ("x", "insult", 3.0)})
    both = a.compose(b, toxicity.SYMBOLS)
    for word in itertools.product(["not", "insult", "other"], repeat=5):
        sa, sb, total, state, one = a.start, b.start, 0.0, both.start, 0.0
        for s in word:
            sa, mid, w = a.step(sa, s)
            sb, last, w2 = b.step(sb, mid)
            total += w + w2
            state, out, w3 = both.step(state, s)
            one += w3
            assert out == last
        assert one == total and state == (sa, sb)


def test_toxicity_learns_stems_and_scores_every_row(spark, corpus):
    r = random.Random(5)
    made = [(k, " ".join(f"w{r.randrange(300)}" for _ in range(30)) + (f" grumf{k % 7} krall{k % 5}" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(400)]
    docs, labels = docs_of(spark, [(k, t) for k, t, _ in made]), spark.createDataFrame([(k, y) for k, _, y in made] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, fold("doc_id", 3) != 1)
    assert any(s.startswith("grumf") for s in model.stems) or any(s.startswith("krall") for s in model.stems)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model).collect()
    got = {x["doc_id"]: x["score"] for x in scored}
    assert all((got[k] >= 0.7) == bool(y) for k, _, y in made)
    rows = toxicity.score_toxicity(corpus.select("doc_id", "text"), model).collect()
    assert len(rows) == corpus.count() and all(0 <= x["score"] <= 1 for x in rows)
    empty = toxicity.fit_toxicity(docs.limit(0), labels.limit(0), F.lit(True))
    assert toxicity.score_toxicity(docs.limit(0).select("doc_id", "text"), empty).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    made = [(k, f"text {k} grumf{k % 3} " * 3 if k % 3 == 0 else f"text {k} plain", int(k % 3 == 0)) for k in range(120)]
    docs = docs_of(spark, [(k, t) for k, t, _ in made])
    flip = lambda k, y: 1 - y if zlib.crc32(str(k).encode()) % 3 == 1 else y
    fits = [toxicity.fit_toxicity(docs, spark.createDataFrame([(k, f(k, y)) for k, _, y in made], "doc_id long, toxic int"), fold("doc_id", 3) != 1) for f in (lambda k, y: y, flip)]
    assert fits[0].stems == fits[1].stems and np.allclose(fits[0].weights, fits[1].weights)


# 2 SimHash


def test_cosets_cover_every_value():
    begins, patterns, weights = simhash.cosets(3)
    assert (np.diff(begins) >= 1).all() and weights.max() == 3
    assert len(patterns) == 1 + 23 + 253 + 1771 and (np.diff(begins) == 1).all()  # perfect: one anchor within 3


@pytest.mark.parametrize(("order", "threshold"), [(1, 4), (2, 4), (1, 8)])
def test_no_link_is_lost(spark, order, threshold):
    r = random.Random(order)
    points = [r.getrandbits(64) for _ in range(60)]
    for p in list(points):
        for d in range(1, 11):
            q = p
            for bit in r.sample(range(64), d):
                q ^= 1 << bit
            points.append(q)
    points = sorted(set(points))
    df = spark.createDataFrame([(0, p - (1 << 64) if p >> 63 else p, k) for k, p in enumerate(points)], "print long, fp long, node long")
    got = dict(map(tuple, components.components(simhash.links(df, order, threshold).select("a", "b")).collect()))
    want = brute_components(range(len(points)), lambda a, b: (points[a] ^ points[b]).bit_count() <= threshold)
    assert {k: got.get(k, k) for k in want} == want
    for x in simhash.links(df, order, threshold).collect():
        assert (points[x["a"]] ^ points[x["b"]]).bit_count() == x["apart"] <= threshold


def test_hot_anchors_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_INNER", 8)
    monkeypatch.setattr(simhash, "CELL_ROWS", 16)
    r = random.Random(9)
    points = sorted({r.getrandbits(5) | r.getrandbits(3) << 30 | 1 << 62 for _ in range(300)} | {r.getrandbits(64) >> 1 for _ in range(50)})
    df = spark.createDataFrame([(0, p, k) for k, p in enumerate(points)], "print long, fp long, node long")
    got = dict(map(tuple, components.components(simhash.links(df, 1).select("a", "b")).collect()))
    want = brute_components(range(len(points)), lambda a, b: (points[a] ^ points[b]).bit_count() <= 4)
    assert {k: got.get(k, k) for k in want} == want


@pytest.mark.parametrize("order", [1, 2])
def test_every_pair_of_different_groups_is_found(spark, order, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_INNER", 8)
    monkeypatch.setattr(simhash, "CELL_ROWS", 16)
    r = random.Random(order)
    points = sorted({r.getrandbits(7) | r.getrandbits(4) << 40 for _ in range(120)} | {r.getrandbits(64) >> 1 for _ in range(30)})
    groups = [k % 7 if k % 3 else 1000 + k for k in range(len(points))]
    df = spark.createDataFrame([(0, p, k, g) for k, (p, g) in enumerate(zip(points, groups, strict=True))], "print long, fp long, node long, group long")
    got = {(x["a"], x["b"]) for x in simhash.links(df, order, 8, None).collect()}
    assert got == {(a, b) for a in range(len(points)) for b in range(a) if groups[a] != groups[b] and (points[a] ^ points[b]).bit_count() <= 8}
    assert simhash.links(df.limit(0), order, 8, None).count() == 0


def test_fingerprint_by_definition():
    xxhash = pytest.importorskip("xxhash")
    for text in some_texts(2, 10):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split() if (text or "").isascii() else None
        if words is None:
            continue
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        assert simhash.fingerprint(text or "") == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint("A b\x0bc") == simhash.fingerprint("a  b c") and simhash.fingerprint("") == 0


def test_near_duplicates_of_a_corpus(spark, corpus):
    rows = simhash.near_duplicates(corpus).collect()
    assert len(rows) == corpus.count()
    fp = {x["doc_id"]: int(x["fingerprint"], 16) for x in rows if x["doc_id"] is not None}
    want = brute_components(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    assert all(x["component_id"] == want[x["doc_id"]] for x in rows if x["doc_id"] is not None)
    assert simhash.near_duplicates(corpus.limit(0)).count() == 0


def test_similar_documents_have_similar_shingles(spark):
    r = random.Random(3)
    base = [" ".join(f"w{r.randrange(5000)}" for _ in range(300)) for _ in range(12)]
    texts = list(base)
    for t in base[:8]:
        w = t.split()
        w[150] = "other"
        texts.append(" ".join(w))
    texts += ["", None, "w1"]
    got = {x["doc_id"]: x["component_id"] for x in similar.similar_documents(docs_of(spark, list(enumerate(texts)))).collect()}
    assert got == {k: k for k in range(8)} | {12 + k: k for k in range(8)}
    assert similar.similar_documents(docs_of(spark, [])).count() == 0


def brute_similar(texts, similarity=0.8):
    """{doc_id: component_id} of texts with a neighbour, by the Jaccard similarity of their sets of five words."""
    sets = {}
    for k, t in enumerate(texts):
        words = (t or "").split()
        if words:
            sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    near = lambda a, b: len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])
    roots = brute_components(sets, near)
    sizes = collections.Counter(roots.values())
    return {k: root for k, root in roots.items() if sizes[root] > 1}


def test_repeated_lines_count_once(spark):
    r = random.Random(5)
    texts = []
    for k in range(24):
        body, line = (" ".join(f"w{r.randrange(5000)}" for _ in range(n)) for n in (300, 24))
        texts += [f"{body}\n{line}", body + f"\n{line}" * (5, 10, 30)[k % 3]]
    want = brute_similar(texts)
    assert len(want) == len(texts)
    assert {x["doc_id"]: x["component_id"] for x in similar.similar_documents(docs_of(spark, list(enumerate(texts)))).collect()} == want


def test_pairs_at_the_similarity_are_found(spark):
    r = random.Random(6)
    word = lambda: f"w{r.randrange(10**6)}"
    texts = []
    for n in [4] * 60 + [8] * 20 + [40, 80, 160, 320, 600] * 12:  # shingles of the shorter; a quarter more follow in the longer: 0.8
        short = [word() for _ in range(n + 4)]
        texts += [" ".join(short), " ".join(short + [word() for _ in range(n // 4)])]
    texts += ["a b c", "a b c", "a b", "", None]
    want = brute_similar(texts)
    assert len(want) == len(texts) - 3
    assert {x["doc_id"]: x["component_id"] for x in similar.similar_documents(docs_of(spark, list(enumerate(texts)))).collect()} == want


def test_every_member_is_held_against_other_components(spark, monkeypatch):
    monkeypatch.setattr(similar, "SIDE", 8)
    monkeypatch.setattr(similar, "BLOCK", 8)  # bands are dealt out to many cells
    r = random.Random(7)
    texts = []
    for _ in range(6):  # chains of which only neighbours are similar, and copies of single members
        words = [f"w{r.randrange(10**6)}" for _ in range(400)]
        chain = [" ".join(words[20 * k : 20 * k + 200]) for k in range(8)]
        texts += [*chain, *chain[2:5], chain[3].upper().lower() + "\n" + chain[3]]
    for _ in range(30):  # members of one template, near the bound to each other
        filled = texts[0].split()
        filled[r.randrange(10, 190)] = f"f{r.randrange(10**6)}"
        filled[r.randrange(10, 190)] = f"f{r.randrange(10**6)}"
        texts.append(" ".join(filled))
    order = list(range(len(texts)))
    r.shuffle(order)
    texts = [texts[k] for k in order]
    assert {x["doc_id"]: x["component_id"] for x in similar.similar_documents(docs_of(spark, list(enumerate(texts)))).collect()} == brute_similar(texts)


# 3 chat


def test_quotations_link_replies(spark):
    m = [(1, 0, "user", "How do I sort?\nThanks"), (1, 1, "assistant", "Use sorted."), (1, 2, "user", "> how do  I sort?\n>> older\nI meant lists."), (1, 3, "assistant", "> Use sorted.\nYes."), (1, 4, "user", "> not written here\nok"), (2, 5, "user", None), (2, 9, "user", "x"), (None, 1, "user", "y"), (2, 9, "user", "x"), (3, None, None, "> q")]
    df = spark.createDataFrame([(*x, "extra") for x in m], "conv_id long, turn long, role string, text string, thread string")
    out = chat.link_quotations(df).collect()
    assert len(out) == len(m)
    by = {(x["conv_id"], x["turn"]): x for x in out}
    assert [by[1, k]["parent_turn"] for k in range(5)] == [None, 0, 0, 1, 3]
    assert [by[1, k]["depth"] for k in range(5)] == [0, 1, 1, 2, 3] and [by[1, k]["thread"] for k in range(5)] == [0, 0, 2, 3, 3]
    assert [by[1, k]["position"] for k in range(5)] == [0, 1, 4, 2, 3]
    assert by[1, 2]["text"] == "I meant lists." and by[1, 2]["quotes"] == 2 and by[2, 9]["parent_turn"] == 5 and by[2, 5]["text"] == ""
    assert by[None, 1]["parent_turn"] is None and by[3, None]["text"] == ""
    assert chat.link_quotations(df.limit(0)).count() == 0


def brute_chat(messages):
    """{(conv, turn): (parent, thread, depth, position, text, quotes)} by reading conversations one by one."""
    norm = lambda t: " ".join(t.split()).lower()
    lines_of = lambda t: [norm(x) for x in t.split("\n") if x.strip()]
    parsed, out = {}, {}
    for conv, turn, text in messages:
        found = []
        for line in text.split("\n"):
            depth, rest = 0, line.lstrip(" \t")
            while rest.startswith(">"):
                depth, rest = depth + 1, rest[1:]
                rest = rest[1:] if rest[:1] in (" ", "\t") else rest
            if found and found[-1][0] == depth:
                found[-1][1].append(rest if depth else line)
            else:
                found.append([depth, [rest if depth else line]])
        own = "\n".join("\n".join(b) for d, b in found if d == 0).strip(" ")
        parsed[conv, turn] = (own, [(d, "\n".join(b)) for d, b in found if d and norm("\n".join(b))])

    def wrote(own, quote):
        runs, want = lines_of(own), lines_of(quote)
        as_text = {norm(p) for p in [own, *own.split("\n"), *own.split("\n\n")]} - {""}
        return norm(quote) in as_text or any(runs[i : i + len(want)] == want for i in range(len(runs) - len(want) + 1))

    for conv in {c for c, *_ in messages}:
        turns, children = sorted(t for c, t in parsed if c == conv), collections.defaultdict(list)
        for k, t in enumerate(turns):
            sources = [(-d, e) for d, q in parsed[conv, t][1] for e in turns[:k] if wrote(parsed[conv, e][0], q)]
            before = turns[k - 1] if k else None
            parent = max(sources)[1] if sources else before
            children[parent].append(t)
            up = out[conv, parent] if parent is not None else None
            thread = t if parent is None or parent != before else up[1]
            out[conv, t] = [parent, thread, up[2] + 1 if up else 0, None, parsed[conv, t][0], len(parsed[conv, t][1])]
        stack, n = [turns[0]], 0
        while stack:
            t = stack.pop()
            out[conv, t][3], n = n, n + 1
            stack += sorted(children[t], reverse=True)
    return {k: tuple(v) for k, v in out.items()}


def linked(df):
    return {(x["conv_id"], x["turn"]): (x["parent_turn"], x["thread"], x["depth"], x["position"], x["text"], x["quotes"]) for x in chat.link_quotations(df).collect()}


@pytest.mark.parametrize("block", [4096, 3])
def test_quotations_against_reading_one_by_one(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "TURNS_A_BLOCK", block)
    r, messages = random.Random(12), []
    for conv in range(30):
        said = []
        for turn in range(r.randint(1, 14)):
            lines = [f"line {r.randrange(90)} of talk" for _ in range(r.randint(1, 4))]
            if r.random() < 0.4:
                lines.insert(1, "")
            if said and r.random() < 0.7:
                source = r.choice(said).split("\n")
                at = r.randrange(len(source))
                quote = r.choice([source, source[at : at + r.randint(1, 3)], [source[at].upper()], ["never said"]])
                mark = r.choice(["> ", ">", " >  ", ">> ", "> > >"])
                lines = [mark + x for x in quote] + ([">>>> deeper"] if r.random() < 0.3 else []) + lines
            said.append("\n".join(x for x in lines if ">" not in x))
            messages.append((conv, turn * 2, "\n".join(lines)))
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in messages], "conv_id long, turn long, role string, text string")
    want = brute_chat(messages)
    assert linked(df) == want and sum(w[0] is not None and w[1] == k[1] for k, w in want.items()) > 20  # threads are opened


def test_quotes_of_deeper_levels_alone_are_linked(spark):
    m = [(1, 0, "first topic"), (1, 1, "other"), (1, 2, "more"), (1, 3, ">> first topic\nback to it"), (1, 4, "> first topic\n>> more\nsaid again"), (1, 5, "> line two.\n> second para.\nyes"), (2, 0, "line one.\nline two.\n\nsecond para."), (2, 1, "hm"), (2, 2, "> line two.\n> second para.\nyes")]
    got = linked(spark.createDataFrame([(c, t, "user", x) for c, t, x in m], "conv_id long, turn long, role string, text string"))
    assert [got[1, t][0] for t in range(6)] == [None, 0, 1, 0, 0, 4] and got[2, 2][0] == 0
    assert [got[1, t][3] for t in range(6)] == [0, 1, 2, 3, 4, 5] and [got[1, t][1] for t in range(6)] == [0, 0, 0, 3, 4, 4]


def test_long_messages_and_common_passages_take_linear_time(spark):
    import time

    lines = [f"line {k}" for k in range(100_000)]
    long = spark.createDataFrame([(1, 0, "user", "\n".join(lines)), (1, 1, "user", "no"), (1, 2, "user", "\n".join("> " + x for x in lines) + "\nyes")], "conv_id long, turn long, role string, text string")
    hot = spark.range(6000).select(F.lit(2).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("> ok\nok").alias("text"))
    began = time.time()
    got = {(x["conv_id"], x["turn"]): x["parent_turn"] for x in chat.link_quotations(long.unionAll(hot)).collect()}
    assert got[1, 2] == 0 and all(got[2, t] == t - 1 for t in range(1, 6000)) and time.time() - began < 60


def test_parts_of_paragraphs_and_deeper_levels_are_linked(spark):
    r, messages, want = random.Random(13), [], {}
    for conv in range(30):
        said = []  # the own lines of each turn, in order
        for turn in range(8):
            own = [f"line {r.randrange(10**6)}" for _ in range(5)]
            quote, depth = [], r.choice([1, 1, 2, 3])
            if turn > 1:
                source = r.randrange(turn)
                at, n = r.randrange(4), r.randrange(2, 5)
                quote = said[source][at : at + n]
                want[conv, turn] = source
            between = "> never said\n" if r.random() < 0.5 else ""  # parts the own lines, as replies between quotes do
            text = "".join(">" * depth + f" {x.upper()}\n" for x in quote) + "\n".join(own[:2]) + "\n" + between + "\n".join(own[2:])
            said.append(own)
            messages.append((conv, turn, "user", text))
    messages += [(99, 0, "user", "a\nb"), (99, 1, "user", "c\nd"), (99, 2, "user", ">> c\n>> d\n> a\n> b\nx"), (99, 3, "user", "> b\n> a\ny")]
    want |= {(99, 2): 0, (99, 3): 2}
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    got = {(x["conv_id"], x["turn"]): x["parent_turn"] for x in chat.link_quotations(df).collect()}
    assert {k: got[k] for k in want} == want


def test_long_conversations_are_linked_in_blocks(spark):
    n = chat.TURNS_A_BLOCK + 50
    df = spark.range(n).select(F.lit(1).alias("conv_id"), (F.col("id") * 3).alias("turn"), F.lit("user").alias("role"), F.lit("same").alias("text"))
    out = chat.link_quotations(df)
    assert out.where("parent_turn is null").count() == 1 and out.where("parent_turn = turn - 3").count() == n - 1 and out.agg(F.max("depth")).first()[0] == n - 1


# 4 HTML


@pytest.fixture(scope="module")
def articles():
    return html_extract.fit_articles()


def test_field_finds_articles_of_pages_it_has_not_seen(articles):
    good = total = 0
    for k in range(60):
        page = html_extract.blocks(html_extract.labelled_page(10_000_000 + k))
        marks = crf.viterbi(articles.chain, articles.chain.emissions(html_extract.features(page)))
        good += sum(m == (b[1].label == "1") for m, b in zip(marks, page, strict=True))
        total += len(page)
    assert good / total > 0.95


def test_pages_of_all_kinds(spark, articles):
    body = "<nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>One  two\n three.<p>Four <b>five</b>, six &lt;p&gt;.</p></article><footer>&copy; x</footer>"
    pages = [(1, "u", f"<html><body>{body}</body></html>"), (2, None, None), (3, "u", ""), (4, "u", "<html><body>" + body[: body.index("six")]), (None, "u", "no tags"), (1, "u", f"<html><body>{body}</body></html>"), (5, "u", "<script>if (a<b) {}</script><style>p{}</style><!-- x"), (6, "u", "<p>" + "x " * 200_000), (7, "u", "<div class='" + "a" * 50_000)]
    df = spark.createDataFrame([(*p, "t", 1) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    out = html_extract.main_text(df, articles).collect()
    assert len(out) == len(pages) and all(x["n_chars"] == len(x["text"]) for x in out)
    by = {x["page_id"]: x for x in out}
    assert by[1]["text"] == "A & B\n\nOne two three.\n\nFour five, six <p>." and by[2]["text"] == by[3]["text"] == by[5]["text"] == "" and by[4]["text"].endswith("Four five,")
    assert html_extract.main_text(df.limit(0), articles).count() == 0


class Cutter(html.parser.HTMLParser):
    """Blocks of pages whose tags are all closed, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.out, self.parts, self.raw = [], [], 0

    def cut(self):
        if text := " ".join("".join(self.parts).split()):
            self.out.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in html_extract.RAW:
            self.raw += 1
        elif tag == "br":
            self.parts.append("\n")
        elif tag not in html_extract.INLINE:
            self.cut()

    def handle_endtag(self, tag):
        if tag in html_extract.RAW:
            self.raw -= 1
        elif tag not in html_extract.INLINE:
            self.cut()

    def handle_data(self, data):
        if not self.raw:
            self.parts.append(data)


def test_blocks_against_a_parser():
    r = random.Random(11)

    def made(depth):
        if depth > 5 or r.random() < 0.3:
            return r.choice(["some  words", "a &amp; b", "&lt;p&gt; &eacute;&#233;", "x <b>bold</b> y", "<a href='/x?a=1&b=2'>link</a> on", "one<br>two", "<!-- no --> yes", "<script>if (a<b) {}</script>s", " \n\t"])
        tag = r.choice(["div", "p", "section", "ul", "article", "span", "em"]) if depth else "body"
        inside = "".join(made(depth + 1 + 5 * (tag == "p")) for _ in range(r.randint(1, 4)))  # a p holds no blocks
        return f"<{tag} class='c{r.randrange(3)}' data-x=\"a>b\">{inside}</{tag}>"

    for _ in range(200):
        page, cutter = made(0), Cutter()
        cutter.feed(page)
        cutter.close()
        cutter.cut()
        assert [b[0] for b in html_extract.blocks(page)] == cutter.out, page


def test_depth_changes_nothing(articles):
    prose = "It was a long day, and nobody had come to the harbour. The boats lay still, as they had for weeks. "
    inside = f"<div class='menu'><ul><li><a href='/'>Home</a></li></ul></div><article><h1>The harbour</h1><p>{prose * 2}</p><p>{prose}</p></article><aside class='sidebar'><p>Buy boats now</p></aside>"
    want = articles.text(f"<html><body>{inside}</body></html>")
    assert "harbour" in want and "Home" not in want and "Buy" not in want
    for n in (10, 140, 5000):
        assert articles.text("<html><body>" + "<div>" * n + inside + "</div>" * n + "</body></html>") == want
        assert articles.text("<html><body>" + "</section>" * n + inside + "</body></html>") == want
    import time

    began = time.time()
    html_extract.blocks("<div>x" * 100_000 + "</b></p></div>" * 100_000)
    assert time.time() - began < 20


S = "The council met on Tuesday to talk about the bridge, which has been closed since March. "
#: Hand-made pages of layouts that the generator does not make, with their main text.
PAGES = [
    (f"<html><body><table width=100%><tr><td bgcolor=#eee><a href=1>News</a><br><a href=2>Sport</a></td><td><font size=5>Bridge closed</font><p>{S * 3}<p>{S * 2}</td></tr></table><center>Copyright 1999</center></body></html>", ["Bridge closed", (S * 3).strip(), (S * 2).strip()]),
    (f"<body><div id=wrap><div id=hd><a href=/>Site</a></div><div id=bd><div class=story><h2>A bridge</h2><p>{S * 2}</p><ul><li>First point, which is long enough.</li><li>Second point, which is too.</li></ul><p>{S}</p></div></div><div id=ft>All rights reserved</div></div></body>", ["A bridge", (S * 2).strip(), "First point, which is long enough.", "Second point, which is too.", S.strip()]),
    (f"<body><header><nav><a href=a>One</a> <a href=b>Two</a></nav></header><main><article><header><h1>On bridges</h1></header><p>{S}</p><p>{S * 4}</p></article></main><footer><p>Contact us by post.</p></footer></body>", ["On bridges", S.strip(), (S * 4).strip()]),
    (f"<body><div class='cookie-banner'>We use cookies. <button>OK</button></div><div class='post-body entry-content'><p>{S * 2}</p><blockquote>{S}</blockquote><p>{S * 3}</p></div><div id=comments><h3>2 comments</h3><div class=comment><p>Great bridge, thanks!</p></div></div></body>", [(S * 2).strip(), S.strip(), (S * 3).strip()]),
    (f"<body><p>{S * 2}</p><p>{S}</p></body>", [(S * 2).strip(), S.strip()]),
    (f"<body><div class=page><div class=left-nav><a href=x>Archive</a><a href=y>Tags</a></div><section class=body-text><h1>Open again</h1><p>{S}</p><pre>load = 40 t</pre><p>{S * 2}</p></section><div class=related-links><a href=q>More on bridges</a></div></div></body>", ["Open again", S.strip(), "load = 40 t", (S * 2).strip()]),
    (f"<body><form action=/s><input name=q><button>Search</button></form><div role=main><h1>Report</h1><div>{S * 3}</div><div>{S * 2}</div></div><div class=newsletter-signup><p>Subscribe to our letters.</p></div></body>", ["Report", (S * 3).strip(), (S * 2).strip()]),
]


def test_hand_made_pages(articles):
    hit = given = wanted = 0
    for page, want in PAGES:
        got = articles.text(page).split("\n\n")
        hit, given, wanted = hit + len(set(got) & set(want)), given + len([g for g in got if g]), wanted + len(want)
    f1 = 2 * hit / (given + wanted)
    print(f"block F1 of hand-made pages {f1:.3f}: {hit} of {wanted}, {given} given")
    assert f1 > 0.85


# 5 top-k


def test_top_k_against_all_pairs(spark):
    r = np.random.default_rng(4)
    v = [(int(i), [float(x) for x in r.normal(size=8)]) for i in range(300)]
    v += [(1000 + k, v[10][1]) for k in range(40)] + [(2000, None), (2050, [1.0, None] * 4), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, [0.5]), (2250, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, x, 0) for i, x in v], "vec_id long, embedding array<float>, score int")
    for wave, block in ((8192, 4096), (2, 16)):
        out = vafile.exact_top_k(vafile.integer_vectors(df, "vec_id", "embedding"), "vec_id % 50 = 0", wave=wave, block_rows=block).collect()
        got = collections.defaultdict(list)
        for x in sorted(out, key=lambda x: (x["query_id"], x["rank"])):
            got[x["query_id"]].append((x["vec_id"], x["score"]))
        ints = {i: np.floor(256 * np.float32(x).astype(float)).astype(int) for i, x in v if i is not None and x and len(x) == 8 and None not in x and np.isfinite(x).all()}
        want = {q: sorted(((int(ints[q] @ y), -i) for i, y in ints.items() if i != q), reverse=True)[:5] for q in ints if q % 50 == 0}
        assert dict(got) == {q: [(-i, s) for s, i in x] for q, x in want.items()}
    assert vafile.exact_top_k(vafile.integer_vectors(df.limit(0), "vec_id", "embedding"), "vec_id % 50 = 0").count() == 0


def test_products_beyond_a_long_are_refused(spark):
    df = spark.createDataFrame([(0, [1e30, 0.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="do not fit"):
        vafile.exact_top_k(vafile.integer_vectors(df, "vec_id", "embedding"), "vec_id % 50 = 0")


def test_bounds_hold_on_packed_cells():
    r = np.random.default_rng(1)
    for dims in (1, 3, 16, 64):
        x, q = r.integers(-300, 300, (500, dims)), r.integers(-300, 300, (20, dims)).astype(float)
        low, width, cells = vafile.quantised(x)
        codes = vafile.unpacked(cells, dims)
        assert vafile.packed(codes) == cells and codes.max() < 1 << vafile.CELL_BITS and (width > 1).all()
        assert (low + codes * width <= x).all() and (x < low + (codes + 1) * width).all()
        lower, upper = vafile.Bounds(dims, low, width, cells).both(q)
        assert (lower <= q @ x.T).all() and (q @ x.T <= upper).all()


def test_equal_vectors_are_kept_as_far_as_any_query_can_rank_them():
    r = np.random.default_rng(2)
    ids, v = r.integers(0, 12, 300), r.integers(0, 2, (300, 2))
    kept = vafile.distinct_enough(ids, v, 2)
    for query in range(13):
        for value in np.unique(v, axis=0):
            best = lambda at: sorted(ids[[k for k in at if (v[k] == value).all() and ids[k] != query]])[:2]
            assert best(range(300)) == best(kept)
    assert len(kept) <= 4 * 3 * 2


def test_the_file_is_small_and_spares_exact_reading(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = vafile.integer_vectors(table, "vec_id", "embedding")
    file = vafile.approximation(vectors.withColumn("row", F.monotonically_increasing_id()), 4096, 5).collect()
    assert sum(len(b["cells"]) for b in file) < 4 * 64 * table.count() / 4 and sum(len(b["rows"]) for b in file) == table.count()
    assert all(w > 1 for b in file for w in b["width"])
    read = []
    products = vafile._products
    monkeypatch.setattr(vafile, "_products", lambda candidates, *a: read.append(candidates.count()) or products(candidates, *a))
    queries = vectors.where("vec_id % 50 = 0").count()
    assert vafile.exact_top_k(vectors, "vec_id % 50 = 0").count() == 5 * queries
    assert sum(read) < queries * (table.count() - 1) / 20  # of exact vectors under a twentieth


# 6 exact dedup


@pytest.mark.parametrize("weak", [False, True])
def test_names_are_free_of_collisions(spark, weak):
    texts = ["aB" * 7, "Ab" * 7, "x", None, "", "aba" * 30, "aba" * 29 + "abb", "ABA" * 30, "aba" * 31, "q" * 50, "q" * 50, "é" * 23, "É" * 23]
    df = docs_of(spark, [*enumerate(texts), (3, None), (None, "x"), (None, "zz")])
    hashed = (lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(3))) if weak else F.xxhash64
    names = collections.defaultdict(set)
    rows = exact_dedup.identities(df, 5, hashed).collect()
    for x in rows:
        names[x["n_blocks"], x["h"], x["r"]].add(x["text_sha256"])
    assert len(rows) == 16 and len(names) == len({x["text_sha256"] for x in rows}) and all(len(s) == 1 for s in names.values())


def test_exact_duplicates_of_a_corpus(spark, corpus):
    lower = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)
    rows = [(r["doc_id"], (r["text"] or "").translate(lower)) for r in corpus.collect()]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    out = exact_dedup.exact_duplicates(corpus).collect()
    best = lambda g: max((i for i in g if i is not None), default=None)
    want = sorted(((i, best(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=repr)
    assert sorted(((x["doc_id"], x["keep_id"], x["group_size"], x["text_sha256"]) for x in out), key=repr) == want
    assert sum(x["kept"] for x in out) == len(groups)
    assert exact_dedup.exact_duplicates(corpus.limit(0)).count() == 0


# 7 packing


def test_pieces_hold_every_id_once(spark, corpus):
    from tokenizers import Tokenizer

    tok, out = Tokenizer.from_file(JSON), packing.pack(corpus, RANKS, public_tokenizers.PATTERN, JSON).collect()
    texts = collections.Counter((r["doc_id"], r["text"] or "") for r in corpus.collect())
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for x in out:
        pieces[x["doc_id"]].append(x)
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
    for s in sequences.values():
        assert [o for o, _ in sorted(s)] == [0, *itertools.accumulate(n for _, n in sorted(s))][:-1] and sum(n for _, n in s) <= 1024 and len(s) <= packing.SEGMENTS
    padding = sum(1024 - n for s in sequences.values() if (n := sum(x for _, x in s)) & (n - 1))
    assert padding <= 0.01 * sum(x["length"] for x in out)
    for (doc, text), times in texts.items():
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        mine = [x for x in pieces[doc] if x["doc_tokens"] == len(ids)]
        if doc is not None:
            assert sum(x["length"] for x in mine) == times * len(ids)
        for x in mine:
            if doc is not None:
                assert x["ids_crc32"] == zlib.crc32(np.array(ids[x["start"] : x["start"] + x["length"]], "<u4").tobytes())
    assert packing.pack(corpus.limit(0), RANKS, public_tokenizers.PATTERN, JSON).count() == 0


def test_three_limits_hold():
    r = random.Random(2)
    p = packing.Packer(0, 64, 4, 40)
    for k in range(500):
        p.add(k, np.arange(r.choice([1, 2, 3, 30, 90])).astype("<u4"), r.choice([0.0, 0.5, 1.0]))
    p.fill(0)
    by = collections.defaultdict(list)
    for row in p.rows:
        by[row[5]].append(row)
    assert all(sum(x[2] for x in s) <= 64 and len(s) <= 4 and sum(x[7] for x in s) <= 40 + 4 for s in by.values())
    done = collections.Counter()
    for row in p.rows:
        done[row[0]] += row[2]
    assert all(done[row[0]] == row[4] for row in p.rows) and len(done) == 500


# 8 quality


def test_marginals_and_viterbi_against_all_labellings():
    r = np.random.default_rng(0)
    chain = crf.Chain(np.zeros(1), np.ones(1), np.zeros(2), r.normal(size=(2, 2)), r.normal(size=2))
    for n in (1, 2, 5):
        e = r.normal(size=n) * 2
        score = {y: chain.start[y[0]] + sum(e[t] * y[t] for t in range(n)) + sum(chain.steps[a, b] for a, b in itertools.pairwise(y)) for y in itertools.product((0, 1), repeat=n)}
        z = sum(np.exp(s) for s in score.values())
        want = [sum(np.exp(s) for y, s in score.items() if y[t]) / z for t in range(n)]
        assert np.allclose(crf.marginals(chain, e), want) and tuple(crf.viterbi(chain, e)) == max(score, key=score.get)
        logz, m, _ = crf._forward_backward(e[None], np.ones((1, n), bool), chain.steps, chain.start)
        assert np.isclose(logz[0], np.log(z)) and np.allclose(m[0, :, 1], want)


def test_quality_learns_lines(spark, corpus):
    r = random.Random(8)
    good = lambda: " ".join(r.choice(["the", "of", "house", "tree", "and", "river"]) for _ in range(12)).capitalize() + "."
    junk = lambda: " ".join(r.choice(["BUY!!", "###", "$$$ NOW!!", "|"]) for _ in range(12))
    made = [(k, "\n".join(([good()] + [junk() for _ in range(5)]) if k % 4 == 0 else [good() for _ in range(5)]), int(k % 4 != 0)) for k in range(240)]
    docs, labels = docs_of(spark, [(k, t) for k, t, _ in made]), spark.createDataFrame([(k, y) for k, _, y in made], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels, fold("doc_id", 5) != 0)
    got = {x["doc_id"]: x["score"] for x in quality.score_quality(docs.select("doc_id", "text"), model).collect()}
    assert all((got[k] >= 0.3) == bool(y) for k, _, y in made)
    lines, _ = model.lines(made[0][1], quality._classes())
    assert lines[0] > lines[1:].max()
    rows = quality.score_quality(corpus.select("doc_id", "text"), model).collect()
    assert len(rows) == corpus.count() and all(0 <= x["score"] <= 1 for x in rows)
    none = quality.fit_quality(docs.limit(0), labels.limit(0), F.lit(True))
    assert {x["score"] for x in quality.score_quality(docs.limit(3).select("doc_id", "text"), none).collect()} == {0.5}


def test_sample_is_bounded_in_lines(spark):
    made = [(k, "\n".join(["The house of the river is old."] * (3 if k % 4 else 400)), k % 2) for k in range(40)]
    docs, labels = docs_of(spark, [(k, t) for k, t, _ in made]), spark.createDataFrame([(k, y) for k, _, y in made], "doc_id long, quality int")
    few = quality.fit_quality(docs.where("doc_id % 4 <> 0"), labels, F.lit(True))
    all_ = quality.fit_quality(docs, labels, F.lit(True))
    assert np.allclose(few.chain.weights, all_.chain.weights)  # rows of many lines are left out of the fit
    assert quality.score_quality(docs, all_).count() == 40


# 9 BPE


def test_round_trip_and_ids(spark, corpus):
    from tokenizers import Tokenizer

    enc, tok = bpe.encoding(RANKS, public_tokenizers.PATTERN), Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    out = bpe.token_ids(corpus, RANKS, public_tokenizers.PATTERN).collect()
    left = collections.Counter((x["doc_id"], bytes(x["decoded"])) for x in out)
    assert left == collections.Counter((r["doc_id"], (r["text"] or "").encode()) for r in corpus.collect())
    for x in out:
        assert x["ids"] == tok.encode(bytes(x["decoded"]).decode(), add_special_tokens=False).ids
    assert enc.decode_bytes(bpe.encode(enc, "é"))[:1] == "é".encode()[:1]
    digest = {(x["doc_id"], x["decoded_sha256"]): x for x in bpe.digests(corpus, RANKS, public_tokenizers.PATTERN).collect()}
    for x in out:
        d = digest[x["doc_id"], hashlib.sha256(bytes(x["decoded"])).hexdigest()]
        assert d["n_tokens"] == len(x["ids"]) and d["ids_sha256"] == hashlib.sha256(np.array(x["ids"], "<u4").tobytes()).hexdigest()


def test_safe_boundaries_change_no_id(monkeypatch):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    r = random.Random(6)
    pieces = ["a", "B", "é", "1", " ", "  ", "\n", "\t", "'s", "!", "...", " ", "word", "　", "don't"]
    for _ in range(300):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 200)))
        monkeypatch.setattr(bpe, "LONG_TEXT", 0)
        monkeypatch.setattr(bpe, "PART", r.randint(1, 20))
        assert bpe.encode(enc, text) == enc.encode_ordinary(text) and "".join(bpe.parts(text)) == text


def test_long_runs_of_white_space(monkeypatch):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for text in ("a" + " " * 5000 + "b", "\n" * 4096, "x " + "\t" * 4100 + "\u3000y", " " * 4500 + "\n", "\x1c" * 5000, "é" + "\xa0" * 6000 + "1 2", " " * 4096 + "'s"):
        want = enc.encode_ordinary(text)
        monkeypatch.setattr(bpe, "LONG_TEXT", 0)
        assert bpe.encode(enc, text) == want
    assert enc.decode_bytes(bpe.encode(enc, " " * 1_000_000 + "b" + "\n" * 300_000)) == b" " * 1_000_000 + b"b" + b"\n" * 300_000


# 10 sharding


def test_smallest_capacity_against_all_cuts():
    r = random.Random(1)
    for _ in range(200):
        sizes, k = [r.randint(0, 20) for _ in range(r.randint(1, 8))], r.randint(1, 4)
        cuts = itertools.combinations_with_replacement(range(len(sizes) + 1), k - 1)
        want = min(max(sum(sizes[a:b]) for a, b in itertools.pairwise((0, *c, len(sizes)))) for c in cuts)
        assert sharding.smallest_capacity(sizes, k) == want
        shards = sharding.cut(sizes, k)
        assert shards == sorted(shards) and len(shards) == len(sizes) and max(sum(s for s, x in zip(sizes, shards, strict=True) if x == y) for y in range(k)) == want


def test_shards_of_a_corpus(spark, corpus):
    for cell in (4096, 2):
        out = sharding.shard(corpus, shards=7, atoms=64, cell_rows=cell).collect()
        assert len(out) == corpus.count() and {x["law"] for x in out} == {"bytes"}
        slots = collections.defaultdict(list)
        for x in out:
            slots[x["shard"]].append(x["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        where = collections.defaultdict(set)
        for x in out:
            where[x["text_crc32"], x["size"]].add(x["shard"])
        assert all(len(s) == 1 for s in where.values())
        want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 16) for r in corpus.collect())
        assert collections.Counter((x["doc_id"], x["size"]) for x in out) == want
    assert sharding.shard(corpus.limit(0)).count() == 0


def test_a_hot_group_leaves_the_other_shards_even(spark):
    df = docs_of(spark, [(k, "hot text " * 20) for k in range(300)] + [(300 + k, f"text {k} " * 10) for k in range(600)])
    load = collections.Counter()
    for x in sharding.shard(df, shards=8, atoms=1024).collect():
        load[x["shard"]] += x["size"]
    rest = sorted(load.values())[:-1]
    assert len(load) == 8 and max(rest) < 1.2 * sum(rest) / 7


def test_repeats_of_one_row_are_numbered(spark):
    df = docs_of(spark, [(1, "same")] * 500 + [(2, "same")] * 3 + [(3, None), (None, None), (4, "x")])
    out = sharding.shard(df, shards=3, atoms=8).collect()
    slots = collections.defaultdict(list)
    for x in out:
        slots[x["shard"]].append(x["slot"])
    assert len(out) == 506 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_runs_of_the_order():
    r = random.Random(3)
    for _ in range(100):
        atoms = [(k, r.randint(0, 30)) for k in range(r.randint(300, 400))] + [(1000 + k, 9000) for k in range(r.randint(0, 2))]
        found = sharding.assign(atoms, 8)
        large = [a for a, _ in atoms if a >= 1000]
        if large:
            rest = [found[a] for a, _ in atoms if a < 1000]
            assert rest == sorted(rest) and {found[a] for a in large} == set(range(len(large)))
