"""Every stage of the pipeline against a brute-force version on its own input, and every registered query on the smallest tables."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.llm.test_corpus import brute_similar

import corpus_pipeline as pipeline
from cohortloom.llm import bpe, exact_dedup, quality, queries, similar, toxicity
from cohortloom.llm.common import fold, materialize, table, written

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest documents with repeats, nulls in every column, near copies, an empty and a long text, and columns whose names the stages use."""
    base = table(spark, DATA, "documents").select(*pipeline.COLUMNS)
    first = base.where("length(text) > 400").orderBy("doc_id").limit(5).collect()
    near = [(900_000 + k, r["text"] + " one more word here", r["lang"], r["source"], None) for k, r in enumerate(first)]
    odd = [(None, "no id at all", None, None, None), (None, "no id at all", None, None, None), (None, None, "en", None, 3), (910_000, None, None, None, None), (910_001, "", None, None, 0), (910_002, first[0]["text"].upper(), None, None, 1), (910_003, "word " * 30_000, "en", "x", None)]
    extra = spark.createDataFrame(near + odd + [tuple(first[0]), tuple(first[0])], DOCS)
    return materialize(base.unionAll(extra).select("*", F.lit(0.5).alias("score"), F.lit("k").alias("key"), F.lit(1).alias("component_id"), F.lit(1).alias("kept")))


def test_quality_stage(spark, docs):
    model = quality.fit_quality(docs, table(spark, DATA, "labels"), fold("doc_id", 5) != 0)
    classes = quality._classes()
    want = [tuple(r) for r in docs.select(*pipeline.COLUMNS).collect() if model.score(r["text"] or "", classes) >= 0.3]
    got = rows_of(pipeline.good_quality(spark, docs, DATA))
    assert got == sorted(want, key=repr) and 0 < len(got) < docs.count()
    assert pipeline.good_quality(spark, docs.limit(0), DATA).count() == 0


def test_toxicity_stage(spark, docs):
    model = toxicity.fit_toxicity(docs, table(spark, DATA, "labels"), fold("doc_id", 3) != 1)
    want = [tuple(r) for r in docs.select(*pipeline.COLUMNS).collect() if model.score(model.clauses(r["text"] or "")) < 0.7]
    got = rows_of(pipeline.not_toxic(spark, docs, DATA))
    assert got == sorted(want, key=repr) and 0 < len(got) < docs.count()
    assert pipeline.not_toxic(spark, docs.limit(0), DATA).count() == 0


def test_exact_stage(spark, docs):
    lower = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)
    groups = collections.defaultdict(list)
    for r in docs.select(*pipeline.COLUMNS).collect():
        groups[(r["text"] or "").translate(lower)].append(r)
    got = collections.Counter((r["text"] or "").translate(lower) for r in pipeline.exact_once(spark, docs, DATA).collect())
    assert set(got) == set(groups) and set(got.values()) == {1}
    best = {t: max((r["doc_id"] for r in g if r["doc_id"] is not None), default=None) for t, g in groups.items()}
    assert {(r["text"] or "").translate(lower): r["doc_id"] for r in pipeline.exact_once(spark, docs, DATA).collect()} == best
    assert pipeline.exact_once(spark, docs.limit(0), DATA).count() == 0


def test_near_stage(spark, docs):
    rows = [r for r in docs.select(*pipeline.COLUMNS).collect()]
    texts = {}
    for r in rows:  # of a doc_id's rows all texts count; here they are equal
        if r["doc_id"] is not None:
            texts[r["doc_id"]] = r["text"]
    ids = sorted(texts)
    lower = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)
    found = brute_similar([(texts[i] or "").translate(lower) for i in ids])
    gone = {ids[k] for k, root in found.items() if root != k}
    got = rows_of(pipeline.near_once(spark, docs, DATA))
    assert len(gone) >= 5 and got == sorted((tuple(r) for r in rows if r["doc_id"] not in gone), key=repr)
    assert pipeline.near_once(spark, docs.limit(0), DATA).count() == 0


def test_packing_stage(spark, docs):
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = {(r["doc_id"], len(x)): x for r in docs.collect() for x in [[*bpe.encode(enc, r["text"] or ""), 0]]}
    want = collections.Counter((r["doc_id"], len(bpe.encode(enc, r["text"] or "")) + 1) for r in docs.collect())
    placed, bins = collections.Counter(), collections.defaultdict(list)
    for x in pipeline.packed(spark, docs, DATA).collect():
        mine = ids[x["doc_id"], x["doc_tokens"]] if (x["doc_id"], x["doc_tokens"]) in ids else None
        assert mine is not None
        if x["doc_id"] is not None:
            assert x["ids_crc32"] == zlib.crc32(np.array(mine[x["start"] : x["start"] + x["length"]], "<u4").tobytes())
        placed[x["doc_id"], x["doc_tokens"]] += x["length"]
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
    assert placed == collections.Counter({k: k[1] * n for k, n in want.items()})
    for s in bins.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert pipeline.packed(spark, docs.limit(0), DATA).count() == 0


def test_run_is_the_stages_one_after_the_other(spark):
    before = written()
    got = rows_of(pipeline.run(spark, DATA).select("doc_id", "start", "length", "ids_crc32", "doc_tokens"))
    assert written() - before == 1  # of what was written on the way, only the last stage's input is left
    docs = table(spark, DATA, "documents")
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == list(pipeline.COLUMNS), name
        docs = materialize(docs)
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {x[0] for x in got} == kept and 0 < len(kept) < table(spark, DATA, "documents").count()
    whole = collections.Counter()
    for doc, _, length, _, total in got:
        whole[doc, total] += length
    assert all(n == total for (_, total), n in whole.items())
    assert [n for n, _ in pipeline.STAGES] == ["quality", "toxicity", "exact_dedup", "near_dedup", "packing"] and pipeline.ORACLE_SQL is None


#: Columns of each query, and the table that it gives a row for, if it does.
CONTRACT = {
    "op1_toxicity": ({"doc_id", "held_out", "score", "predicted"}, "documents"), "op2_simhash": ({"doc_id", "fingerprint", "component_id"}, "documents"), "op3_chat": ({"conv_id", "turn", "text", "parent_turn", "position"}, "conversations"),
    "op4_html": ({"page_id", "url", "text", "n_chars"}, "pages"), "op5_top_k": ({"query_id", "rank", "vec_id", "score"}, None), "op6_exact_dedup": ({"doc_id", "keep_id", "group_size", "kept", "text_sha256"}, "documents"),
    "op7_packing": ({"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}, None), "op8_quality": ({"doc_id", "held_out", "score", "predicted"}, "documents"), "op9_bpe": ({"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "documents"),
    "op10_sharding": ({"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}, "documents")}


@pytest.mark.parametrize("name", list(CONTRACT))
def test_registered_queries(spark, name):
    columns, of = CONTRACT[name]
    df = queries.queries()[name](spark, DATA)
    rows = df.collect()
    assert columns <= set(df.columns)
    if of:
        assert len(rows) == table(spark, DATA, of).count()
    if name in ("op1_toxicity", "op8_quality"):
        least, modulus, rest = (0.7, 3, 1) if name == "op1_toxicity" else (0.3, 5, 0)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in rows)
    if name == "op3_chat":
        by = {(r["conv_id"], r["turn"]): r for r in rows}
        assert all(r["parent_turn"] is None or by[r["conv_id"], r["parent_turn"]]["position"] < r["position"] for r in rows)
    if name == "op10_sharding":
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_similar_documents_of_all_rows(spark):
    docs = table(spark, DATA, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids, lower = sorted(texts), str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)
    want = {ids[k]: ids[root] for k, root in brute_similar([(texts[i] or "").translate(lower) for i in ids]).items()}
    assert {r["doc_id"]: r["component_id"] for r in similar.similar_documents(docs).collect()} == want
