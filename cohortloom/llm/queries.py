"""The registered queries of the corpus operators: thin, each with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import bpe, chat, exact_dedup, filter_audit, html_extract, negatives, packing, quality, quality_rules, sharding, simhash, toxicity, vafile
from cohortloom.llm.common import fold, table


def _predicted(scored: DataFrame, held_out: Column, least: float) -> DataFrame:
    return scored.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a grammar learned from labelled rows that are not held out; a null text is empty, rows without id are held out as their empty text says."""
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 3) == 1
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)
    return _predicted(toxicity.score_toxicity(docs.select("doc_id", "text"), model), held_out, 0.7)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components of at most four differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes, with what it quotes and answers; nulls, ties and repeats as link_quotations() says."""
    return chat.link_quotations(table(spark, sf_dir, "conversations"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by a field fitted on generated pages."""
    return html_extract.main_text(table(spark, sf_dir, "pages"), html_extract.fit_articles())


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every fiftieth; nulls, ties and repeats as exact_top_k() says."""
    vectors = vafile.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return vafile.exact_top_k(vectors, "vec_id % 50 = 0")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equals that stays."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1,024 tokens; an empty text is its end token alone."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a field over lines learned from labelled rows that are not held out; a null text is empty."""
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out)
    return _predicted(quality.score_quality(docs.select("doc_id", "text"), model), held_out, 0.3)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in forty shards of near equal size, equal texts together."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part and order of the five filters over all documents; nulls, repeats and empty tables as filter_audit says."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by robust outliers of its language and source; nulls, repeats and empty tables as quality_rules says."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every hundredth vector over all vectors; labels of ids divisible by 7 are one on. Nulls, ties and repeats as hard_negatives says."""
    rows = negatives.labelled_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), "vec_id % 100 = 0")


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_chat, op4_html, op5_top_k, op6_exact_dedup, op7_packing, op8_quality, op9_bpe, op10_sharding, op11_filter_audit, op12_quality_rules, op13_hard_negatives)}


TOP_K_SQL = """
with v as (select vec_id, list_transform(embedding, lambda e: floor(256 * e::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""

EXACT_SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
g as (select *, max(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as group_size,
  row_number() over (partition by text order by doc_id desc nulls last) = 1 as kept from t)
select doc_id, keep_id, group_size, kept, sha256(text) as text_sha256 from g"""


AUDIT_SQL = r"""
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from t),
f as (select doc_id, part, (case when len(ws) < 50 then 1 else 0 end) + (case when 100 * len(list_distinct(ws)) < 65 * len(ws) then 2 else 0 end)
    + (case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) then 4 else 0 end)
    + (case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end)
    + (case when doc_id > min(doc_id) over (partition by text) then 16 else 0 end) as mask from w),
l as (select doc_id, max((quality is not distinct from 1)::int) as good, max((toxic is not distinct from 1)::int) as toxic from labels group by 1),
m as (select part, mask, count(*) as n, count(*) filter (where good = 1) as good, count(*) filter (where toxic = 1) as toxic from f left join l using (doc_id) group by 1, 2),
x(c) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
o as (select a.c || b.c || c.c || d.c || e.c as filter_order from x a, x b, x c, x d, x e
  where a.c not in (b.c, c.c, d.c, e.c) and b.c not in (c.c, d.c, e.c) and c.c not in (d.c, e.c) and d.c <> e.c),
s as (select filter_order, step, (1 << (ascii(substr(filter_order, step, 1)) - 65))::int as bit,
    list_sum(list_transform(range(1, step), lambda k: (1 << (ascii(substr(filter_order, k::int, 1)) - 65))::int))::int as earlier from o, (select unnest(range(1, 6))::int as step)),
r as (select part, filter_order, step, any_value(bit) as bit, sum(case when mask & (coalesce(earlier, 0) | bit) = 0 then n else 0 end)::bigint as kept,
    sum(case when mask & coalesce(earlier, 0) = 0 and mask & bit <> 0 then n else 0 end)::bigint as removed,
    sum(case when mask & coalesce(earlier, 0) <> 0 and mask & bit <> 0 then n else 0 end)::bigint as redundant,
    sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
    sum(case when mask & coalesce(earlier, 0) = 0 and mask & bit <> 0 then good else 0 end)::bigint as good_lost,
    sum(case when mask & coalesce(earlier, 0) = 0 and mask & bit <> 0 then toxic else 0 end)::bigint as toxic_lost
  from m, s group by 1, 2, 3)
select * exclude (bit), (sum(removed) over (partition by part, bit))::bigint as shapley from r"""

NEGATIVES_SQL = """
with v as (select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label, list_transform(embedding, lambda e: floor(256 * e::double)::bigint) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0),
a as (select vec_id, min({'label': label, 'v': v}) as a from v where vec_id % 100 = 0 group by 1),
s as (select a.vec_id as anchor_id, c.vec_id, a.a.label = c.label as same, list_sum(list_transform(list_zip(a.a.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from a join v c on a.vec_id <> c.vec_id and len(a.a.v) = len(c.v)),
p as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as place from s where same),
n as (select anchor_id, place, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by anchor_id, place order by s.score desc, s.vec_id)::int as rank
  from p join s using (anchor_id) where place <= 5 and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op5_top_k": TOP_K_SQL, "op6_exact_dedup": EXACT_SQL, "op11_filter_audit": AUDIT_SQL, "op13_hard_negatives": NEGATIVES_SQL}
