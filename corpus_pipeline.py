"""The corpus pipeline: quality, toxicity, exact and near duplicates, packing; each stage written and read again.

Every stage takes whole texts of any length, a null one as empty, passes nulls of other columns and repeated rows on, gives an
empty table for an empty one, and drops columns beside those of documents, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import exact_dedup, packing, quality, similar, toxicity
from cohortloom.llm.common import discard, discard_since, fold, materialize, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _key(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of a quality score under 0.3. Repeated rows fare alike; a tie at 0.3 stays; without labels of both classes all score alike."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return quality.score_quality(docs.select(*COLUMNS), model).where("score >= 0.3").select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of a toxicity score of 0.7 or more. Repeated rows fare alike; a tie at 0.7 goes; an empty text holds nothing toxic."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return toxicity.score_toxicity(docs.select(*COLUMNS), model).where("score < 0.7").select(*COLUMNS)


def exact_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts the row with the largest doc_id stays, one of its repeats; a row without id only where no other has one."""
    kept = exact_dedup.exact_duplicates(docs).where("kept").select(_key().alias("key"), F.col("text_sha256").alias("sha"))
    keyed = docs.select(*COLUMNS, _key().alias("key"), F.sha2(exact_dedup.normalized(), 256).alias("sha"))
    return keyed.join(kept, ["key", "sha"], "left_semi").dropDuplicates(["key", "sha"]).select(*COLUMNS)


def near_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest doc_id stays.

    Rows without an id or without words stay, repeats of a row stay together; chains of near duplicates are one group.
    """
    dropped = similar.similar_documents(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1,024 tokens: packing.pack() of all rows; an empty text is its end token alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("exact_dedup", exact_once), ("near_dedup", near_once), ("packing", packed)]

#: The stages fit models and tokenise, which SQL cannot express; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each one's rows are written, in the folder of spark.checkpoint.dir, and read again.

    What a stage wrote on its way, and its own input, is deleted when its rows are written.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        mark = written()
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        made = materialize(made)
        discard_since(spark, mark, but=1)
        if k:
            discard(docs)
        docs = made
