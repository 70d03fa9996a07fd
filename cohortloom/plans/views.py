"""The domain views that stand on the driver tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """A row for each cell: subject, class, source, whether the class is known, cell type."""
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select(
        v.alias("cell_id"), F.concat(F.lit("s"), v % 40).alias("subject_id"), "label", F.concat(F.lit("src"), v % 40 % 4).alias("source"), (v % 7 != 0).alias("known"), (v % 4).cast("int").alias("cell_type_id"))


def expr(spark: SparkSession, d: str) -> DataFrame:
    """(cell_id, gene, value) of the embedding dimensions."""
    long = table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.posexplode("embedding").alias("pos", "value"))
    return long.select("cell_id", F.concat(F.lit("g"), F.lpad(F.col("pos").cast("string"), 2, "0")).alias("gene"), F.col("value").cast("double").alias("value"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    """(cell_id, gene, value, subject_id, batch): large sparse triplets; every tenth gene is mitochondrial."""
    gene = F.col("l_partkey") % 200
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.concat(F.when(gene % 10 == 0, F.lit("MT-")).otherwise(F.lit("G")), gene.cast("string")).alias("gene"), "l_quantity")
    return lines.groupBy("cell_id", "gene").agg(F.sum("l_quantity").alias("value"))


def preds(spark: SparkSession, d: str) -> DataFrame:
    """A row for each labelled document as a prediction: truth, probability, group, seed."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("subject_id"), F.col("quality").alias("y_true"), ((F.col("n_chars") % 1000 + F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") / 4294967296.0) / 1000.0).alias("y_prob"), "lang", "source", (F.col("doc_id") % 8).cast("int").alias("seed"), "toxic")


CELLS = "cells as (select vec_id as cell_id, 's' || (vec_id % 40) as subject_id, label, 'src' || (vec_id % 40 % 4) as source, vec_id % 7 <> 0 as known, (vec_id % 4)::int as cell_type_id from embeddings)"
EXPR = "expr as (select vec_id as cell_id, 'g' || lpad((i - 1)::varchar, 2, '0') as gene, embedding[i]::double as value from embeddings, range(1, 65) r(i))"
COUNTS = "counts as (select l_orderkey as cell_id, (case when l_partkey % 200 % 10 = 0 then 'MT-' else 'G' end) || (l_partkey % 200) as gene, sum(l_quantity) as value from lineitem group by 1, 2)"
PREDS = "preds as (select l.doc_id as subject_id, l.quality as y_true, (d.n_chars % 1000 + ('0x' || substr(md5(l.doc_id::varchar), 1, 8))::bigint / 4294967296.0::double) / 1000.0::double as y_prob, d.lang, d.source, (l.doc_id % 8)::int as seed, l.toxic from labels l join documents d using (doc_id))"


def sql(*parts: str, then: str) -> str:
    """SQL with common table expressions."""
    return f"with {', '.join(parts)} {then}"
