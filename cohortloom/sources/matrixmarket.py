"""MatrixMarket coordinate files, 10x-style folders and id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators.cohorts import ContractError


def triples(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, val) from 0, of a coordinate file; stays long. Comments and the size line are left out, wherever the file is split.

    The size line is known by its value. An entry may look the same; a coordinate occurs once, so of n equal lines n - 1 are entries.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
    head = [r["value"] for r in lines.where(~F.col("value").startswith("%")).limit(1).collect()]
    banner = lines.where(F.col("value").startswith("%%MatrixMarket")).limit(1).collect()
    if not banner or not head or len(head[0].split()) != 3:
        raise ContractError(f"{path} is no MatrixMarket coordinate file")
    body = lines.where(~F.col("value").startswith("%") & (F.col("value") != head[0]))
    equal = lines.where(F.col("value") == head[0]).groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select(F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))).alias("k"), "value").select("value")
    f = F.split("value", r"\s+")
    return body.unionAll(equal).select((F.get(f, F.lit(0)).cast("int") - 1).alias("row"), (F.get(f, F.lit(1)).cast("int") - 1).alias("col"), F.coalesce(F.get(f, F.lit(2)).cast("float"), F.lit(1.0)).alias("val"))


def size_of(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(rows, columns, entries) as the file states them."""
    head = spark.read.text(path).where(~F.col("value").startswith("%")).limit(1).collect()
    return tuple(int(x) for x in head[0]["value"].split())


def id_list(spark: SparkSession, path: str, expected: int, symbols: bool = False) -> DataFrame:
    """(pos, id) of a tab list, second column where asked for and there; a header is dropped only if there is one line too many."""
    whole = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("lines"))
    lines = F.when(F.size("lines") == expected + 1, F.slice("lines", 2, expected)).otherwise(F.col("lines"))
    f = F.split("line", "\t")
    name = F.when(F.size(f) >= 2, F.get(f, F.lit(1))).otherwise(F.get(f, F.lit(0))) if symbols else F.get(f, F.lit(0))
    out = whole.select(F.posexplode(lines).alias("pos", "line")).select("pos", F.trim(name).alias("id"))
    if out.count() != expected:
        raise ContractError(f"{path} has not {expected} ids")
    return out


def cells_by_genes(entries: DataFrame, size: tuple[int, int, int], barcodes: DataFrame, genes: DataFrame) -> DataFrame:
    """(cell_id, gene, value): entries are turned if the columns, and not the rows, are as many as the barcodes."""
    n = barcodes.count()
    turn = size[1] == n and size[0] != n
    cell, gene = ("col", "row") if turn else ("row", "col")
    b, g = barcodes.select(F.col("pos").alias(cell), F.col("id").alias("cell_id")), genes.select(F.col("pos").alias(gene), F.col("id").alias("gene"))
    return entries.join(b, cell).join(F.broadcast(g), gene).select("cell_id", "gene", F.col("val").alias("value"))
