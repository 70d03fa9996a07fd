"""Sources by kind: reading what a configuration names, checksums, dataset manifests."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.parse import is_placeholder
from cohortloom.operators.cohorts import ContractError, assert_rows_match_policy, require_none
from cohortloom.operators.experiments import namespaced
from cohortloom.sources import geo, matrixmarket

#: What an assay policy admits and whether it can be trained on.
POLICIES = {"single_cell_only": {"bulk": False, "trainable": True}, "bulk_only": {"bulk": True, "trainable": True}, "multimodal": {"bulk": None, "trainable": False}}
MODES = {"human_only": ("human",), "mouse_only": ("mouse",), "cross_species": ("human", "mouse")}


@dataclass
class Entry:
    """A dataset of a manifest; checksums is file to SHA-256, null where a file is absent."""

    name: str
    kind: str
    species: str
    access: str
    checksums: dict[str, str | None] = field(default_factory=dict)

    def validate(self) -> None:
        if self.species not in ("human", "mouse") or self.access not in ("open", "controlled") or not self.name:
            raise ContractError(f"entry {asdict(self)}")


def single_cell(spark: SparkSession, at: dict) -> tuple[DataFrame, DataFrame]:
    """(expr, cells) of a MatrixMarket triple {matrix, barcodes, genes, n_barcodes, n_genes}; a barcode is its own subject unless donors (cell_id, subject_id) are given."""
    b, g = matrixmarket.id_list(spark, at["barcodes"], at["n_barcodes"]), matrixmarket.id_list(spark, at["genes"], at["n_genes"], symbols=True)
    expr = matrixmarket.cells_by_genes(matrixmarket.triples(spark, at["matrix"]), matrixmarket.size_of(spark, at["matrix"]), b, g)
    cells = b.select(F.col("id").alias("cell_id"))
    if "donors" in at:
        cells = cells.join(spark.read.csv(at["donors"], header=True), "cell_id", "left")
    subject = F.col("subject_id") if "subject_id" in cells.columns else F.lit(None).cast("string")
    species = at.get("species", "human")
    return expr, cells.select("cell_id", namespaced(F.coalesce(subject, F.lit("unknown")), F.lit(species)).alias("subject_id"), F.lit(False).alias("is_pseudo_bulk"), F.lit(species).alias("species"))


def microarray(spark: SparkSession, at: dict) -> tuple[DataFrame, DataFrame]:
    """(expr, cells) of a genes-by-samples table {csv, sidecar, smoke_type}."""
    expr = geo.wide_matrix(spark, at["csv"])
    cells = geo.with_sidecar(expr, spark.read.csv(at["sidecar"], header=True), at["smoke_type"]).withColumnRenamed("sample_id", "cell_id").withColumn("species", F.lit("human"))
    return expr.withColumnRenamed("sample_id", "cell_id"), cells


def conditions(spark: SparkSession, at: dict) -> tuple[DataFrame, DataFrame]:
    """(expr, cells) of one MatrixMarket triple for each sample, {samples: [{matrix, barcodes, genes, n_barcodes, n_genes}, ...]}, on all their genes.

    Sample and condition are read from the matrix's name; absent values are zeros, so the union of genes needs no filling. A condition that is
    not known leaves the label empty.
    """
    from cohortloom.operators.texts import sample_of_file

    expr = cells = None
    for one in at["samples"]:
        e, c = single_cell(spark, one | {"species": at.get("species", "mouse")})
        s = spark.range(1).select(sample_of_file(F.lit(one["matrix"])).alias("s")).first()["s"]
        name = F.concat(F.lit(f"{s['sample']}_{s['condition']}_"), "cell_id")
        e = e.groupBy(name.alias("cell_id"), "gene").agg(F.sum("value").alias("value"))  # a symbol may stand for several ids
        c = c.select(name.alias("cell_id"), namespaced(F.lit(s["sample"]), F.lit(at.get("species", "mouse"))).alias("subject_id"), "is_pseudo_bulk", "species", F.lit(s["label"]).cast("string").alias("smoke_type"))
        expr, cells = (e, c) if expr is None else (expr.unionByName(e), cells.unionByName(c))
    if expr is None:
        raise ContractError("no sample is given")
    return expr, cells


def _bulk(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("sample_id").alias("cell_id"), *(c for c in cells.columns if c != "sample_id"), F.lit(True).alias("is_pseudo_bulk"), F.lit("human").alias("species"))


def three_fields(spark: SparkSession, at: dict) -> tuple[DataFrame, DataFrame]:
    """(expr, cells) of a series matrix and the matrix of its samples {series, matrix}; every sample is its own subject."""
    expr, samples = geo.three_field_microarray(spark, at["series"], at["matrix"])
    return expr.withColumnRenamed("sample_id", "cell_id"), _bulk(samples.withColumn("subject_id", F.col("sample_id")))


def count_folder(spark: SparkSession, at: dict) -> tuple[DataFrame, DataFrame]:
    """(expr, cells) of a folder with file_meta.csv and a count table in a folder for each file id, {folder, layout}.

    layout is "plain" (gene and count, statistics rows begin with __) or "star" (named columns, statistics rows begin with N_). Files that the sheet does not list, and
    annotations, are left out; listed files that are not there too, and none at all is an error. A case is the subject, a file without case its own. Whether a
    sample is of a tumour says what was dissected, of the whole sample: it is malignancy of bulk rows alone. Smoking is unknown of all, never what is
    usual in the cohort. A gene that a file lacks counts as zero, so absent rows stay absent.
    """
    from cohortloom.operators.texts import strip_version

    sheet = spark.read.csv(f"{at['folder']}/file_meta.csv", header=True)
    if missing := [c for c in ("file_id", "sample_type", "case_id") if c not in sheet.columns]:
        raise ContractError(f"{at['folder']}/file_meta.csv lacks {missing}")
    listed = require_none(sheet.groupBy("file_id").agg(F.count("*").alias("n"), F.max("sample_type").alias("sample_type"), F.max("case_id").alias("case_id")), F.col("n") > 1, "files listed twice")
    if at.get("layout", "plain") == "star":
        rows = geo.star_counts(spark, f"{at['folder']}/*/*", at.get("value", "tpm_unstranded")).withColumnRenamed("file", "path")
    else:
        lines = spark.read.option("pathGlobFilter", "*").text(f"{at['folder']}/*/*").select("value", F.col("_metadata.file_path").alias("path"))
        f = F.split("value", "\t")
        rows = lines.where(~F.col("value").startswith("__") & (F.size(f) >= 2)).select("path", strip_version(F.get(f, F.lit(0))).alias("gene"), F.get(f, F.lit(1)).try_cast("double").alias("value"))
    rows = rows.where(F.element_at(F.split("path", "/"), -1) != "annotations.txt").withColumn("file_id", F.element_at(F.split("path", "/"), -2))
    expr = rows.join(F.broadcast(listed.select("file_id")), "file_id", "left_semi").where("value is not null").groupBy(F.col("file_id").alias("cell_id"), "gene").agg(F.sum("value").alias("value"))  # a row a file in the sheet
    there = listed.join(expr.select(F.col("cell_id").alias("file_id")).distinct(), "file_id", "left_semi")
    if there.isEmpty():
        raise ContractError(f"no count file is under {at['folder']}")
    case = F.when(F.trim(F.coalesce("case_id", F.lit(""))) != "", F.col("case_id")).otherwise(F.col("file_id"))
    samples = there.select(F.col("file_id").alias("sample_id"), case.alias("subject_id"), F.lit("unknown").alias("smoke_type"), F.lit(False).alias("smoke_type_known"), F.coalesce(F.col("sample_type").contains("Tumor"), F.lit(False)).cast("double").alias("malignancy"))
    return expr, _bulk(samples)


def subject_outcomes(cells: DataFrame) -> DataFrame:
    """(subject_id, outcome): 1 if any sample of a subject is malignant, 0 if none is; unknown samples say nothing, and a subject of such alone has no row."""
    return cells.where("malignancy is not null").groupBy("subject_id").agg(F.max("malignancy").cast("int").alias("outcome"))


READERS: dict[str, Callable] = {"single_cell": single_cell, "conditions": conditions, "microarray": microarray, "three_fields": three_fields, "count_folder": count_folder}
#: The file of each kind that decides whether a source is there.
MAIN: dict[str, Callable] = {"single_cell": lambda at: at["matrix"], "conditions": lambda at: at["samples"][0]["matrix"], "microarray": lambda at: at["csv"], "three_fields": lambda at: at["series"], "count_folder": lambda at: f"{at['folder']}/file_meta.csv"}


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds anything at a path."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def load_bulk(spark: SparkSession, at: dict, enabled: bool = False, trainable: bool = False) -> tuple[DataFrame, DataFrame] | None:
    """(expr, cells) of a bulk source, which is off by default: None. Every row must be bulk, and none may be asked for as trainable cells."""
    if trainable:
        raise ContractError("bulk rows are no cells to train on")
    if not enabled:
        return None
    expr, cells = microarray(spark, at)
    return expr, assert_rows_match_policy(cells, "bulk_only")


def load_config(config: dict | str) -> dict:
    """A configuration: a dictionary, or the path of a JSON file with an object."""
    if isinstance(config, dict):
        return config
    found = json.loads(Path(config).read_text())
    if not isinstance(found, dict):
        raise ContractError(f"{config} holds no object")
    return found


def load_all(spark: SparkSession, sources: dict[str, dict], policy: str = "single_cell_only", mode: str = "human_only") -> dict[str, tuple[DataFrame, DataFrame]]:
    """Every source whose files are there, under the policy and species mode; none at all is an error."""
    if policy not in POLICIES or mode not in MODES:
        raise ContractError(f"no policy {policy} or mode {mode}")
    out = {}
    for name, at in sources.items():
        if at["kind"] not in READERS:
            raise ContractError(f"no reader for {at['kind']}")
        if not is_there(spark, MAIN[at["kind"]](at)):
            continue
        expr, cells = READERS[at["kind"]](spark, at)  # a side file that is missing is an error
        require_none(assert_rows_match_policy(cells, policy), ~F.col("species").isin(*MODES[mode]), "species outside the mode")
        out[name] = (expr, cells)
    if not out:
        raise ContractError("no source is there")
    return out


def require_real_subjects(cells: DataFrame) -> DataFrame:
    """cells, unless some subject's name is a placeholder."""
    return require_none(cells, is_placeholder(F.col("subject_id")), "placeholder subjects")


def checksums(spark: SparkSession, paths: list[str]) -> dict[str, str | None]:
    """SHA-256 of each file, hashed in tasks; null where it is absent. For files that fit a task."""
    out: dict[str, str | None] = {}
    for p in paths:
        row = spark.read.format("binaryFile").load(p).select(F.sha2("content", 256)).first() if is_there(spark, p) else None
        out[p] = row[0] if row else None
    return out
