"""Predicting with a fitted model: what keeps input from being scored, and one row a subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.parse import is_placeholder
from cohortloom.operators import cohorts, mil
from cohortloom.operators.cohorts import ContractError, require_none

#: What rows of a policy are; other policies have no model (fixed values).
MODALITIES = {"single_cell_only": "single_cell", "bulk_only": "bulk"}
#: How a cell's type may have been found for a model that is used in earnest (fixed values).
ANNOTATIONS = ("inductive_per_cell", "pseudo_bulk_no_cell_type_identity")


def _problems(by: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(holds, name) for name, holds in by.items())))


def input_problems(cells: DataFrame, policy: str, cell_types: int, dims: int) -> DataFrame:
    """(subject_id, problem, n): the cells (subject_id, x, cell_type_id, is_pseudo_bulk, modality) that a model of `policy` may not score, by subject.

    What a row does not say is never taken for safe: a null is a problem of its column. One pass, summed in the tasks first.
    """
    if policy not in MODALITIES:
        raise ContractError(f"policy {policy} has no model")
    c, bulk = F.col, F.col("is_pseudo_bulk")
    found = _problems({
        "placeholder": is_placeholder(c("subject_id").cast("string")), "no_provenance": bulk.isNull(), "policy": bulk != F.lit(policy == "bulk_only"), "modality": ~c("modality").eqNullSafe(MODALITIES[policy]),
        "cell_type": c("cell_type_id").isNull() | ~c("cell_type_id").between(0, cell_types - 1), "length": c("x").isNull() | (F.size("x") != dims),
        "not_finite": F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))})
    return cells.select("subject_id", F.explode(found).alias("problem")).groupBy("subject_id", "problem").agg(F.count("*").alias("n"))


def panel_problems(fitted: DataFrame, given: DataFrame) -> DataFrame:
    """(pos, gene, given) where the genes of a matrix without names, (pos, gene), are not those fitted, in their order."""
    theirs = given.select("pos", F.col("gene").alias("given"))
    return fitted.select("pos", "gene").join(theirs, "pos", "full").where(~F.col("gene").eqNullSafe(F.col("given")))


def artifact_problems(artifacts: DataFrame, current: str) -> DataFrame:
    """artifacts with problems (array<string>): what keeps a fitted artifact from being used in earnest; an absent field is a problem.

    artifacts: policy, policy_version, bulk_at_fit, modality_at_fit, degraded, annotation, map_fingerprint. current is the
    fingerprint of the mapping of cell types in use.
    """
    c, print_ = F.col, F.col("map_fingerprint")
    per_cell, none = c("annotation") == ANNOTATIONS[0], c("annotation") == ANNOTATIONS[1]
    return artifacts.withColumn("problems", _problems({
        "policy": c("policy").isNull() | ~c("policy").isin(*MODALITIES, "multimodal"), "policy_version": F.coalesce(c("policy_version"), F.lit("")) == "", "incomplete": c("bulk_at_fit").isNull() | c("modality_at_fit").isNull(),
        "contradiction": (c("policy") == "single_cell_only") & c("bulk_at_fit"), "degraded": ~c("degraded").eqNullSafe(False), "annotation": c("annotation").isNull() | ~c("annotation").isin(*ANNOTATIONS),
        "fingerprint": per_cell & ~F.coalesce(print_.rlike("^[0-9a-f]{64}$"), F.lit(False)), "stale_mapping": per_cell & print_.rlike("^[0-9a-f]{64}$") & (print_ != current), "unexpected_mapping": none & print_.isNotNull()}))


def predict_subjects(cells: DataFrame, model: mil.GatedAttention, policy: str, cell_types: int, diagnostic: bool = False) -> DataFrame:
    """(subject_id, y_prob, risk_tier, n_cells, diagnostic) of every subject of cells, as input_problems() takes them.

    A problem of any subject refuses the whole table before anything is scored; a diagnostic call is marked, not excused.
    """
    require_none(input_problems(cells, policy, cell_types, len(model.c)), F.lit(True), "input that the model may not score")
    n = cells.groupBy("subject_id").agg(F.count("*").alias("n_cells"))
    return mil.predict(cells, model).join(n, "subject_id").select("subject_id", "y_prob", cohorts.risk_tier(F.col("y_prob")).alias("risk_tier"), "n_cells", F.lit(diagnostic).alias("diagnostic"))


def most_attended(cells: DataFrame, model: mil.GatedAttention, n: int = 5) -> DataFrame:
    """(subject_id, cell_id, weight, rank): the cells that weigh most in a subject's prediction; ties go to the smaller cell_id."""
    weighed = mil.attention(cells, model)
    total = weighed.groupBy("subject_id").agg(F.sum("e").alias("norm"))
    best = F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc(F.round("e", 9)), "cell_id"))
    top = weighed.withColumn("rank", best).where(F.col("rank") <= n)
    return top.join(total, "subject_id").select("subject_id", "cell_id", (F.col("e") / F.col("norm")).alias("weight"), F.col("rank").cast("int").alias("rank"))
