"""Counts and gates: class weights, reports, eligibility of sources and cohorts, subgroup and source summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Rows that break what an operator needs."""


def require_none(df: DataFrame, holds: Column, what: str) -> DataFrame:
    """df, unless some row satisfies `holds`."""
    bad = df.where(holds).limit(10).collect()
    if bad:
        raise ContractError(f"{what}: {[r.asDict() for r in bad]}")
    return df


def policy_violations(cells: DataFrame, bulk: str = "is_pseudo_bulk") -> DataFrame:
    """(policy, n_rows, n_violations, admitted) of each policy that can be trained on; a row that does not say what it is violates both."""
    n = cells.agg(F.count("*").alias("n"), F.count_if(F.coalesce(bulk, F.lit(True))).alias("bulk"), F.count_if(~F.coalesce(bulk, F.lit(False))).alias("single"))
    each = n.select("n", F.explode(F.array(F.struct(F.lit("single_cell_only").alias("policy"), F.col("bulk").alias("bad")), F.struct(F.lit("bulk_only").alias("policy"), F.col("single").alias("bad")))).alias("p"))
    return each.select("p.policy", F.col("n").alias("n_rows"), F.col("p.bad").alias("n_violations"), (F.col("p.bad") == 0).alias("admitted"))


def assert_rows_match_policy(cells: DataFrame, policy: str, bulk: str = "is_pseudo_bulk") -> DataFrame:
    """single_cell_only admits no bulk row, bulk_only no cell row, neither one that does not say; other policies can't be trained on."""
    if policy == "single_cell_only":
        return require_none(cells, F.coalesce(bulk, F.lit(True)), "bulk rows under single_cell_only")
    if policy == "bulk_only":
        return require_none(cells, ~F.coalesce(bulk, F.lit(False)), "cell rows under bulk_only")
    raise ContractError(f"policy {policy} has no trainable rows")


def conflicting(rows: DataFrame, by: str, column: str) -> DataFrame:
    """(by, n) of those with more than one distinct value."""
    return rows.groupBy(by).agg(F.count_distinct(column).alias("n")).where("n > 1")


def class_counts(rows: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """(label, n) over the whole range of classes, absent ones 0."""
    return classes.join(rows.groupBy(label).agg(F.count("*").alias("n")), label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))


def inverse_weights(counts: DataFrame, floored: bool) -> DataFrame:
    """(label, weight): floored counts absent classes as 1 and rescales to sum K; else n / (K c), and 0 for absent classes."""
    k = counts.agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.sum(F.greatest("n", F.lit(1))).alias("floor_total"))
    both = counts.join(F.broadcast(k))
    if not floored:
        return both.select("label", F.when(F.col("n") > 0, F.col("total") / (F.col("k") * F.col("n"))).otherwise(0.0).alias("weight"))
    raw = both.withColumn("w", F.col("floor_total") / (F.col("k") * F.greatest("n", F.lit(1))))
    s = raw.agg(F.sum("w").alias("s"))
    return raw.join(F.broadcast(s)).select("label", (F.col("w") * F.col("k") / F.col("s")).alias("weight"))


def split_report(rows: DataFrame) -> DataFrame:
    """(split, label, n_subjects, n_cells) with unknown labels as -1."""
    return rows.groupBy("split", F.coalesce("label", F.lit(-1)).alias("label")).agg(F.count_distinct("subject_id").alias("n_subjects"), F.count("*").alias("n_cells"))


def task_a_status(subjects: DataFrame, by: str) -> DataFrame:
    """(by, n_subjects, n_classes, status, reasons): at least 6 subjects and 2 classes."""
    agg = subjects.groupBy(by).agg(F.count_distinct("subject_id").alias("n_subjects"), F.count_distinct("label").alias("n_classes"))
    reasons = F.array_compact(F.array(F.when(F.col("n_subjects") < 6, "too_few_subjects"), F.when(F.col("n_classes") < 2, "too_few_classes")))
    return agg.select(by, "n_subjects", "n_classes", F.when(F.size(reasons) == 0, "eligible").otherwise("not_eligible").alias("status"), F.array_join(reasons, ";").alias("reasons"))


def task_b_status(subjects: DataFrame, by: str, least: int = 10, each: int = 2) -> DataFrame:
    """(by, n_known, n_pos, n_neg, status): enough known outcomes of both kinds."""
    agg = subjects.groupBy(by).agg(F.count("outcome").alias("n_known"), F.count_if(F.col("outcome") == 1).alias("n_pos"), F.count_if(F.col("outcome") == 0).alias("n_neg"))
    return agg.withColumn("status", F.when((F.col("n_known") >= least) & (F.col("n_pos") >= each) & (F.col("n_neg") >= each), "eligible").otherwise("not_eligible"))


def source_status(sources: DataFrame) -> DataFrame:
    """Adds `status`, the first gate that fails, to rows of (controlled, compatible, assay_ok, species, n_subjects, n_classes)."""
    c = F.col
    return sources.withColumn("status", F.when(c("controlled"), "controlled_access").when(~c("compatible"), "incompatible").when(~c("assay_ok"), "assay_mismatch").when(c("species").isNull(), "species_unknown").when(c("species") != "human", "species_mismatch").when(c("n_subjects") < 3, "too_few_subjects").when(c("n_classes") < 2, "too_few_classes").otherwise("eligible"))


def cohort_status(cohorts: DataFrame) -> DataFrame:
    """Adds `status` to rows of (structural_ok, role, n_subjects, min_class)."""
    c = F.col
    external = F.when(c("n_subjects") >= 20, "eligible_external").otherwise("exploratory_only")
    return cohorts.withColumn("status", F.when(~c("structural_ok"), "incompatible").when(c("role") == "excluded", "not_eligible").when(c("role") == "external", external).when(c("n_subjects") < 6, "not_eligible").when((c("n_subjects") < 20) | (c("min_class") < 5), "exploratory_only").otherwise("eligible_internal"))


def source_summary(reports: DataFrame) -> DataFrame:
    """One row over (source, n_subjects, metric): averages, extremes, spread; null metrics are left out and counted."""
    return reports.agg(
        F.avg("metric").alias("macro"), (F.sum(F.col("metric") * F.col("n_subjects")) / F.sum(F.when(F.col("metric").isNotNull(), F.col("n_subjects")))).alias("weighted"),
        F.min("metric").alias("worst"), F.max("metric").alias("best"), (F.max("metric") - F.min("metric")).alias("range"), F.percentile("metric", 0.5).alias("median"),
        (F.percentile("metric", 0.75) - F.percentile("metric", 0.25)).alias("iqr"), F.count_if(F.col("metric").isNull()).alias("n_undefined"))


def composition(cells: DataFrame) -> DataFrame:
    """One row: minimum, median, inter-quartile range and maximum of cells a subject."""
    n = cells.groupBy("subject_id").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), (F.percentile("n", 0.75) - F.percentile("n", 0.25)).alias("iqr"), F.max("n").alias("most"))


def risk_tier(p: Column) -> Column:
    return F.when(p >= 0.70, "HIGH").when(p >= 0.40, "MODERATE").otherwise("LOW")


def top_cells(cells: DataFrame, by: str, score: str, n: int) -> DataFrame:
    """The n cells of largest score of each group, ties to the smaller cell_id. A row's rank costs a sort of its group."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "cell_id"))
    return cells.withColumn("rank", k).where(F.col("rank") <= n)


def missing_types(cells: DataFrame) -> DataFrame:
    """(subject_id, cell_type_id) that occur in some subject, but not in this one."""
    grid = cells.select("subject_id").distinct().join(F.broadcast(cells.select("cell_type_id").distinct()))
    return grid.join(cells.select("subject_id", "cell_type_id").distinct(), ["subject_id", "cell_type_id"], "left_anti")


def track_status(cohorts: DataFrame, tracks: DataFrame) -> DataFrame:
    """(task, role, status, cohorts): which of cohorts (cohort, tasks, roles) serve each of the few tracks (task, role), by the registry alone.

    status is no_eligible_cohort or eligible; a cohort serves where it supports the task and may have the role.
    """
    serves = cohorts.select("cohort", "roles", F.explode("tasks").alias("task")).select("cohort", "task", F.explode("roles").alias("role")).distinct()
    named = serves.groupBy("task", "role").agg(F.array_join(F.array_sort(F.collect_list("cohort")), ";").alias("cohorts"))
    return tracks.join(named, ["task", "role"], "left").select("task", "role", F.when(F.col("cohorts").isNull(), "no_eligible_cohort").otherwise("eligible").alias("status"), F.coalesce("cohorts", F.lit("")).alias("cohorts"))
