"""Whole experiments as compositions: split-aware preparation, cross-validation, comparison, frozen evaluation, ablation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.draws import draw
from cohortloom.functions.parse import is_placeholder
from cohortloom.operators import calibration, cohorts, matrix, metrics, models, resampling, splits


def prepare(expr: DataFrame, cells: DataFrame, n_genes: int, train: float = 0.7, val: float = 0.15, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assignment, artifact, scaled): subjects split by majority label, panel and statistics from train alone, every cell scaled."""
    labels = matrix.majority(cells, "subject_id", "label")
    everyone = cells.select("subject_id").distinct().join(labels, "subject_id", "left")
    assignment = splits.train_val_test(everyone, train, val, seed)
    fitting = cells.join(assignment.where("split = 'train'").select("subject_id"), "subject_id", "left_semi")
    artifact = matrix.gene_stats(expr, fitting).join(matrix.top_variance(expr, fitting, n_genes).select("gene"), "gene", "left_semi")
    return assignment, artifact, matrix.scale(expr, cells, artifact)


def subject_vectors(scaled: DataFrame, cells: DataFrame) -> DataFrame:
    """(subject_id, features): a vector of the panel's means, genes in order."""
    means = matrix.pooled(scaled, cells)
    x = F.transform(F.array_sort(F.collect_list(F.struct("gene", "value"))), lambda s: s["value"])  # the panel bounds the list
    return means.groupBy("subject_id").agg(array_to_vector(x).alias("features"))


def cross_validate(rows: DataFrame, kinds: list[str], folds: int, seeds: list[int], fit: Callable = models.out_of_fold) -> DataFrame:
    """(candidate, seed, fold, n, auroc): every candidate on the same grouped folds; rows has subject_id, y_true, features."""
    out = None
    for seed in seeds:
        fold = splits.grouped_folds(rows.select("subject_id", F.col("y_true").alias("label")), folds, seed).select("subject_id", "fold")
        dealt = rows.join(fold, "subject_id").persist()  # read once for all candidates and folds
        for kind in kinds:
            got = fit(dealt, kind, seed)
            part = metrics.ranking_metrics(got, ["fold"]).join(got.groupBy("fold").agg(F.count("*").alias("n")), "fold").select(F.lit(kind).alias("candidate"), F.lit(seed).alias("seed"), "fold", "n", "auroc")
            out = part if out is None else out.unionByName(part)
    return out


def repeated_out_of_fold(rows: DataFrame, kind: str, folds: int, seeds: list[int]) -> DataFrame:
    """(seed, subject_id, source, fold, y_true, y_prob): every row of the development pool once a repeat, on folds of its own.

    rows: subject_id, source, y_true, features; splits.oof_problems() tells whether a repeat misses a row or has it twice. Candidates
    that are fitted from class means see all repeats at once: features are read twice, however many repeats and folds there are.
    """
    subjects, dealt, out = rows.select("subject_id", F.col("y_true").alias("label")), None, None
    for seed in seeds:
        fold = splits.grouped_folds(subjects, folds, seed).select(F.lit(seed).alias("seed"), "subject_id", "fold")
        dealt = fold if dealt is None else dealt.unionByName(fold)
        if kind not in models.BY_CLASS:
            part = models.out_of_fold(rows.join(fold, "subject_id"), kind, seed)
            out = part if out is None else out.unionByName(part)
    if kind in models.BY_CLASS:
        out = models.apart(rows.join(dealt, "subject_id"), kind, "fold", ("seed",))
    return out.select("seed", "subject_id", "source", "fold", "y_true", "y_prob")


def repeat_spread(repeats: DataFrame) -> DataFrame:
    """(subject_id, n, mean, sd, flips): how a subject's predictions vary over the repeats; flips counts those on the less frequent side of 0.5."""
    above = F.count_if(F.col("y_prob") >= 0.5)
    return repeats.groupBy("subject_id").agg(F.count("*").alias("n"), F.avg("y_prob").alias("mean"), F.stddev_pop("y_prob").alias("sd"), F.least(above, F.count("*") - above).alias("flips"))


def compare(results: DataFrame, a: str, b: str) -> DataFrame:
    """Wins, ties, losses and effect of candidate a against b, paired by seed and fold; pairs with an undefined side are left out."""
    x, y = results.where(F.col("candidate") == a), results.where(F.col("candidate") == b)
    return calibration.pairs_summary(x.select("seed", "fold", F.col("auroc").alias("a")).join(y.select("seed", "fold", F.col("auroc").alias("b")), ["seed", "fold"]))


def develop(rows: DataFrame, kinds: list[str], folds: int, seeds: list[int], baseline: str = "prevalence") -> tuple[DataFrame, DataFrame]:
    """(candidates, against_baseline): repeated cross-validation, candidates ranked by their mean over repeats, each paired with the baseline.

    Folds and seeds are few, so their metrics are gathered once and reused.
    """
    results = cross_validate(rows, kinds, folds, seeds)
    kept = rows.sparkSession.createDataFrame(results.collect(), results.schema)
    ranked = None
    for kind in kinds:
        own = kept.where(F.col("candidate") == kind)
        one = resampling.seed_summary(own.select("seed", F.col("auroc").alias("metric"))).withColumn("candidate", F.lit(kind))
        pair = compare(kept, kind, baseline).withColumn("candidate", F.lit(kind))
        ranked = (one, pair) if ranked is None else (ranked[0].unionByName(one), ranked[1].unionByName(pair))
    return models.final_rank(ranked[0].withColumnRenamed("mean", "metric")), ranked[1]


def frozen_evaluation(development: DataFrame, test: DataFrame, kind: str, seed: int = 0, how: str = "youden", method: str | None = None) -> DataFrame:
    """One row of test metrics. Calibrator and threshold come from out-of-fold predictions of the development rows alone."""
    policy = calibration.freeze(models.out_of_fold(development, kind, seed).select("y_true", "y_prob"), how, method)
    raw = models.fit_candidate(development, kind, seed).predict(test).select("subject_id", "y_true", "y_prob")
    final = policy.calibrator.apply(raw)
    return policy.evaluate(raw).crossJoin(metrics.ranking_metrics(final)).crossJoin(metrics.calibration_error(final))  # one row each


def source_predictability(rows: DataFrame, seed: int = 0, kind: str = "random_forest", **params) -> DataFrame:
    """One row (accuracy, baseline): how well features tell the sources apart, and after the sources are permuted."""

    def accuracy(df: DataFrame) -> DataFrame:
        index = {s: float(k) for k, s in enumerate(sorted(r["source"] for r in df.select("source").distinct().collect()))}
        y = F.create_map(*[F.lit(x) for kv in index.items() for x in kv])[F.col("source")]
        out = models.out_of_fold(df.withColumn("y_true", y), kind, seed, **params)
        return out.agg(F.avg((F.col("y_pred") == F.col("y_true")).cast("double")).alias("a"))

    mixed = rows.drop("source").join(splits.permuted(rows.select("subject_id", "source"), "subject_id", "source", seed), "subject_id")
    return accuracy(rows).withColumnRenamed("a", "accuracy").crossJoin(accuracy(mixed).withColumnRenamed("a", "baseline"))


def module_ablation(expr: DataFrame, cells: DataFrame, modules: DataFrame, weights: DataFrame) -> DataFrame:
    """(module, score): the mean absolute change of subjects' linear logits when a module's genes are set to zero; weights is (gene, weight)."""
    parts = matrix.pooled(expr, cells).join(F.broadcast(weights), "gene").select("subject_id", "gene", (F.col("value") * F.col("weight")).alias("part"))
    lost = parts.join(F.broadcast(modules), "gene").groupBy("module", "subject_id").agg(F.sum("part").alias("change"))
    n = cells.agg(F.count_distinct("subject_id").alias("n"))
    return lost.groupBy("module").agg(F.sum(F.abs("change")).alias("s")).join(F.broadcast(n)).select("module", (F.col("s") / F.col("n")).alias("score"))


def matched_random_modules(modules: DataFrame, genes: DataFrame, seed: int) -> DataFrame:
    """(module, gene): for each module as many genes, drawn from the panel."""
    size = modules.groupBy("module").agg(F.count("*").alias("k"))
    grid = genes.select("gene").distinct().join(F.broadcast(size))
    rank = F.row_number().over(Window.partitionBy("module").orderBy(draw(seed, "null", "module", "gene"), "gene"))
    return grid.withColumn("r", rank).where("r <= k").select("module", "gene")


def centre_batches(points: DataFrame, dims: int) -> DataFrame:
    """(id, source, x): the first principal components less each source's mean. A diagnostic: it uses all rows, so never before a split."""
    model = PCA(k=dims, inputCol="v", outputCol="p").fit(points.select(array_to_vector("x").alias("v")))
    scored = model.transform(points.withColumn("v", array_to_vector("x"))).select("id", "source", F.posexplode(vector_to_array("p")).alias("k", "u"))
    mean = scored.groupBy("source", "k").agg(F.avg("u").alias("m"))
    x = F.transform(F.array_sort(F.collect_list(F.struct("k", (F.col("u") - F.col("m")).alias("u")))), lambda s: s["u"])
    return scored.join(F.broadcast(mean), ["source", "k"]).groupBy("id", "source").agg(x.alias("x"))


def external_gate(cohorts_: DataFrame, least: int = 20) -> DataFrame:
    """Cohorts that may serve for external validation, and why the others may not."""
    c = F.col
    reasons = F.array_compact(F.array(F.when(c("role") != "external", "role"), F.when(c("controlled"), "controlled_access"), F.when(~c("compatible"), "incompatible"), F.when(c("n_subjects") < least, "too_few_subjects"), F.when(c("min_class") < 2, "one_class")))
    return cohorts_.withColumn("reasons", F.array_join(reasons, ";")).withColumn("selected", c("reasons") == "")


def verified_subject_labels(cells: DataFrame) -> DataFrame:
    """(subject_id, label, state): the one label of a subject's verified cells; without any, weak_proxy_only or unknown. Two labels are an error."""
    agg = cells.groupBy("subject_id").agg(F.collect_set(F.when(F.col("known"), F.col("label"))).alias("labels"), F.bool_or("weak").alias("weak"))
    checked = cohorts.require_none(agg, F.size("labels") > 1, "subjects with several verified labels")
    return checked.select("subject_id", F.get("labels", F.lit(0)).alias("label"), F.when(F.size("labels") == 1, "verified").when(F.col("weak"), "weak_proxy_only").otherwise("unknown").alias("state"))


def paired_with_gates(a: DataFrame, b: DataFrame) -> DataFrame:
    """(source, seed, reason, difference) of (source, seed, candidate, applicable, identity, metric) rows: reason is the first gate that fails."""
    y = b.select("source", "seed", *(F.col(c).alias(f"b_{c}") for c in ("candidate", "applicable", "identity", "metric")))
    reason = F.when(F.col("candidate") != F.col("b_candidate"), "candidate_mismatch").when(~F.col("applicable") | ~F.col("b_applicable"), "strategy_not_applicable").when(F.col("identity") != F.col("b_identity"), "identity_mismatch")
    return a.join(y, ["source", "seed"]).withColumn("reason", reason).select("source", "seed", "reason", F.when(F.col("reason").isNull(), F.col("metric") - F.col("b_metric")).alias("difference"))


def best_parameters(scores: DataFrame, by: str) -> DataFrame:
    """(by, params): the parameters with the largest mean of defined scores, the first in order at ties, the first of all where none is defined."""
    means = scores.groupBy(by, "position", "params").agg(F.avg("score").alias("m"))
    return means.groupBy(by).agg(F.max_by("params", F.struct(F.coalesce(F.round("m", 12), F.lit(float("-inf"))), -F.col("position"))).alias("params"))


def intervals_overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Null where a bound is."""
    return F.when(lo_a.isNull() | hi_a.isNull() | lo_b.isNull() | hi_b.isNull(), None).otherwise((lo_a <= hi_b) & (lo_b <= hi_a))


def namespaced(subject: Column, species: Column) -> Column:
    """Mouse subjects get the prefix mouse::, once."""
    return F.when((species == "mouse") & ~subject.startswith("mouse::"), F.concat(F.lit("mouse::"), subject)).otherwise(subject)


def source_ablation(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(arm, n, balanced_accuracy, change): at the threshold over all of (source, y_true, y_prob), and without each source; change is against all.

    A row goes to the arms that keep it, so all arms are one pass; there are as many as sources and one.
    """
    arms = rows.select(F.col("source").alias("arm")).distinct().agg(F.array_sort(F.collect_list("arm")).alias("arms"))
    dealt = rows.join(F.broadcast(arms)).select("y_true", "y_prob", F.explode(F.concat(F.array(F.lit("all")), F.transform(F.filter("arms", lambda a: a != F.col("source")), lambda a: F.concat(F.lit("without "), a)))).alias("arm"))
    at = metrics.at_threshold(dealt, threshold, ["arm"]).select("arm", "n", ((F.col("sensitivity") + F.col("specificity")) / 2).alias("balanced_accuracy"))
    whole = at.where("arm = 'all'").select(F.col("balanced_accuracy").alias("whole"))
    return at.crossJoin(F.broadcast(whole)).select("arm", "n", "balanced_accuracy", (F.col("balanced_accuracy") - F.col("whole")).alias("change"))  # one row


def context_problems(cells: DataFrame, manifest: DataFrame, bags: DataFrame) -> DataFrame:
    """(subject_id, problem): what keeps cells (subject_id, split), a manifest (subject_id, split) and bags (subject_id, split) from being one experiment.

    overlap: in several splits; unexpected, missing: cells and manifest differ; placeholder: a name that stands for none.
    """
    seen = cells.select("subject_id", "split").distinct()
    both = seen.select("subject_id", "split").unionByName(bags.select("subject_id", "split")).distinct()
    overlap = both.groupBy("subject_id").agg(F.count_distinct("split").alias("n")).where("n > 1").select("subject_id", F.lit("overlap").alias("problem"))
    unexpected = seen.join(manifest, ["subject_id", "split"], "left_anti").select("subject_id", F.lit("unexpected").alias("problem"))
    missing = manifest.join(seen, ["subject_id", "split"], "left_anti").select("subject_id", F.lit("missing").alias("problem"))
    blank = both.where(is_placeholder(F.col("subject_id"))).select("subject_id", F.lit("placeholder").alias("problem"))
    return overlap.unionAll(unexpected).unionAll(missing).unionAll(blank).distinct()


def require_inductive(transductive: bool, where: str) -> None:
    """Batch correction over all rows has no place where folds or a frozen test are promised."""
    if transductive:
        raise cohorts.ContractError(f"{where}: batch correction over all rows leaks across splits")
