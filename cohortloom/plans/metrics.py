"""Queries on classification and probability metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import metrics as M
from cohortloom.operators.matrix import majority
from cohortloom.plans.views import CELLS, PREDS, cells, preds, sql
from cohortloom.registry import query

VOTES = "v as (select cell_id, subject_id, label as y_true, ((label + (cell_id % 5 = 0)::int) % 12)::int as y_pred from cells where known)"
GRID = "cm as (select g.y_true, g.y_pred, count(v.cell_id)::bigint as n from (select t::int as y_true, p::int as y_pred from range(0, 12) a(t), range(0, 12) b(p)) g left join v on v.y_true = g.y_true and v.y_pred = g.y_pred group by 1, 2)"
PER = "tr as (select y_true as label, sum(n)::bigint as support, sum(case when y_true = y_pred then n else 0 end) as tp from cm group by 1), pr as (select y_pred as label, sum(n) as predicted from cm group by 1), pc as (select label, case when predicted > 0 then tp / predicted else 0 end as precision, case when support > 0 then tp / support else 0 end as recall, case when support + predicted > 0 then 2 * tp / (support + predicted) else 0 end as f1, support from tr join pr using (label))"


def _votes(spark, d):
    return cells(spark, d).where("known").select("cell_id", "subject_id", F.col("label").alias("y_true"), ((F.col("label") + (F.col("cell_id") % 5 == 0).cast("int")) % 12).alias("y_pred"))


def _classes(spark):
    return spark.range(12).select(F.col("id").cast("int").alias("label"))


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes))


@query(sql(CELLS, VOTES, GRID, then="select y_true, y_pred, n from cm"))
def m1_confusion(spark, d):
    return M.confusion(_votes(spark, d), _classes(spark))


@query(sql(CELLS, VOTES, GRID, PER, then="select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from pc"))
def m2_per_class(spark, d):
    return _rounded(M.per_class(M.confusion(_votes(spark, d), _classes(spark))))


SUMMARY = "select round(avg(f1), 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1, round(avg(case when support > 0 then recall end), 6) as balanced_accuracy, round(sum(recall * support) / sum(support), 6) as accuracy, sum(support)::bigint as n, (count(*) filter (where support = 0))::bigint as n_absent from pc"


@query(sql(CELLS, VOTES, GRID, PER, then=SUMMARY))
def m4_cell_weighted(spark, d):
    return _rounded(M.classification_summary(M.per_class(M.confusion(_votes(spark, d), _classes(spark)))))


SUBJECT_VOTES = "v0 as (select cell_id, subject_id, label as y_true, ((label + (cell_id % 5 = 0)::int) % 12)::int as y_pred from cells where known), a as (select subject_id, y_true from (select subject_id, y_true, row_number() over (partition by subject_id order by count(*) desc, y_true) as k from v0 group by 1, 2) where k = 1), b as (select subject_id, y_pred from (select subject_id, y_pred, row_number() over (partition by subject_id order by count(*) desc, y_pred) as k from v0 group by 1, 2) where k = 1), v as (select subject_id as cell_id, y_true, y_pred from a join b using (subject_id))"


@query(sql(CELLS, SUBJECT_VOTES, GRID, PER, then=SUMMARY))
def m4_subject_weighted(spark, d):
    v = _votes(spark, d)
    voted = majority(v, "subject_id", "y_true").join(majority(v, "subject_id", "y_pred"), "subject_id")
    return _rounded(M.classification_summary(M.per_class(M.confusion(voted, _classes(spark)))))


AT = "select source, case when tp + fn > 0 and fp + tn > 0 then round(tp / (tp + fn), 6) end as sensitivity, case when tp + fn > 0 and fp + tn > 0 then round(tn / (tn + fp), 6) end as specificity, case when tp + fn > 0 and fp + tn > 0 then round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) end as ppv, case when tp + fn > 0 and fp + tn > 0 then round(case when tn + fn > 0 then tn / (tn + fn) else 0 end, 6) end as npv, case when tp + fn > 0 and fp + tn > 0 then round((tp + tn) / (tp + fp + fn + tn), 6) end as accuracy, tp + fp + fn + tn as n from c"
COUNTS_AT = "c as (select source, count(*) filter (where y_true = 1 and y_prob >= 0.5) as tp, count(*) filter (where y_true <> 1 and y_prob >= 0.5) as fp, count(*) filter (where y_true = 1 and y_prob < 0.5) as fn, count(*) filter (where y_true <> 1 and y_prob < 0.5) as tn from preds group by 1)"


@query(sql(PREDS, COUNTS_AT, then=AT))
def m6_at_threshold(spark, d):
    return _rounded(M.at_threshold(preds(spark, d), 0.5, ["source"]))


CURVE = "e as (select {by} y_prob as t, count(*) filter (where y_true = 1) as p, count(*) filter (where y_true <> 1) as q from preds group by all), cv as (select *, sum(p) over ({part} order by t desc) as tp, sum(q) over ({part} order by t desc) as fp, sum(p) over ({part}) as pos, sum(q) over ({part}) as neg from e)"
RANK = "case when max(pos) > 0 and max(neg) > 0 then round(sum(p * (neg - fp + q / 2)) / (max(pos) * max(neg)), 6) end as auroc, case when max(pos) > 0 and max(neg) > 0 then round(sum(p * tp / (tp + fp)) / max(pos), 6) end as auprc"


@query(sql(PREDS, CURVE.format(by="", part=""), then=f"select {RANK} from cv"))
def m7_ranking(spark, d):
    return _rounded(M.ranking_metrics(preds(spark, d)))


@query(sql(PREDS, CURVE.format(by="lang,", part="partition by lang"), then=f"select lang, {RANK} from cv group by 1"))
def m7_ranking_by_group(spark, d):
    return _rounded(M.ranking_metrics(preds(spark, d), ["lang"]))


@query(sql(PREDS, then="select lang, round(avg((y_prob - y_true) ** 2), 6) as brier, round(avg(-(y_true * ln(greatest(1e-15, least(1 - 1e-15, y_prob))) + (1 - y_true) * ln(1 - greatest(1e-15, least(1 - 1e-15, y_prob))))), 6) as log_loss from preds group by 1"))
def m9_losses(spark, d):
    return _rounded(M.loss_metrics(preds(spark, d), ["lang"]))


BINS = "bn as (select *, least(9, (y_prob >= 0.1)::int + (y_prob >= 0.2)::int + (y_prob >= 3 * 0.1::double)::int + (y_prob >= 4 * 0.1::double)::int + (y_prob >= 0.5)::int + (y_prob >= 6 * 0.1::double)::int + (y_prob >= 7 * 0.1::double)::int + (y_prob >= 8 * 0.1::double)::int + (y_prob >= 9 * 0.1::double)::int) as bin from preds), rl as (select bin, count(*)::bigint as n, avg(y_prob) as mean_prob, avg(y_true::double) as observed from bn group by 1)"


@query(sql(PREDS, BINS, then="select bin, n, round(mean_prob, 6) as mean_prob, round(observed, 6) as observed from rl"))
def m8_reliability(spark, d):
    return _rounded(M.reliability(preds(spark, d)))


@query(sql(PREDS, BINS, then="select round(sum(n * abs(mean_prob - observed)) / sum(n), 6) as ece from rl"))
def m8_calibration_error(spark, d):
    return _rounded(M.calibration_error(preds(spark, d)))


@query(sql(PREDS, then="select source as candidate, round(avg(((y_prob >= 0.5)::int = y_true)::int), 6) as mean_metric from preds group by 1 order by round(avg(((y_prob >= 0.5)::int = y_true)::int), 12) desc, source limit 1"))
def m15_best_candidate(spark, d):
    hit = ((F.col("y_prob") >= 0.5).cast("int") == F.col("y_true")).cast("int")
    return _rounded(M.best_candidate(preds(spark, d).select(F.col("source").alias("candidate"), hit.alias("metric"))))
