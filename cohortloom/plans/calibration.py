"""Queries on thresholds, calibration, decision curves and abstention."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.vectors import binary_entropy
from cohortloom.operators import calibration as C
from cohortloom.plans.metrics import CURVE, _rounded
from cohortloom.plans.views import PREDS, preds, sql
from cohortloom.registry import query

ONE = CURVE.format(by="", part="")
SENS, SPEC = "tp / pos", "(1 - fp / neg)"


def _best(value: str) -> str:
    return sql(PREDS, ONE, f"r as (select t, round({value}, 12) as value from cv where pos > 0 and neg > 0)", then="select round(coalesce((select t from r where value is not null order by value desc, t limit 1), 0.5::double), 6) as threshold, (select round(max(value), 6) from r) as value")


@query(_best(f"{SENS} + {SPEC} - 1"))
def c2_youden(spark, d):
    return _rounded(C.select_threshold(preds(spark, d), "youden"))


@query(_best(f"({SENS} + {SPEC}) / 2"))
def c2_balanced_accuracy(spark, d):
    return _rounded(C.select_threshold(preds(spark, d), "balanced_accuracy"))


@query(_best(f"case when {SENS} >= 0.9 then {SPEC} end"))
def c2_sensitivity_constrained(spark, d):
    return _rounded(C.select_threshold(preds(spark, d), "sensitivity_constrained"))


@query(_best(f"case when {SPEC} >= 0.9 then {SENS} end"))
def c4_specificity_constrained(spark, d):
    return _rounded(C.select_threshold(preds(spark, d), "specificity_constrained"))


@query(sql(PREDS, "g as (select i / 100 as t from range(1, 100) r(i))", "x as (select t, count(*) filter (where y_true = 1 and y_prob >= t - 1e-11) as tp, count(*) filter (where y_true <> 1 and y_prob >= t - 1e-11) as fp, count(*) as n, count(*) filter (where y_true = 1) as pos from g, preds group by 1)",
           then="select round(t, 6) as t, round((tp - fp * t / (1 - t)) / n, 6) as model, round((pos - (n - pos) * t / (1 - t)) / n, 6) as treat_all, 0.0::double as treat_none from x"))
def c5_decision_curve(spark, d):
    return _rounded(C.decision_curve(preds(spark, d)))


P = "greatest(1e-12, least(1 - 1e-12, y_prob))"


@query(sql(PREDS, then=f"select subject_id, round(-({P} * ln({P}) + (1 - {P}) * ln(1 - {P})), 6) as entropy, round(greatest({P}, 1 - {P}), 6) as confidence, round(ln({P} / (1 - {P}) + 1e-12), 6) as logit from preds"))
def c6_uncertainty(spark, d):
    return _rounded(C.uncertainty(preds(spark, d)).select("subject_id", "entropy", "confidence", "logit"))


@query(sql(PREDS, f"u as (select subject_id, y_true, y_prob, round(-({P} * ln({P}) + (1 - {P}) * ln(1 - {P})), 9) as u, subject_id % 2 = 0 as dev from preds)", "th as (select quantile_cont(u, 0.8) as t from u where dev)",
           then="select round(t, 6) as t, count(*)::bigint as n, (count(*) filter (where u <= t))::bigint as retained, round(avg(case when u <= t then (round_even(y_prob, 0)::int = y_true)::int end), 6) as accuracy from u, th where not dev group by t"))
def c8_abstention(spark, d):
    u = preds(spark, d).withColumn("u", F.round(binary_entropy(F.col("y_prob")), 9))
    return _rounded(C.apply_abstention(u.where("subject_id % 2 <> 0"), C.abstention_threshold(u.where("subject_id % 2 = 0"), 0.8)))


@query(sql(PREDS, "f as (select seed, source, avg(((y_prob >= 0.5)::int = y_true)::int) as a, avg(((y_prob >= 0.3)::int = y_true)::int) as b from preds group by 1, 2)",
           then="select (count(*) filter (where a - b > 1e-9))::bigint as wins, (count(*) filter (where abs(a - b) <= 1e-9))::bigint as ties, (count(*) filter (where a - b < -1e-9))::bigint as losses, round(avg(a - b), 6) as mean, round(stddev_samp(a - b), 6) as sd, round(avg(a - b) / stddev_samp(a - b), 6) as effect from f"))
def m13_compare_models(spark, d):
    hit = lambda t: F.avg(((F.col("y_prob") >= t).cast("int") == F.col("y_true")).cast("int"))
    return _rounded(C.pairs_summary(preds(spark, d).groupBy("seed", "source").agg(hit(0.5).alias("a"), hit(0.3).alias("b"))))


@query(sql(PREDS, "a as (select seed, avg(y_prob) as a from preds where seed <> 3 group by 1)", "b as (select seed, avg(y_prob) as b from preds where seed <> 5 and lang = 'en' group by 1)",
           then="select coalesce(a.seed, b.seed) as seed, case when a.a is null then 'only_b' when b.b is null then 'only_a' when a.a > b.b then 'win' when a.a < b.b then 'loss' else 'tie' end as outcome from a full join b on a.seed = b.seed"))
def j11_paired_repeats(spark, d):
    p = preds(spark, d)
    a, b = p.where("seed <> 3").groupBy("seed").agg(F.avg("y_prob").alias("a")), p.where("seed <> 5 and lang = 'en'").groupBy("seed").agg(F.avg("y_prob").alias("b"))
    outcome = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").when(F.col("a") > F.col("b"), "win").when(F.col("a") < F.col("b"), "loss").otherwise("tie")
    return a.join(b, "seed", "full").select("seed", outcome.alias("outcome"))


PAV = """dv as (select y_prob as p, avg(y_true) as y, count(*) as w from preds where subject_id % 2 = 0 group by 1), ix as (select p, row_number() over (order by p) as i, sum(w) over (order by p) as w, sum(w * y) over (order by p) as s, w as w1, w * y as s1 from dv),
pa as (select a.i as j, b.i as k, (b.s - a.s + a.s1) / (b.w - a.w + a.w1) as m from ix a join ix b on a.i <= b.i), lo as (select j, k, min(m) over (partition by j order by k desc) as m from pa), iso as (select ix.p, max(lo.m) as y from ix join lo on lo.k = ix.i and lo.j <= ix.i group by 1),
te as (select subject_id, y_true, y_prob from preds where subject_id % 2 <> 0), be as (select te.*, iso.p as pa, iso.y as ya from te asof left join iso on te.y_prob >= iso.p), bo as (select be.*, iso.p as pb, iso.y as yb from be asof left join iso on be.y_prob < iso.p)"""


@query(sql(PREDS, PAV, then="select subject_id, y_true, round(case when pa is null then yb when pb is null then ya else ya + (yb - ya) * (y_prob - pa) / (pb - pa) end, 6) as calibrated from bo"))
def c1_isotonic(spark, d):
    """Calibrated probabilities of the held-out half, from steps fitted on the other."""
    p = preds(spark, d)
    fitted = C.fit_calibrator(p.where("subject_id % 2 = 0"), "isotonic")
    return _rounded(fitted.apply(p.where("subject_id % 2 <> 0").select("subject_id", "y_true", "y_prob")).withColumnRenamed("y_prob", "calibrated"))


@query()
def c1_sigmoid(spark, d):
    p = preds(spark, d)
    fitted = C.fit_calibrator(p.where("subject_id % 2 = 0"), "sigmoid")
    return fitted.apply(p.where("subject_id % 2 <> 0").select("subject_id", "y_true", "y_prob")).withColumnRenamed("y_prob", "calibrated")
