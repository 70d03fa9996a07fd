"""Queries on bootstrap, permutation and repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import resampling as R
from cohortloom.plans.metrics import _rounded
from cohortloom.plans.views import PREDS, preds, sql, table
from cohortloom.registry import query

M = 4294967296


def _mix(x: str, out: str) -> str:
    """Select items out1 .. out5 of which the last is the mix of 32-bit x."""
    o = [f"{out}{k}" for k in range(1, 6)]
    return f"xor({x}, {x} >> 16) as {o[0]}, ({o[0]} * 2246822507) % {M} as {o[1]}, xor({o[1]}, {o[1]} >> 13) as {o[2]}, ({o[2]} * 3266489909) % {M} as {o[3]}, xor({o[3]}, {o[3]} >> 16) as {o[4]}"


def _hashed(rows: str, key: str, repeats: int, seed: int) -> str:
    """hb: rows with b and its 32-bit hash h."""
    half = lambda at: f"('0x' || substr(md5(({key})::varchar), {at}, 8))::ubigint"
    return f"""hk as (select *, {half(1)} as high, {half(9)} as low from {rows}), ho as (select r::int as b, ((r * 1000003 + {seed}) % {M})::ubigint as o0, {_mix('o0', 'q')} from range(0, {repeats}) t(r)),
h1 as (select hk.*, b, xor(high, q5) as s0, {_mix('s0', 's')} from hk, ho), hb as (select * exclude (s0, s1, s2, s3, s4), xor(s5, low) as u0, {_mix('u0', 'u')}, u5 as h from h1)"""


def _weighted(rows: str, n_boot: int, seed: int) -> str:
    """wb: rows with b and how often that resample has them."""
    return _hashed(rows, "subject_id", n_boot, seed) + ", wb as (select *, " + " + ".join(f"(h >= {t})::int" for t in R.POISSON) + " as w from hb)"


#: Resamples and permutations, as the reference has them.
N_BOOT, N_PERMUTATIONS = 2000, 200


@query(sql(PREDS, _weighted("preds", N_BOOT, 1), "m as (select b, sum(w * y_prob) / nullif(sum(w), 0) as v from wb group by 1)", then="select round(avg(v), 6) as mean, round(quantile_cont(v, 0.025), 6) as lo, round(quantile_cont(v, 0.975), 6) as hi, count(v)::bigint as n_defined from m"))
def m11_bootstrap_mean(spark, d):
    return _rounded(R.bootstrap_mean(preds(spark, d), "subject_id", "y_prob", N_BOOT, 1))


AUROC = "e as (select b, t, sum(w) filter (where y_true = 1) as p, sum(w) filter (where y_true <> 1) as q from (select *, {0} as t from wb) group by 1, 2), cv as (select b, coalesce(p, 0) as p, coalesce(q, 0) as q, coalesce(sum(q) over (partition by b order by t rows between unbounded preceding and 1 preceding), 0) as below from e), m as (select b, case when sum(p) > 0 and sum(q) > 0 then sum(p * (below + q / 2)) / (sum(p) * sum(q)) end as v from cv group by 1)"


@query(sql(PREDS, _weighted("preds", N_BOOT, 3), AUROC.format("y_prob"), then="select round(avg(v), 6) as mean, round(quantile_cont(v, 0.025), 6) as lo, round(quantile_cont(v, 0.975), 6) as hi, count(v)::bigint as n_defined from m"))
def m12_bootstrap_auroc(spark, d):
    return _rounded(R.bootstrap_auroc(preds(spark, d), "subject_id", N_BOOT, 3))


GROUPS = "m as (select source as g, b, sum(w * y_true) / nullif(sum(w), 0)::double as m from wb group by 1, 2), ci as (select g, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from m group by 1)"


@query(sql(PREDS, _weighted("preds", N_BOOT, 5), GROUPS, then="select g as source, n, case when n >= 10 then round(estimate, 6) end as estimate, case when n >= 10 then round(lo, 6) end as lo, case when n >= 10 then round(hi, 6) end as hi, case when n >= 10 then 'ok' else 'not_evaluable' end as status from (select source as g, count(*)::bigint as n, avg(y_true) as estimate from preds group by 1) join ci using (g)"))
def g22_subgroup_report(spark, d):
    return _rounded(R.grouped_bootstrap(preds(spark, d), "subject_id", F.col("y_true"), "source", N_BOOT, 5))


@query(sql(PREDS, "f as (select seed, source, case when seed <> 6 then avg(((y_prob >= 0.5)::int = y_true)::int) end as metric from preds group by 1, 2)", "s as (select seed, avg(metric) as m from f group by 1)",
           then="select round(avg(m), 6) as mean, round(stddev_pop(m), 6) as std, round(quantile_cont(m, 0.5), 6) as median, round(quantile_cont(m, 0.75) - quantile_cont(m, 0.25), 6) as iqr, (count(*) filter (where m is null))::bigint as n_undefined from s"))
def g28_repeat_summary(spark, d):
    hit = F.avg(((F.col("y_prob") >= 0.5).cast("int") == F.col("y_true")).cast("int"))
    return _rounded(R.seed_summary(preds(spark, d).groupBy("seed", "source").agg(hit.alias("v")).select("seed", F.when(F.col("seed") != 6, F.col("v")).alias("metric"))))


@query(sql("cu as (select c_custkey, c_acctbal as x, c_nationkey::double as y from customer)", _hashed("cu", "c_custkey", N_PERMUTATIONS, 17), f"bl as (select *, low % (select greatest(1, ceil(count(*) / {R.BLOCK}.0)::ubigint) from cu) as block from hb)",
           "a as (select b, block, x, row_number() over (partition by b, block order by high, c_custkey::varchar) as k from bl), p as (select b, block, y, row_number() over (partition by b, block order by h, high, c_custkey::varchar) as k from bl), n as (select b, corr(x, y) as r0 from a join p using (b, block, k) group by 1), o as (select corr(x, y) as r from cu)",
           then="select round(r, 6) as r, avg((abs(r0) >= abs(r))::int) as p_value from n, o group by r"))
def x9_permutation_null(spark, d):
    return _rounded(R.permutation_null(table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("n")), "c_custkey", "c_acctbal", "n", N_PERMUTATIONS, 17))
