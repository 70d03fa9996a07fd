"""Queries on distances between sources and stability of rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import shift as X
from cohortloom.operators.matrix import pooled
from cohortloom.plans.metrics import _rounded
from cohortloom.plans.views import CELLS, EXPR, cells, expr, sql, table
from cohortloom.registry import query

FEATURES = "ft as (select source, cell_id, gene, value from expr join cells using (cell_id))"
SUBJECTS = "sm as (select subject_id as id, source, gene, avg(value) as value from expr join cells using (cell_id) group by 1, 2, 3), pt as (select id, source, list(value order by gene) as x from sm group by 1, 2)"


def _points(spark, d):
    """A vector for each subject: the mean over its cells."""
    e, c = expr(spark, d), cells(spark, d)
    means = pooled(e, c).groupBy("subject_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("gene", "value"))), lambda s: s["value"]).alias("x"))
    return means.join(c.select("subject_id", "source").distinct(), "subject_id").select(F.col("subject_id").alias("id"), "source", "x")


@query(sql(CELLS, EXPR, FEATURES, "m as (select source, gene, avg(value) as m from ft group by 1, 2)", then="select a.source as a, b.source as b, round(sqrt(sum((a.m - b.m) ** 2)), 6) as distance from m a join m b on a.gene = b.gene and a.source < b.source group by 1, 2"))
def x1_centroid_distance(spark, d):
    return _rounded(X.centroid_distances(expr(spark, d).join(cells(spark, d).select("cell_id", "source"), "cell_id")))


D2 = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) ** 2))"


@query(sql(CELLS, EXPR, SUBJECTS, f"p as (select a.source as s, b.source as t, sqrt({D2} + 1e-12) as d from pt a, pt b where a.source in ('src0', 'src1') and b.source in ('src0', 'src1'))",
           then="select round(2 * avg(d) filter (where s = 'src0' and t = 'src1') - avg(d) filter (where s = 'src0' and t = 'src0') - avg(d) filter (where s = 'src1' and t = 'src1'), 6) as energy from p"))
def x2_energy_distance(spark, d):
    return _rounded(X.energy_distance(_points(spark, d), "src0", "src1"))


@query("with v as (select 'src' || (vec_id % 40 % 4) as source, g, h, covar_samp(embedding[g + 1]::double, embedding[h + 1]::double) as cov from embeddings, range(0, 64) a(g), range(0, 64) b(h) group by 1, 2, 3) select a.source as a, b.source as b, round(sum((a.cov - b.cov) ** 2) / (4 * 4096), 9) as distance from v a join v b on a.g = b.g and a.h = b.h and a.source < b.source group by 1, 2")
def x3_coral_distance(spark, d):
    wide = table(spark, d, "embeddings").select(F.concat(F.lit("src"), F.col("vec_id") % 40 % 4).alias("source"), F.transform("embedding", lambda a: a.cast("double")).alias("x"))
    return X.coral_distances(wide, 64).withColumn("distance", F.round("distance", 9))


@query(sql(CELLS, EXPR, SUBJECTS, f"p as (select a.id as i, b.id as j, a.source as s, b.source as t, {D2} as d2 from pt a, pt b where a.source in ('src0', 'src1') and b.source in ('src0', 'src1'))", "w as (select sqrt(quantile_disc(d2, 0.5)) as w from p where i < j)", "k as (select s, t, exp(-d2 / (2 * w * w)) as k from p, w)",
           then="select (select round(w, 6) from w) as bandwidth, round(avg(k) filter (where s = 'src0' and t = 'src0') + avg(k) filter (where s = 'src1' and t = 'src1') - 2 * avg(k) filter (where s = 'src0' and t = 'src1'), 6) as mmd from k"))
def x4_mmd(spark, d):
    return _rounded(X.mmd(_points(spark, d), "src0", "src1"))


#: Of two sources: energy distance, bandwidth and MMD, and the distance of their means.
REPORT = sql(CELLS, EXPR, SUBJECTS, FEATURES, f"p as (select a.id as i, b.id as j, a.source as s, b.source as t, {D2} as d2 from pt a, pt b where a.source in ('src0', 'src1') and b.source in ('src0', 'src1'))", "w as (select sqrt(quantile_disc(d2, 0.5)) as w from p where i < j)", "k as (select s, t, sqrt(d2 + 1e-12) as d, exp(-d2 / (2 * w * w)) as k from p, w)",
             "m as (select source, gene, avg(value) as m from ft where source in ('src0', 'src1') group by 1, 2)", "c as (select sqrt(sum((a.m - b.m) ** 2)) as distance from m a join m b on a.gene = b.gene and a.source = 'src0' and b.source = 'src1')",
             then="select round(2 * avg(d) filter (where s = 'src0' and t = 'src1') - avg(d) filter (where s = 'src0' and t = 'src0') - avg(d) filter (where s = 'src1' and t = 'src1'), 6) as energy, (select round(w, 6) from w) as bandwidth, round(avg(k) filter (where s = 'src0' and t = 'src0') + avg(k) filter (where s = 'src1' and t = 'src1') - 2 * avg(k) filter (where s = 'src0' and t = 'src1'), 6) as mmd, 'src0' as a, 'src1' as b, (select round(distance, 6) from c) as distance from k")

RANKS = "rk as (select l_suppkey % 100 as key, sum(l_quantity) as a, sum(l_extendedprice) as b from lineitem group by 1)"


@query(sql(RANKS, "r as (select row_number() over (order by a, key) as ra, row_number() over (order by round(b, 2), key) as rb from rk)", then="select round(1 - 6 * sum((ra - rb) ** 2) / (count(*) * (count(*)::double ** 2 - 1)), 6) as rho from r"))
def x7_spearman(spark, d):
    rk = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 100).alias("key")).agg(F.sum("l_quantity").alias("a"), F.round(F.sum("l_extendedprice"), 2).alias("b"))
    return _rounded(X.spearman_ordinal(rk))


RUNS = "ru as (select l_linenumber as run, l_suppkey as key, sum(l_quantity) as score from lineitem group by 1, 2), best as (select run, key from (select *, row_number() over (partition by run order by score desc, key) as r from ru) where r <= 20)"


def _runs(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("run"), F.col("l_suppkey").alias("key")).agg(F.sum("l_quantity").alias("score"))


@query(sql(RUNS, "n as (select run, count(*) as n from best group by 1)", then="select p.a, p.b, round(count(x.key) / least(20, any_value(p.na), any_value(p.nb)), 6) as overlap from (select n.run as a, m.run as b, n.n as na, m.n as nb from n, n m where n.run < m.run) p left join (select s.run as a, t.run as b, s.key from best s join best t on s.key = t.key and s.run < t.run) x on x.a = p.a and x.b = p.b group by 1, 2"))
def x8_top_k_overlap(spark, d):
    return _rounded(X.top_k_overlap(_runs(spark, d), 20))


@query(sql(RUNS, then="select key, round(count(*) / (select count(distinct run) from ru), 6) as frequency from best group by 1"))
def x8_selection_frequency(spark, d):
    return _rounded(X.selection_frequency(_runs(spark, d), 20))
