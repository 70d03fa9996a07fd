"""Queries on counts, gates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import cohorts as C
from cohortloom.plans.views import CELLS, PREDS, cells, preds, sql, table
from cohortloom.registry import query


@query("select c_custkey % 40 as subject_id, count(distinct c_nationkey)::bigint as n from customer group by 1 having count(distinct c_nationkey) > 1")
def g26_conflicting_labels(spark, d):
    return C.conflicting(table(spark, d, "customer").select((F.col("c_custkey") % 40).alias("subject_id"), "c_nationkey"), "subject_id", "c_nationkey")


@query("select user_id as subject_id, count(distinct event_type)::bigint as n from events group by 1 having count(distinct event_type) > 1")
def p22_cross_source_subjects(spark, d):
    return C.conflicting(table(spark, d, "events").select(F.col("user_id").alias("subject_id"), F.col("event_type").alias("source")), "subject_id", "source")


CC = "cc as (select t::int as label, (count(c.label))::bigint as n from range(0, 12) r(t) left join (select label from cells where known) c on c.label = t group by 1)"


def _counts(spark, d):
    return C.class_counts(cells(spark, d).where("known"), spark.range(12).select(F.col("id").cast("int").alias("label")))


@query(sql(CELLS, CC, then="select label, n from cc"))
def g5_class_counts(spark, d):
    return _counts(spark, d)


@query(sql(CELLS, CC, then="select label, round(case when n > 0 then (select sum(n) from cc) / (12 * n) else 0 end, 6) as weight from cc"))
def g5_train_weights(spark, d):
    return C.inverse_weights(_counts(spark, d), floored=False).withColumn("weight", F.round("weight", 6))


@query(sql(CELLS, CC, "w as (select label, (select sum(greatest(n, 1)) from cc) / (12 * greatest(n, 1)) as w from cc)", then="select label, round(w * 12 / (select sum(w) from w), 6) as weight from w"))
def g5_rescaled_weights(spark, d):
    return C.inverse_weights(_counts(spark, d), floored=True).withColumn("weight", F.round("weight", 6))


@query(sql(CELLS, then="select source as split, case when known then label else -1 end as label, count(distinct subject_id)::bigint as n_subjects, count(*)::bigint as n_cells from cells group by 1, 2"))
def g12_split_report(spark, d):
    return C.split_report(cells(spark, d).select(F.col("source").alias("split"), F.when(F.col("known"), F.col("label")).alias("label"), "subject_id"))


@query("select c_nationkey || '-' || floor(c_acctbal / 2000)::int as source, count(distinct c_custkey)::bigint as n_subjects, count(distinct c_mktsegment)::bigint as n_classes, case when count(distinct c_custkey) >= 6 and count(distinct c_mktsegment) >= 2 then 'eligible' else 'not_eligible' end as status, concat_ws(';', case when count(distinct c_custkey) < 6 then 'too_few_subjects' end, case when count(distinct c_mktsegment) < 2 then 'too_few_classes' end) as reasons from customer group by 1")
def g17_task_a(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("label"), F.concat(F.col("c_nationkey").cast("string"), F.lit("-"), F.floor(F.col("c_acctbal") / 2000).cast("string")).alias("source"))
    return C.task_a_status(s, "source")


@query(sql(PREDS, then="select source, count(toxic)::bigint as n_known, (count(*) filter (where toxic = 1))::bigint as n_pos, (count(*) filter (where toxic = 0))::bigint as n_neg, case when count(toxic) >= 10 and count(*) filter (where toxic = 1) >= 2 and count(*) filter (where toxic = 0) >= 2 then 'eligible' else 'not_eligible' end as status from preds group by 1"))
def g17_task_b(spark, d):
    return C.task_b_status(preds(spark, d).withColumn("outcome", F.col("toxic")), "source")


SRC = "src as (select c_nationkey as source, c_nationkey % 11 = 0 as controlled, c_nationkey % 7 <> 1 as compatible, c_nationkey % 5 <> 2 as assay_ok, case when c_nationkey % 6 = 3 then null when c_nationkey % 6 = 4 then 'mouse' else 'human' end as species, count(*)::bigint as n_subjects, count(distinct c_mktsegment)::bigint as n_classes from customer group by 1)"


@query(sql(SRC, then="select *, case when controlled then 'controlled_access' when not compatible then 'incompatible' when not assay_ok then 'assay_mismatch' when species is null then 'species_unknown' when species <> 'human' then 'species_mismatch' when n_subjects < 3 then 'too_few_subjects' when n_classes < 2 then 'too_few_classes' else 'eligible' end as status from src"))
def g18_source_eligibility(spark, d):
    k = F.col("c_nationkey")
    src = table(spark, d, "customer").groupBy(k.alias("source")).agg(F.count("*").alias("n_subjects"), F.count_distinct("c_mktsegment").alias("n_classes"))
    k = F.col("source")
    src = src.select("source", (k % 11 == 0).alias("controlled"), (k % 7 != 1).alias("compatible"), (k % 5 != 2).alias("assay_ok"), F.when(k % 6 == 3, None).when(k % 6 == 4, "mouse").otherwise("human").alias("species"), "n_subjects", "n_classes")
    return C.source_status(src)


COH = "coh as (select nk as cohort, nk % 9 <> 0 as structural_ok, case when nk % 8 = 1 then 'excluded' when nk % 4 = 2 then 'external' else 'internal' end as role, sum(n)::bigint as n_subjects, min(n)::bigint as min_class from (select c_nationkey as nk, c_mktsegment, count(*) as n from customer group by 1, 2) group by 1)"


@query(sql(COH, then="select *, case when not structural_ok then 'incompatible' when role = 'excluded' then 'not_eligible' when role = 'external' then (case when n_subjects >= 20 then 'eligible_external' else 'exploratory_only' end) when n_subjects < 6 then 'not_eligible' when n_subjects < 20 or min_class < 5 then 'exploratory_only' else 'eligible_internal' end as status from coh"))
def g19_cohort_eligibility(spark, d):
    k = F.col("cohort")
    coh = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("cohort"), "c_mktsegment").count().groupBy("cohort").agg(F.sum("count").alias("n_subjects"), F.min("count").alias("min_class"))
    coh = coh.select("cohort", (k % 9 != 0).alias("structural_ok"), F.when(k % 8 == 1, "excluded").when(k % 4 == 2, "external").otherwise("internal").alias("role"), "n_subjects", "min_class")
    return C.cohort_status(coh)


REP = "rep as (select source, count(*)::bigint as n_subjects, case when count(*) filter (where y_true = 0) > 0 then avg(((y_prob >= 0.5)::int = y_true)::int) end as metric from preds group by 1)"


@query(sql(PREDS, REP, then="select round(avg(metric), 6) as macro, round(sum(metric * n_subjects) / sum(case when metric is not null then n_subjects end), 6) as weighted, round(min(metric), 6) as worst, round(max(metric), 6) as best, round(max(metric) - min(metric), 6) as range, round(quantile_cont(metric, 0.5), 6) as median, round(quantile_cont(metric, 0.75) - quantile_cont(metric, 0.25), 6) as iqr, (count(*) filter (where metric is null))::bigint as n_undefined from rep"))
def g21_source_summary(spark, d):
    p = preds(spark, d)
    hit = ((F.col("y_prob") >= 0.5).cast("int") == F.col("y_true")).cast("int")
    rep = p.groupBy("source").agg(F.count("*").alias("n_subjects"), F.when(F.count_if(F.col("y_true") == 0) > 0, F.avg(hit)).alias("metric"))
    out = C.source_summary(rep)
    return out.select(*(F.round(c, 6).alias(c) if c != "n_undefined" else c for c in out.columns))


@query("select min(n)::bigint as least, quantile_cont(n, 0.5) as median, quantile_cont(n, 0.75) - quantile_cont(n, 0.25) as iqr, max(n)::bigint as most from (select user_id, count(*) as n from events group by 1)")
def g15_composition(spark, d):
    return C.composition(table(spark, d, "events").select(F.col("user_id").alias("subject_id")))


@query("select min(n)::bigint as least, quantile_cont(n, 0.5) as median, max(n)::bigint as most from (select o_custkey, count(*) as n from orders group by 1)")
def g16_cells_per_subject(spark, d):
    return C.composition(table(spark, d, "orders").select(F.col("o_custkey").alias("subject_id"))).drop("iqr")


@query("select s.user_id as subject_id, t.event_type as cell_type_id from (select distinct user_id from events) s, (select distinct event_type || '-' || hour(ts) as event_type from events) t where not exists (select 1 from events e where e.user_id = s.user_id and e.event_type || '-' || hour(e.ts) = t.event_type)")
def g15_missing_types(spark, d):
    return C.missing_types(table(spark, d, "events").select(F.col("user_id").alias("subject_id"), F.concat("event_type", F.lit("-"), F.hour("ts").cast("string")).alias("cell_type_id")))


@query(sql(PREDS, then="select case when y_prob >= 0.7 then 'HIGH' when y_prob >= 0.4 then 'MODERATE' else 'LOW' end as tier, count(*)::bigint as n from preds group by 1"))
def g23_risk_tiers(spark, d):
    return preds(spark, d).groupBy(C.risk_tier(F.col("y_prob")).alias("tier")).agg(F.count("*").alias("n"))


@query("with r as (select user_id as subject_id, event_id as cell_id, value, row_number() over (partition by user_id order by value desc, event_id)::int as rank from events) select * from r where rank <= 5")
def g25_top_cells(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("subject_id"), F.col("event_id").alias("cell_id"), "value")
    return C.top_cells(e, "subject_id", "value", 5)


@query("select user_id as subject_id, count(*)::bigint as n, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.75), 6) as p75, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1")
def g25_subject_percentiles(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("subject_id")).agg(F.count("*").alias("n"), *(F.round(F.percentile("value", q / 100), 6).alias(f"p{q}") for q in (25, 50, 75, 95)))


@query("select event_type, round(avg(value), 6) as mean_value, round(coalesce(corr(value, event_id), 0), 6) as r from events group by 1")
def g24_interpretability(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.coalesce(F.corr("value", "event_id"), F.lit(0.0)), 6).alias("r"))


@query(sql(CELLS, then="select cell_id, subject_id from cells where subject_id in ('s1', 's5', 's33')"))
def j7_semi_join(spark, d):
    wanted = spark.createDataFrame([("s1",), ("s5",), ("s33",)], "subject_id string")
    return cells(spark, d).join(F.broadcast(wanted), "subject_id", "left_semi").select("cell_id", "subject_id")


@query("select c_custkey as subject_id from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def j8_anti_join(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"))
    return c.join(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("subject_id")), "subject_id", "left_anti")


@query("select a.vec_id as cell_id, (i - 1)::int as pos, a.embedding[i] as value, 'name_' || (i - 1) as name from embeddings a, range(1, 65) r(i)")
def j9_positional_join(spark, d):
    names = spark.range(64).select(F.col("id").cast("int").alias("pos"), F.concat(F.lit("name_"), F.col("id").cast("string")).alias("name"))
    long = table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.posexplode("embedding").alias("pos", "value"))
    return long.join(F.broadcast(names), "pos").select("cell_id", "pos", "value", "name")


@query("select n_regionkey as cohort, r_name, count(n_nationkey)::bigint as n, count(*) filter (where n_name is null) = 0 as matched from region left join nation on r_regionkey = n_regionkey group by 1, 2")
def j15_cohort_check(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    return r.join(n, r["r_regionkey"] == n["n_regionkey"], "left").groupBy(F.col("n_regionkey").alias("cohort"), "r_name").agg(F.count("n_nationkey").alias("n"), (F.count_if(F.col("n_name").isNull()) == 0).alias("matched"))
