"""Queries on whole experiments, gates and pairings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import experiments as E
from cohortloom.operators import matrix as M
from cohortloom.operators import metrics, models, splits
from cohortloom.plans.matrix import MODULES, _modules
from cohortloom.plans.metrics import COUNTS_AT, _rounded
from cohortloom.plans.models import BY_FOLD, CENTROID, HELD_RANK, SJ, _subjects, folds_sql
from cohortloom.plans.views import CELLS, EXPR, PREDS, cells, expr, preds, sql, table
from cohortloom.registry import query

LABELS = "sl as (select subject_id, label from (select subject_id, label, row_number() over (partition by subject_id order by count(*) desc, label) as k from cells group by 1, 2) where k = 1)"
ASSIGN = """st as (select *, case when count(*) over (partition by label) >= 3 then label::varchar else '~pool' end as stratum from sl),
rk as (select *, count(*) over (partition by stratum) as n, row_number() over (partition by stratum order by md5('42|split|' || subject_id), subject_id) as k from st),
a as (select *, case when stratum = '~pool' then round_even(n * 0.7::double, 0)::bigint else least(greatest(1, round_even(n * 0.7::double, 0)::bigint), n - 2) end as n_train from rk),
b as (select *, case when stratum = '~pool' then least(round_even(n * 0.15::double, 0)::bigint, n - n_train) else least(greatest(1, round_even(n * 0.15::double, 0)::bigint), n - n_train - 1) end as n_val from a),
asg as (select subject_id, case when k <= n_train then 'train' when k <= n_train + n_val then 'val' else 'test' end as split from b),
train as (select cell_id from cells join asg using (subject_id) where split = 'train'), n as (select count(*) as n from train),
stats as (select gene, sum(value) / any_value(n) as mean, sqrt(greatest(0, sum(value * value) / any_value(n) - (sum(value) / any_value(n)) ** 2)) as std from expr join train using (cell_id), n group by 1),
top as (select * from stats order by round(std * std, 9) desc, gene limit 8)"""


@query(sql(CELLS, EXPR, LABELS, ASSIGN, then="select subject_id, gene, split, round(avg(greatest(-10, least(10, (value - mean) / std))), 6) as value from expr join top using (gene) join cells using (cell_id) join asg using (subject_id) group by 1, 2, 3"))
def e1_split_aware_pipeline(spark, d):
    e, c = expr(spark, d), cells(spark, d)
    assignment, _, scaled = E.prepare(e, c, 8)
    return _rounded(M.pooled(scaled, c).join(assignment.select("subject_id", "split"), "subject_id"))


@query()
def e2_bulk_classification(spark, d):
    """Top-variance panel and logistic regression fitted on train subjects, metrics on the others."""
    e, c = expr(spark, d), cells(spark, d).withColumn("subject_id", F.col("cell_id").cast("string"))
    y = c.select("subject_id", (F.col("label") >= 5).cast("double").alias("y_true"))
    assignment, _, scaled = E.prepare(e, c.withColumn("label", (F.col("label") >= 5).cast("int")), 16, 0.7, 0.0)
    rows = E.subject_vectors(scaled, c).join(y, "subject_id").join(assignment.select("subject_id", "split"), "subject_id")
    got = models.fit_candidate(rows.where("split = 'train'"), "logistic").predict(rows.where("split = 'test'"))
    return metrics.at_threshold(got, 0.5).crossJoin(metrics.ranking_metrics(got))


CV = "rs as (select 'prevalence' as candidate, seed, held as fold, n, case when auroc is not null then 0.5::double end as auroc from rm union all select 'centroid', seed, held, n, auroc from rm)"


@query(sql(SJ, folds_sql(3), BY_FOLD, CENTROID, HELD_RANK, CV, then="select candidate, seed, fold, n, round(auroc, 6) as auroc from rs"))
def e3_cross_validation(spark, d):
    return _rounded(E.cross_validate(_subjects(spark, d).select("subject_id", "y_true", "features"), ["prevalence", "centroid"], 3, [1]))


@query(sql(SJ, folds_sql(3, "(1), (2)"), BY_FOLD, CENTROID, HELD_RANK, then="select (count(*) filter (where auroc - 0.5 > 1e-9))::bigint as wins, (count(*) filter (where abs(auroc - 0.5) <= 1e-9))::bigint as ties, (count(*) filter (where auroc - 0.5 < -1e-9))::bigint as losses, round(avg(auroc - 0.5), 6) as mean, round(stddev_samp(auroc - 0.5), 6) as sd, round(avg(auroc - 0.5) / stddev_samp(auroc - 0.5), 6) as effect from rm where auroc is not null"))
def e7_compare_candidates(spark, d):
    results = E.cross_validate(_subjects(spark, d).select("subject_id", "y_true", "features"), ["prevalence", "centroid"], 3, [1, 2])
    return _rounded(E.compare(results, "centroid", "prevalence"))


@query(sql(SJ, folds_sql(2, "(1), (2)"), BY_FOLD, CENTROID, HELD_RANK, CV, "s as (select candidate, seed, avg(auroc) as m from rs group by 1, 2)", "q as (select candidate, avg(m) as metric, stddev_pop(m) as std, quantile_cont(m, 0.5) as median, quantile_cont(m, 0.75) - quantile_cont(m, 0.25) as iqr, (count(*) filter (where m is null))::bigint as n_undefined from s group by 1)",
           then="select round(metric, 6) as metric, round(std, 6) as std, round(median, 6) as median, round(iqr, 6) as iqr, n_undefined, candidate, (row_number() over (order by metric desc nulls last, candidate))::int as rank from q"))
def e8_repeated_development(spark, d):
    return _rounded(E.develop(_subjects(spark, d).select("subject_id", "y_true", "features"), ["prevalence", "centroid"], 2, [1, 2])[0])


E4 = """dv as (select cp.* from cp), dc as (select y_prob as t, count(*) filter (where y_true = 1) as p, count(*) filter (where y_true <> 1) as q from dv group by 1), dq as (select t, sum(p) over (order by t desc) as tp, sum(q) over (order by t desc) as fp, sum(p) over () as pos, sum(q) over () as neg from dc),
th as (select coalesce((select t from dq where pos > 0 and neg > 0 order by round(tp / pos - fp / neg, 12) desc, t limit 1), 0.5::double) as threshold), fc as (select g, avg(x) filter (where y_true = 1) as a, avg(x) filter (where y_true <> 1) as b from lx join sj using (subject_id) where subject_id % 4 <> 0 group by 1),
fp as (select subject_id, any_value(y_true) as y_true, 1 / (1 + exp(-(sum(x * (a - b)) + sum(b * b - a * a) / 2))) as y_prob from lx join sj using (subject_id) join fc using (g) where subject_id % 4 = 0 group by 1), n4 as (select count(*) filter (where y_true = 1 and y_prob >= threshold) as tp, count(*) filter (where y_true <> 1 and y_prob >= threshold) as fp, count(*) filter (where y_true = 1 and y_prob < threshold) as fn, count(*) filter (where y_true <> 1 and y_prob < threshold) as tn from fp, th),
er as (select y_prob as t, count(*) filter (where y_true = 1) as p, count(*) filter (where y_true <> 1) as q from fp group by 1), rq as (select *, sum(p) over (order by t desc) as tp, sum(q) over (order by t desc) as fp, sum(p) over () as pos, sum(q) over () as neg from er)"""


@query(sql(SJ, folds_sql(3), "gr as (select seed, subject_id, fold as held from fd where subject_id % 4 <> 0)", CENTROID, E4, then="select case when tp + fn > 0 and fp + tn > 0 then round(tp / (tp + fn), 6) end as sensitivity, case when tp + fn > 0 and fp + tn > 0 then round(tn / (tn + fp), 6) end as specificity, tp + fp + fn + tn as n, (select round(threshold, 6) from th) as threshold, (select case when max(pos) > 0 and max(neg) > 0 then round(sum(p * (neg - fp + q / 2)) / (max(pos) * max(neg)), 6) end from rq) as auroc from n4"))
def e4_frozen_evaluation(spark, d):
    """Development is three rows of four, the frozen test the fourth."""
    rows = _subjects(spark, d)
    out = E.frozen_evaluation(rows.where("subject_id % 4 <> 0"), rows.where("subject_id % 4 = 0"), "centroid", method="none")
    return _rounded(out.select("sensitivity", "specificity", "n", "threshold", "auroc"))


@query()
def e4_calibrated_evaluation(spark, d):
    rows = _subjects(spark, d)
    return E.frozen_evaluation(rows.where("subject_id % 4 <> 0"), rows.where("subject_id % 4 = 0"), "logistic")


@query()
def x6_source_predictability(spark, d):
    return E.source_predictability(_subjects(spark, d).drop("y_true"))


WEIGHTS = "w as (select 'g' || lpad(i::varchar, 2, '0') as gene, ((i % 7) - 3) / 3.0::double as weight from range(0, 64) r(i)), pool as (select subject_id, gene, avg(value) * any_value(weight) as part from expr join cells using (cell_id) join w using (gene) group by 1, 2)"


def _weights(spark):
    return spark.range(64).select(F.concat(F.lit("g"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("gene"), (((F.col("id") % 7) - 3) / 3.0).alias("weight"))


@query(sql(CELLS, EXPR, MODULES, WEIGHTS, then="select module, round(sum(abs(c)) / (select count(distinct subject_id) from cells), 6) as score from (select module, subject_id, sum(part) as c from pool join modules using (gene) group by 1, 2) group by 1"))
def x10_module_ablation(spark, d):
    return _rounded(E.module_ablation(expr(spark, d), cells(spark, d), _modules(spark, d), _weights(spark)))


@query(sql(EXPR, MODULES, "s as (select module, count(*) as k from modules group by 1)", then="select module, gene from (select module, gene, k, row_number() over (partition by module order by md5('8|null|' || module || '|' || gene), gene) as r from (select distinct gene from expr), s) where r <= k"))
def x10_matched_random_modules(spark, d):
    return E.matched_random_modules(_modules(spark, d), expr(spark, d).select("gene"), 8)


@query()
def n6_batch_centring(spark, d):
    from cohortloom.plans.shift import _points

    return E.centre_batches(_points(spark, d), 4)


@query(sql(CELLS, "v as (select 's' || (cell_id % 30) as subject_id, case when cell_id % 30 % 6 = 0 then null else cell_id % 30 % 4 end as label, cell_id % 30 % 5 <> 0 and cell_id % 3 = 0 as known, cell_id % 30 % 2 = 0 as weak from cells)",
           then="select subject_id, min(case when known then label end) as label, case when count(case when known then label end) > 0 then 'verified' when bool_or(weak) then 'weak_proxy_only' else 'unknown' end as state from v group by 1"))
def g7_verified_labels(spark, d):
    k = F.col("cell_id") % 30
    v = cells(spark, d).select(F.concat(F.lit("s"), k).alias("subject_id"), F.when(k % 6 == 0, None).otherwise(k % 4).alias("label"), ((k % 5 != 0) & (F.col("cell_id") % 3 == 0)).alias("known"), (k % 2 == 0).alias("weak"))
    return E.verified_subject_labels(v)


@query(sql(PREDS, "r as (select source, seed, case when seed = 1 and source = 'src1' then 'x' else 'm' end as candidate, seed <> 2 as applicable, source || (case when seed = 3 then '!' else '' end) as identity, avg(y_prob) as metric from preds group by 1, 2)", "q as (select source, seed, 'm' as candidate, true as applicable, source as identity, avg(y_true) as metric from preds group by 1, 2)",
           then="select source, seed, case when r.candidate <> q.candidate then 'candidate_mismatch' when not r.applicable then 'strategy_not_applicable' when r.identity <> q.identity then 'identity_mismatch' end as reason, case when r.candidate = q.candidate and r.applicable and r.identity = q.identity then round(r.metric - q.metric, 6) end as difference from r join q using (source, seed)"))
def j12_gated_pairs(spark, d):
    p = preds(spark, d)
    a = p.groupBy("source", "seed").agg(F.avg("y_prob").alias("metric")).select("source", "seed", F.when((F.col("seed") == 1) & (F.col("source") == "src1"), "x").otherwise("m").alias("candidate"), (F.col("seed") != 2).alias("applicable"), F.concat("source", F.when(F.col("seed") == 3, "!").otherwise("")).alias("identity"), "metric")
    b = p.groupBy("source", "seed").agg(F.avg("y_true").alias("metric")).select("source", "seed", F.lit("m").alias("candidate"), F.lit(True).alias("applicable"), F.col("source").alias("identity"), "metric")
    return _rounded(E.paired_with_gates(a, b))


@query(sql(PREDS, "s as (select lang, (subject_id % 4)::int as position, 'p' || (subject_id % 4) as params, case when lang <> 'fr' then avg(y_prob) end as m from preds group by 1, 2, 3)", then="select lang, params from (select lang, params, row_number() over (partition by lang order by coalesce(round(m, 12), '-infinity'::double) desc, position) as k from s) where k = 1"))
def r12_best_parameters(spark, d):
    s = preds(spark, d).select("lang", (F.col("subject_id") % 4).cast("int").alias("position"), F.concat(F.lit("p"), F.col("subject_id") % 4).alias("params"), F.when(F.col("lang") != "fr", F.col("y_prob")).alias("score"))
    return E.best_parameters(s, "lang")


@query(sql(PREDS, "i as (select source, avg(y_prob) - stddev_samp(y_prob) / 5 as lo, avg(y_prob) + stddev_samp(y_prob) / 5 as hi from preds group by 1)", then="select a.source as a, b.source as b, case when a.lo is null or b.lo is null then null else round(a.lo, 9) <= round(b.hi, 9) and round(b.lo, 9) <= round(a.hi, 9) end as overlap from i a join i b on a.source < b.source"))
def m14_interval_overlap(spark, d):
    i = preds(spark, d).groupBy("source").agg(F.round(F.avg("y_prob") - F.stddev_samp("y_prob") / 5, 9).alias("lo"), F.round(F.avg("y_prob") + F.stddev_samp("y_prob") / 5, 9).alias("hi"))
    a, b = i.select(F.col("source").alias("a"), F.col("lo").alias("la"), F.col("hi").alias("ha")), i.select(F.col("source").alias("b"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", E.intervals_overlap(F.col("la"), F.col("ha"), F.col("lb"), F.col("hb")).alias("overlap"))


@query(sql(CELLS, then="select cell_id, case when cell_id % 3 = 0 then 'mouse::' || (case when cell_id % 2 = 0 then subject_id else replace('mouse::' || subject_id, 'mouse::', '') end) else subject_id end as subject_id from cells"))
def p8_namespaced_subjects(spark, d):
    c = cells(spark, d)
    given = F.when((F.col("cell_id") % 3 == 0) & (F.col("cell_id") % 2 == 1), F.concat(F.lit("mouse::"), "subject_id")).otherwise(F.col("subject_id"))
    return c.select("cell_id", E.namespaced(given, F.when(F.col("cell_id") % 3 == 0, "mouse").otherwise("human")).alias("subject_id"))


@query(sql(CELLS, then="select (count(*) filter (where cell_id % 10 = 0 and cell_id % 20 <> 0))::bigint as bulk_as_cell, (count(*) filter (where cell_id % 10 <> 0 and cell_id % 15 = 0))::bigint as cell_as_bulk from cells"))
def p5_provenance_conflicts(spark, d):
    i = F.col("cell_id")
    rows = cells(spark, d).select((i % 10 == 0).alias("bulk"), F.when((i % 10 == 0) & (i % 20 == 0), "bulk_tcga").when((i % 10 != 0) & (i % 15 == 0), "bulk_tcga").otherwise("human_single_cell").alias("mode"))
    return rows.agg(F.count_if(F.col("bulk") & (F.col("mode") == "human_single_cell")).alias("bulk_as_cell"), F.count_if(~F.col("bulk") & (F.col("mode") == "bulk_tcga")).alias("cell_as_bulk"))


@query("select c_nationkey as cohort, count(*)::bigint as n, count(*) >= 30 and min(n) >= 3 as supported from (select c_nationkey, c_custkey, count(*) over (partition by c_nationkey, c_mktsegment) as n from customer) group by 1")
def g20_test_support(spark, d):
    per = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("cohort"), "c_mktsegment").count()
    return per.groupBy("cohort").agg(F.sum("count").alias("n"), ((F.sum("count") >= 30) & (F.min("count") >= 3)).alias("supported"))


@query("select n_name as dataset, t as task, case when n_nationkey % 4 = 0 then 'controlled' else 'open' end as access, t = 'a' or n_nationkey % 2 = 0 as eligible from nation, (values ('a'), ('b'), ('c')) x(t)")
def g30_audit(spark, d):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "task string")
    n = table(spark, d, "nation")
    return n.crossJoin(F.broadcast(tasks)).select(F.col("n_name").alias("dataset"), "task", F.when(F.col("n_nationkey") % 4 == 0, "controlled").otherwise("open").alias("access"), ((F.col("task") == "a") | (F.col("n_nationkey") % 2 == 0)).alias("eligible"))


@query("select c_nationkey as cohort, case when c_nationkey % 3 = 0 then 'internal' else 'external' end as role, count(*)::bigint as n_subjects, concat_ws(';', case when c_nationkey % 3 = 0 then 'role' end, case when c_nationkey % 5 = 1 then 'controlled_access' end, case when c_nationkey % 7 = 2 then 'incompatible' end, case when count(*) < 20 then 'too_few_subjects' end) as reasons, c_nationkey % 3 <> 0 and c_nationkey % 5 <> 1 and c_nationkey % 7 <> 2 and count(*) >= 20 as selected from customer group by 1")
def e11_external_gate(spark, d):
    k = F.col("cohort")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("cohort")).agg(F.count("*").alias("n_subjects"))
    c = c.select("cohort", F.when(k % 3 == 0, "internal").otherwise("external").alias("role"), "n_subjects", (k % 5 == 1).alias("controlled"), (k % 7 != 2).alias("compatible"), F.lit(5).alias("min_class"))
    return E.external_gate(c).select("cohort", "role", "n_subjects", "reasons", "selected")


@query(sql(CELLS, "cdf as (select source, row_number() over (order by source) as r, count(*) over () as k from (select distinct source from cells))", "su as (select source, subject_id, row_number() over (partition by source order by subject_id) - 1 as s, count(*) over (partition by source) as n_s from (select distinct source, subject_id from cells))",
           "ce as (select source, subject_id, cell_id, row_number() over (partition by source, subject_id order by cell_id) - 1 as c, count(*) over (partition by source, subject_id) as n_c from cells)", "dr as (select i, ('0x' || substr(md5('6|class|' || i), 1, 8))::bigint / 4294967296.0::double as u, ('0x' || substr(md5('6|subject|' || i), 1, 8))::bigint as us, ('0x' || substr(md5('6|cell|' || i), 1, 8))::bigint as uc from range(0, 1000) r(i))",
           then="select i, x.source, su.subject_id, ce.cell_id from (select dr.*, source from dr join cdf on u >= (r - 1) / k::double and u < r / k::double) x join su on su.source = x.source and su.s = us % n_s join ce on ce.source = su.source and ce.subject_id = su.subject_id and ce.c = uc % n_c"))
def r8_source_balanced_draws(spark, d):
    rows = cells(spark, d).select(F.col("source").alias("label"), "subject_id", "cell_id")
    return splits.balanced_draws(rows, splits.selection_probabilities(rows, "uniform"), 1000, 6).withColumnRenamed("label", "source")


@query(sql(PREDS, COUNTS_AT, then="select source, case when tp + fn > 0 and fp + tn > 0 then round((tp / (tp + fn) + tn / (tn + fp)) / 2, 4) end as balanced_accuracy, case when tp + fn = 0 or fp + tn = 0 then 'one class' end as note from c"))
def m5_binary_report(spark, d):
    at = metrics.at_threshold(preds(spark, d), 0.5, ["source"])
    b = F.round((F.col("sensitivity") + F.col("specificity")) / 2, 4)
    return at.select("source", b.alias("balanced_accuracy"), F.when(F.col("sensitivity").isNull(), "one class").alias("note"))


@query(sql(EXPR, "a as (select distinct gene from expr where gene < 'g45')", "b as (select distinct gene from expr where gene > 'g08')",
           then="select coalesce(a.gene, b.gene) as gene, case when a.gene is null then 'unexpected' when b.gene is null then 'missing' else 'shared' end as state from a full join b using (gene)"))
def p16_gene_spaces(spark, d):
    g = expr(spark, d).select("gene").distinct()
    a, b = g.where("gene < 'g45'").withColumn("a", F.lit(1)), g.where("gene > 'g08'").withColumn("b", F.lit(1))
    return a.join(b, "gene", "full").select("gene", F.when(F.col("a").isNull(), "unexpected").when(F.col("b").isNull(), "missing").otherwise("shared").alias("state"))


@query(sql(PREDS, "f as (select seed, source as fold, avg(((y_prob >= 0.5)::int = y_true)::int) as a, case when seed <> 4 then avg(((y_prob >= 0.3)::int = y_true)::int) end as b from preds group by 1, 2)", then="select seed, fold, round(a - b, 6) as difference from f where a is not null and b is not null"))
def j10_paired_folds(spark, d):
    hit = lambda t: F.avg(((F.col("y_prob") >= t).cast("int") == F.col("y_true")).cast("int"))
    p = preds(spark, d).withColumnRenamed("source", "fold")
    a, b = p.groupBy("seed", "fold").agg(hit(0.5).alias("a")), p.where("seed <> 4").groupBy("seed", "fold").agg(hit(0.3).alias("b"))
    return _rounded(a.join(b, ["seed", "fold"]).where("a is not null and b is not null").select("seed", "fold", (F.col("a") - F.col("b")).alias("difference")))


@query("select o_orderkey as cell_id, case when o_orderpriority = '1-URGENT' then 'COPD' else 'Control' end as disease, false as smoke_type_known, o_orderpriority = '1-URGENT' as weak_smoke_proxy_known, case when o_orderpriority = '1-URGENT' then 'disease_status' end as weak_smoke_proxy_type from orders")
def s8_disease_metadata(spark, d):
    copd = F.col("o_orderpriority") == "1-URGENT"
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"), F.when(copd, "COPD").otherwise("Control").alias("disease"), F.lit(False).alias("smoke_type_known"), copd.alias("weak_smoke_proxy_known"), F.when(copd, "disease_status").alias("weak_smoke_proxy_type"))


@query("select o_custkey as subject_id, count(*)::bigint as n_samples, max((o_totalprice > 200000)::int) as outcome, bool_or(o_orderstatus = 'F') as tumour from orders where o_orderpriority not like '5%' group by 1")
def s11_sample_sheet(spark, d):
    o = table(spark, d, "orders").where(~F.col("o_orderpriority").startswith("5"))
    return o.groupBy(F.col("o_custkey").alias("subject_id")).agg(F.count("*").alias("n_samples"), F.max((F.col("o_totalprice") > 200000).cast("int")).alias("outcome"), F.bool_or(F.col("o_orderstatus") == "F").alias("tumour"))


@query("select c_custkey as subject_id, case when o_custkey is null then 'missing' when n > 1 then 'repeated' else 'ok' end as state from customer left join (select o_custkey, count(*) as n from orders where o_orderpriority = '1-URGENT' group by 1) on c_custkey = o_custkey")
def k11_oof_rows(spark, d):
    n = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer")
    return c.join(n, c["c_custkey"] == n["o_custkey"], "left").select(F.col("c_custkey").alias("subject_id"), F.when(F.col("o_custkey").isNull(), "missing").when(F.col("n") > 1, "repeated").otherwise("ok").alias("state"))


@query("select cell_id, gene, round(value, 6) as value, source from (select vec_id as cell_id, 'g' || lpad((i - 1)::varchar, 2, '0') as gene, embedding[i]::double as value, 'src' || (vec_id % 40 % 4) as source from embeddings, range(1, 65) r(i)) where source in ('src0', 'src2')")
def n8_concat_sources(spark, d):
    e = expr(spark, d).join(cells(spark, d).select("cell_id", "source"), "cell_id")
    return _rounded(e.where("source = 'src0'").unionByName(e.where("source = 'src2'")).select("cell_id", "gene", "value", "source"))
