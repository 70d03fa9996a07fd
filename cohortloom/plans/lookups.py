"""Queries on lookups, gates and reports that join or scan small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.vectors import binary_entropy
from cohortloom.operators import calibration, cohorts, experiments, labels, metrics, mil, splits, texts
from cohortloom.operators import matrix as M
from cohortloom.plans import shift as shift_sql
from cohortloom.plans.matrix import STATS, TRAIN, _train
from cohortloom.plans.metrics import GRID, PER, VOTES, _classes, _rounded, _votes
from cohortloom.plans.views import CELLS, EXPR, PREDS, cells, expr, preds, sql, table
from cohortloom.registry import query

MAP = "mp as (select 'g' || lpad(i::varchar, 2, '0') as mouse_gene, 'H' || i as human_gene from range(0, 64, 3) r(i))"


@query(sql(EXPR, MAP, then="select cell_id, human_gene as gene, round(value, 6) as value from expr join mp on gene = mouse_gene"))
def p11_map_species(spark, d):
    pairs = spark.range(0, 64, 3).select(F.concat(F.lit("g"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("mouse_gene"), F.concat(F.lit("H"), F.col("id").cast("string")).alias("human_gene"))
    mapped = labels.ortholog_map(pairs).select(F.col("mouse_gene").alias("gene"), "human_gene")
    return _rounded(expr(spark, d).join(F.broadcast(mapped), "gene").select("cell_id", F.col("human_gene").alias("gene"), "value"))


@query("select o_orderkey as sample_id, coalesce(c_mktsegment, 'cigarette') as smoke_type, coalesce(c_nationkey % 2 = 0, true) as smoke_type_known, coalesce('p' || c_custkey, o_orderkey::varchar) as subject_id from orders left join (select * from customer where c_acctbal >= 0) on o_custkey = c_custkey")
def j2_sidecar_join(spark, d):
    side = table(spark, d, "customer").where("c_acctbal >= 0")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(side, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("sample_id"), F.coalesce("c_mktsegment", F.lit("cigarette")).alias("smoke_type"), F.coalesce(F.col("c_nationkey") % 2 == 0, F.lit(True)).alias("smoke_type_known"), F.coalesce(F.concat(F.lit("p"), F.col("c_custkey").cast("string")), F.col("o_orderkey").cast("string")).alias("subject_id"))


@query("select doc_id as subject_id, toxic as outcome, toxic is not null as outcome_known from documents left join labels using (doc_id)")
def j4_outcome_join(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left").select(F.col("doc_id").alias("subject_id"), F.col("toxic").alias("outcome"), F.col("toxic").isNotNull().alias("outcome_known"))


@query("select p_partkey as probe, p_brand as symbol, s.id from part join (select b as p_brand, row_number() over (order by b) as id from (select distinct p_brand as b from part where p_brand < 'Brand#3')) s using (p_brand)")
def j6_map_lookup(spark, d):
    from pyspark.sql import Window

    p = table(spark, d, "part")
    names = p.where("p_brand < 'Brand#3'").select(F.col("p_brand").alias("name")).distinct().withColumn("id", F.row_number().over(Window.orderBy("name")))
    return labels.map_names(p, names, "p_brand").select(F.col("p_partkey").alias("probe"), F.col("p_brand").alias("symbol"), "id")


@query(sql(PREDS, then="select t::int as t, (count(*) filter (where y_true = 1 and y_prob >= t / 20.0::double))::bigint as tp, (count(*) filter (where y_true <> 1 and y_prob >= t / 20.0::double))::bigint as fp from preds, range(1, 20) r(t) group by 1"))
def j13_threshold_grid(spark, d):
    return metrics.threshold_counts(preds(spark, d), [t / 20.0 for t in range(1, 20)])


@query("select a.n_nationkey as a, b.n_nationkey as b, round(abs(a.x - b.x), 4) as gap from (select c_nationkey as n_nationkey, round(avg(c_acctbal), 4) as x from customer group by 1) a, (select c_nationkey as n_nationkey, round(avg(c_acctbal), 4) as x from customer group by 1) b")
def j14_all_pairs(spark, d):
    x = table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 4).alias("x"))  # a row a nation
    return x.select(F.col("c_nationkey").alias("a"), F.col("x").alias("u")).crossJoin(x.select(F.col("c_nationkey").alias("b"), F.col("x").alias("v"))).select("a", "b", F.round(F.abs(F.col("u") - F.col("v")), 4).alias("gap"))


@query(sql(CELLS, then="select subject_id, sum(n)::bigint as n_cells, arg_min(source, k) as source from (select 'f' || (cell_id % 37) as subject_id, source, count(*) as n, row_number() over (partition by cell_id % 37 order by count(*) desc, source) as k from cells group by cell_id % 37, source) group by 1 having sum(n) >= 10"))
def g4_bags_with_source(spark, d):
    c = cells(spark, d).select(F.concat(F.lit("f"), F.col("cell_id") % 37).alias("subject_id"), "source")
    return c.groupBy("subject_id").agg(F.count("*").alias("n_cells"), F.mode("source", True).alias("source")).where("n_cells >= 10")


OUT = "oc as (select 's' || (doc_id % 25) as subject_id, max(toxic) as outcome from labels group by 1)"


@query(sql(CELLS, EXPR, OUT, then="select subject_id, gene, outcome, round(avg(value), 6) as mean from expr join cells using (cell_id) join oc using (subject_id) where outcome is not null group by 1, 2, 3"))
def g9_outcome_features(spark, d):
    known = M.outcome_max(table(spark, d, "labels").select(F.concat(F.lit("s"), F.col("doc_id") % 25).alias("subject_id"), F.col("toxic").alias("outcome"))).where("outcome is not null")
    means = M.pooled(expr(spark, d), cells(spark, d)).withColumnRenamed("value", "mean")
    return _rounded(means.join(known, "subject_id").select("subject_id", "gene", "outcome", "mean"))


@query("with p as (select distinct c_nationkey as m, c_mktsegment as h from customer) select (count(distinct m))::bigint as n_mouse, (count(distinct h))::bigint as n_human, (count(*))::bigint as n_pairs, (select count(*) from (select m from p group by 1 having count(*) > 1))::bigint as n_one_to_many, (select count(*) from (select h from p group by 1 having count(*) > 1))::bigint as n_many_to_one from p")
def g29_pair_counts(spark, d):
    p = table(spark, d, "customer").select(F.col("c_nationkey").alias("m"), F.col("c_mktsegment").alias("h")).distinct()
    both = p.agg(F.count_distinct("m").alias("n_mouse"), F.count_distinct("h").alias("n_human"), F.count("*").alias("n_pairs"))
    more = lambda c, name: p.groupBy(c).count().agg(F.count_if(F.col("count") > 1).alias(name))
    return both.crossJoin(more("m", "n_one_to_many")).crossJoin(more("h", "n_many_to_one"))  # one row each


FOLDS = "fd as (select subject_id, ('0x' || substr(md5('2|cv|' || subject_id), 1, 8))::bigint % 3 as fold from (select distinct subject_id from cells))"


@query(sql(CELLS, EXPR, FOLDS, "tr as (select k.fold, c.cell_id from (select distinct fold from fd) k, cells c join fd using (subject_id) where fd.fold <> k.fold)", "nn as (select fold, count(*) as n from tr group by 1)",
           then="select tr.fold, gene, round(sum(value) / any_value(n), 6) as mean, round(sqrt(greatest(0, sum(value * value) / any_value(n) - (sum(value) / any_value(n)) ** 2)), 6) as std from expr join tr using (cell_id) join nn on nn.fold = tr.fold group by 1, 2"))
def n9_fold_statistics(spark, d):
    """All folds' statistics in one pass: each cell's sums go to the folds that train on it."""
    from cohortloom.functions.draws import draw_u32

    c = cells(spark, d).select("cell_id", (draw_u32(2, "cv", "subject_id") % 3).alias("own"))
    folds = c.select("cell_id", F.explode(F.filter(F.array(*(F.lit(k).cast("bigint") for k in range(3))), lambda k: k != F.col("own"))).alias("fold"))
    n = folds.groupBy("fold").agg(F.count("*").alias("n"))
    sums = expr(spark, d).join(folds, "cell_id").groupBy("fold", "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / F.col("n")
    return _rounded(sums.join(F.broadcast(n), "fold").select("fold", "gene", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("std")))


@query(sql(CELLS, EXPR, TRAIN, STATS, then="select gene, round(mean, 6) as mean, round(std, 6) as std, (row_number() over (order by gene) - 1)::int as pos from (select * from stats order by round(std * std, 9) desc, gene limit 10)"))
def n3_fit_artifact(spark, d):
    from pyspark.sql import Window

    e, train = expr(spark, d), _train(spark, d)
    panel = M.gene_stats(e, train).join(M.top_variance(e, train, 10).select("gene"), "gene", "left_semi")
    return _rounded(panel.withColumn("pos", F.row_number().over(Window.orderBy("gene")) - 1))  # a row a gene of the panel


@query(sql(CELLS, VOTES, GRID, PER, then="select round(avg(f1), 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1, list(label order by label) filter (where support = 0) as absent, count(*) filter (where support = 0) > 0 as is_partial from pc"))
def m3_multiclass_report(spark, d):
    per = metrics.per_class(metrics.confusion(_votes(spark, d), _classes(spark)))
    absent = F.array_sort(F.collect_list(F.when(F.col("support") == 0, F.col("label"))))  # a class each
    out = metrics.classification_summary(per).crossJoin(per.agg(absent.alias("absent")))
    return _rounded(out.select("macro_f1", "weighted_f1", "absent", (F.size("absent") > 0).alias("is_partial")))


@query(sql(PREDS, "s as (select source, count(*) filter (where y_true = 1) as p, count(*) filter (where y_true <> 1) as q from preds group by 1)", "u as (select a.source, sum(case when a.y_prob > b.y_prob then 1 when a.y_prob = b.y_prob then 0.5 else 0 end) as wins from preds a join preds b on a.source = b.source and a.y_true = 1 and b.y_true <> 1 group by 1)",
           then="select source, case when p > 0 and q > 0 then round(wins / (p * q), 6) end as auroc_or_null, case when p > 0 and q > 0 then round(wins / (p * q), 6) else 0.5::double end as subject_auc from s left join u using (source)"))
def m10_auc_variants(spark, d):
    r = metrics.ranking_metrics(preds(spark, d), ["source"])
    return _rounded(r.select("source", F.col("auroc").alias("auroc_or_null"), F.coalesce("auroc", F.lit(0.5)).alias("subject_auc")))


P = "greatest(1e-12, least(1 - 1e-12, y_prob))"


@query(sql(PREDS, then=f"select lang, round(quantile_cont(round(-({P} * ln({P}) + (1 - {P}) * ln(1 - {P})), 9), 0.9), 6) as t from preds group by 1"))
def c7_abstention_by_group(spark, d):
    return _rounded(calibration.abstention_threshold(preds(spark, d).withColumn("u", F.round(binary_entropy(F.col("y_prob")), 9)), 0.9, ["lang"]))


@query(f"select doc_id, regexp_matches(text, '{texts.PROHIBITED_VALUES}') as prohibited from documents")
def k8_prohibited_values(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.prohibited_value(F.col("text")).alias("prohibited"))


@query(sql(CELLS, "s as (select cell_id, ['known_positive','known_negative','unknown','not_applicable','excluded_by_policy'][(cell_id % 5 + 1)::int] as state from cells)", then="select state, count(*)::bigint as n, state in ('known_positive', 'known_negative') as supervisable from s group by 1"))
def p26_label_states(spark, d):
    names = F.array(*map(F.lit, ("known_positive", "known_negative", "unknown", "not_applicable", "excluded_by_policy")))
    state = F.element_at(names, (F.col("cell_id") % 5 + 1).cast("int"))
    return cells(spark, d).groupBy(state.alias("state")).agg(F.count("*").alias("n")).withColumn("supervisable", F.col("state").isin(*labels.SUPERVISED))


@query(sql(CELLS, "n as (select count(*)::bigint as n, (count(*) filter (where cell_id % 10 = 0))::bigint as bulk from cells)", then="select 'single_cell_only' as policy, n as n_rows, bulk as n_violations, bulk = 0 as admitted from n union all select 'bulk_only', n, n - bulk, n - bulk = 0 from n"))
def p4_policy_rows(spark, d):
    return cohorts.policy_violations(cells(spark, d).withColumn("is_pseudo_bulk", F.col("cell_id") % 10 == 0))


@query(sql(CELLS, then="select cell_id, 'mouse::' || subject_id as subject_id, 'mouse' as species from cells"))
def s18_mouse_subjects(spark, d):
    return cells(spark, d).select("cell_id", experiments.namespaced(F.col("subject_id"), F.lit("mouse")).alias("subject_id"), F.lit("mouse").alias("species"))


@query(sql(PREDS, "ar as (select 'all' as arm, * from preds union all select 'without ' || s.source, p.* from preds p join (select distinct source from preds) s on p.source <> s.source)",
           "ac as (select arm, count(*)::bigint as n, (count(*) filter (where y_true = 1 and y_prob >= 0.5) / nullif(count(*) filter (where y_true = 1), 0) + count(*) filter (where y_true <> 1 and y_prob < 0.5) / nullif(count(*) filter (where y_true <> 1), 0)) / 2 as b from ar group by 1)",
           then="select arm, n, round(b, 6) as balanced_accuracy, round(b - (select b from ac where arm = 'all'), 6) as change from ac"))
def e6_ablation_arms(spark, d):
    return _rounded(experiments.source_ablation(preds(spark, d)))


#: Length of the embeddings.
DIMENSIONS = 64


def _bags(spark, d):
    c = table(spark, d, "embeddings").select(F.concat(F.lit("b"), F.floor(F.col("vec_id") / 5).cast("string")).alias("subject_id"), F.transform("embedding", lambda x: x.cast("double") * 8).alias("x"), "label")
    y = c.groupBy("subject_id").agg((F.max("label") >= 8).cast("double").alias("y"))
    return c.select("subject_id", "x"), y


@query()
def u5_attention_training(spark, d):
    """A few rounds of distributed training of gated attention, and its predictions."""
    bags, y = _bags(spark, d)
    return mil.predict(bags, mil.fit(bags, y, DIMENSIONS, hidden=4, rounds=5))


@query("select o.sample_id, coalesce(m.smoke_type, 'cigarette') as smoke_type, coalesce(m.known, true) as smoke_type_known, coalesce(m.subject_id, o.sample_id) as subject_id, true as is_pseudo_bulk from (select distinct 'x' || (l_orderkey % 500) as sample_id from lineitem) o left join (select 'x' || c_custkey as sample_id, lower(c_mktsegment) as smoke_type, c_custkey % 2 = 0 as known, 'p' || c_nationkey as subject_id from customer where c_acctbal >= 3000) m using (sample_id)")
def s17_matrix_with_sidecar(spark, d):
    from cohortloom.sources.geo import with_sidecar

    long = table(spark, d, "lineitem").select(F.concat(F.lit("x"), (F.col("l_orderkey") % 500).cast("string")).alias("sample_id"))
    side = table(spark, d, "customer").where("c_acctbal >= 3000").select(F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("sample_id"), F.lower("c_mktsegment").alias("smoke_type"), (F.col("c_custkey") % 2 == 0).alias("smoke_type_known"), F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("subject_id"))
    return with_sidecar(long, side, "cigarette")


@query("with e as (select o_custkey % 30 as sample_id, 'S' || (l_partkey % 25) as symbol, avg(l_quantity) as value from lineitem join orders on l_orderkey = o_orderkey where l_partkey % 25 < 20 group by 1, 2), m as (select r::bigint as sample_id, ['Never smoker','current smoker','ex'][(r % 3 + 1)::int] as status from range(0, 30) a(r)) select sample_id, symbol, round(value, 6) as value, case when status = 'Never smoker' then 'unexposed' when status = 'current smoker' then 'cigarette' else 'unknown' end as smoke_type, status <> 'ex' as known from e join m using (sample_id)")
def s9_microarray(spark, d):
    """Probe means per symbol, with the samples' smoking status."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    long = lines.select((F.col("o_custkey") % 30).alias("sample_id"), F.col("l_partkey").alias("probe"), F.col("l_quantity").alias("value"))
    k = F.col("p_partkey") % 25
    probes = table(spark, d, "part").where(k < 20).select(F.col("p_partkey").alias("probe"), F.concat(F.lit("S"), k.cast("string")).alias("symbol"), F.col("p_partkey").alias("line_no"))
    status = F.element_at(F.array(*map(F.lit, ("Never smoker", "current smoker", "ex"))), (F.col("id") % 3 + 1).cast("int"))
    samples = spark.range(30).select(F.col("id").alias("sample_id"), labels.smoke_status(status).alias("smoke_type"))
    return _rounded(M.mean_by_symbol(long, probes).join(samples, "sample_id").withColumn("known", F.col("smoke_type") != "unknown"))


@query(shift_sql.REPORT)
def x5_shift_report(spark, d):
    """Energy distance, MMD and centroid distance of two sources' subjects in one row."""
    from cohortloom.operators import shift
    from cohortloom.plans.shift import _points

    p = _points(spark, d)
    c = shift.centroid_distances(expr(spark, d).join(cells(spark, d).select("cell_id", "source"), "cell_id")).where("a = 'src0' and b = 'src1'")
    return _rounded(shift.energy_distance(p, "src0", "src1").crossJoin(shift.mmd(p, "src0", "src1")).crossJoin(c))  # one row each


@query(sql(CELLS, VOTES, GRID, PER, then="select 'class' as level, label::varchar as name, round(f1, 6) as value from pc union all select 'all', 'macro_f1', round(avg(f1), 6) from pc union all select 'all', 'balanced_accuracy', round(avg(case when support > 0 then recall end), 6) from pc"))
def u7_evaluation_report(spark, d):
    per = metrics.per_class(metrics.confusion(_votes(spark, d), _classes(spark)))
    whole = metrics.classification_summary(per)
    out = per.select(F.lit("class").alias("level"), F.col("label").cast("string").alias("name"), F.col("f1").alias("value"))
    for name in ("macro_f1", "balanced_accuracy"):
        out = out.unionByName(whole.select(F.lit("all").alias("level"), F.lit(name).alias("name"), F.col(name).alias("value")))
    return _rounded(out)


DEV = "dv as (select y_true, y_prob from preds where seed < 4), te as (select source, y_true, y_prob from preds where seed >= 4), e as (select y_prob as t, count(*) filter (where y_true = 1) as p, count(*) filter (where y_true <> 1) as q from dv group by 1), cv as (select t, sum(p) over (order by t desc) as tp, sum(q) over (order by t desc) as fp, sum(p) over () as pos, sum(q) over () as neg from e), th as (select coalesce((select t from cv where pos > 0 and neg > 0 order by round(tp / pos - fp / neg, 12) desc, t limit 1), 0.5::double) as threshold)"
C3 = "c as (select source, count(*) filter (where y_true = 1 and y_prob >= threshold) as tp, count(*) filter (where y_true <> 1 and y_prob >= threshold) as fp, count(*) filter (where y_true = 1 and y_prob < threshold) as fn, count(*) filter (where y_true <> 1 and y_prob < threshold) as tn, threshold from te, th group by source, threshold)"


@query(sql(PREDS, DEV, C3, then="select source, case when tp + fn > 0 and fp + tn > 0 then round(tp / (tp + fn), 6) end as sensitivity, case when tp + fn > 0 and fp + tn > 0 then round(tn / (tn + fp), 6) end as specificity, tp + fp + fn + tn as n, round(threshold, 6) as threshold from c"))
def c3_frozen_policy(spark, d):
    """A threshold frozen on the development half, applied once to the other."""
    p = preds(spark, d)
    policy = calibration.freeze(p.where("seed < 4").select("y_true", "y_prob"), method="none")
    return _rounded(policy.evaluate(p.where("seed >= 4"), ["source"]).select("source", "sensitivity", "specificity", "n", "threshold"))


@query("""with f as (select c_custkey as subject_id, c_custkey % 3 as fold from customer), d as (select k.fold, sha256(f.subject_id::varchar) as d from f join (select distinct fold from f) k on k.fold <> f.fold), p as (select fold, substr(d, 1, 3) as p, sha256(string_agg(d, '' order by d)) as d from d group by 1, 2)
select fold, sha256(string_agg(p || d, '' order by p || d)) as fingerprint from p group by 1""")
def k5_fold_fingerprints(spark, d):
    """What binds a fold's artifact to the subjects that it was fitted on."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), (F.col("c_custkey") % 3).alias("fold"))
    out = None
    for k in range(3):
        one = splits.fingerprint(c.where(F.col("fold") != k), "", "subject_id").withColumn("fold", F.lit(k).cast("bigint"))
        out = one if out is None else out.unionByName(one)
    return out


CTX = "ce as (select distinct 's' || (vec_id % 97) as subject_id, case when vec_id % 97 % 5 = 0 then 'test' else 'train' end as split from embeddings union select 'unknown', 'train'), mf as (select distinct 's' || (vec_id % 101) as subject_id, case when vec_id % 101 % 5 = 0 then 'test' else 'train' end as split from embeddings union select 'unknown', 'train'), bg as (select distinct 's' || (vec_id % 97) as subject_id, case when vec_id % 97 % 10 < 2 then 'test' else 'train' end as split from embeddings), bo as (select * from ce union select * from bg)"


@query(sql(CTX, then="select subject_id, 'overlap' as problem from bo group by 1 having count(distinct split) > 1 union select subject_id, 'unexpected' from (select * from ce except select * from mf) union select subject_id, 'missing' from (select * from mf except select * from ce) union select subject_id, 'placeholder' from bo where lower(trim(subject_id)) in ('', 'unknown', 'none', 'nan', 'null', 'n/a', 'na')"))
def p23_context_problems(spark, d):
    e, blank = table(spark, d, "embeddings"), spark.createDataFrame([("unknown", "train")], "subject_id string, split string")
    side = lambda n, test: e.select(F.concat(F.lit("s"), (F.col("vec_id") % n).cast("string")).alias("subject_id"), F.when(test(F.col("vec_id") % n), "test").otherwise("train").alias("split")).distinct()
    return experiments.context_problems(side(97, lambda k: k % 5 == 0).unionAll(blank), side(101, lambda k: k % 5 == 0).unionAll(blank), side(97, lambda k: k % 10 < 2))


FILES = "fl as (select o_orderkey, '/data/GSM' || o_orderkey || '_' || ['Con', 'E-cigs', 'ecig', 'other', 'Control'][(o_orderkey % 5 + 1)::int] || '_matrix.mtx.gz' as path from orders)"


@query(sql(FILES, then="select o_orderkey, regexp_extract(path, '(GSM[0-9]+)_([^_]+)_', 1) as sample, regexp_extract(path, '(GSM[0-9]+)_([^_]+)_', 2) as condition, case lower(regexp_extract(path, '(GSM[0-9]+)_([^_]+)_', 2)) when 'con' then 'unexposed' when 'control' then 'unexposed' when 'e-cigs' then 'vape' when 'ecig' then 'vape' when 'ecigs' then 'vape' end as label from fl"))
def s7_conditions(spark, d):
    """Sample and condition of a name, as the converter of one matrix a sample reads them."""
    names = F.element_at(F.array(*map(F.lit, ("Con", "E-cigs", "ecig", "other", "Control"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    path = F.concat(F.lit("/data/GSM"), F.col("o_orderkey").cast("string"), F.lit("_"), names, F.lit("_matrix.mtx.gz"))
    return table(spark, d, "orders").select("o_orderkey", texts.sample_of_file(path).alias("s")).select("o_orderkey", "s.sample", "s.condition", "s.label")
