"""Queries on matrices: quality control, normalisation, statistics, panels, pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.draws import draw
from cohortloom.operators import matrix as M
from cohortloom.plans.views import CELLS, COUNTS, EXPR, cells, counts, expr, sql
from cohortloom.registry import query

QC = """pc as (select cell_id, count(*) as n, sum(value) as total, sum(case when gene like 'MT-%' then value else 0 end) as mito from counts where value > 0 group by 1),
kept as (select c.* from counts c join pc using (cell_id) where n >= 3 and 100 * mito / total <= 20),
genes as (select gene from kept where value > 0 group by 1 having count(*) >= 3),
qc as (select cell_id, gene, value from kept where gene in (select gene from genes))"""
NORM = "norm as (select cell_id, gene, ln(1 + value * 1e4 / sum(value) over (partition by cell_id)) as value from qc)"
TRAIN = "train as (select cell_id from cells where subject_id in (select subject_id from cells group by 1 having substr(md5('7|split|' || subject_id), 1, 1) < 'b'))"
STATS = "n as (select count(*) as n from train), stats as (select gene, sum(value) / any_value(n) as mean, sqrt(greatest(0, sum(value * value) / any_value(n) - (sum(value) / any_value(n)) ** 2)) as std from expr join train using (cell_id), n group by 1)"


def _train(spark, d):
    return cells(spark, d).where(F.substring(draw(7, "split", "subject_id"), 1, 1) < "b")


def _r(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(sql(COUNTS, QC, then="select cell_id, gene, round(value, 6) as value from qc"))
def p9_qc_filter(spark, d):
    return _r(M.qc_filter(counts(spark, d), min_genes=3), "value")


@query(sql(COUNTS, QC, NORM, then="select cell_id, gene, round(value, 6) as value from norm"))
def n1_normalize(spark, d):
    return _r(M.log_normalize(M.qc_filter(counts(spark, d), min_genes=3)), "value")


@query(sql(CELLS, EXPR, TRAIN, STATS, then="select gene, round(mean, 6) as mean, round(std, 6) as std from stats"))
def g10_gene_stats(spark, d):
    return _r(M.gene_stats(expr(spark, d), _train(spark, d)), "mean", "std")


@query(sql(CELLS, EXPR, TRAIN, STATS, then="select gene, round(std * std, 6) as variance from stats order by round(std * std, 9) desc, gene limit 16"))
def g11_top_variance(spark, d):
    return _r(M.top_variance(expr(spark, d), _train(spark, d), 16), "variance")


SPARSE = EXPR.replace("expr as (select", "expr as (select * from (select") + " where value > 0)"


@query(sql(CELLS, SPARSE, TRAIN, STATS, then="select c.cell_id, s.gene, round(greatest(-10, least(10, (coalesce(e.value, 0) - mean) / std)), 6) as value from cells c cross join stats s left join expr e on e.cell_id = c.cell_id and e.gene = s.gene"))
def n4_apply_scaling(spark, d):
    """Values that are not above zero are absent, as in a sparse matrix."""
    e = expr(spark, d).where("value > 0")
    return _r(M.scale(e, cells(spark, d), M.gene_stats(e, _train(spark, d))), "value")


N3_TOP = "top as (select gene, mean, std from stats order by round(std * std, 9) desc, gene limit 16)"
N3_SCALED = "scaled as (select cell_id, gene, greatest(-10, least(10, (value - mean) / std)) as value from expr join top using (gene))"


@query(sql(CELLS, EXPR, TRAIN, STATS, N3_TOP, N3_SCALED, then="select subject_id, gene, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std from scaled join cells using (cell_id) group by 1, 2"))
def g8_subject_features(spark, d):
    """Fit statistics and panel on the training subjects alone, scale every cell, summarise subjects."""
    e, c, train = expr(spark, d), cells(spark, d), _train(spark, d)
    stats = M.gene_stats(e, train).join(M.top_variance(e, train, 16).select("gene"), "gene", "left_semi")
    return _r(M.subject_gene_features(M.scale(e, c, stats), c), "mean", "std")


@query(sql(CELLS, then="select subject_id, t::int as cell_type_id, round(count(*) filter (where cell_type_id = t) / count(*), 6) as share from cells, range(0, 4) r(t) group by 1, 2"))
def g8_cell_type_shares(spark, d):
    return _r(M.cell_type_shares(cells(spark, d), 4), "share")


@query(sql(CELLS, then="select subject_id, label from (select subject_id, label, row_number() over (partition by subject_id order by count(*) desc, label) as k from cells group by 1, 2) where k = 1"))
def g6_majority_label(spark, d):
    return M.majority(cells(spark, d), "subject_id", "label")


def _hvg(by: str) -> str:
    """Normalised dispersions z of each gene, by a batch column or none."""
    part, keep, same = (f"partition by {by}", f"{by}, ", f"{by}, ") if by else ("", "", "")
    return f"""m0 as (select {keep}gene, avg(exp(value) - 1) as mean, var_samp(exp(value) - 1) as var from lg group by all),
m as (select {keep}gene, round(ln(1 + mean), 9) as m, case when var / (case when mean = 0 then 1e-12 else mean end) > 0 then ln(var / (case when mean = 0 then 1e-12 else mean end)) end as d from m0),
e as (select *, min(m) over ({part}) as lo, max(m) over ({part}) as hi from m),
b as (select *, case when hi > lo then greatest(0, least(19, ceil((m - lo) / (hi - lo) * 20) - 1)) else 0 end as bin from e),
z as (select {keep}gene, case when count(d) over (partition by {same}bin) = 1 then (case when d is not null then 1.0::double end) else (d - avg(d) over (partition by {same}bin)) / nullif(stddev_samp(d) over (partition by {same}bin), 0) end as z from b)"""


LG = "lg as (select cell_id, gene, greatest(value, 0) as value, cell_id % 3 as batch from expr)"
HVG = f"{LG}, {_hvg('')}, r as (select gene from z order by round(z, 6) desc nulls last, gene limit 20)"


@query(sql(EXPR, LG, _hvg("batch"), "k as (select batch, gene, z, row_number() over (partition by batch order by round(z, 6) desc nulls last, gene) as r from z)", then="select gene from (select gene, count(*) filter (where r <= 20 and z is not null) as k, round(avg(z), 6) as z from k group by 1) order by k desc, z desc nulls last, gene limit 20"))
def n2_by_batch(spark, d):
    e = expr(spark, d).withColumns({"value": F.greatest("value", F.lit(0.0)), "batch": F.col("cell_id") % 3})
    return M.highly_variable(e, 20, batch="batch")


@query(sql(EXPR, HVG, then="select gene from r"))
def n2_highly_variable(spark, d):
    e = expr(spark, d).withColumn("value", F.greatest("value", F.lit(0.0)))
    return M.highly_variable(e, 20)


@query(sql(EXPR, HVG, "k as (select gene, gene in ('g00', 'g01', 'g02', 'g63') as marker from r)", "missing as (select distinct gene from expr where gene in ('g00', 'g01', 'g02', 'g63') and gene not in (select gene from r))",
           then="select gene from (select gene, marker, row_number() over (order by marker, gene desc) as p from k) where marker or p > (select count(*) from missing) union all select gene from missing"))
def n2_forced_markers(spark, d):
    e = expr(spark, d).withColumn("value", F.greatest("value", F.lit(0.0)))
    return M.highly_variable(e, 20, markers=["g00", "g01", "g02", "g63"])


PANELS = "panels as (select distinct 'a' as source, gene from expr where gene < 'g40' union all select distinct 'b', gene from expr where gene >= 'g10' union all select distinct 'c', gene from expr where gene <> 'g20')"


@query(sql(EXPR, PANELS, then="select gene from panels group by 1 having count(distinct source) = 3"))
def j5_shared_genes(spark, d):
    g = expr(spark, d).select("gene").distinct()
    parts = {"a": g.where("gene < 'g40'"), "b": g.where("gene >= 'g10'"), "c": g.where("gene <> 'g20'")}
    panels = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("source"), "gene")
        panels = part if panels is None else panels.unionAll(part)
    return M.shared_genes(panels)


@query(sql(EXPR, then="select c.cell_id, g.gene, round(coalesce(e.value, 0), 6) as value from (select distinct cell_id from expr) c, (select 'g' || lpad(i::varchar, 2, '0') as gene from range(60, 70) r(i)) g left join expr e on e.cell_id = c.cell_id and e.gene = g.gene"))
def p12_project_panel(spark, d):
    panel = spark.range(60, 70).select(F.concat(F.lit("g"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("gene"))
    return _r(M.project_panel(expr(spark, d), cells(spark, d), panel), "value")


@query(sql(EXPR, "mine as (select distinct gene from expr where gene < 'g50')", "theirs as (select 'g' || lpad((i % 58 + 4)::varchar, 2, '0') as gene, count(*) as b from range(0, 60) r(i) group by 1)",
           then="select (count(*) filter (where b is null))::bigint as n_missing, (count(*) filter (where m.gene is null))::bigint as n_unexpected, (count(*) filter (where b > 1))::bigint as n_duplicate, count(*) filter (where m.gene is not null and b is not null) / count(m.gene) as coverage from mine m full join theirs t using (gene)"))
def p15_compare_panels(spark, d):
    given = spark.range(60).select(F.concat(F.lit("g"), F.lpad(((F.col("id") % 58) + 4).cast("string"), 2, "0")).alias("gene"))
    return M.compare_panels(expr(spark, d).where("gene < 'g50'").select("gene"), given)


@query("select o_custkey % 20 as sample_id, 'S' || (l_partkey % 30) as symbol, round(avg(l_quantity), 6) as value from lineitem join orders on l_orderkey = o_orderkey where l_partkey % 7 <> 0 group by 1, 2")
def g1_probe_symbol_mean(spark, d):
    from cohortloom.plans.views import table

    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    probe = F.col("l_partkey")
    long = lines.select((F.col("o_custkey") % 20).alias("sample_id"), probe.alias("probe"), F.col("l_quantity").alias("value"))
    probes = table(spark, d, "part").select(F.col("p_partkey").alias("probe"), F.when(F.col("p_partkey") % 7 == 0, " ").otherwise(F.concat(F.lit("S"), F.col("p_partkey") % 30)).alias("symbol"), F.col("p_partkey").alias("line_no"))
    return _r(M.mean_by_symbol(long, probes), "value")


@query(sql(CELLS, EXPR, then="select subject_id, gene, round(max(value), 6) as value from expr join cells using (cell_id) group by 1, 2"))
def u3_max_pooling(spark, d):
    return _r(M.pooled(expr(spark, d), cells(spark, d), "max"), "value")


@query(sql(CELLS, EXPR, then="select subject_id, gene, round(avg(value), 6) as value from expr join cells using (cell_id) group by 1, 2"))
def u3_mean_pooling(spark, d):
    return _r(M.pooled(expr(spark, d), cells(spark, d)), "value")


SCORES = "scores as (select cell_id, subject_id, (cell_id % 11) / 5.0::double as score from cells), w as (select cell_id, subject_id, exp(score - max(score) over (partition by subject_id)) as e from scores), p as (select cell_id, subject_id, e / sum(e) over (partition by subject_id) as w from w)"


@query(sql(CELLS, EXPR, SCORES, then="select subject_id, gene, round(sum(w * value), 6) as value from expr join p using (cell_id) group by 1, 2"))
def u4_attention_pooling(spark, d):
    scores = cells(spark, d).select("cell_id", "subject_id", ((F.col("cell_id") % 11) / 5.0).alias("score"))
    return _r(M.attention_pool(expr(spark, d), scores), "value")


MODULES = "modules as (select m::int as module, gene from (select m, gene, row_number() over (partition by m order by md5('3|module|' || m || '|' || gene), gene) as k from (select distinct gene from expr), range(0, 6) r(m)) where k <= 8)"


def _modules(spark, d):
    return M.synthetic_modules(expr(spark, d).select("gene"), 6, 8, draw(3, "module", "module", "gene"))


@query(sql(EXPR, MODULES, then="select module, gene from modules"))
def s29_synthetic_modules(spark, d):
    return _modules(spark, d)


@query(sql(EXPR, MODULES, then="select cell_id, module, round(avg(value), 6) as score from expr join modules using (gene) group by 1, 2"))
def u4_module_scores(spark, d):
    return _r(M.module_scores(expr(spark, d), _modules(spark, d)), "score")


@query(sql(EXPR, MODULES, then="select module, count(*)::bigint as n_genes, (count(*) filter (where gene < 'g32'))::bigint as n_covered, count(*) filter (where gene < 'g32') >= 3 as usable from modules group by 1"))
def g27_module_coverage(spark, d):
    return M.module_coverage(_modules(spark, d), expr(spark, d).where("gene < 'g32'"))


@query(sql(CELLS, then="select subject_id, count(*)::bigint as n_cells, min(source) as source, o.outcome, o.outcome is not null as outcome_known from cells left join (select 's' || (doc_id % 30 * 2) as subject_id, max(toxic) as outcome from labels group by 1) o using (subject_id) group by subject_id, o.outcome having count(*) >= 12"))
def g3_subject_bags(spark, d):
    from cohortloom.plans.views import table

    known = table(spark, d, "labels").select(F.concat(F.lit("s"), F.col("doc_id") % 30 * 2).alias("subject_id"), F.col("toxic").alias("outcome"))
    return M.subject_bags(cells(spark, d), M.outcome_max(known), min_cells=12)


@query("select 's' || (doc_id % 60) as subject_id, max(toxic) as outcome from labels group by 1")
def g2_outcome_max(spark, d):
    from cohortloom.plans.views import table

    return M.outcome_max(table(spark, d, "labels").select(F.concat(F.lit("s"), F.col("doc_id") % 60).alias("subject_id"), F.col("toxic").alias("outcome")))


@query(sql(EXPR, then="select cell_id, case when k = 0 then symbol else symbol || '-' || k end as gene, round(value, 6) as value from (select cell_id, 'H' || (substr(gene, 2)::int % 20) as symbol, value, row_number() over (partition by cell_id, substr(gene, 2)::int % 20 order by gene) - 1 as k from expr where gene < 'g50')"))
def p10_harmonize_genes(spark, d):
    e = expr(spark, d)
    mapping = e.where("gene < 'g50'").select("gene").distinct().withColumn("symbol", F.concat(F.lit("H"), (F.substring("gene", 2, 2).cast("int") % 20).cast("string")))
    return _r(M.harmonize_genes(e, mapping), "value")


@query(sql(EXPR, "t as (select cell_id, gene, value, case when cell_id % 2 = 0 then 'even' else 'odd' end as source, case when cell_id % 2 = 0 then 'source_0' else 'source_1' end as batch from expr where (cell_id % 2 = 0 and gene < 'g50') or (cell_id % 2 = 1 and gene > 'g05'))",
           then="select cell_id, gene, round(value, 6) as value, source, batch from t where gene > 'g05' and gene < 'g50'"))
def n5_merge_sources(spark, d):
    e = expr(spark, d)
    return _r(M.merge_sources({"even": e.where("cell_id % 2 = 0 and gene < 'g50'"), "odd": e.where("cell_id % 2 = 1 and gene > 'g05'")}), "value")
