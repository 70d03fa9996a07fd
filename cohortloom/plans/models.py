"""Queries on models: baselines, out-of-fold prediction, pooling, losses, scorers."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortloom.operators import lattice
from cohortloom.operators import models as U
from cohortloom.operators.splits import grouped_folds
from cohortloom.plans.metrics import _rounded
from cohortloom.plans.views import CELLS, EXPR, PREDS, cells, expr, preds, sql, table
from cohortloom.registry import query


def _vectors(spark, d):
    """A row for each vector, with class 1 for labels of 5 and more."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("subject_id"), (F.col("label") >= 5).cast("double").alias("y_true"), F.concat(F.lit("src"), F.col("vec_id") % 3).alias("source"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))


def _subjects(spark, d):
    """Vectors with their folds."""
    e = _vectors(spark, d)
    return e.join(grouped_folds(e.select("subject_id", F.col("y_true").alias("label")), 3, 1).select("subject_id", "fold"), "subject_id")


SJ = "sj as (select vec_id as subject_id, (label >= 5)::int::double as y_true, 'src' || (vec_id % 3) as source, embedding from embeddings), lx as (select subject_id, i as g, embedding[i]::double as x from sj, range(1, 65) r(i))"


def folds_sql(folds: int, seeds: str = "(1)") -> str:
    """fd: (seed, subject_id, fold) of grouped_folds."""
    return f"fd as (select seed, subject_id, ((row_number() over (partition by seed order by y_true, md5(seed || '|fold|' || subject_id), subject_id) - 1) % (select greatest(2, least({folds}, min(n))) from (select count(*) as n from sj group by y_true)))::int as fold from sj, (values {seeds}) v(seed))"


#: cp: probabilities of the nearest-centroid model that the other rows of `held` give, gr being (seed, subject_id, held).
CENTROID = """ce as (select h.seed, h.held, g, avg(x) filter (where y_true = 1) as a, avg(x) filter (where y_true <> 1) as b from (select distinct seed, held from gr) h join gr on gr.seed = h.seed and gr.held <> h.held join sj using (subject_id) join lx using (subject_id) group by 1, 2, 3),
cp as (select gr.seed, gr.held, subject_id, any_value(y_true) as y_true, 1 / (1 + exp(-(sum(x * (a - b)) + sum(b * b - a * a) / 2))) as y_prob from gr join sj using (subject_id) join lx using (subject_id) join ce on ce.seed = gr.seed and ce.held = gr.held and ce.g = lx.g group by 1, 2, 3)"""
#: rm: AUROC of cp by seed and held.
HELD_RANK = "e as (select seed, held, y_prob as t, count(*) filter (where y_true = 1) as p, count(*) filter (where y_true <> 1) as q from cp group by 1, 2, 3), cv as (select *, sum(p) over (partition by seed, held order by t desc) as tp, sum(q) over (partition by seed, held order by t desc) as fp, sum(p) over (partition by seed, held) as pos, sum(q) over (partition by seed, held) as neg from e), rm as (select seed, held, sum(p + q)::bigint as n, case when max(pos) > 0 and max(neg) > 0 then sum(p * (neg - fp + q / 2)) / (max(pos) * max(neg)) end as auroc, case when max(pos) > 0 and max(neg) > 0 then sum(p * tp / (tp + fp)) / max(pos) end as auprc from cv group by 1, 2)"
BY_FOLD = "gr as (select seed, subject_id, fold as held from fd)"


@query(sql(SJ, folds_sql(3), BY_FOLD, CENTROID, then="select subject_id, y_true, held as fold, round(y_prob, 6) as y_prob, (y_prob >= 0.5)::int::double as y_pred from cp"))
def r9_out_of_fold(spark, d):
    return _rounded(U.out_of_fold(_subjects(spark, d), "centroid").select("subject_id", "y_true", "fold", "y_prob", "y_pred"))


@query()
def u2_logistic(spark, d):
    return U.out_of_fold(_subjects(spark, d), "logistic").select("subject_id", "y_true", "fold", "y_prob", "y_pred")


@query()
def u2_random_forest(spark, d):
    rows = _subjects(spark, d)
    return U.fit_candidate(rows.where("fold <> 0"), "random_forest", numTrees=10).predict(rows.where("fold = 0")).select("subject_id", "y_true", "y_prob", "y_pred")


@query("select vec_id as subject_id, (label >= 5)::int::double as y_true, (select avg((label >= 5)::int) from embeddings where vec_id % 2 = 0) as y_prob from embeddings where vec_id % 2 = 1")
def u2_prevalence(spark, d):
    rows = _subjects(spark, d)
    return U.fit_candidate(rows.where("subject_id % 2 = 0"), "prevalence").predict(rows.where("subject_id % 2 = 1")).select("subject_id", "y_true", "y_prob")


@query(sql(SJ, "gr as (select 1 as seed, subject_id, source as held from sj)", CENTROID, HELD_RANK, then="select held as source, n, round(auroc, 6) as auroc, round(auprc, 6) as auprc from rm"))
def e5_leave_one_source_out(spark, d):
    return _rounded(U.leave_one_source_out(_subjects(spark, d), "centroid"))


WEIGHTS = [[((i * j) % 7 - 3) / 10.0 for i in range(64)] for j in (1, 2, 3)]
LOGIT = "list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::double * ((i * {j}) % 7 - 3) / 10.0::double))"
LIN = f"lg as (select vec_id, {LOGIT.format(j=1)} as a, {LOGIT.format(j=2)} + 0.25 as b, {LOGIT.format(j=3)} as c from embeddings)"


@query(sql(LIN, then="select vec_id, round(exp(a) / (exp(a) + exp(b) + exp(c)), 6) as p0, round(exp(b) / (exp(a) + exp(b) + exp(c)), 6) as p1, round(exp(c) / (exp(a) + exp(b) + exp(c)), 6) as p2 from lg"))
def u3_linear_scores(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    out = U.linear_scores(x, WEIGHTS, [0.0, 0.25, 0.0])
    return _rounded(out.select("vec_id", *(F.col("scores")[k].alias(f"p{k}") for k in range(3))))


@query(sql(LIN, then="select vec_id, round(tanh(a) / (1 + exp(-(b - 0.25))) - 0.5 * tanh(c) / (1 + exp(-a)), 6) as score from lg"))
def u3_gated_attention(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    return _rounded(U.gated_attention(x, [WEIGHTS[0], WEIGHTS[2]], [WEIGHTS[1], WEIGHTS[0]], [1.0, -0.5]).select("vec_id", "score"))


PT = "pt as (select source, toxic is not null as known, case when y_true = 1 then y_prob else 1 - y_prob end as pt from preds)"


@query(sql(PREDS, PT, then="select source, round(coalesce(avg(case when known then -((1 - pt) ** 2) * ln(greatest(pt, 1e-12)) end), 0), 6) as loss from pt group by 1"))
def u4_masked_focal_loss(spark, d):
    p = preds(spark, d)
    return _rounded(p.groupBy("source").agg(U.masked_mean(U.focal_loss(F.col("y_prob"), F.col("y_true")), F.col("toxic").isNotNull()).alias("loss")))


@query(sql(CELLS, EXPR, then="select subject_id, gene, round(avg(value), 6) as value from (select subject_id, label % 3 as t, gene, avg(value) as value from expr join cells using (cell_id) group by 1, 2, 3) group by 1, 2"))
def u4_hierarchical_pooling(spark, d):
    rows = expr(spark, d).join(cells(spark, d).select("cell_id", "subject_id", (F.col("label") % 3).alias("cell_type_id")), "cell_id")
    return _rounded(U.hierarchical_pool(rows))


def _lattice_rows(spark, d):
    """Subjects with two features, sums of the even and of the odd dimensions, on nested folds."""
    e = table(spark, d, "embeddings")
    half = lambda k: F.aggregate(F.filter("embedding", lambda x, i: i % 2 == k), F.lit(0.0), lambda a, b: a + b.cast("double"))
    rows = e.select(F.col("vec_id").cast("string").alias("subject_id"), (F.col("label") >= 5).cast("double").alias("y"), F.array(half(0), half(1)).alias("x"))
    return rows.join(lattice.nested_folds(rows.select("subject_id", F.col("y").alias("label")), 3, 3, 1), "subject_id")


PENALTIES = [0.01, 0.1, 1.0]
#: nr: (subject_id, y, a, b) and nf: the inner fold inn of a subject outside each outer one; tr: training rows of every split (o, i), i = -1 for the whole rest.
NESTED = """nr as (select vec_id::varchar as subject_id, (label >= 5)::int::double as y, list_sum(list_transform(range(0, 32), lambda i: embedding[2 * i + 1]::double)) as a, list_sum(list_transform(range(0, 32), lambda i: embedding[2 * i + 2]::double)) as b from embeddings),
nd as (select nr.*, (row_number() over (order by y, md5('1|fold|' || subject_id), subject_id) - 1) % (select greatest(2, least(3, min(n))) from (select count(*) as n from nr group by y)) as fold from nr),
no as (select nd.*, o from nd, (select distinct fold as o from nd) where fold <> o),
nk as (select o, greatest(2, least(3, min(n))) as k from (select o, y, count(*) as n from no group by 1, 2) group by 1),
nf as (select no.*, (row_number() over (partition by o order by y, md5('1|fold|' || subject_id), subject_id) - 1) % k as inn from no join nk using (o)),
sp as (select distinct o, inn as i from nf union select distinct o, -1 from nf),
tw as (select sp.o, sp.i, nf.* exclude (o) from sp join nf on nf.o = sp.o and nf.inn <> sp.i),
sc as (select o, i, avg(a) as ma, avg(b) as mb, stddev_samp(a) as da, stddev_samp(b) as db, count(*) / 2.0::double / sum(y) as w1, count(*) / 2.0::double / sum(1 - y) as w0 from tw group by 1, 2),
tr as (select tw.o, tw.i, y, (a - ma) / da as u, (b - mb) / db as v, case when y = 1 then w1 else w0 end as w from tw join sc using (o, i)),
pn as (select unnest(range(0, 3))::int as pos, unnest([0.01, 0.1, 1.0])::double as pen)"""


def _newton_sql(step: int, models: str) -> str:
    """c<step>: coefficients c0, c1, c2 after a Newton step from c<step - 1>, for (o, i, pos) of models, the 3 x 3 system solved by Cramer's rule."""
    prior = f"c{step - 1}"
    return f"""g{step} as (select o, i, pos, sum(w) as sw, sum(w * (p - y)) / sum(w) as g0, sum(w * (p - y) * u) / sum(w) + max(pen * c1) as g1, sum(w * (p - y) * v) / sum(w) + max(pen * c2) as g2,
    sum(w * p * (1 - p)) / sum(w) as h00, sum(w * p * (1 - p) * u) / sum(w) as h01, sum(w * p * (1 - p) * v) / sum(w) as h02, sum(w * p * (1 - p) * u * u) / sum(w) + max(pen) as h11, sum(w * p * (1 - p) * u * v) / sum(w) as h12, sum(w * p * (1 - p) * v * v) / sum(w) + max(pen) as h22
  from (select o, i, pos, pen, c1, c2, y, u, v, w, 1 / (1 + exp(-(c0 + c1 * u + c2 * v))) as p from {models} join {prior} using (o, i, pos) join pn using (pos) join tr using (o, i)) group by 1, 2, 3),
d{step} as (select *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) as det from g{step}),
c{step} as (select o, i, pos, c0 - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det as c0,
    c1 - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det as c1,
    c2 - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det as c2 from d{step} join {prior} using (o, i, pos))"""


#: Every model's AUROC on what it holds out: inner models their inner fold, the others (i = -1) their outer one.
NESTED_SCORES = """im as (select o, i, pos from sp, pn where i >= 0), c0 as (select o, i, pos, 0::double as c0, 0::double as c1, 0::double as c2 from sp, pn)"""
RANKED = "select o, i, pos, case when sum(p) > 0 and sum(q) > 0 then sum(p * (below + q / 2)) / (sum(p) * sum(q)) end as auroc from (select o, i, pos, t, p, q, coalesce(sum(q) over (partition by o, i, pos order by t rows between unbounded preceding and 1 preceding), 0) as below from (select o, i, pos, t, sum(y) as p, sum(1 - y) as q from {0} group by 1, 2, 3, 4)) group by 1, 2, 3"
NESTED_CHOICE = f"""pi as (select c2.o, c2.i, pos, y, 1 / (1 + exp(-(c0 + c1 * (a - ma) / da + c2 * (b - mb) / db))) as t from c2 join sc using (o, i) join nf on nf.o = c2.o and nf.inn = c2.i),
ri as ({RANKED.format('pi')}), mi as (select o, pos, avg(auroc) as m, count(auroc) as n from ri group by 1, 2),
ch as (select o, pos, m, n from (select *, row_number() over (partition by o order by coalesce(round(m, 12), '-infinity'::double) desc, pos) as k from mi) where k = 1),
om as (select o, -1 as i, pos from ch)"""


@query(sql(NESTED, NESTED_SCORES, _newton_sql(1, "im"), _newton_sql(2, "im"), NESTED_CHOICE,
           _newton_sql(1, "om").replace("c1 as (", "x1 as (").replace("g1 as (", "y1 as (").replace("d1 as (", "w1 as (").replace("from g1", "from y1").replace("from d1", "from w1"),
           _newton_sql(2, "om").replace("c2 as (", "x2 as (").replace("g2 as (", "y2 as (").replace("d2 as (", "w2 as (").replace("from g2", "from y2").replace("from d2", "from w2").replace("join c1 using", "join x1 using"),
           f"po as (select x2.o, x2.i, pos, y, 1 / (1 + exp(-(c0 + c1 * (a - ma) / da + c2 * (b - mb) / db))) as t from x2 join sc using (o, i) join nd on nd.fold = x2.o), ro as ({RANKED.format('po')})",
           then="select o::int as outer_fold, pen as penalty, round(m, 6) as inner_score, n::int as n_defined, round(auroc, 6) as auroc from ch join pn using (pos) join ro using (o, pos)"))
def r12_nested_selection(spark, d):
    """Penalties chosen by inner folds for each outer one, all models fitted together by two Newton steps."""
    return _rounded(lattice.nested_selection(_lattice_rows(spark, d), PENALTIES, 2, steps=2)[0].withColumnRenamed("outer", "outer_fold"))


#: Arms as splits of every held-out source: -1 weighs classes alike, -2 does not. Labels under 3 are the rarer class.
ABLATION = """nr as (select vec_id as subject_id, 'src' || (vec_id % 4) as source, (label < 3)::int::double as y, list_sum(list_transform(range(0, 32), lambda i: embedding[2 * i + 1]::double)) as a, list_sum(list_transform(range(0, 32), lambda i: embedding[2 * i + 2]::double)) as b from embeddings),
os as (select distinct source as o from nr), ai as (select unnest([-1, -2])::int as i),
tw as (select o, nr.* from os join nr on nr.source <> o),
sc as (select o, avg(a) as ma, avg(b) as mb, stddev_samp(a) as da, stddev_samp(b) as db, count(*) / 2.0::double / sum(y) as w1, count(*) / 2.0::double / sum(1 - y) as w0 from tw group by 1),
tr as (select o, i, y, (a - ma) / da as u, (b - mb) / db as v, case when i = -2 then 1 when y = 1 then w1 else w0 end as w from tw join sc using (o), ai),
pn as (select 0 as pos, 0.1::double as pen), im as (select o, i, 0 as pos from os, ai), c0 as (select o, i, 0 as pos, 0::double as c0, 0::double as c1, 0::double as c2 from os, ai)"""


@query(sql(ABLATION, _newton_sql(1, "im"), _newton_sql(2, "im"), "po as (select o, i, pos, y, 1 / (1 + exp(-(c0 + c1 * (a - ma) / da + c2 * (b - mb) / db))) as t from c2 join sc using (o) join nr on nr.source = o)",
           f"ro as ({RANKED.format('po')})", "ba as (select o, i, count(*)::bigint as n, (avg((t >= 0.5)::int) filter (where y = 1) + avg((t < 0.5)::int) filter (where y = 0)) / 2 as bal from po group by 1, 2)",
           then="select case i when -1 then 'balanced' else 'unweighted' end as arm, o as source, n, round(auroc, 6) as auroc, round(bal, 6) as balanced_accuracy, round(bal - (select x.bal from ba x where x.o = ba.o and x.i = -1), 6) as change from ba join ro using (o, i)"))
def e6_refitted_arms(spark, d):
    """Logistic models with and without class weights, refitted without each source and judged on it."""
    half = lambda k: F.aggregate(F.filter("embedding", lambda x, i: i % 2 == k), F.lit(0.0), lambda a, b: a + b.cast("double"))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("subject_id"), F.concat(F.lit("src"), F.col("vec_id") % 4).alias("source"), (F.col("label") < 3).cast("double").alias("y"), F.array(half(0), half(1)).alias("x"))
    return _rounded(lattice.held_out_sources(rows, {"balanced": True, "unweighted": False}, 0.1, 2, steps=2))


@query()
def n10_scaled_logistic(spark, d):
    """Out-of-fold probabilities of class-weighted logistic regression on all dimensions, its folds fitted together to convergence."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("subject_id"), (F.col("label") >= 5).cast("double").alias("y"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    folds = grouped_folds(e.select("subject_id", F.col("y").alias("label")), 3, 1).select("subject_id", "fold")
    return lattice.out_of_fold(e.join(folds, "subject_id"), 0.1, 64).select("subject_id", "fold", F.col("y").alias("y_true"), "y_prob")
