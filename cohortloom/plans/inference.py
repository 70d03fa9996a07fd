"""Queries on input gates, prediction by subject, tracks and repeats."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cohortloom.operators import cohorts, experiments, inference, mil, models
from cohortloom.plans.lookups import DIMENSIONS
from cohortloom.plans.metrics import _rounded
from cohortloom.plans.models import BY_FOLD, CENTROID, SJ, _vectors, folds_sql
from cohortloom.plans.views import sql, table
from cohortloom.registry import query

#: Cells of which some break each rule of the input.
INPUT = """ic as (select case when vec_id % 40 = 39 then 'unknown' else 's' || (vec_id % 40) end as subject_id, case when vec_id % 11 = 0 then null else vec_id % 13 = 0 end as bulk, case when vec_id % 17 = 0 then null when vec_id % 19 = 0 then 'bulk' else 'single_cell' end as modality,
case when vec_id % 23 = 0 then null when vec_id % 29 = 0 then 9 else vec_id % 4 end as kind, vec_id % 31 = 0 as short, vec_id % 37 = 0 as nan from embeddings),
pb as (select subject_id, 'placeholder' as problem from ic where subject_id = 'unknown' union all select subject_id, 'no_provenance' from ic where bulk is null union all select subject_id, 'policy' from ic where bulk union all select subject_id, 'modality' from ic where modality is distinct from 'single_cell'
union all select subject_id, 'cell_type' from ic where kind is null or kind > 3 union all select subject_id, 'length' from ic where short union all select subject_id, 'not_finite' from ic where nan and not short)"""


@query(sql(INPUT, then="select subject_id, problem, count(*)::bigint as n from pb group by 1, 2"))
def p19_input_problems(spark, d):
    v, x = F.col("vec_id"), F.transform("embedding", lambda e: e.cast("double"))
    short = F.slice(x, 1, DIMENSIONS - 1)
    given = table(spark, d, "embeddings").select(
        F.when(v % 40 == 39, "unknown").otherwise(F.concat(F.lit("s"), (v % 40).cast("string"))).alias("subject_id"), F.when(v % 11 != 0, v % 13 == 0).alias("is_pseudo_bulk"),
        F.when(v % 17 == 0, None).when(v % 19 == 0, "bulk").otherwise("single_cell").alias("modality"), F.when(v % 23 == 0, None).when(v % 29 == 0, 9).otherwise(v % 4).cast("int").alias("cell_type_id"),
        F.when(v % 31 == 0, short).when(v % 37 == 0, F.array_append(short, F.lit(float("nan")))).otherwise(x).alias("x"))
    return inference.input_problems(given, "single_cell_only", 4, DIMENSIONS)


@query("with g as (select p_partkey as pos, 'p' || p_partkey as gene from part), t as (select p_partkey as pos, 'p' || (p_partkey + (p_partkey % 10 = 0)::int) as given from part where p_partkey % 77 <> 0) select pos, gene, given from g full join t using (pos) where gene is distinct from given")
def p17_panel_order(spark, d):
    part, k = table(spark, d, "part"), F.col("p_partkey")
    fitted = part.select(k.alias("pos"), F.concat(F.lit("p"), k.cast("string")).alias("gene"))
    given = part.where(k % 77 != 0).select(k.alias("pos"), F.concat(F.lit("p"), (k + (k % 10 == 0).cast("int")).cast("string")).alias("gene"))
    return inference.panel_problems(fitted, given)


ARTIFACTS = """ar as (select c_custkey as id, [null, 'single_cell_only', 'bulk_only', 'mixed', 'single_cell_only'][(c_custkey % 5 + 1)::int] as policy, case when c_custkey % 7 = 0 then '' when c_custkey % 7 <> 1 then '2' end as policy_version, case when c_custkey % 6 <> 0 then c_custkey % 4 = 0 end as bulk_at_fit,
case when c_custkey % 9 <> 0 then 'cells' end as modality_at_fit, case when c_custkey % 8 <> 0 then c_custkey % 16 = 1 end as degraded, [null, 'inductive_per_cell', 'pseudo_bulk_no_cell_type_identity', 'majority_voting'][(c_custkey % 4 + 1)::int] as annotation,
case when c_custkey % 3 = 0 then sha256('old') when c_custkey % 3 = 1 then sha256('map') when c_custkey % 10 = 2 then 'XYZ' end as print from customer)"""


@query(sql(ARTIFACTS, then="select id, concat_ws(';', case when policy is null or policy = 'mixed' then 'policy' end, case when coalesce(policy_version, '') = '' then 'policy_version' end, case when bulk_at_fit is null or modality_at_fit is null then 'incomplete' end, case when policy = 'single_cell_only' and bulk_at_fit then 'contradiction' end, case when degraded is distinct from false then 'degraded' end, case when annotation is null or annotation = 'majority_voting' then 'annotation' end, case when annotation = 'inductive_per_cell' and (print is null or print = 'XYZ') then 'fingerprint' end, case when annotation = 'inductive_per_cell' and print = sha256('old') then 'stale_mapping' end, case when annotation = 'pseudo_bulk_no_cell_type_identity' and print is not null then 'unexpected_mapping' end) as problems from ar"))
def p17_artifact_problems(spark, d):
    k, pick = F.col("c_custkey"), lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % n + 1).cast("int"))
    old, now = (F.sha2(F.lit(x).cast("binary"), 256) for x in ("old", "map"))
    given = table(spark, d, "customer").select(
        k.alias("id"), pick(5, None, "single_cell_only", "bulk_only", "mixed", "single_cell_only").alias("policy"), F.when(k % 7 == 0, "").when(k % 7 != 1, "2").alias("policy_version"), F.when(k % 6 != 0, k % 4 == 0).alias("bulk_at_fit"),
        F.when(k % 9 != 0, "cells").alias("modality_at_fit"), F.when(k % 8 != 0, k % 16 == 1).alias("degraded"), pick(4, None, "inductive_per_cell", "pseudo_bulk_no_cell_type_identity", "majority_voting").alias("annotation"),
        F.when(k % 3 == 0, old).when(k % 3 == 1, now).when(k % 10 == 2, "XYZ").alias("map_fingerprint"))
    import hashlib

    return inference.artifact_problems(given, hashlib.sha256(b"map").hexdigest()).select("id", F.array_join("problems", ";").alias("problems"))


def _given(spark, d):
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select(
        F.concat(F.lit("s"), (v % 40).cast("string")).alias("subject_id"), v.alias("cell_id"), F.transform("embedding", lambda e: e.cast("double")).alias("x"), (v % 4).cast("int").alias("cell_type_id"),
        F.lit(False).alias("is_pseudo_bulk"), F.lit("single_cell").alias("modality"))


#: Cells with the scores of a model with one hidden unit, whose weights repeat along the vector; e is what a cell weighs.
SCORES = "sc as (select vec_id as cell_id, 's' || (vec_id % 40) as subject_id, sum(embedding[i]::double * ((i - 1) % 5 - 2) / 4) as p, sum(embedding[i]::double * ((i - 1) % 3 - 1) / 4) as q from embeddings, range(1, 65) r(i) group by 1, 2), aw as (select *, exp(3 * tanh(p) / (1 + exp(-q))) as e from sc)"


def _model() -> mil.GatedAttention:
    k = np.arange(DIMENSIONS)
    return mil.GatedAttention(((k % 5 - 2) / 4)[None], ((k % 3 - 1) / 4)[None], np.array([3.0]), (k % 7 - 3) * 2.0, 0.25)


@query(sql(SCORES, "z as (select subject_id, i, sum(e * embedding[i]::double) / sum(e) as z from aw join embeddings on cell_id = vec_id, range(1, 65) r(i) group by 1, 2), p as (select subject_id, 1 / (1 + exp(-(sum(z * ((i - 1) % 7 - 3) * 2) + 0.25))) as y_prob from z group by 1), n as (select subject_id, count(*)::bigint as n_cells from aw group by 1)",
           then="select subject_id, round(y_prob, 6) as y_prob, case when y_prob >= 0.7 then 'HIGH' when y_prob >= 0.4 then 'MODERATE' else 'LOW' end as risk_tier, n_cells, false as diagnostic from p join n using (subject_id)"))
def u6_predict_subjects(spark, d):
    return _rounded(inference.predict_subjects(_given(spark, d), _model(), "single_cell_only", 4))


#: Dropout of the classifier's inputs: passes, share dropped, and the inputs each pass keeps (1) as a string.
PASSES, DROP = 20, 0.25
KEPT = ", ".join(f"({k}, '{''.join('01'[int(x >= DROP)] for x in np.random.default_rng((0, k)).random(DIMENSIONS))}')" for k in range(PASSES))


@query(sql(SCORES, "z as (select subject_id, i, sum(e * embedding[i]::double) / sum(e) as z from aw join embeddings on cell_id = vec_id, range(1, 65) r(i) group by 1, 2)", f"ks as (select * from (values {KEPT}) v(k, kept))",
           f"p as (select subject_id, k, 1 / (1 + exp(-(sum(case when substr(kept, i::int, 1) = '1' then z * ((i - 1) % 7 - 3) * 2 / {1 - DROP}::double else 0 end) + 0.25))) as y_prob from z, ks group by 1, 2)",
           then="select subject_id, round(avg(y_prob), 6) as mean, round(var_pop(y_prob), 6) as variance from p group by 1"))
def c9_dropout_uncertainty(spark, d):
    return _rounded(mil.dropout_report(_given(spark, d).select("subject_id", "x"), _model(), PASSES, DROP))


@query(sql(SCORES, "t as (select *, sum(e) over (partition by subject_id) as norm, row_number() over (partition by subject_id order by round(e, 9) desc, cell_id)::int as rank from aw)", then="select subject_id, cell_id, round(e / norm, 6) as weight, rank from t where rank <= 5"))
def u6_most_attended(spark, d):
    return _rounded(inference.most_attended(_given(spark, d), _model()))


@query("with c as (select n_name as cohort, n_nationkey as k from nation), s as (select cohort, unnest(list_filter([case when k % 2 = 0 then 'exposure' end, case when k % 3 = 0 then 'outcome' end], lambda x: x is not null)) as task, k from c), r as (select cohort, task, unnest(list_filter([case when k % 5 <> 0 then 'development' end, case when k % 4 = 1 then 'external' end], lambda x: x is not null)) as role from s), t as (select task, role from (values ('exposure'), ('outcome'), ('stage')) a(task), (values ('development'), ('external')) b(role)) select t.task, t.role, case when count(cohort) > 0 then 'eligible' else 'no_eligible_cohort' end as status, coalesce(string_agg(cohort, ';' order by cohort), '') as cohorts from t left join r using (task, role) group by 1, 2")
def e9_tracks(spark, d):
    k = F.col("n_nationkey")
    some = lambda **when: F.array_compact(F.array(*(F.when(holds, name) for name, holds in when.items())))
    registry = table(spark, d, "nation").select(F.col("n_name").alias("cohort"), some(exposure=k % 2 == 0, outcome=k % 3 == 0).alias("tasks"), some(development=k % 5 != 0, external=k % 4 == 1).alias("roles"))
    tracks = spark.createDataFrame([(t, r) for t in ("exposure", "outcome", "stage") for r in ("development", "external")], "task string, role string")
    return cohorts.track_status(registry, tracks)


def _repeats(spark, d):
    return experiments.repeated_out_of_fold(_vectors(spark, d).where("y_true is not null"), "centroid", 3, [1, 2])


@query(sql(SJ, folds_sql(3, "(1), (2)"), BY_FOLD, CENTROID, then="select seed, subject_id, source, held as fold, cp.y_true, round(y_prob, 6) as y_prob from cp join sj using (subject_id)"))
def e10_repeated_out_of_fold(spark, d):
    return _rounded(_repeats(spark, d))


@query(sql(SJ, folds_sql(3, "(1), (2)"), BY_FOLD, CENTROID, then="select subject_id, count(*)::bigint as n, round(avg(y_prob), 6) as mean, round(stddev_pop(y_prob), 6) as sd, least(count(*) filter (where y_prob >= 0.5), count(*) filter (where y_prob < 0.5))::bigint as flips from cp group by 1"))
def e10_repeat_spread(spark, d):
    return _rounded(experiments.repeat_spread(_repeats(spark, d)))


RUNS = "rn as (select o_orderkey, ['logistic', 'attention', 'module_attention', 'prevalence'][(o_orderkey % 4 + 1)::int] as candidate, ['erm', 'source_balanced', 'coral', 'mmd', 'domain_adversarial'][(o_custkey % 5 + 1)::int] as strategy from orders)"


@query(sql(RUNS, then="select *, case when candidate = 'module_attention' or strategy = 'erm' then strategy else 'erm' end as applied, candidate = 'module_attention' or strategy = 'erm' as applicable from rn"))
def l12_applied_strategies(spark, d):
    pick = lambda n, by, *names: F.element_at(F.array(*map(F.lit, names)), (F.col(by) % n + 1).cast("int"))
    runs = table(spark, d, "orders").select("o_orderkey", pick(4, "o_orderkey", "logistic", "attention", "module_attention", "prevalence").alias("candidate"), pick(5, "o_custkey", *models.STRATEGIES).alias("strategy"))
    return models.applied_strategies(runs)
