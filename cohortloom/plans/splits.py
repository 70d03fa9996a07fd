"""Queries on splits, folds and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import sampling
from cohortloom.operators import splits as S
from cohortloom.plans.views import CELLS, cells, sql, table
from cohortloom.registry import query

SUB = "sub as (select c_custkey as subject_id, case when c_custkey % 11 = 0 then null when c_acctbal > 9900 then c_nationkey + 100 else c_nationkey end as label from customer)"


def _sub(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("subject_id"), F.when(k % 11 == 0, None).when(F.col("c_acctbal") > 9900, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey")).alias("label"))


R1 = """st as (select *, case when count(*) over (partition by label) >= 3 then coalesce(label::varchar, '~null') else '~pool' end as stratum from sub),
rk as (select *, count(*) over (partition by stratum) as n, row_number() over (partition by stratum order by md5('11|split|' || subject_id), subject_id) as k from st),
a as (select *, case when stratum = '~pool' then round_even(n * 0.6::double, 0)::bigint else least(greatest(1, round_even(n * 0.6::double, 0)::bigint), n - 2) end as n_train from rk),
b as (select *, case when stratum = '~pool' then least(round_even(n * 0.2::double, 0)::bigint, n - n_train) else least(greatest(1, round_even(n * 0.2::double, 0)::bigint), n - n_train - 1) end as n_val from a)"""


@query(sql(SUB, R1, then="select subject_id, label, case when k <= n_train then 'train' when k <= n_train + n_val then 'val' else 'test' end as split from b"))
def r1_train_val_test(spark, d):
    return S.train_val_test(_sub(spark, d), 0.6, 0.2, 11)


@query("with k as (select greatest(2, least(5, min(n))) as k from (select count(*) as n from customer group by c_mktsegment)) select c_custkey as subject_id, c_mktsegment as label, ((row_number() over (order by c_mktsegment, md5('5|fold|' || c_custkey), c_custkey) - 1) % k)::int as fold from customer, k")
def r3_grouped_folds(spark, d):
    return S.grouped_folds(table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("label")), 5, 5)


@query("select event_id, user_id from (select event_id, user_id, row_number() over (partition by user_id order by md5('2|cap|' || event_id), event_id) as k from events) where k <= 20")
def r5_cap_rows(spark, d):
    return S.cap_rows(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", 20, 2)


def _probabilities_sql(weight: str) -> str:
    return f"with n as (select c_nationkey as label, count(distinct c_custkey) as n from customer group by 1), w as (select label, {weight} as w from n) select label, round(w / (select sum(w) from w), 9) as p from w"


def _probabilities(spark, d, how):
    s = table(spark, d, "customer").select(F.col("c_nationkey").alias("label"), F.col("c_custkey").alias("subject_id"))
    return S.selection_probabilities(s, how).withColumn("p", F.round("p", 9))


@query(_probabilities_sql("1.0::double"))
def r6_uniform(spark, d):
    return _probabilities(spark, d, "uniform")


@query(_probabilities_sql("n::double"))
def r6_natural(spark, d):
    return _probabilities(spark, d, "natural")


@query(_probabilities_sql("1.0::double / n"))
def r6_inverse_subject_frequency(spark, d):
    return _probabilities(spark, d, "inverse_subject_frequency")


DRAW = """o as (select c_mktsegment as label, c_nationkey as subject_id, c_custkey as cell_id from customer),
cls as (select label, row_number() over (order by label) as r, count(*) over () as k from (select distinct label from o)),
cdf as (select label, r / k::double as hi, (r - 1) / k::double as lo from cls),
su as (select label, subject_id, row_number() over (partition by label order by subject_id) - 1 as s, count(*) over (partition by label) as n_s from (select distinct label, subject_id from o)),
ce as (select label, subject_id, cell_id, row_number() over (partition by label, subject_id order by cell_id) - 1 as c, count(*) over (partition by label, subject_id) as n_c from o),
dr as (select i, ('0x' || substr(md5('9|class|' || i), 1, 8))::bigint / 4294967296.0::double as u, ('0x' || substr(md5('9|subject|' || i), 1, 8))::bigint as us, ('0x' || substr(md5('9|cell|' || i), 1, 8))::bigint as uc from range(0, 2000) r(i))"""


@query(sql(DRAW, then="select i, dr_c.label, su.subject_id, ce.cell_id from (select dr.*, cdf.label from dr join cdf on round(u, 9) >= round(lo, 9) and round(u, 9) < round(hi, 9)) dr_c join su on su.label = dr_c.label and su.s = us % n_s join ce on ce.label = su.label and ce.subject_id = su.subject_id and ce.c = uc % n_c"))
def r7_balanced_draws(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("label"), F.col("c_nationkey").alias("subject_id"), F.col("c_custkey").alias("cell_id"))
    subjects = rows.select("label", F.col("cell_id").alias("subject_id"))
    return S.balanced_draws(rows, S.selection_probabilities(subjects, "uniform"), 2000, 9)


@query("with a as (select c_custkey, row_number() over (order by md5(c_custkey::varchar), c_custkey) as k from customer), b as (select c_mktsegment, row_number() over (order by md5('4|permute|' || c_custkey), c_custkey) as k from customer) select c_custkey, c_mktsegment from a join b using (k)")
def r13_permute_labels(spark, d):
    return S.permuted(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 4)


@query(sql(CELLS, then="select subject_id from cells group by 1 having count(distinct label % 3) > 1"))
def p21_overlapping_subjects(spark, d):
    return S.overlapping(cells(spark, d).select("subject_id", (F.col("label") % 3).alias("split")))


@query("""with d as (select sha256(c_custkey || '|' || coalesce(c_mktsegment, '~')) as d from customer), p as (select substr(d, 1, 3) as p, sha256(string_agg(d, '' order by d)) as d from d group by 1)
select sha256(string_agg(p || d, '' order by p || d) || '{"seed":1}') as fingerprint from p""")
def r2_split_fingerprint(spark, d):
    return S.fingerprint(table(spark, d, "customer"), '{"seed":1}', "c_custkey", "c_mktsegment")


@query("select a::bigint as alpha, k as kind from (values (1), (2), (3)) x(a), (values ('l1'), ('l2')) y(k)")
def r11_parameter_grid(spark, d):
    return S.parameter_grid(spark, {"kind": ["l1", "l2"], "alpha": [1, 2, 3]})


OOF = "s as (select c_custkey as subject_id, c_custkey % 5 as f from customer), p as (select subject_id, f as subject_fold, case when subject_id % 31 = 0 then (f + 1) % 5 else f end as fold, case when subject_id % 37 = 0 then null else 0.5::double end as p from s where subject_id % 17 <> 0 union all select subject_id, f, f, 0.5::double from s where subject_id % 41 = 0 union all select -1, 0, 0, 0.5::double)"


@query(sql(OOF, "n as (select subject_id, count(*) as n, bool_or(fold <> subject_fold) as leak, bool_or(p is null) as bad from p group by 1)",
           then="select subject_id, problem from (select coalesce(s.subject_id, n.subject_id) as subject_id, case when n.n is null then 'missing' when s.subject_id is null then 'unexpected' when n.n > 1 then 'duplicate' when leak then 'leaked' when bad then 'not_finite' end as problem from s full join n on s.subject_id = n.subject_id) where problem is not null"))
def r10_oof_problems(spark, d):
    i = F.col("subject_id")
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), (F.col("c_custkey") % 5).alias("f"))
    p = s.where(i % 17 != 0).select(i, F.col("f").alias("subject_fold"), F.when(i % 31 == 0, (F.col("f") + 1) % 5).otherwise(F.col("f")).alias("fold"), F.when(i % 37 == 0, None).otherwise(0.5).alias("p"))
    p = p.unionAll(s.where(i % 41 == 0).select(i, "f", "f", F.lit(0.5))).unionAll(spark.range(1).select(F.lit(-1), F.lit(0), F.lit(0), F.lit(0.5)))
    return S.oof_problems(s, p)


@query(sql(CELLS, then="select cell_id, subject_id, case when subject_id in ('s3', 's7') then 'test' else 'train' end as split from cells"))
def p13_subset_by_subjects(spark, d):
    c = cells(spark, d).select("cell_id", "subject_id")
    return c.withColumn("split", F.when(F.col("subject_id").isin("s3", "s7"), "test").otherwise("train"))


R4 = """st as (select *, case when count(*) over (partition by label) >= 3 then coalesce(label::varchar, '~null') else '~pool' end as stratum from sub),
rk as (select *, count(*) over (partition by stratum) as n, row_number() over (partition by stratum order by md5('42|split|' || subject_id), subject_id) as k from st)"""


@query(sql(SUB, R4, then="select subject_id, label, case when k <= (case when stratum = '~pool' then round_even(n * 0.7::double, 0)::bigint else least(greatest(1, round_even(n * 0.7::double, 0)::bigint), n - 2) end) then 'train' else 'test' end as split from rk"))
def r4_train_test(spark, d):
    return S.train_val_test(_sub(spark, d), 0.7, 0.0, 42, min_val=0)


@query("select c as cell_id, 's' || (c // 20) as subject_id, ('0x' || substr(md5('5|label|s' || (c // 20)), 1, 8))::bigint % 3 as label, 'src' || (c // 20 % 2) as source, round(('0x' || substr(md5('5|value|' || c || '|' || g), 1, 8))::bigint / 4294967296.0::double, 9) as value, 'g' || g as gene from range(0, 640) a(c), range(0, 15) b(g)")
def s32_synthetic_context(spark, d):
    """Cells, subjects, labels and values that depend on their names alone."""
    from cohortloom.functions.draws import draw_u32, draw_unit

    subject = F.concat(F.lit("s"), F.floor(F.col("cell_id") / 20).cast("string"))
    c = spark.range(640).select(F.col("id").alias("cell_id")).withColumn("subject_id", subject)
    c = c.select("cell_id", "subject_id", (draw_u32(5, "label", "subject_id") % 3).alias("label"), F.concat(F.lit("src"), (F.floor(F.col("cell_id") / 20) % 2).cast("string")).alias("source"), F.explode(F.sequence(F.lit(0), F.lit(14))).alias("g"))
    return c.select("cell_id", "subject_id", "label", "source", F.round(draw_unit(5, "value", "cell_id", "g"), 9).alias("value"), F.concat(F.lit("g"), F.col("g").cast("string")).alias("gene"))


def _drawn(spark, d, by, replacement):
    """Batches in which caps bind: six cells of a subject at most, of classes with few subjects."""
    rows = cells(spark, d).select(F.when(F.substring("subject_id", 2, 9).cast("int") < 3, "rare").when(F.substring("subject_id", 2, 9).cast("int") < 9, "some").otherwise("many").alias("label"), "source", "subject_id", "cell_id")
    return sampling.capped_batches(rows, S.selection_probabilities(rows, "uniform", by), 60, 6, replacement, 11, samples=1000, by=by)


@query()
def r7_capped_batches(spark, d):
    """1,000 draws in batches of 60, without replacement: rare classes run out within a batch and the others fill it."""
    return _drawn(spark, d, "label", False)


@query()
def r8_capped_source_batches(spark, d):
    """The same by source, with replacement, as a report on every batch."""
    return sampling.batch_report(_drawn(spark, d, "source", True), "source")
