"""Queries on labels, identities and mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.parse import integral, is_placeholder, strict_bool
from cohortloom.operators import labels as L
from cohortloom.plans.views import CELLS, cells, sql, table
from cohortloom.registry import query

STATUS = "st as (select event_id, user_id, ts, ['Never smoker','current smoker','Ever','non-smoker','ex','control group','Cigarette user',''][(event_id % 8 + 1)::int] as status from events)"
_STATUS = ["Never smoker", "current smoker", "Ever", "non-smoker", "ex", "control group", "Cigarette user", ""]


def _pick(column, values, k):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(column) % k + 1).cast("int"))


@query(sql(STATUS, then="select event_id, case when regexp_matches(status, '\\bnever\\b|\\bnon-?smoker\\b|\\bcontrol\\b', 'i') then 'unexposed' when regexp_matches(status, '\\bcurrent\\b|\\bsmoker\\b|\\bever\\b|\\bcigarette\\b', 'i') then 'cigarette' else 'unknown' end as smoke_type from st"))
def l1_smoke_status(spark, d):
    return table(spark, d, "events").select("event_id", L.smoke_status(_pick("event_id", _STATUS, 8)).alias("smoke_type"))


@query("select c_custkey as sample_id, 'patient_' || c_custkey as subject_id, true as subject_id_verified from customer")
def l2_verified_subjects(spark, d):
    samples = table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.concat(F.lit("Patient "), F.col("c_custkey").cast("string"), F.lit(" lung")).alias("title"))
    return L.verified_subjects(samples).select("sample_id", "subject_id", "subject_id_verified")


@query("select c_custkey as sample_id, c_custkey::varchar as subject_id, false as subject_id_verified from customer")
def l2_unverified_subjects(spark, d):
    samples = table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.when(F.col("c_custkey") != 3, F.concat(F.lit("patient_"), F.col("c_custkey").cast("string"))).alias("title"))
    return L.verified_subjects(samples).select("sample_id", "subject_id", "subject_id_verified")


CODES = "co as (select event_id, [null,'1','2.0',' 1 ','x','1.5','2',''][(event_id % 8 + 1)::int] as cig, ['1','0',null,'1.0','2'][(event_id % 5 + 1)::int] as cigar from events)"


@query(sql(CODES, "n as (select event_id, try_cast(trim(cig) as double) as a, try_cast(trim(cigar) as double) as b from co)",
           then="select event_id, case when a in (1, 2) and b = 1 then 'dual_use' when a in (1, 2) then 'cigarette' when b = 1 then 'cigar' end as smoke_type from n"))
def l3_clinical_smoking(spark, d):
    cig, cigar = _pick("event_id", [None, "1", "2.0", " 1 ", "x", "1.5", "2", ""], 8), _pick("event_id", ["1", "0", None, "1.0", "2"], 5)
    return table(spark, d, "events").select("event_id", L.clinical_smoking(cig, cigar).alias("smoke_type"))


@query("with f as (select event_id, ['cannabis daily','no'][(event_id % 2 + 1)::int] as c, ['current','former','never'][(event_id % 3 + 1)::int] as g, ['yes','no',null,'no','no'][(event_id % 5 + 1)::int] as v from events) select event_id, case when c like 'cannabis%' and (g in ('current', 'former') or coalesce(v = 'yes', false)) then 'dual_use' when c like 'cannabis%' then 'cannabis' when g in ('current', 'former') then 'cigarette' when v = 'yes' then 'vape' else 'unexposed' end as smoke_type from f")
def l4_three_fields(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", L.three_field_class(_pick("event_id", ["cannabis daily", "no"], 2), _pick("event_id", ["current", "former", "never"], 3), _pick("event_id", ["yes", "no", None, "no", "no"], 5)).alias("smoke_type"))


@query(sql(CELLS, then="select cell_id, case when not known and cell_id % 2 = 0 then 9 else label end as label, known or cell_id % 2 = 0 as known from cells"))
def l5_weak_proxy(spark, d):
    c = cells(spark, d).withColumns({"proxy_known": F.col("cell_id") % 2 == 0, "proxy_value": F.lit(9)})
    return L.weak_proxy(c, enabled=True).select("cell_id", "label", "known")


@query(sql(CELLS, then="select cell_id, case when cell_id % 5 = 0 then 1.0::double else 0.0::double end as malignancy, cell_id % 5 = 0 as malignancy_known from cells"))
def l6_malignancy(spark, d):
    c = cells(spark, d)
    tumour = c.where("cell_id % 5 = 0").select("cell_id", F.lit(1.0).alias("m"))
    return c.join(tumour, "cell_id", "left").select("cell_id", F.coalesce("m", F.lit(0.0)).alias("malignancy"), F.col("m").isNotNull().alias("malignancy_known"))


SUBJ = "subj as (select c_custkey as subject_id, case when c_acctbal > 9900 then c_nationkey + 100 else c_nationkey end as label from customer)"


def _subj(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), F.when(F.col("c_acctbal") > 9900, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey")).alias("label"))


RARE = "rare as (select label from subj where label in (3, 7, 103, 107, 110, 115, 120) group by 1 having count(distinct subject_id) < 3)"


@query(sql(SUBJ, RARE, then="select subject_id, case when label in (select label from rare) then 4 else label end as label from subj"))
def l7_merge_rare(spark, d):
    return L.apply_rare_policy(_subj(spark, d), [3, 7, 103, 107, 110, 115, 120], "merge", into=4).select("subject_id", F.col("label").cast("int").alias("label"))


@query(sql(SUBJ, RARE, then="select subject_id, label from subj where label not in (select label from rare)"))
def l7_exclude_rare(spark, d):
    return L.apply_rare_policy(_subj(spark, d), [3, 7, 103, 107, 110, 115, 120], "exclude").select("subject_id", "label")


@query("select distinct c_nationkey as label, (dense_rank() over (order by c_nationkey) - 1)::int as effective from customer where c_nationkey not in (2, 5, 24)")
def l8_effective_mapping(spark, d):
    return L.effective_mapping(table(spark, d, "customer").select(F.col("c_nationkey").alias("label")), [2, 5, 24])


PAIRS = "pairs as (select distinct 'm' || l_partkey as mouse_gene, case when l_partkey % 13 = 0 then ' ' when l_partkey % 3 = 0 then 'h' || (l_suppkey * 7 % 300) else 'h' || (1000 + l_partkey // 2) end as human_gene from lineitem)"


def _pairs(spark, d):
    part = F.col("l_partkey")
    return table(spark, d, "lineitem").select(F.concat(F.lit("m"), part.cast("string")).alias("mouse_gene"), F.when(part % 13 == 0, " ").when(part % 3 == 0, F.concat(F.lit("h"), (F.col("l_suppkey") * 7 % 300).cast("string"))).otherwise(F.concat(F.lit("h"), (1000 + F.floor(part / 2)).cast("string"))).alias("human_gene")).distinct()


@query(sql(PAIRS, "p as (select * from pairs where trim(human_gene) <> '')", then="select mouse_gene, min(human_gene) as human_gene from p group by 1 having count(distinct human_gene) = 1 and min(human_gene) in (select human_gene from p group by 1 having count(*) = 1)"))
def l9_one_to_one_orthologs(spark, d):
    return L.ortholog_map(_pairs(spark, d))


@query(sql(PAIRS, then="select mouse_gene, min(human_gene) as human_gene from pairs where trim(human_gene) <> '' group by 1"))
def l9_best_orthologs(spark, d):
    return L.ortholog_map(_pairs(spark, d), "keep_best")


@query(sql(CELLS, then="select cell_id, case when known then label end as label from cells"))
def l11_unknown_to_null(spark, d):
    return cells(spark, d).select("cell_id", L.unknown_to_null().alias("label"))


@query("select n_nationkey, n_name, case when n_nationkey % 3 = 0 then n_nationkey else 0 end as id from nation")
def l10_name_lookup(spark, d):
    n = table(spark, d, "nation")
    names = n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))
    return L.map_names(n, names, "n_name", default=0).select("n_nationkey", "n_name", "id")


@query("select event_id, case when trim(t) in ('true', 'True', '1') then true when trim(t) in ('false', 'False', '0') then false end as flag from (select event_id, ['true',' False ','1.0','0','yes','',null,'True'][(event_id % 8 + 1)::int] as t from events)")
def p2_strict_bool(spark, d):
    return table(spark, d, "events").select("event_id", strict_bool(_pick("event_id", ["true", " False ", "1.0", "0", "yes", "", None, "True"], 8)).alias("flag"))


@query("select event_id, case when t in ('true', 'True', '1') then true when t in ('false', 'False', '0') then false end as flag from (select event_id, ['true',' False ','1.0','0','yes','',null,'True'][(event_id % 8 + 1)::int] as t from events)")
def p3_strict_bool_untrimmed(spark, d):
    return table(spark, d, "events").select("event_id", strict_bool(_pick("event_id", ["true", " False ", "1.0", "0", "yes", "", None, "True"], 8), trim=False).alias("flag"))


@query("select event_id, value, case when value = floor(value) then value::bigint end as id from events")
def p18_integral_ids(spark, d):
    return table(spark, d, "events").select("event_id", "value", integral(F.col("value")).alias("id"))


@query("select event_id, coalesce(lower(trim(t)) in ('', 'unknown', 'none', 'nan', 'null', 'n/a', 'na'), true) as placeholder from (select event_id, ['src1','Unknown ',null,'N/A','x','',' nan'][(event_id % 7 + 1)::int] as t from events)")
def p20_placeholder_sources(spark, d):
    return table(spark, d, "events").select("event_id", is_placeholder(_pick("event_id", ["src1", "Unknown ", None, "N/A", "x", "", " nan"], 7)).alias("placeholder"))


@query(sql(CELLS, "r as (select vec_id % 50 as cell_id, label as v, vec_id as line from embeddings), last as (select cell_id, arg_max(v, line) as v from r group by 1)",
           then="select c.cell_id, coalesce(v, label) as label, known or v is not null as known from cells c left join last using (cell_id)"))
def j3_transfer_labels(spark, d):
    records = table(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("cell_id"), F.col("label").alias("v"), F.col("vec_id").alias("line"))
    return L.transfer_labels(cells(spark, d), records, "cell_id", "v", "line").select("cell_id", "label", "known")


@query("select n_nationkey as id, n_name, coalesce(r_name, 'unknown') as r_name, r_name is not null as matched from nation left join (select * from region where r_regionkey < 3) on n_regionkey = r_regionkey")
def j1_metadata_join(spark, d):
    r = table(spark, d, "region").where("r_regionkey < 3")
    n = table(spark, d, "nation")
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"], "left").select(F.col("n_nationkey").alias("id"), "n_name", F.coalesce("r_name", F.lit("unknown")).alias("r_name"), F.col("r_name").isNotNull().alias("matched"))


CASES = "c as (select doc_id, doc_id // 3 * (case when doc_id % 10 = 0 then 1 else 1000 end) as case_id, ['Alive','Dead','unknown'][(doc_id % 3 + 1)::int] as status, n_chars from documents), r as (select *, case when count(*) over (partition by case_id) > 1 then 'duplicate_case' when status not in ('Alive', 'Dead') then 'unknown_status' when n_chars < 100 then 'missing_file' end as reason from c)"


def _cases(spark, d):
    i = F.col("doc_id")
    c = table(spark, d, "documents").select("doc_id", (F.floor(i / 3) * F.when(i % 10 == 0, 1).otherwise(1000)).cast("long").alias("case_id"), _pick("doc_id", ["Alive", "Dead", "unknown"], 3).alias("status"), "n_chars")
    return L.exclusion_cascade(c, [("duplicate_case", L.repeated("case_id")), ("unknown_status", ~F.col("status").isin("Alive", "Dead")), ("missing_file", F.col("n_chars") < 100)])


@query(sql(CASES, then="select doc_id, case_id, (status = 'Dead')::int as outcome from r where reason is null"))
def s13_vital_status(spark, d):
    return _cases(spark, d).where("reason is null").select("doc_id", "case_id", (F.col("status") == "Dead").cast("int").alias("outcome"))


@query(sql(CASES, then="select coalesce(reason, 'included') as reason, count(*)::bigint as n from r group by 1"))
def g14_exclusion_counts(spark, d):
    return L.exclusion_counts(_cases(spark, d))


@query("select doc_id, (quality = 1)::int as outcome from labels where quality is not null")
def s14_outcomes(spark, d):
    return table(spark, d, "labels").where("quality is not null").select("doc_id", (F.col("quality") == 1).cast("int").alias("outcome"))


QUAL = "q as (select source as split, known, cell_id % 3 = 0 as weak from cells)"
_Q = "count(*)::bigint as n, (count(*) filter (where known))::bigint as n_known, (count(*) filter (where not known))::bigint as n_unknown, (count(*) filter (where weak))::bigint as n_weak"


@query(sql(CELLS, QUAL, then=f"select split, {_Q} from q group by 1 union all select 'all', {_Q} from q"))
def g13_label_quality(spark, d):
    return L.label_quality(cells(spark, d).select(F.col("source").alias("split"), "known", (F.col("cell_id") % 3 == 0).alias("weak")))


@query("select o_orderkey as cell_id, lower(coalesce(nullif(o_orderstatus, 'P'), 'X')) as smoke_type_name, case lower(o_orderpriority) when '1-urgent' then 0 else 5 end::int as smoke_type, true as known, -1.0::double as exposure_dose from orders")
def p1_stamp_defaults(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("smoke_type_name"), F.when(F.col("o_orderpriority") == "1-URGENT", "cigarette").otherwise(F.col("o_orderpriority")).alias("p"))
    stamped = L.stamp_defaults(o, {"smoke_type_name": "X", "known": True, "exposure_dose": -1.0})
    return stamped.select("cell_id", F.lower("smoke_type_name").alias("smoke_type_name"), L.smoke_id(F.col("p")).alias("smoke_type"), "known", "exposure_dose")
