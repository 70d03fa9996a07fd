"""Queries on text records."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import texts as T
from cohortloom.plans.views import table
from cohortloom.registry import query


@query("select doc_id, list_filter(['the and', 'de la', 'license'], lambda p: contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), p)) as found from documents where len(list_filter(['the and', 'de la', 'license'], lambda p: contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), p))) > 0")
def p25_banned_phrases(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.banned_phrases(F.col("text"), ["the and", "de la", "license"]).alias("found"))
    return docs.where(F.size("found") > 0)


@query("select 'status' as key, c_custkey as pos, c_mktsegment as value from customer union all select 'age', c_custkey, (c_nationkey)::varchar from customer")
def s1_characteristics(spark, d):
    """Three lines of a cell for each customer; of the last, some cells have no key, so it is dropped."""
    c = table(spark, d, "customer")
    some = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("sex: "), F.col("c_name"))).otherwise("none")
    line = lambda n, cell: c.select(F.lit(n).alias("line_no"), F.col("c_custkey").alias("pos"), cell.alias("cell"))
    lines = line(1, F.concat(F.lit("Status: "), "c_mktsegment")).unionAll(line(2, F.concat(F.lit("age:"), F.col("c_nationkey").cast("string")))).unionAll(line(3, some))
    return T.characteristics(lines, c.count())


@query("select distinct 'M' || (p_partkey % 50) as module, unnest(string_split(p_type, ' ')) as gene from part where p_partkey % 5 <> 0")
def s28_gmt_modules(spark, d):
    p = table(spark, d, "part")
    name = F.concat(F.lit("M"), (F.col("p_partkey") % 50).cast("string"))
    line = F.when(F.col("p_partkey") % 5 == 0, F.concat(name, F.lit("\tx"))).otherwise(F.concat(name, F.lit("\tdescription\t"), F.regexp_replace("p_type", " ", "\t")))
    return T.modules_from_gmt(p.select(line.alias("value")))


@query("select l_orderkey as cell_id, split_part('ENSG' || l_partkey || '.' || l_linenumber, '.', 1) as gene, count(*)::bigint as n from lineitem group by 1, 2")
def s12_strip_version(spark, d):
    gene = F.concat(F.lit("ENSG"), F.col("l_partkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id"), T.strip_version(gene).alias("gene")).agg(F.count("*").alias("n"))


@query("select event_id, (props->>'$.k')::bigint as k from events")
def s31_json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
