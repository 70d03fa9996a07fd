"""Queries on event time, in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.plans.views import table
from cohortloom.registry import query
from cohortloom.streaming.votes import sessions, windowed_counts


@query("select time_bucket(interval '1 day', ts) as start, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by 1, 2")
def t1_windowed_counts(spark, d):
    return windowed_counts(table(spark, d, "events"), "1 day").withColumn("total", F.round("total", 4))


@query("with g as (select user_id, ts, case when ts - lag(ts) over w < interval '6 hours' then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, max(ts) + interval '6 hours' as \"end\", count(*)::bigint as n from s group by user_id, k")
def t2_sessions(spark, d):
    return sessions(table(spark, d, "events"), "6 hours")
