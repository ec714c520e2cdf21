"""Queries of the general problems (pN_...), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.operators.intervals import periods_and_gaps
from lectern.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_and_gaps(table(spark, sf_dir, "speaker_turns", "job_id", "speaker_id", "start_ms", "end_ms"), ["job_id", "speaker_id"])


QUERIES = {"p1_found": p1_found}

SQL = {
    "p1_found": """
with t as (select distinct job_id, speaker_id, start_ms, end_ms from speaker_turns
           where job_id is not null and speaker_id is not null and start_ms < end_ms),
m as (select *, max(end_ms) over (partition by job_id, speaker_id order by start_ms, end_ms
                                  rows between unbounded preceding and 1 preceding) as reach from t),
g as (select *, sum(case when reach is null or start_ms > reach then 1 else 0 end)
                over (partition by job_id, speaker_id order by start_ms, end_ms rows unbounded preceding) as grp from m),
p as (select job_id, speaker_id, min(start_ms) as start_ms, max(end_ms) as end_ms from g group by job_id, speaker_id, grp),
n as (select *, lead(start_ms) over (partition by job_id, speaker_id order by start_ms) as next_ms from p)
select job_id, speaker_id, 'period' as kind, start_ms, end_ms from p
union all
select job_id, speaker_id, 'gap' as kind, end_ms as start_ms, next_ms as end_ms from n where next_ms is not null
""",
}
