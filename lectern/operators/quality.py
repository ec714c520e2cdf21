"""Data quality: one row for each group, with a boolean for each check and whether all hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.ordered import blocked, with_neighbor


def verdict(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds each check, and ``passed``; a check that is null doesn't hold."""
    df = df.select("*", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()])
    every = F.lit(True)
    for k in checks:
        every = every & F.col(k)
    return df.withColumn("passed", every)


def segment_checks(segments: DataFrame, jobs: DataFrame, width: int = 900_000) -> DataFrame:
    """Each job's segments: texts, durations, no overlap with the next start, and an end near the recording's.

    The end may miss the recording's by 30 s or 2 %, whichever is more; a recording without a duration isn't held against that.
    """
    rows = with_neighbor(blocked(segments, ["job_id"], "start_ms", width), ["job_id"], ["start_ms", "seg_id"], ["end_ms"], "prev")
    per = rows.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("n_blank"), F.count_if(F.col("end_ms") <= F.col("start_ms")).alias("n_empty"),
        F.count_if(F.col("prev.end_ms") > F.col("start_ms")).alias("n_overlap"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"),
    )
    per = per.join(jobs.select("job_id", "duration_ms"), "job_id", "left")
    gap = F.abs(F.col("duration_ms") - F.col("last_ms")) <= F.greatest(F.lit(30_000), F.floor(F.col("duration_ms") * 0.02))
    checks = {"has_text": F.col("n_blank") == 0, "durations": F.col("n_empty") == 0, "apart": F.col("n_overlap") == 0, "early_start": F.col("first_ms") <= 60_000, "near_end": F.col("duration_ms").isNull() | gap}
    return verdict(per, checks).drop("first_ms", "last_ms", "duration_ms")


def entry_checks(entries: DataFrame, cited: DataFrame, known: DataFrame) -> DataFrame:
    """Each course's entries: titles, bodies, and that what they cite exists. ``cited``: course_id, id, evidence_id; ``known``: evidence_id."""
    per = entries.groupBy("course_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.trim("title"), F.lit("")) == "").alias("n_untitled"), F.count_if(F.coalesce(F.trim("body"), F.lit("")) == "").alias("n_blank"))
    lost = cited.join(known.distinct(), "evidence_id", "left_anti").groupBy("course_id").agg(F.count(F.lit(1)).alias("n_lost"))
    citing = cited.groupBy("course_id").agg(F.count_distinct("id").alias("n_citing"))
    per = per.join(lost, "course_id", "left").join(citing, "course_id", "left").fillna(0, ["n_lost", "n_citing"])
    return verdict(per, {"titled": F.col("n_untitled") == 0, "bodies": F.col("n_blank") == 0, "evidence_exists": F.col("n_lost") == 0, "all_cite": F.col("n_citing") == F.col("n")})
