"""Streams of segments and turns: an extension, the survey's engine has none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlaps(segments: DataFrame, turns: DataFrame, late: str = "10 minutes", longest: str = "10 minutes") -> DataFrame:
    """(job_id, seg_id, turn_id, overlap_ms): stream-stream inner join on overlap.

    Both sides: job_id, id, start_ts, end_ts. Intervals are at most ``longest``,
    so a watermark on the start bounds the state of both sides. Event times lie
    after 1970: what doesn't is late for Spark's first watermark, and dropped.
    """
    a = segments.select("job_id", "seg_id", F.col("start_ts").alias("a"), F.col("end_ts").alias("b")).withWatermark("a", late)
    t = turns.select(F.col("job_id").alias("t_job"), "turn_id", F.col("start_ts").alias("c"), F.col("end_ts").alias("d")).withWatermark("c", late)
    span = F.expr(f"interval {longest}")
    near = (F.col("c") >= F.col("a") - span) & (F.col("c") <= F.col("a") + span)
    both = a.join(t, (F.col("job_id") == F.col("t_job")) & near & (F.col("c") < F.col("b")) & (F.col("a") < F.col("d")))
    ms = F.unix_millis(F.least("b", "d")) - F.unix_millis(F.greatest("a", "c"))
    return both.select("job_id", "seg_id", "turn_id", ms.alias("overlap_ms"))


def sessions(turns: DataFrame, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """(job_id, speaker_id, start, end, n): session windows of each speaker's turns; works on streams and tables."""
    rows = turns.withWatermark("start_ts", late) if turns.isStreaming else turns
    out = rows.groupBy("job_id", "speaker_id", F.session_window("start_ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("job_id", "speaker_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
