"""Relations over the tables: rows that come twice with one key count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.tables import table


def segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcript_segments", "seg_id", "job_id", "start_ms", "end_ms", "text").dropDuplicates(["seg_id"])


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "speaker_turns", "turn_id", "job_id", "start_ms", "end_ms", "speaker_id", "source").where("end_ms > start_ms and speaker_id is not null").dropDuplicates(["turn_id"])


def boards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "board_segments", "board_id", "job_id", "start_ms", "end_ms", "version_id", "region").dropDuplicates(["board_id"])


def speech(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("speaker_id", "([0-9]+)", 1)
    rows = table(spark, d, "speech_segments", "speech_id", "job_id", "start_ms", "end_ms", "speaker_id", "text", "confidence", "match_ratio", "inferred").dropDuplicates(["speech_id"])
    return rows.withColumn("speaker", F.when(F.coalesce(n, F.lit("")) == "", "unknown").otherwise(F.concat(F.lit("speaker_"), n.cast("int"))))


def frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "frames", "job_id", "timestamp_ms", "frame_index", "sharpness", "has_text").dropDuplicates(["job_id", "timestamp_ms"])


def entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "knowledge_entries", "id", "course_id", "case_id", "type", "title", "body", "evidence_json", "confidence").dropDuplicates(["id"])


def course_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments with their course and an id of the form SEG-<course>-<8 digits>."""
    jobs = table(spark, d, "jobs", "job_id", "course_id").dropDuplicates(["job_id"])
    number = F.lpad((F.col("seg_id") % 100_000_000).cast("string"), 8, "0")
    return segments(spark, d).join(jobs, "job_id").withColumn("segment_id", F.concat_ws("-", F.lit("SEG"), "course_id", number))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """(id, course_id, case_id, evidence_id), one row for each cited segment."""
    return entries(spark, d).select("id", "course_id", "case_id", F.explode(F.from_json("evidence_json", "array<string>")).alias("evidence_id")).distinct()


SQL = """with seg as (select distinct seg_id, job_id, start_ms, end_ms, text from transcript_segments),
turn as (select distinct turn_id, job_id, start_ms, end_ms, speaker_id, source from speaker_turns where end_ms > start_ms and speaker_id is not null),
board as (select distinct on (board_id) board_id, job_id, start_ms, end_ms, version_id, region from board_segments),
sp as (select distinct on (speech_id) speech_id, job_id, start_ms, end_ms, speaker_id, text, confidence, match_ratio,
  case when coalesce(regexp_extract(speaker_id, '([0-9]+)', 1), '') = '' then 'unknown'
       else 'speaker_' || cast(regexp_extract(speaker_id, '([0-9]+)', 1) as int) end as speaker from speech_segments),
fr as (select distinct on (job_id, timestamp_ms) job_id, timestamp_ms, frame_index, sharpness, has_text from frames),
en as (select distinct on (id) id, course_id, case_id, type, title, body, evidence_json, confidence from knowledge_entries),
cs as (select seg.*, course_id, 'SEG-' || course_id || '-' || lpad(cast(seg_id % 100000000 as varchar), 8, '0') as segment_id
       from seg join (select distinct job_id, course_id from jobs) using (job_id)),
ev as (select distinct id, course_id, case_id, unnest(from_json(evidence_json, '["VARCHAR"]')) as evidence_id from en)
"""
