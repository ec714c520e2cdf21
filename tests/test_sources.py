"""Payload shapes, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.sources import payloads, sinks
from lectern.streaming import turns


def test_transcripts(spark):
    sentences = [{"text": "", "sentence_info": [{"text": " 你好 ", "start": 0, "end": 500, "timestamp": [[0, 200], [200, 500]]}, {"text": "…", "start": 500, "end": 600}, {"text": "bad", "start": 9, "end": 9}]}]
    whole = [{"text": "hello world", "timestamp": [[10, 20], [20, 40]]}]
    raw = spark.createDataFrame([("a", json.dumps(sentences)), ("b", json.dumps(whole)), ("c", "no json"), ("d", None)], "job_id string, raw string")
    got = {r.job_id: (r.start_ms, r.end_ms, r.text, [tuple(w) for w in r.words]) for r in payloads.transcripts(raw).collect()}
    assert got == {"a": (0, 500, "你好", [(0, 200, "你"), (200, 500, "好")]), "b": (10, 40, "hello world", [(10, 20, "hello"), (20, 40, "world")])}


def test_diarization(spark):
    raw = spark.createDataFrame([("a", 1.0, 2.0, "7"), ("a", 0.0, 0.5, "3"), ("a", 3.0, 4.0, "-1"), ("a", 5.0, 4.0, "3"), ("a", 2.0, 2.5, "x"), ("a", 2.0, 3.0, None)], "job_id string, start double, end double, label string")
    got = {(r.start_ms, r.speaker_id) for r in payloads.diarization(raw).collect()}
    assert got == {(0, "speaker_0"), (1000, "speaker_1"), (2000, "speaker_2")}


def test_ocr(spark):
    box = lambda x, y: [[x, y], [x + 10, y], [x + 10, y + 10], [x, y + 10]]
    one = {"rec_texts": ["B", "A", " ", "C"], "rec_scores": [0.9, 0.4, 0.9, 0.8], "rec_polys": [box(20, 1), box(0, 0), box(0, 30), box(0, 50)]}
    raw = spark.createDataFrame([(1, json.dumps(one)), (2, "{}"), (3, None)], "frame_id long, raw string")
    got = [(r.text, r.confidence, r.low_confidence) for r in payloads.ocr_lines(raw).orderBy("line_no").collect()]
    assert got == [("AB", 0.4, True), ("C", 0.8, False)]


def test_frame_rate(spark):
    df = spark.createDataFrame([("30000/1001",), ("25",), ("1/0",), ("x",), (None,)], "r string")
    assert [round(r.v, 3) for r in df.select(payloads.frame_rate(F.col("r")).alias("v")).collect()] == [29.97, 25.0, 0.0, 0.0, 0.0]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    sinks.write_once(df, f"{tmp_path}/x")
    sinks.write_once(df.orderBy(F.desc("k")), f"{tmp_path}/x")
    with pytest.raises(FileExistsError):
        sinks.write_once(df.where("k = 1"), f"{tmp_path}/x")
    cues = spark.createDataFrame([("j", k, f"cue {k}") for k in (3, 1, 2)], "job_id string, cue_no long, cue string")
    sinks.write_jobs_text(cues, f"{tmp_path}/srt", "job_id", "cue_no", "cue")
    assert "".join(p.read_text() for p in sorted((tmp_path / "srt/job_id=j").glob("*.txt"))) == "cue 1\ncue 2\ncue 3\n"


def test_streams(spark, tmp_path):
    day = 86_400_000  # what isn't after the epoch is late for Spark's first watermark
    segs = spark.createDataFrame([("j", 1, 0, 1000), ("j", 2, 5000, 6000)], "job_id string, seg_id long, a long, b long")
    trns = spark.createDataFrame([("j", 7, 500, 800), ("j", 8, 900, 5500), ("k", 9, 0, 9000)], "job_id string, turn_id long, a long, b long")
    for name, df in (("s", segs), ("t", trns)):
        df.select("*", F.timestamp_millis(F.col("a") + day).alias("start_ts"), F.timestamp_millis(F.col("b") + day).alias("end_ts")).write.parquet(f"{tmp_path}/{name}")
    read = lambda n: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{n}").schema).parquet(f"{tmp_path}/{n}")
    q = turns.overlaps(read("s"), read("t")).writeStream.format("memory").queryName("met").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("met").collect()} == {("j", 1, 7, 300), ("j", 1, 8, 100), ("j", 2, 8, 500)}
