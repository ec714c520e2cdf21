"""Interval and order operators against brute force on small random cases."""

import random

import pytest

from lectern.operators import joins
from lectern.operators.intervals import periods_and_gaps
from lectern.operators.ordered import collapse_runs

TURN = "job_id string, turn_id long, start_ms long, end_ms long, speaker_id string, extra string"
SEG = "job_id string, seg_id long, start_ms long, end_ms long"


def brute_periods(rows):
    out, by = set(), {}
    for job, _, a, b, who, _ in rows:
        if None not in (job, who, a, b) and a < b:
            by.setdefault((job, who), []).append((a, b))
    for key, spans in by.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(*key, "period", a, b) for a, b in merged}
        out |= {(*key, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("width", [7, 1000])
def test_periods_and_gaps(spark, width):
    rnd = random.Random(width)
    rows = [(rnd.choice(["a", "b"]), k, s := rnd.randint(-50, 300), s + rnd.randint(-3, 25), rnd.choice(["x", "unknown", None]), "e") for k in range(250)]
    rows += [("a", 1, 5, None, "x", "e"), (None, 2, 5, 9, "x", "e"), ("a", 3, None, 9, "x", "e"), ("c", 4, 0, 10, "x", "e"), ("c", 5, 10, 20, "x", "e"), ("c", 5, 10, 20, "x", "e")]
    got = periods_and_gaps(spark.createDataFrame(rows, TURN), ["job_id", "speaker_id"], width=width).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute_periods(rows)
    assert ("c", "x", "period", 0, 20) in {tuple(r) for r in got}


def test_no_rows(spark):
    none = spark.createDataFrame([], TURN)
    assert periods_and_gaps(none, ["job_id", "speaker_id"]).count() == 0
    assert joins.best_speaker(spark.createDataFrame([], SEG), none, "seg_id").count() == 0


def test_goldens(spark):
    """A segment of one second against two speakers: clear, under the threshold, tied, none."""
    segs = [(j, k, 0, 1000) for k, j in enumerate("abcd")]
    turns = [("a", 1, 0, 800, "A", ""), ("a", 2, 800, 2000, "B", ""), ("b", 3, 0, 400, "A", ""), ("c", 4, 0, 500, "A", ""), ("c", 5, 500, 1000, "B", ""), ("d", 6, 1000, 2000, "A", "")]
    got = {r.seg_id: tuple(r)[1:] for r in joins.best_speaker(spark.createDataFrame(segs, SEG), spark.createDataFrame(turns, TURN), "seg_id").collect()}
    assert got == {0: ("A", 800, 0.8, "max_overlap"), 1: ("unknown", 400, 0.4, "below_threshold"), 2: ("unknown", 500, 0.5, "equal_overlap"), 3: ("unknown", 0, 0.0, "no_overlap")}


@pytest.mark.parametrize("bucket", [5, 60_000])
def test_overlap_and_nearest(spark, bucket):
    rnd = random.Random(3)
    segs = [(rnd.choice("ab"), k, s := rnd.randint(0, 200), s + rnd.randint(1, 12)) for k in range(60)]
    turns = [(rnd.choice("ab"), k, s := rnd.randint(0, 200), s + rnd.randint(1, 12), rnd.choice("xyz"), "") for k in range(40)]
    left, right = spark.createDataFrame(segs, SEG), spark.createDataFrame(turns, TURN)
    got = [(r.l_seg_id, r.r_turn_id, r.overlap_ms) for r in joins.overlap_pairs(left, right, "job_id", bucket).collect()]
    want = [(i, t, min(b, d) - max(a, c)) for j, i, a, b in segs for k, t, c, d, _, _ in turns if j == k and a < d and c < b]
    assert sorted(got) == sorted(want)
    near = {r.seg_id: (r.speaker_id, r.distance_ms) for r in joins.nearest_interval(left, right, "seg_id", "speaker_id", width=bucket).collect()}
    for j, i, a, b in segs:
        d, _, x = min((max(0, c - b, a - e), c, s) for k, _, c, e, s, _ in turns if k == j)
        assert near[i] == (x, d)


@pytest.mark.parametrize("width", [3, 10_000])
def test_runs(spark, width):
    rnd = random.Random(width)
    rows = [("k", i, rnd.choice(["a", "a", "b", None])) for i in range(80)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "job_id string, t long, v string")
    got = {tuple(r) for r in collapse_runs(df, ["job_id"], ["t"], width, ["v"], F.col("v") == F.col("prev.v"), ["t", "v"], ["t"], F.col("v").isNotNull()).collect()}
    want, k = set(), 0
    while k < len(rows):
        m = k
        while m + 1 < len(rows) and rows[m + 1][2] == rows[k][2]:
            m += 1
        if rows[k][2] is not None:
            want.add(("k", k, rows[k][2], m, m - k + 1))
        k = m + 1
    assert got == want


@pytest.mark.parametrize("long_", [4096, 3])
def test_long_intervals_meet_once(spark, monkeypatch, long_):
    """A live channel and a wrong end among short rows, against brute force; nothing is laid out bucket by bucket for them."""
    from lectern.operators import joins

    monkeypatch.setattr(joins, "LONG", long_)
    rnd = random.Random(8)
    make = lambda n: [(rnd.choice("ab"), k, *(lambda a: (a, a + rnd.choice([1, 50, 400, 5000])))(rnd.randint(0, 9000))) for k in range(n)]
    left, right = make(60) + [("a", 900, 100, 9_000_000_000_000_000_000 // 1000), ("a", 901, 5, 5)], make(60) + [("a", 902, 0, 2_000_000_000_000), (None, 903, 0, 9)]
    schema = "job_id string, k long, start_ms long, end_ms long"
    got = sorted((r.l_k, r.r_k, r.overlap_ms) for r in joins.overlap_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "job_id", 100).collect())
    want = sorted((i, j, min(b, e) - max(a, c)) for x, i, a, b in left for y, j, c, e in right if x == y and a < e and c < b and a < b and c < e)
    assert got == want
