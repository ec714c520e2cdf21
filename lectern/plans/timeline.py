"""Queries of the timeline operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import joins, positions
from lectern.operators.ordered import collapse_runs
from lectern.plans import relations as r
from lectern.session import cut
from lectern.sources.tables import table

BLOCK = 900_000
_runs = lambda s, d: positions.speaker_runs(r.speech(s, d), ["job_id"], ["start_ms", "speech_id"], "speaker", BLOCK, ["speech_id", "start_ms"], ["speech_id", "end_ms"])


def align_max_overlap(s, d):
    return joins.best_speaker(r.segments(s, d), r.turns(s, d), "seg_id")


def overlap_by_speaker(s, d):
    pairs = joins.overlap_pairs(r.segments(s, d).drop("text"), r.turns(s, d), "job_id")
    return pairs.groupBy(F.col("l_seg_id").alias("seg_id"), F.col("r_speaker_id").alias("speaker_id")).agg(F.sum("overlap_ms").alias("overlap_ms"))


def interval_join_bucketed(s, d):
    pairs = joins.overlap_pairs(r.segments(s, d).drop("text"), r.boards(s, d), "job_id")
    return pairs.select(F.col("l_seg_id").alias("seg_id"), F.col("r_board_id").alias("board_id"), "overlap_ms")


def timeline_merge(s, d):
    """Each segment with the boards that overlap it, in order."""
    pairs = joins.overlap_pairs(r.segments(s, d).drop("text"), r.boards(s, d).drop("region"), "job_id")
    held = pairs.groupBy(F.col("l_seg_id").alias("seg_id")).agg(F.sort_array(F.collect_list(F.struct("r_start_ms", "r_board_id"))).alias("b"))
    ids = F.array_join(F.transform("b", lambda x: x["r_board_id"].cast("string")), ",")
    return r.segments(s, d).select("seg_id").join(held, "seg_id", "left").select("seg_id", F.coalesce(F.size("b"), F.lit(0)).cast("long").alias("n_boards"), F.coalesce(ids, F.lit("")).alias("boards"))


def orphan_boards(s, d):
    met = joins.overlap_pairs(r.boards(s, d).drop("region"), r.segments(s, d).drop("text"), "job_id").select(F.col("l_board_id").alias("board_id")).distinct()
    return r.boards(s, d).join(met, "board_id", "left_anti").select("board_id", "job_id", "start_ms", "end_ms")


def nearest_turn(s, d):
    return joins.nearest_interval(r.segments(s, d).where("end_ms > start_ms"), r.turns(s, d), "seg_id", "speaker_id")


def board_for_point(s, d):
    points = r.frames(s, d).select("job_id", F.col("timestamp_ms").alias("t"), F.struct("job_id", "timestamp_ms").alias("id"))
    out = joins.point_lookup(points, r.boards(s, d).drop("region"), "id", "board_id")
    return out.select("id.job_id", "id.timestamp_ms", "board_id", "inside")


def speaker_islands(s, d):
    return _runs(s, d).select("job_id", F.col("first_speaker").alias("speaker"), "first_speech_id", "last_speech_id", "n")


def unknown_run_inherit(s, d):
    runs = _runs(s, d).select("job_id", "first_speaker", F.col("first_speech_id").alias("first_id"), F.col("first_start_ms").alias("first_start"), F.col("last_end_ms").alias("last_end"))
    out = positions.fill_unknown(runs, ["job_id"], BLOCK)
    return out.select("job_id", F.col("first_id").alias("first_speech_id"), F.col("first_speaker").alias("speaker"), "filled")


def word_runs_inherit(s, d):
    """Words of the segments that are split by speaker (clear_switches), with their speaker, and what short runs of unknown words inherit."""
    from lectern.plans.exports import clear_switches

    rows = table(s, d, "transcript_segments", "seg_id", "job_id", "start_ms", "end_ms", "words").dropDuplicates(["seg_id"]).where("size(words) > 0").join(clear_switches(s, d).select("seg_id"), "seg_id", "left_semi")
    good = F.filter("words", lambda w: (w["start_ms"] >= 0) & (w["end_ms"] > w["start_ms"]) & (F.length(w["text"]) > 0))
    clamp = F.transform(good, lambda w: F.struct(F.greatest(w["start_ms"], F.col("start_ms")).alias("start_ms"), F.least(w["end_ms"], F.col("end_ms")).alias("end_ms"), w["text"].alias("text")))
    words = rows.select("seg_id", "job_id", F.explode(F.transform(clamp, lambda w, i: F.struct(w.alias("w"), i.alias("i")))).alias("x")).select("seg_id", "job_id", "x.w.*", "x.i").where("end_ms > start_ms")
    words = cut(words.withColumn("word", F.struct("seg_id", "i")))
    labelled = cut(words.join(joins.best_speaker(words, r.turns(s, d), "word").select("word", F.col("speaker_id").alias("speaker")), "word"))
    return positions.fill_unknown_words(labelled, r.turns(s, d)).select("seg_id", "word_no", "start_ms", "end_ms", "speaker", "filled")


def speaker_first_seen_rank(s, d):
    from pyspark.sql import Window

    first = r.turns(s, d).groupBy("job_id", "speaker_id").agg(F.min(F.struct("start_ms", "end_ms", "speaker_id")).alias("k"))
    return first.select("job_id", "speaker_id", (F.dense_rank().over(Window.partitionBy("job_id").orderBy("k")) - 1).cast("long").alias("rank"))


def running_overlap_check(s, d):
    rows = positions.reach_before(r.turns(s, d), ["job_id"], ["start_ms", "turn_id"], "end_ms", BLOCK)
    return rows.where("reach > start_ms").select("turn_id", "reach")


def first_board_appearance(s, d):
    pairs = joins.overlap_pairs(r.segments(s, d).drop("text"), r.boards(s, d).drop("region").where("version_id is not null"), "job_id")
    best = pairs.groupBy("job_id", F.col("r_version_id").alias("version_id")).agg(F.min(F.struct("l_start_ms", "l_seg_id")).alias("k"))
    return best.select("job_id", "version_id", F.col("k.l_seg_id").alias("seg_id"))


def even_samples(s, d):
    rows = positions.even_samples(r.segments(s, d), ["job_id"], ["start_ms", "seg_id"], 5, BLOCK)
    return rows.select("job_id", "pos", "seg_id")


def context_window(s, d):
    rows = positions.with_context(r.segments(s, d), ["job_id"], ["start_ms", "seg_id"], F.col("text").contains("为什么") | F.col("text").contains("what happens"), 2, 2, BLOCK)
    return rows.select("seg_id", "pos")


def text_stays(s, d):
    """Runs of frames with text."""
    runs = collapse_runs(r.frames(s, d), ["job_id"], ["timestamp_ms"], 1_800_000, [], F.lit(True), ["timestamp_ms"], ["timestamp_ms"], F.col("has_text") == 1)
    return runs.select("job_id", F.col("first_timestamp_ms").alias("first_ms"), F.col("last_timestamp_ms").alias("last_ms"), "n")


def keyframe_pick(s, d):
    best = r.frames(s, d).where("sharpness is not null").groupBy("job_id").agg(F.max(F.struct("sharpness", (-F.col("timestamp_ms")).alias("t"))).alias("k"))
    return best.select("job_id", (-F.col("k.t")).alias("timestamp_ms"), F.col("k.sharpness").alias("sharpness"))


def frame_index_lookup(s, d):
    """The lowest timestamp of each frame index."""
    return r.frames(s, d).where("frame_index is not null").groupBy("job_id", "frame_index").agg(F.min("timestamp_ms").alias("timestamp_ms"))


def latest_frame(s, d):
    """Upsert: of rows with one key the last to arrive."""
    rows = table(s, d, "frames", "job_id", "timestamp_ms", "ingested_at")
    return rows.groupBy("job_id", "timestamp_ms").agg(F.max("ingested_at").cast("timestamp_ntz").alias("ingested_at"), F.count(F.lit(1)).alias("n"))


def region_median(s, d):
    mids = [F.bround(F.median(f"region.{c}")).cast("long").alias(c) for c in ("x", "y", "width", "height")]
    return r.boards(s, d).groupBy("job_id").agg(*mids)


def coarse_grid(s, d):
    grid = F.array_distinct(F.array_append(F.sequence(F.lit(0).cast("long"), F.col("duration_ms") - 1, F.lit(60_000).cast("long")), F.col("duration_ms") - 1))
    return table(s, d, "jobs", "job_id", "duration_ms").where("duration_ms > 0").distinct().select("job_id", F.explode(grid).alias("t"))


def bisect_intervals(s, d):
    """Recursive bisection: halves each recording until no piece is over 60 s, or 8 times."""
    open_, done = table(s, d, "jobs", "job_id", "duration_ms").where("duration_ms > 0").distinct().select("job_id", F.lit(0).cast("long").alias("a"), F.col("duration_ms").alias("b")), None
    for _ in range(8):
        mid = F.expr("(a + b) div 2")
        halves = F.when(F.col("b") - F.col("a") > 60_000, F.array(F.struct(F.col("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("b")))).otherwise(F.array(F.struct("a", "b")))
        open_ = open_.select("job_id", F.explode(halves).alias("h")).select("job_id", "h.a", "h.b")
    return open_


def representative_points(s, d):
    at = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.struct(k.cast("long").alias("k"), (F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * k / F.lit(6))).alias("t")))
    return r.boards(s, d).where("end_ms > start_ms").select("board_id", F.explode(at).alias("p")).select("board_id", "p.k", "p.t")


def speaker_stats(s, d):
    rows = r.speech(s, d).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("speaker") == "unknown").alias("n_unknown"), F.count_distinct("speaker").alias("n_speakers"))
    return rows.withColumn("unknown_ratio", F.col("n_unknown").cast("double") / F.col("n").cast("double"))


def dominant_cluster(s, d):
    """The speaker with the most segments; ties: who speaks first."""
    per = r.speech(s, d).where("speaker <> 'unknown'").groupBy("job_id", "speaker").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("start_ms", "speech_id")).alias("k"))
    best = per.groupBy("job_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "k", "speaker")).alias("b"))
    return best.select("job_id", F.col("b.speaker").alias("speaker"), (-F.col("b.n")).alias("n"))


def usable_words(s, d):
    """Words clamped to their segment, without invalid ones."""
    rows = table(s, d, "transcript_segments", "seg_id", "start_ms", "end_ms", "words").dropDuplicates(["seg_id"])
    clamp = F.transform("words", lambda w: F.struct(F.greatest(w["start_ms"], F.col("start_ms")).alias("a"), F.least(w["end_ms"], F.col("end_ms")).alias("b"), w["text"].alias("t")))
    good = F.filter(clamp, lambda w: (w["b"] > w["a"]) & (F.length(F.trim(w["t"])) > 0))
    return rows.where("size(words) > 0").select("seg_id", F.size(good).cast("long").alias("n_words"), F.array_join(F.transform(good, lambda w: w["t"]), "").alias("joined"))


QUERIES = {
    f.__name__: f
    for f in (
        align_max_overlap, overlap_by_speaker, interval_join_bucketed, timeline_merge, orphan_boards, nearest_turn, board_for_point, speaker_islands, unknown_run_inherit, word_runs_inherit, speaker_first_seen_rank,
        running_overlap_check, first_board_appearance, even_samples, context_window, text_stays, keyframe_pick, frame_index_lookup, latest_frame, region_median, coarse_grid, bisect_intervals,
        representative_points, speaker_stats, dominant_cluster, usable_words,
    )
}

_OVER = "l.job_id = r.job_id and l.start_ms < r.end_ms and r.start_ms < l.end_ms and l.start_ms < l.end_ms and r.start_ms < r.end_ms"
_MS = "least(l.end_ms, r.end_ms) - greatest(l.start_ms, r.start_ms)"
_SUMS = f"sums as (select l.seg_id, r.speaker_id, cast(sum({_MS}) as bigint) as overlap_ms from seg l join turn r on {_OVER} group by 1, 2)"
_ISLES = """isl as (select *, case when lag(speaker) over w is not distinct from speaker and row_number() over w > 1 then 0 else 1 end as f from sp
  window w as (partition by job_id order by start_ms, speech_id)),
g as (select *, sum(f) over (partition by job_id order by start_ms, speech_id rows unbounded preceding) as grp from isl),
runs as (select job_id, grp, min(speaker) as speaker, arg_min(speech_id, (start_ms, speech_id)) as first_speech_id, arg_max(speech_id, (start_ms, speech_id)) as last_speech_id,
  min(start_ms) as first_start, arg_max(end_ms, (start_ms, speech_id)) as last_end, count(*) as n from g group by 1, 2)"""

SQL = {
    k: r.SQL + v
    for k, v in {
        "align_max_overlap": f""", {_SUMS},
k as (select *, row_number() over (partition by seg_id order by overlap_ms desc, speaker_id) as rn, count(*) over (partition by seg_id, overlap_ms) as ties from sums),
b as (select seg.seg_id, greatest(1, end_ms - start_ms) as dur, speaker_id, overlap_ms, ties from seg left join k on k.seg_id = seg.seg_id and rn = 1),
m as (select *, coalesce(overlap_ms, 0) * 1.0::double / dur as ratio from b),
x as (select *, case when overlap_ms is null then 'no_overlap' when ties > 1 then 'equal_overlap' when ratio < 0.5 then 'below_threshold' else 'max_overlap' end as mm from m)
select seg_id, case when mm = 'max_overlap' then speaker_id else 'unknown' end as speaker_id, coalesce(overlap_ms, 0) as overlap_ms, ratio as match_ratio, mm as match_method from x""",
        "overlap_by_speaker": f", {_SUMS} select * from sums",
        "interval_join_bucketed": f" select l.seg_id, r.board_id, {_MS} as overlap_ms from seg l join board r on {_OVER}",
        "timeline_merge": f""" select l.seg_id, count(r.board_id) as n_boards, coalesce(string_agg(cast(r.board_id as varchar), ',' order by r.start_ms, r.board_id), '') as boards
from seg l left join board r on {_OVER} group by 1""",
        "orphan_boards": f" select board_id, job_id, start_ms, end_ms from board l where not exists (select 1 from seg r where {_OVER})",
        "nearest_turn": """, c as (select l.seg_id, r.speaker_id, r.start_ms, greatest(0, r.start_ms - l.end_ms, l.start_ms - r.end_ms) as d from seg l join turn r on l.job_id = r.job_id where l.end_ms > l.start_ms)
select seg_id, arg_min(speaker_id, (d, start_ms, speaker_id)) as speaker_id, min(d) as distance_ms from c group by 1""",
        "board_for_point": """, c as (select fr.job_id, timestamp_ms, board_id, start_ms, case when timestamp_ms >= start_ms and timestamp_ms < end_ms then 0 else 1 end as far, abs(timestamp_ms - start_ms) as d
  from fr join board on board.job_id = fr.job_id)
select job_id, timestamp_ms, arg_min(board_id, (far, case when far = 0 then 0 else d end, start_ms, board_id)) as board_id, min(far) = 0 as inside from c group by 1, 2""",
        "speaker_islands": f", {_ISLES} select job_id, speaker, first_speech_id, last_speech_id, n from runs",
        "unknown_run_inherit": f""", {_ISLES},
n as (select *, lag(speaker) over w as ls, lag(last_end) over w as le, lead(speaker) over w as rs, lead(first_start) over w as rb from runs window w as (partition by job_id order by grp))
select job_id, first_speech_id, speaker, case when speaker <> 'unknown' or last_end - first_start > 8000 then speaker
  when ls = rs and first_start - le <= 1000 and rb - last_end <= 1000 then ls
  when rs is null and ls is not null and first_start - le <= 250 then ls
  when ls is null and rs is not null and rb - last_end <= 250 then rs else speaker end as filled from n""",
        "speaker_first_seen_rank": """, k as (select job_id, speaker_id, min((start_ms, end_ms, speaker_id)) as k from turn group by 1, 2)
select job_id, speaker_id, dense_rank() over (partition by job_id order by k) - 1 as rank from k""",
        "running_overlap_check": """, k as (select turn_id, start_ms, max(end_ms) over (partition by job_id order by start_ms, turn_id rows between unbounded preceding and 1 preceding) as reach from turn)
select turn_id, reach from k where reach > start_ms""",
        "first_board_appearance": f" select l.job_id, r.version_id, arg_min(l.seg_id, (l.start_ms, l.seg_id)) as seg_id from seg l join board r on {_OVER} where r.version_id is not null group by 1, 2",
        "even_samples": """, k as (select job_id, seg_id, row_number() over (partition by job_id order by start_ms, seg_id) as pos, count(*) over (partition by job_id) as n from seg),
i as (select distinct job_id, case when n <= 5 then i + 1 else cast(round_even(i * (n - 1) / 4.0, 0) as bigint) + 1 end as pos from (select distinct job_id, n from k), range(5) as t(i) where n > 5 or i < n)
select job_id, pos, seg_id from k join i using (job_id, pos)""",
        "context_window": """, k as (select job_id, seg_id, row_number() over (partition by job_id order by start_ms, seg_id) as pos, contains(text, '为什么') or contains(text, 'what happens') as hit from seg),
c as (select seg_id, pos, max(cast(coalesce(hit, false) as int)) over (partition by job_id order by pos rows between 2 preceding and 2 following) as near from k)
select seg_id, pos from c where near = 1""",
        "text_stays": """, k as (select *, coalesce(has_text, 0) = 1 as live, row_number() over (partition by job_id order by timestamp_ms) as p from fr),
g as (select *, p - row_number() over (partition by job_id, live order by timestamp_ms) as grp from k)
select job_id, min(timestamp_ms) as first_ms, max(timestamp_ms) as last_ms, count(*) as n from g where live group by job_id, grp""",
        "keyframe_pick": " select job_id, arg_max(timestamp_ms, (sharpness, -timestamp_ms)) as timestamp_ms, max(sharpness) as sharpness from fr where sharpness is not null group by 1",
        "frame_index_lookup": " select job_id, frame_index, min(timestamp_ms) as timestamp_ms from fr where frame_index is not null group by 1, 2",
        "latest_frame": " select job_id, timestamp_ms, max(ingested_at) as ingested_at, count(*) as n from frames group by 1, 2",
        "region_median": """ select job_id, cast(round_even(median(region.x), 0) as bigint) as x, cast(round_even(median(region.y), 0) as bigint) as y,
cast(round_even(median(region.width), 0) as bigint) as width, cast(round_even(median(region.height), 0) as bigint) as height from board group by 1""",
        "coarse_grid": """ select distinct job_id, unnest(list_distinct(list_append(range(0, duration_ms, 60000), duration_ms - 1))) as t from (select distinct job_id, duration_ms from jobs where duration_ms > 0)""",
        "representative_points": " select board_id, k, start_ms + cast(floor((end_ms - start_ms) * k / 6.0) as bigint) as t from board, range(1, 6) as t(k) where end_ms > start_ms",
        "speaker_stats": " select job_id, count(*) as n, count(*) filter (speaker = 'unknown') as n_unknown, count(distinct speaker) as n_speakers, count(*) filter (speaker = 'unknown') * 1.0::double / count(*) as unknown_ratio from sp group by 1",
        "dominant_cluster": """, k as (select job_id, speaker, count(*) as n, min((start_ms, speech_id)) as k from sp where speaker <> 'unknown' group by 1, 2)
select job_id, arg_min(speaker, (-n, k, speaker)) as speaker, max(n) as n from k group by 1""",
    }.items()
} | {
    "bisect_intervals": """with recursive b as (select job_id, 0::bigint as a, duration_ms as b, 0 as depth from (select distinct job_id, duration_ms from jobs where duration_ms > 0)
union all select job_id, case when h = 0 then a else (a + b) // 2 end, case when h = 0 then (a + b) // 2 else b end, depth + 1 from b, range(2) as t(h) where b - a > 60000 and depth < 8)
select job_id, a, b from b where b - a <= 60000 or depth = 8""",
    "usable_words": """with w as (select distinct on (seg_id) seg_id, start_ms, end_ms, words from transcript_segments where len(words) > 0),
g as (select seg_id, list_filter(list_transform(words, lambda x: {'a': greatest(x.start_ms, start_ms), 'b': least(x.end_ms, end_ms), 't': x.text}), lambda x: x.b > x.a and length(trim(x.t)) > 0) as g from w)
select seg_id, len(g) as n_words, coalesce(array_to_string(list_transform(g, lambda x: x.t), ''), '') as joined from g""",
}
