"""Queries of sources, sinks, quality and sessions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import joins, quality
from lectern.plans import relations as r
from lectern.sources import payloads, sinks
from lectern.sources.tables import table
from lectern.streaming import turns as stream


def media_catalog(s, d):
    return payloads.media_catalog(table(s, d, "jobs", "source_path").distinct().withColumnRenamed("source_path", "path"))


def frame_lines(s, d):
    """Lines of each frame's recognised text."""
    rows = table(s, d, "frames", "job_id", "timestamp_ms", "ocr_lines_json").where("ocr_lines_json is not null").dropDuplicates(["job_id", "timestamp_ms"])
    rows = rows.select("job_id", "timestamp_ms", F.posexplode(F.from_json("ocr_lines_json", "array<struct<text string>>")).alias("line_no", "x"))
    return rows.select("job_id", "timestamp_ms", F.col("line_no").cast("long").alias("line_no"), "x.text")


def entry_markdown(s, d):
    return sinks.entry_markdown(r.entries(s, d))


def board_bodies(s, d):
    return sinks.board_bodies(table(s, d, "board_segments", "board_id", "text_lines").dropDuplicates(["board_id"]))


def segment_checks(s, d):
    return quality.segment_checks(r.segments(s, d), table(s, d, "jobs", "job_id", "duration_ms").dropDuplicates(["job_id"]))


def entry_checks(s, d):
    return quality.entry_checks(r.entries(s, d), r.evidence(s, d), r.course_segments(s, d).select(F.col("segment_id").alias("evidence_id")))


def clear_switches(s, d):
    """Segments in which at least two speakers hold 15 % each."""
    pairs = joins.overlap_pairs(r.segments(s, d).drop("text"), r.turns(s, d), "job_id")
    per = pairs.groupBy(F.col("l_seg_id").alias("seg_id"), "r_speaker_id", (F.col("l_end_ms") - F.col("l_start_ms")).alias("dur")).agg(F.sum("overlap_ms").alias("ms"))
    return per.where(F.col("ms") >= 0.15 * F.col("dur")).groupBy("seg_id").agg(F.count(F.lit(1)).alias("n_speakers")).where("n_speakers >= 2")


def resolved_confidence(s, d):
    """A segment's confidence: its own, else the match ratio; unknown speakers have 0.3 at most; clamped to 0..1.

    Inferred segments count 0.8 times; others, in which at least two speakers of one diarization hold 15 % each, 0.5 times.
    """
    speech = r.speech(s, d).drop("text")
    pairs = joins.overlap_pairs(speech.select("speech_id", "job_id", "start_ms", "end_ms"), r.turns(s, d), "job_id")
    per = pairs.groupBy(F.col("l_speech_id").alias("speech_id"), "r_source", "r_speaker_id", (F.col("l_end_ms") - F.col("l_start_ms")).alias("dur")).agg(F.sum("overlap_ms").alias("ms"))
    several = per.where(F.col("ms") >= 0.15 * F.col("dur")).groupBy("speech_id", "r_source").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("speech_id", F.lit(0.5).alias("scale")).distinct()
    inferred = F.coalesce("inferred", F.lit(False))
    value = F.coalesce("confidence", "match_ratio") * F.when(inferred, 0.8).otherwise(F.coalesce("scale", F.lit(1.0)))
    out = F.when(F.col("speaker") == "unknown", F.least(F.col("confidence"), F.when(F.col("confidence").isNotNull(), F.lit(0.3)))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
    return speech.join(several, "speech_id", "left").select("speech_id", F.when(F.col("speaker").eqNullSafe("unknown") | value.isNotNull(), out).alias("resolved"))


def segment_roles(s, d):
    """The speaker with the most segments of a job leads; others take part."""
    from lectern.plans.timeline import dominant_cluster

    lead = dominant_cluster(s, d).select("job_id", F.col("speaker").alias("lead"))
    role = F.when(F.col("speaker") == "unknown", "unknown").when(F.col("speaker") == F.col("lead"), "lead").otherwise("participant")
    return r.speech(s, d).join(lead, "job_id", "left").select("job_id", role.alias("role")).groupBy("job_id", "role").agg(F.count(F.lit(1)).alias("n"))


def turn_sessions(s, d):
    turns = r.turns(s, d).select("job_id", "speaker_id", F.timestamp_millis("start_ms").alias("start_ts"))
    return stream.sessions(turns).select("job_id", "speaker_id", F.unix_millis("start").alias("start_ms"), (F.unix_millis("end") - 30_000).alias("last_ms"), "n")


def course_delta(s, d):
    """Recordings and entries of each course, whichever side has it."""
    jobs = table(s, d, "jobs", "job_id", "course_id").distinct().groupBy("course_id").agg(F.count(F.lit(1)).alias("n_jobs"))
    own = r.entries(s, d).groupBy("course_id").agg(F.count(F.lit(1)).alias("n_entries"))
    out = jobs.join(own, "course_id", "full").fillna(0, ["n_jobs", "n_entries"])
    return out.withColumn("delta", F.col("n_entries") - F.col("n_jobs"))


def speaker_names(s, d):
    """Display names: a speaker's name where the job gives one, else the speaker."""
    rows = table(s, d, "speech_segments", "speech_id", "job_id", "speaker_id", "speaker_name").dropDuplicates(["speech_id"])
    named = rows.where("speaker_id is not null").groupBy("job_id", "speaker_id").agg(F.max(F.nullif(F.trim("speaker_name"), F.lit(""))).alias("name"))
    return named.select("job_id", "speaker_id", F.coalesce("name", "speaker_id").alias("shown"))


def repeated_keys(s, d):
    """Rows of each table that come with a key that was there before."""
    keys = {"transcript_segments": ["seg_id"], "speaker_turns": ["turn_id"], "speech_segments": ["speech_id"], "board_segments": ["board_id"], "frames": ["job_id", "timestamp_ms"], "knowledge_entries": ["id"]}
    out = None
    for name, key in keys.items():
        per = table(s, d, name, *key).groupBy(*key).agg(F.count(F.lit(1)).alias("k"))
        one = per.agg(F.lit(name).alias("tab"), F.sum("k").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("k") > 1).alias("n_repeated"))
        out = one if out is None else out.unionByName(one)
    return out


def pii_totals(s, d):
    from lectern.plans.texts import pii_counts

    return pii_counts(s, d).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("phones", "ids", "emails")])


def frame_stats(s, d):
    flags = {"n_text": F.col("has_text") == 1, "n_no_text": F.col("has_text") == 0, "n_open": F.col("has_text").isNull()}
    return r.frames(s, d).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()], F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"))


def payload_profile(s, d):
    """Segments and characters of each job, in all and of those that are cited."""
    cited = r.evidence(s, d).select(F.col("evidence_id").alias("segment_id"), F.lit(True).alias("hit")).distinct()
    rows = r.course_segments(s, d).join(cited, "segment_id", "left").withColumn("c", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    return rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_cited"), F.sum("c").alias("chars"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("c"))), F.lit(0)).cast("long").alias("chars_cited"))


def board_overlaps(s, d):
    """Each segment's share of time with a board on screen: covered milliseconds over its periods."""
    from lectern.operators.intervals import periods_and_gaps

    shown = periods_and_gaps(r.boards(s, d).select("job_id", "start_ms", "end_ms"), ["job_id"]).where("kind = 'period'")
    pairs = joins.overlap_pairs(r.segments(s, d).drop("text"), shown.drop("kind"), "job_id")
    return pairs.groupBy(F.col("l_seg_id").alias("seg_id")).agg(F.sum("overlap_ms").alias("covered_ms"))


def transcript_text(s, d):
    """Lines of the text export: each segment, and each board once, with the first segment it overlaps."""
    from lectern.functions.text import clock
    from lectern.plans.timeline import first_board_appearance

    said = r.segments(s, d).select("job_id", "start_ms", F.lit(0).alias("part"), F.col("seg_id").alias("seq"), F.concat(F.lit("["), clock(F.col("start_ms")), F.lit(" -> "), clock(F.col("end_ms")), F.lit("] "), F.coalesce("text", F.lit(""))).alias("line"))
    first = first_board_appearance(s, d).join(r.segments(s, d).select("seg_id", "start_ms"), "seg_id")
    shown = first.select("job_id", "start_ms", F.lit(1).alias("part"), F.col("seg_id").alias("seq"), F.concat(F.lit("[board] "), "version_id").alias("line"))
    return said.unionByName(shown)


QUERIES = {f.__name__: f for f in (media_catalog, frame_lines, entry_markdown, board_bodies, segment_checks, entry_checks, clear_switches, resolved_confidence, segment_roles, turn_sessions, course_delta, speaker_names, repeated_keys, pii_totals, frame_stats, payload_profile, board_overlaps, transcript_text)}

_CLOCK = lambda c, m: f"printf('%02d:%02d:%02d{m}%03d', greatest({c}, 0) // 3600000, greatest({c}, 0) // 60000 % 60, greatest({c}, 0) // 1000 % 60, greatest({c}, 0) % 1000)"

SQL = {
    k: r.SQL + v
    for k, v in {
        "entry_markdown": """ select id, '---' || chr(10) || 'id: ' || id || chr(10) || 'course_id: ' || coalesce(course_id, '') || chr(10) || 'case_id: ' || coalesce(case_id, '') || chr(10) || 'type: ' || coalesce(type, '') || chr(10) || '---'
|| chr(10) || chr(10) || '# ' || coalesce(title, '') || chr(10) || chr(10) || coalesce(body, '') as markdown from en""",
        "segment_checks": """, k as (select *, lag(end_ms) over (partition by job_id order by start_ms, seg_id) as pe from seg),
p as (select job_id, count(*) as n, count(*) filter (coalesce(trim(text), '') = '') as n_blank, count(*) filter (end_ms <= start_ms) as n_empty, count(*) filter (pe > start_ms) as n_overlap, min(start_ms) as a, max(end_ms) as b from k group by 1),
j as (select distinct job_id, duration_ms as dur from jobs),
c as (select job_id, n, n_blank, n_empty, n_overlap, n_blank = 0 as has_text, n_empty = 0 as durations, n_overlap = 0 as apart, a <= 60000 as early_start, dur is null or abs(dur - b) <= greatest(30000, cast(floor(dur * 0.02) as bigint)) as near_end from p left join j using (job_id))
select *, has_text and durations and apart and early_start and near_end as passed from c""",
        "entry_checks": """, p as (select course_id, count(*) as n, count(*) filter (coalesce(trim(title), '') = '') as n_untitled, count(*) filter (coalesce(trim(body), '') = '') as n_blank from en group by 1),
l as (select course_id, count(*) as n_lost from ev where evidence_id not in (select segment_id from cs) group by 1), z as (select course_id, count(distinct id) as n_citing from ev group by 1),
c as (select course_id, n, n_untitled, n_blank, coalesce(n_lost, 0) as n_lost, coalesce(n_citing, 0) as n_citing from p left join l using (course_id) left join z using (course_id)),
x as (select *, n_untitled = 0 as titled, n_blank = 0 as bodies, n_lost = 0 as evidence_exists, n_citing = n as all_cite from c) select *, titled and bodies and evidence_exists and all_cite as passed from x""",
        "clear_switches": """, o as (select l.seg_id, r.speaker_id, l.end_ms - l.start_ms as dur, sum(least(l.end_ms, r.end_ms) - greatest(l.start_ms, r.start_ms)) as ms from seg l join turn r
on l.job_id = r.job_id and l.start_ms < r.end_ms and r.start_ms < l.end_ms and l.start_ms < l.end_ms group by 1, 2, 3)
select seg_id, count(*) as n_speakers from o where ms >= 0.15 * dur group by 1 having count(*) >= 2""",
        "resolved_confidence": """, o as (select l.speech_id, r.source, r.speaker_id, l.end_ms - l.start_ms as dur, sum(least(l.end_ms, r.end_ms) - greatest(l.start_ms, r.start_ms)) as ms from sp l join turn r
 on l.job_id = r.job_id and l.start_ms < r.end_ms and r.start_ms < l.end_ms and l.start_ms < l.end_ms group by 1, 2, 3, 4),
v as (select distinct speech_id from (select speech_id, source from o where ms >= 0.15 * dur group by 1, 2 having count(*) >= 2)), i as (select distinct speech_id, inferred from speech_segments),
x as (select sp.*, coalesce(confidence, match_ratio) * case when coalesce(i.inferred, false) then 0.8::double when v.speech_id is not null then 0.5::double else 1 end as value from sp join i using (speech_id) left join v on v.speech_id = sp.speech_id)
select speech_id, case when speaker = 'unknown' then case when confidence is null then null else least(confidence, 0.3::double) end when value is null then null else greatest(0.0::double, least(1.0::double, value)) end as resolved from x""",
        "segment_roles": """, k as (select job_id, speaker, count(*) as n, min((start_ms, speech_id)) as k from sp where speaker <> 'unknown' group by 1, 2),
l as (select job_id, arg_min(speaker, (-n, k, speaker)) as lead from k group by 1)
select job_id, case when speaker = 'unknown' then 'unknown' when speaker = lead then 'lead' else 'participant' end as role, count(*) as n from sp left join l using (job_id) group by 1, 2""",
        "turn_sessions": """, k as (select *, case when start_ms - lag(start_ms) over w < 30000 then 0 else 1 end as f from turn window w as (partition by job_id, speaker_id order by start_ms, turn_id)),
g as (select *, sum(f) over (partition by job_id, speaker_id order by start_ms, turn_id rows unbounded preceding) as grp from k)
select job_id, speaker_id, min(start_ms) as start_ms, max(start_ms) as last_ms, count(*) as n from g group by job_id, speaker_id, grp""",
        "course_delta": """, a as (select course_id, count(*) as n_jobs from (select distinct job_id, course_id from jobs) group by 1), b as (select course_id, count(*) as n_entries from en group by 1)
select course_id, coalesce(n_jobs, 0) as n_jobs, coalesce(n_entries, 0) as n_entries, coalesce(n_entries, 0) - coalesce(n_jobs, 0) as delta from a full join b using (course_id)""",
        "frame_stats": """ select job_id, count(*) as n, count(*) filter (has_text = 1) as n_text, count(*) filter (has_text = 0) as n_no_text, count(*) filter (has_text is null) as n_open, min(timestamp_ms) as first_ms, max(timestamp_ms) as last_ms from fr group by 1""",
        "payload_profile": """, k as (select cs.*, segment_id in (select evidence_id from ev) as hit, length(coalesce(text, '')) as c from cs)
select job_id, count(*) as n, count(*) filter (hit) as n_cited, cast(sum(c) as bigint) as chars, cast(coalesce(sum(c) filter (hit), 0) as bigint) as chars_cited from k group by 1""",
        "board_overlaps": """, m as (select *, max(end_ms) over (partition by job_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as reach from board where start_ms < end_ms),
g as (select *, sum(case when reach is null or start_ms > reach then 1 else 0 end) over (partition by job_id order by start_ms, end_ms rows unbounded preceding) as grp from m),
p as (select job_id, min(start_ms) as start_ms, max(end_ms) as end_ms from g group by job_id, grp)
select l.seg_id, cast(sum(least(l.end_ms, r.end_ms) - greatest(l.start_ms, r.start_ms)) as bigint) as covered_ms from seg l join p r on l.job_id = r.job_id and l.start_ms < r.end_ms and r.start_ms < l.end_ms and l.start_ms < l.end_ms group by 1""",
        "transcript_text": """, f as (select l.job_id, r.version_id, arg_min(l.seg_id, (l.start_ms, l.seg_id)) as seg_id from seg l join board r on l.job_id = r.job_id and l.start_ms < r.end_ms and r.start_ms < l.end_ms and l.start_ms < l.end_ms and r.start_ms < r.end_ms
where r.version_id is not null group by 1, 2)
select job_id, start_ms, 0 as part, seg_id as seq, '[' || """ + _CLOCK("start_ms", ".") + """ || ' -> ' || """ + _CLOCK("end_ms", ".") + """ || '] ' || coalesce(text, '') as line from seg
union all select f.job_id, seg.start_ms, 1 as part, seg_id as seq, '[board] ' || version_id as line from f join seg using (seg_id)""",
    }.items()
} | {
    "speaker_names": """with k as (select distinct on (speech_id) speech_id, job_id, speaker_id, speaker_name from speech_segments)
select job_id, speaker_id, coalesce(max(nullif(trim(speaker_name), '')), speaker_id) as shown from k where speaker_id is not null group by 1, 2""",
    "repeated_keys": " union all ".join(
        f"select '{t}' as tab, cast(sum(k) as bigint) as n_rows, count(*) as n_keys, count(*) filter (k > 1) as n_repeated from (select count(*) as k from {t} group by {c})"
        for t, c in (("transcript_segments", "seg_id"), ("speaker_turns", "turn_id"), ("speech_segments", "speech_id"), ("board_segments", "board_id"), ("frames", "job_id, timestamp_ms"), ("knowledge_entries", "id"))
    ),
    "pii_totals": """with k as (select distinct seg_id, text, regexp_extract_all(text, '[0-9]+[Xx]?') as runs from transcript_segments)
select coalesce(cast(sum(len(list_filter(runs, lambda x: regexp_full_match(x, '1[3-9][0-9]{9}[Xx]?')))) as bigint), 0) as phones,
coalesce(cast(sum(len(list_filter(runs, lambda x: regexp_full_match(x, '[0-9]{17}[0-9Xx]') or regexp_full_match(x, '[0-9]{18}[Xx]')))) as bigint), 0) as ids,
coalesce(cast(sum(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))) as bigint), 0) as emails from k""",
    "media_catalog": """with k as (select distinct source_path as path, regexp_extract(source_path, '([^/\\\\]+)\\.[^./\\\\]+$', 1) as name, lower(regexp_extract(source_path, '\\.([^./\\\\]+)$', 1)) as suffix from jobs),
c as (select path, case when suffix in ('mp4', 'mov', 'mkv', 'avi', 'flv', 'wmv', 'm4v', 'webm') then 'video' when suffix = 'pdf' then 'pdf' end as kind, cast(nullif(regexp_extract(name, '([0-9]+)', 1), '') as bigint) as number,
trim(regexp_replace(regexp_replace(name, '\\[[0-9]+\\]|[0-9]+$', '', 'g'), '[_\\-.\\s]+', ' ', 'g')) as title from k) select * from c where kind is not null""",
    "frame_lines": """with k as (select distinct job_id, timestamp_ms, from_json(ocr_lines_json, '[{"text":"VARCHAR"}]') as x from frames where ocr_lines_json is not null)
select job_id, timestamp_ms, unnest(range(0, len(x))) as line_no, unnest(list_transform(x, lambda i: i.text)) as text from k""",
    "board_bodies": """with k as (select distinct on (board_id) board_id, list_filter(list_transform(text_lines, lambda x: trim(coalesce(x.corrected_text, x.text))), lambda t: t <> '') as g from board_segments)
select board_id, coalesce(len(g), 0) as n_lines, coalesce(array_to_string(g, chr(10)), '') as body from k""",
}
