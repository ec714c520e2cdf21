"""Queries of text rules, payload fields, positional comparison and contract checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import rules, text as t
from lectern.operators import lines, quality
from lectern.operators.ordered import running
from lectern.operators.positions import numbered
from lectern.plans import relations as r
from lectern.plans.texts import _placed, _ranges
from lectern.sources import payloads
from lectern.sources.tables import table


def rule_rewrites(s, d):
    clean, notes = rules.rewritten(F.col("text"))
    return r.segments(s, d).where("text is not null").select("seg_id", clean.alias("clean"), F.array_join(notes, ",").alias("notes"))


def rewrite_metrics(s, d):
    """How many segments of each job the rules change, by kind, and how many hold an ambiguous repeat."""
    clean, notes = rules.rewritten(F.col("text"))
    rows = r.segments(s, d).where("text is not null").select("job_id", (clean != F.col("text")).alias("changed"), notes.alias("notes"), F.col("text").rlike(rules.AMBIGUOUS).alias("open"))
    kinds = {"n_disfluency": rules.DISFLUENCY, "n_typo": rules.TYPO, "n_punctuation": rules.PUNCTUATION}
    return rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("n_changed"), *[F.count_if(F.array_contains("notes", k)).alias(c) for c, k in kinds.items()], F.count_if("open").alias("n_ambiguous"))


def label_speakers(s, d):
    rows = lines.transcript_blocks(table(s, d, "documents", "doc_id", "text", "source").where("source = 'transcript_export'"))
    return rows.select("doc_id", F.col("block").cast("long").alias("block"), rules.label_speaker(F.col("label")).alias("speaker"), rules.label_type(F.col("label")).alias("content_type"))


def payload_confidences(s, d):
    """Confidences read back from payloads that keep them in three ways."""
    rows = table(s, d, "transcript_segments", "seg_id", "confidence").dropDuplicates(["seg_id"]).where("confidence is not null and not isnan(confidence)")
    c = F.col("confidence")
    payload = F.when(F.col("seg_id") % 3 == 0, F.to_json(F.struct(c.alias("confidence")))).when(F.col("seg_id") % 3 == 1, F.to_json(F.struct(F.lit("?").alias("confidence"), (c * 100).alias("score")))).otherwise(F.to_json(F.struct(F.lit(-1.0).alias("score"), c.alias("confidence_score"))))
    return rows.select("seg_id", F.round(rules.payload_confidence(payload), 9).alias("confidence"))


def fenced_objects(s, d):
    """Regions read from a fenced payload with words about it."""
    rows = table(s, d, "frames", "job_id", "timestamp_ms", "content_region_json").where("content_region_json is not null").dropDuplicates(["job_id", "timestamp_ms"])
    one = F.from_json(rules.fenced_object(F.concat(F.lit("Here:\n```json\n"), "content_region_json", F.lit("\n```\nDone."))), "x long, y long, width long, height long")
    return rows.select("job_id", "timestamp_ms", one.alias("q")).select("job_id", "timestamp_ms", "q.*")


def secret_free(s, d):
    return table(s, d, "courses", "course_id", "title").select("course_id", rules.without_bearer(F.concat(F.lit("Authorization: Bearer key-"), "course_id", F.lit(", "), F.coalesce("title", F.lit("")))).alias("line"))


def entry_files(s, d):
    return r.entries(s, d).select("id", F.concat(rules.file_name(F.col("id")), F.lit(".md")).alias("file"), rules.file_name(F.coalesce("title", F.lit(""))).alias("by_title"))


def joined_words(s, d):
    """The text of each segment's words, usable and in order of time."""
    rows = table(s, d, "transcript_segments", "seg_id", "start_ms", "end_ms", "words").dropDuplicates(["seg_id"]).where("size(words) > 0")
    clamp = F.transform("words", lambda w: F.struct(F.greatest(w["start_ms"], F.col("start_ms")).alias("a"), F.least(w["end_ms"], F.col("end_ms")).alias("b"), w["text"].alias("t")))
    good = F.array_sort(F.filter(clamp, lambda w: (w["b"] > w["a"]) & (F.length(w["t"]) > 0)))
    return rows.select("seg_id", F.size(good).cast("long").alias("n_words"), rules.joined_words(F.transform(good, lambda w: w["t"])).alias("joined"))


def metric_texts(s, d):
    return r.segments(s, d).where("text is not null").select("seg_id", rules.metric_text(F.col("text")).alias("tight"), rules.metric_text(F.col("text"), True).alias("spaced"))


def line_accuracy(s, d):
    """1 less the character error rate of each corrected line, from 0 to 1."""
    rows = table(s, d, "board_segments", "board_id", "text_lines").dropDuplicates(["board_id"]).select("board_id", F.posexplode("text_lines").alias("line_no", "x")).where("x.corrected_text is not null and x.text is not null")
    rate = t.error_rate(F.col("x.corrected_text"), F.col("x.text"))
    return rows.select("board_id", F.col("line_no").cast("long").alias("line_no"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - rate)).alias("accuracy"))


def combined_lines(s, d):
    """Lines of each board without near repeats, the surer reading of each."""
    return lines.combined_lines(table(s, d, "board_segments", "board_id", "text_lines").dropDuplicates(["board_id"]))


def short_times(s, d):
    return r.segments(s, d).select("seg_id", F.substring_index(t.clock(F.col("start_ms")), ".", 1).alias("at"), F.bround(F.col("start_ms") / 1000.0 * 1000).cast("long").alias("ms"))


def cache_keys(s, d):
    """Keys of results by what went in: hash of the canonical JSON of input, prompt, model and stage; and of a source's path, length and time."""
    rows = table(s, d, "jobs", "job_id", "source_path", "duration_ms", "updated_at", "status").dropDuplicates(["job_id"])
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    canonical = F.concat(F.lit('{"input":'), q(F.col("source_path")), F.lit(',"model":'), q(F.lit("m1")), F.lit(',"prompt":'), q(F.lit("p1")), F.lit(',"stage":'), q(F.col("status")), F.lit("}"))
    source = F.concat_ws("|", F.coalesce("source_path", F.lit("")), F.coalesce(F.col("duration_ms").cast("string"), F.lit("")), F.unix_seconds(F.col("updated_at").cast("timestamp")).cast("string"))
    return rows.select("job_id", F.sha2(canonical, 256).alias("cache_key"), F.substring(F.sha2(source, 256), 1, 20).alias("source_key"))


def unique_evidence(s, d):
    """Cited segments of each entry once each, in the order of their first citation."""
    ids = F.array_distinct(F.from_json("evidence_json", "array<string>"))
    return r.entries(s, d).where("evidence_json is not null").select("id", F.size(ids).cast("long").alias("n"), F.array_join(ids, ",").alias("ids"))


def asr_round_trip(s, d):
    """Segments written as a recogniser's raw sentences and read back; texts without letters or digits are left out."""
    rows = r.segments(s, d).where("text is not null")
    info = F.array(F.struct("text", F.col("start_ms").alias("start"), F.col("end_ms").alias("end")))
    raw = rows.select(F.concat_ws("/", "job_id", "seg_id").alias("job_id"), F.to_json(F.array(F.struct(info.alias("sentence_info")))).alias("raw"))
    return payloads.transcripts(raw).select(F.col("job_id").alias("source"), "start_ms", "end_ms", "text")


def diarization_round_trip(s, d):
    """Turns written as a diarizer's raw rows in seconds and read back, speakers renumbered by first appearance; noise is left out."""
    rows = table(s, d, "speaker_turns", "turn_id", "job_id", "start_ms", "end_ms", "speaker_id", "source").dropDuplicates(["turn_id"]).where("source = 'wespeaker'")
    label = F.when(F.col("speaker_id") == "unknown", "-1").otherwise(F.col("speaker_id"))
    return payloads.diarization(rows.select("job_id", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), label.alias("label")))


def frame_rates(s, d):
    rows = table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").distinct()
    text = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("/"), (F.col("l_linenumber") - 1).cast("string"))
    return rows.select("l_orderkey", "l_linenumber", F.col("l_quantity"), F.round(payloads.frame_rate(text), 9).alias("fps"))


def video_paths(s, d):
    """Whether each recording's file can be taken, and the first reason why not: kind of file, length, more than eight hours."""
    rows = table(s, d, "jobs", "job_id", "source_path", "duration_ms").dropDuplicates(["job_id"])
    suffix = F.lower(F.regexp_extract("source_path", r"(\.[^./\\]+)$", 1))
    reason = F.when(F.col("source_path").isNull() | ~suffix.isin(".mp4", ".mkv", ".mov", ".avi", ".webm"), "suffix").when(F.col("duration_ms").isNull() | (F.col("duration_ms") <= 0), "empty").when(F.col("duration_ms") > 28_800_000, "too_long").otherwise("ok")
    return rows.select("job_id", suffix.alias("suffix"), reason.alias("reason"))


def source_ids(s, d):
    """Recordings with a number in their name are C001 ...; others are VIDEO001 ... by name. Numbers come from the name's last digits here."""
    rows = table(s, d, "jobs", "job_id", "source_path").dropDuplicates(["job_id"]).where("source_path is not null")
    name = F.regexp_extract("source_path", r"([^/\\]+)$", 1)
    n = F.regexp_extract(name, r"([0-9]+)\.[^.]+$", 1)
    rows = rows.select("job_id", F.lower(name).alias("name"), F.when(F.length(n) > 1, n.cast("long")).alias("number"))
    rest = numbered(rows.where("number is null").withColumn("one", F.lit(1)).withColumn("zero", F.lit(0)), ["one"], ["zero", "name", "job_id"], 1).select("job_id", F.concat(F.lit("VIDEO"), F.lpad(F.col("pos").cast("string"), 3, "0")).alias("source_id"))
    own = rows.where("number is not null").select("job_id", F.format_string("C%03d", "number").alias("source_id"))
    return own.unionByName(rest)


def _zipped(s, d):
    """Transcript and speech segments of a job at one position, by start."""
    said = numbered(table(s, d, "speech_segments", "speech_id", "job_id", "start_ms", "end_ms", "text", "speaker_id").dropDuplicates(["speech_id"]), ["job_id"], ["start_ms", "speech_id"], 900_000)
    heard = numbered(r.segments(s, d), ["job_id"], ["start_ms", "seg_id"], 900_000)
    names = {"start_ms": "a", "end_ms": "b", "text": "x"}
    left = heard.select("job_id", "pos", "seg_id", *[F.col(c).alias(f"l{k}") for c, k in names.items()])
    right = said.select("job_id", "pos", "speech_id", "speaker_id", *[F.col(c).alias(f"r{k}") for c, k in names.items()])
    return left.join(right, ["job_id", "pos"])


def positional_zip(s, d):
    """Both at one position, over the shorter of the two, and whether they tell the same."""
    return _zipped(s, d).select("seg_id", "speech_id", "pos", F.col("lx").eqNullSafe(F.col("rx")).alias("same_text"), ((F.col("la") == F.col("ra")) & (F.col("lb") == F.col("rb"))).alias("same_times"))


def preserved_checks(s, d):
    """Each job's speech against its transcript, position by position: counts, ids, texts, times, speakers."""
    heard = r.segments(s, d).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_in"))
    said = table(s, d, "speech_segments", "speech_id", "job_id").dropDuplicates(["speech_id"]).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_out"))
    both = _zipped(s, d).groupBy("job_id").agg(
        F.count_if(~F.col("lx").eqNullSafe(F.col("rx"))).alias("n_text"), F.count_if((F.col("la") != F.col("ra")) | (F.col("lb") != F.col("rb"))).alias("n_times"),
        F.count_if(F.coalesce(F.trim("rx"), F.lit("")) == "").alias("n_blank"), F.count_if(F.col("speaker_id").isNull()).alias("n_speakerless"),
    )
    per = heard.join(said, "job_id").join(both, "job_id", "left").fillna(0)
    return quality.verdict(per, {"segment_count": F.col("n_in") == F.col("n_out"), "text_preserved": F.col("n_text") == 0, "timestamps_preserved": F.col("n_times") == 0, "text_non_empty": F.col("n_blank") == 0, "speaker_contract": F.col("n_speakerless") == 0})


def case_checks(s, d):
    """Cases of each job as closed ranges of positions: boundaries, overlap with any case before, and what is covered, missing or assigned twice."""
    ranges = _ranges(s, d)
    rows = running(_blocks(ranges.withColumn("k", F.struct("a", "b", "case_id"))), ["job_id"], ["a", "b", "case_id"], F.col("b"), "reach", "max")
    from lectern.operators.ordered import with_neighbor

    rows = with_neighbor(rows, ["job_id"], ["a", "b", "case_id"], ["reach"], "p")
    per = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(F.col("p.reach") >= F.col("a")).alias("n_overlapping"), F.sum(F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a") - 1, F.coalesce("p.reach", F.lit(0))))).cast("long").alias("n_covered"))
    sizes = _placed(s, d).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_segments"))
    per = sizes.join(per, "job_id", "left").fillna(0).withColumn("n_missing", F.col("n_segments") - F.col("n_covered"))
    return quality.verdict(per, {"has_cases": F.col("n_cases") > 0, "cases_do_not_overlap": F.col("n_overlapping") == 0, "complete_coverage": F.col("n_missing") == 0})


def _blocks(ranges):
    from lectern.operators.ordered import blocked

    return blocked(ranges, ["job_id"], "a", 4096)


def case_segments(s, d):
    """The segments of each case: those at the positions of its closed range."""
    from lectern.operators.joins import overlap_pairs

    spans = _ranges(s, d).select("job_id", "case_id", F.col("a").alias("start_ms"), (F.col("b") + 1).alias("end_ms"))
    points = _placed(s, d).select("job_id", "seg_id", F.col("pos").alias("start_ms"), (F.col("pos") + 1).alias("end_ms"))
    return overlap_pairs(points, spans, "job_id", 256).select("job_id", F.col("r_case_id").alias("case_id"), F.col("l_seg_id").alias("seg_id"))


def review_targets(s, d):
    """Cases that name a risk but no response, and the other way round."""
    rows = r.entries(s, d).where("case_id is not null").select("course_id", "case_id", "type").distinct()
    a, b = (rows.where(F.col("type") == k).select("course_id", "case_id") for k in ("risk", "response"))
    keys = ["course_id", "case_id"]
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("no_response")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("no_risk")))


def missing_samples(s, d):
    """The first twenty lost citations of each course, as a report shows them."""
    have = r.course_segments(s, d).select(F.col("segment_id").alias("evidence_id"))
    lost = r.evidence(s, d).join(have, "evidence_id", "left_anti")
    first = Window.partitionBy("course_id").orderBy("id", "evidence_id")
    return lost.withColumn("rank", F.row_number().over(first).cast("long")).where("rank <= 20").select("course_id", "rank", "id", "evidence_id")


def order_checks(s, d):
    """Whether an order's line numbers are 1 to n, each once."""
    rows = table(s, d, "lineitem", "l_orderkey", "l_linenumber").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_linenumber").alias("n_distinct"), F.min("l_linenumber").alias("low"), F.max("l_linenumber").alias("high"))
    return rows.select("l_orderkey", ((F.col("n") == F.col("n_distinct")) & (F.col("low") == 1) & (F.col("high") == F.col("n"))).alias("ordered"))


QUERIES = {
    f.__name__: f
    for f in (
        rule_rewrites, rewrite_metrics, label_speakers, payload_confidences, fenced_objects, secret_free, entry_files, joined_words, metric_texts, line_accuracy, combined_lines, short_times, cache_keys, unique_evidence, asr_round_trip,
        diarization_round_trip, frame_rates, video_paths, source_ids, positional_zip, preserved_checks, case_checks, case_segments, review_targets, missing_samples, order_checks,
    )
}


def _folded(column: str) -> tuple[str, dict[str, str]]:
    """The rewrites as columns of CTEs: one step for each rule, with what it noted."""
    notes: dict[str, list[str]] = {rules.DISFLUENCY: [], rules.TYPO: []}
    steps = [f"s0 as (select seg_id, job_id, text, {column} as t0 from seg where text is not null)"]
    for k, (p, to) in enumerate(rules.REWRITES):
        steps.append(f"s{k + 1} as (select *, regexp_replace(t{k}, '{p}', '{to}', 'g') as t{k + 1} from s{k})")
        notes[rules.TYPO if p in rules.TYPOS else rules.DISFLUENCY].append(f"regexp_matches(t{k}, '{p}')")
    return ",\n".join(steps), {k: " or ".join(v) for k, v in notes.items()}


_STEPS, _NOTES = _folded("text")
_N = len(rules.REWRITES)
_MARKS = f"regexp_replace(translate(t{_N}, ',?!', '，？！'), '\\.$', '。')"
for _c in "，。！？、；：":
    _MARKS = f"regexp_replace({_MARKS}, '{_c}+', '{_c}', 'g')"
_RULED = f"""{_STEPS}, ruled as (select *, {_MARKS} as clean, {_NOTES[rules.DISFLUENCY]} as d, {_NOTES[rules.TYPO]} as y from s{_N})"""
_ZIP = """, h as (select *, row_number() over (partition by job_id order by start_ms, seg_id) as pos from seg), q as (select distinct on (speech_id) * from speech_segments),
w as (select *, row_number() over (partition by job_id order by start_ms, speech_id) as pos from q),
z as (select h.job_id, h.pos, seg_id, speech_id, speaker_id, h.text as lx, w.text as rx, h.start_ms as la, w.start_ms as ra, h.end_ms as lb, w.end_ms as rb from h join w on h.job_id = w.job_id and h.pos = w.pos)"""
_RG = """, pl as (select segment_id as evidence_id, job_id, seg_id, row_number() over (partition by job_id order by start_ms, seg_id) as pos from cs),
rg as (select job_id, case_id, min(pos) as a, max(pos) as b from ev join pl using (evidence_id) group by 1, 2)"""

SQL = {
    k: r.SQL + v
    for k, v in {
        "rule_rewrites": f", {_RULED} select seg_id, clean, concat_ws(',', case when d then '{rules.DISFLUENCY}' end, case when y then '{rules.TYPO}' end, case when clean <> t{_N} then '{rules.PUNCTUATION}' end) as notes from ruled",
        "rewrite_metrics": f""", {_RULED} select job_id, count(*) as n, count(*) filter (clean <> text) as n_changed, count(*) filter (d) as n_disfluency, count(*) filter (y) as n_typo, count(*) filter (clean <> t{_N}) as n_punctuation,
count(*) filter (regexp_matches(text, '{rules.AMBIGUOUS}')) as n_ambiguous from ruled group by 1""",
        "entry_files": " select id, coalesce(nullif(trim(regexp_replace(id, '[^0-9A-Za-z._-]+', '_', 'g'), '_'), ''), 'entry') || '.md' as file, coalesce(nullif(trim(regexp_replace(coalesce(title, ''), '[^0-9A-Za-z._-]+', '_', 'g'), '_'), ''), 'entry') as by_title from en",
        "metric_texts": " select seg_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') as tight, trim(regexp_replace(lower(text), '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g')) as spaced from seg where text is not null",
        "short_times": " select seg_id, printf('%02d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) as at, start_ms as ms from seg",
        "unique_evidence": """, k as (select id, from_json(evidence_json, '["VARCHAR"]') as x from en where evidence_json is not null), u as (select id, list_filter(x, lambda e, i: list_position(x, e) = i) as x from k)
select id, len(x) as n, array_to_string(x, ',') as ids from u""",
        "asr_round_trip": " select job_id || '/' || seg_id as source, start_ms, end_ms, trim(text) as text from seg where text is not null and regexp_matches(text, '[\\p{L}\\p{N}_]') and start_ms >= 0 and end_ms > start_ms and job_id is not null",
        "positional_zip": f"{_ZIP} select seg_id, speech_id, pos, lx is not distinct from rx as same_text, la = ra and lb = rb as same_times from z",
        "preserved_checks": f"""{_ZIP}, a as (select job_id, count(*) as n_in from seg group by 1), b as (select job_id, count(*) as n_out from q group by 1),
c as (select job_id, count(*) filter (lx is distinct from rx) as n_text, count(*) filter (la <> ra or lb <> rb) as n_times, count(*) filter (coalesce(trim(rx), '') = '') as n_blank, count(*) filter (speaker_id is null) as n_speakerless from z group by 1),
x as (select *, n_in = n_out as segment_count, n_text = 0 as text_preserved, n_times = 0 as timestamps_preserved, n_blank = 0 as text_non_empty, n_speakerless = 0 as speaker_contract from a join b using (job_id) join c using (job_id))
select *, segment_count and text_preserved and timestamps_preserved and text_non_empty and speaker_contract as passed from x""",
        "case_checks": f"""{_RG}, m as (select *, max(b) over (partition by job_id order by a, b, case_id rows between unbounded preceding and 1 preceding) as reach from rg),
c as (select job_id, count(*) as n_cases, count(*) filter (reach >= a) as n_overlapping from m group by 1),
v as (select pl.job_id, count(distinct seg_id) as n_covered from pl join rg on pl.job_id = rg.job_id and pos between a and b group by 1),
n as (select job_id, count(*) as n_segments from pl group by 1),
x as (select job_id, n_segments, coalesce(n_cases, 0) as n_cases, coalesce(n_overlapping, 0) as n_overlapping, coalesce(n_covered, 0) as n_covered from n left join c using (job_id) left join v using (job_id)),
y as (select *, n_segments - n_covered as n_missing from x), w as (select *, n_cases > 0 as has_cases, n_overlapping = 0 as cases_do_not_overlap, n_missing = 0 as complete_coverage from y)
select *, has_cases and cases_do_not_overlap and complete_coverage as passed from w""",
        "case_segments": f"{_RG} select pl.job_id, case_id, seg_id from pl join rg on pl.job_id = rg.job_id and pos between a and b",
        "review_targets": """, k as (select distinct course_id, case_id, type from en where case_id is not null), a as (select course_id, case_id from k where type = 'risk'), b as (select course_id, case_id from k where type = 'response')
select *, 'no_response' as side from (select * from a except select * from b) union all select *, 'no_risk' as side from (select * from b except select * from a)""",
        "missing_samples": """, l as (select * from ev where not exists (select 1 from cs where segment_id = evidence_id)), k as (select *, row_number() over (partition by course_id order by id, evidence_id) as rank from l)
select course_id, rank, id, evidence_id from k where rank <= 20""",
    }.items()
} | {
    "label_speakers": """with b as (select doc_id, unnest(str_split(text, chr(10) || chr(10))) as raw, generate_subscripts(str_split(text, chr(10) || chr(10)), 1) - 1 as block from documents where source = 'transcript_export'),
k as (select doc_id, block, regexp_extract(raw, '^\\[[0-9]{2,}:[0-9]{2}:[0-9]{2}\\.[0-9]{3} -> [0-9]{2,}:[0-9]{2}:[0-9]{2}\\.[0-9]{3}\\] ([^\\n]*)\\n', 1) as l from b where regexp_matches(raw, '^\\[[0-9]{2,}:[0-9]{2}:[0-9]{2}\\.[0-9]{3} -> [0-9]{2,}:[0-9]{2}:[0-9]{2}\\.[0-9]{3}\\] [^\\n]*\\n'))
select doc_id, block, case when l like '课板%' then 'unknown' when regexp_full_match(l, '(?i)Speaker\\s+[0-9]+') then 'speaker_' || regexp_extract(l, '([0-9]+)$', 1) when l = '导师' then 'teacher_a' when l = '学员' then 'student' else 'unknown' end as speaker,
case when l like '课板%' then 'board_ocr' else 'speech' end as content_type from k""",
    "payload_confidences": "select distinct seg_id, round(confidence, 9) as confidence from transcript_segments where confidence is not null and not isnan(confidence)",
    "fenced_objects": """with k as (select distinct job_id, timestamp_ms, from_json(content_region_json, '{"x":"BIGINT","y":"BIGINT","width":"BIGINT","height":"BIGINT"}') as q from frames where content_region_json is not null)
select job_id, timestamp_ms, q.x as x, q.y as y, q.width as width, q.height as height from k""",
    "secret_free": "select course_id, 'Authorization: Bearer [REDACTED], ' || coalesce(title, '') as line from courses",
    "joined_words": """with w as (select distinct on (seg_id) seg_id, start_ms, end_ms, words from transcript_segments where len(words) > 0),
g as (select seg_id, list_transform(list_sort(list_filter(list_transform(words, lambda x: {'a': greatest(x.start_ms, start_ms), 'b': least(x.end_ms, end_ms), 't': x.text}), lambda x: x.b > x.a and length(x.t) > 0)), lambda x: x.t) as g from w)
select seg_id, len(g) as n_words, case when (len(list_filter(g, lambda t: contains(t, ' '))) > 0 or len(list_filter(g, lambda t: length(t) <= 1)) = 0) and len(list_filter(g, lambda t: not regexp_matches(t, '[一-鿿]'))) > 0 then array_to_string(g, ' ') else coalesce(array_to_string(g, ''), '') end as joined from g""",
    "cache_keys": """with k as (select distinct on (job_id) * from jobs), e as (select *, '"' || replace(replace(coalesce(source_path, ''), '\\', '\\\\'), '"', '\\"') || '"' as p, '"' || coalesce(status, '') || '"' as t from k)
select job_id, sha256('{"input":' || p || ',"model":"m1","prompt":"p1","stage":' || t || '}') as cache_key, substr(sha256(coalesce(source_path, '') || '|' || coalesce(cast(duration_ms as varchar), '') || '|' || cast(epoch_ms(updated_at) // 1000 as varchar)), 1, 20) as source_key from e""",
    "diarization_round_trip": """with t as (select distinct turn_id, job_id, start_ms, end_ms, speaker_id from speaker_turns where source = 'wespeaker' and end_ms > start_ms and start_ms >= 0 and speaker_id is not null and speaker_id <> 'unknown' and job_id is not null),
k as (select job_id, speaker_id, min((start_ms, end_ms, speaker_id)) as k from t group by 1, 2), n as (select job_id, speaker_id, 'speaker_' || (dense_rank() over (partition by job_id order by k) - 1) as s from k)
select t.job_id, start_ms, end_ms, s as speaker_id from t join n using (job_id, speaker_id)""",
    "frame_rates": "select distinct l_orderkey, l_linenumber, l_quantity, case when l_linenumber = 1 then 0.0::double else round(floor(l_quantity) * 1.0::double / (l_linenumber - 1), 9) end as fps from lineitem",
    "video_paths": """with k as (select distinct on (job_id) job_id, source_path, duration_ms, lower(regexp_extract(source_path, '(\\.[^./\\\\]+)$', 1)) as suffix from jobs)
select job_id, suffix, case when source_path is null or suffix not in ('.mp4', '.mkv', '.mov', '.avi', '.webm') then 'suffix' when duration_ms is null or duration_ms <= 0 then 'empty' when duration_ms > 28800000 then 'too_long' else 'ok' end as reason from k""",
    "source_ids": """with k as (select distinct on (job_id) job_id, regexp_extract(source_path, '([^/\\\\]+)$', 1) as name from jobs where source_path is not null), n as (select *, regexp_extract(name, '([0-9]+)\\.[^.]+$', 1) as d from k)
select job_id, printf('C%03d', cast(d as bigint)) as source_id from n where length(d) > 1
union all select job_id, 'VIDEO' || lpad(cast(row_number() over (order by lower(name), job_id) as varchar), 3, '0') as source_id from n where length(d) <= 1""",
    "order_checks": "select l_orderkey, count(*) = count(distinct l_linenumber) and min(l_linenumber) = 1 and max(l_linenumber) = count(*) as ordered from lineitem group by 1",
}
