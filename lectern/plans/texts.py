"""Queries of the text, evidence, retrieval and evaluation operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.operators import lines, retrieval, scoring
from lectern.operators.ordered import blocked, running_sum, with_neighbor
from lectern.operators.positions import numbered, with_context
from lectern.plans import relations as r
from lectern.sources.tables import table


def text_keys(s, d):
    return r.segments(s, d).select("seg_id", t.text_key(F.col("text")).alias("key"), t.content_chars(F.col("text")).alias("n"))


def format_timestamps(s, d):
    return r.segments(s, d).select("seg_id", t.clock(F.col("start_ms")).alias("at"), t.clock(F.col("end_ms"), ",").alias("until"))


def character_error_rate(s, d):
    """Of all segments that have both texts."""
    rows = table(s, d, "transcript_segments", "seg_id", "text", "raw_text").dropDuplicates(["seg_id"]).where("raw_text is not null and text is not null")
    return rows.select("seg_id", t.error_rate(F.col("raw_text"), F.col("text")).alias("cer"))


def pii_counts(s, d):
    rows = r.segments(s, d).select("seg_id", *[F.regexp_count("text", F.lit(p)).cast("long").alias(n) for n, p in (("phones", t.PHONE), ("ids", t.IDENTITY), ("emails", t.EMAIL))])
    return rows.where("phones + ids + emails > 0")


def pii_redact(s, d):
    return r.segments(s, d).where("text is not null").select("seg_id", t.redact_patterns(F.col("text")).alias("clean"))


def punctuation_rules(s, d):
    return r.segments(s, d).where("text is not null").select("seg_id", t.full_width_marks(F.col("text")).alias("marked"))


def safe_names(s, d):
    return table(s, d, "courses", "course_id", "title").select("course_id", t.safe_name(F.col("title")).alias("name"))


def query_ngrams(s, d):
    return table(s, d, "courses", "course_id", "title").select("course_id", F.explode(t.query_grams(F.col("title"))).alias("token"))


def speaker_spellings(s, d):
    rows = table(s, d, "speech_segments", "speech_id", "speaker_id").dropDuplicates(["speech_id"])
    n = F.regexp_extract(F.lower(F.trim("speaker_id")), r"^\[?(?:speaker|spk|s)[ _-]?([0-9]+)\]?:?$", 1)
    return rows.select("speech_id", F.when(n == "", None).otherwise(F.concat(F.lit("speaker_"), n.cast("int"))).alias("speaker"))


def first_lines(s, d):
    return lines.first_lines(lines.doc_lines(table(s, d, "documents", "doc_id", "text"))).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "n")


def transcript_blocks(s, d):
    rows = lines.transcript_blocks(table(s, d, "documents", "doc_id", "text", "source").where("source = 'transcript_export'"))
    return rows.select("doc_id", F.col("block").cast("long").alias("block"), t.clock_ms(F.col("start")).alias("start_ms"), t.clock_ms(F.col("end")).alias("end_ms"), "label", F.length("body").cast("long").alias("n_chars"))


def transcript_metrics(s, d):
    docs = table(s, d, "documents", "doc_id", "text").where("text is not null")
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.regexp_count("text", F.lit(lines.STAMP)).cast("long").alias("n_stamps"))


def srt_cues(s, d):
    return lines.srt_cues(r.speech(s, d))


def duplicate_sources(s, d):
    """Documents of one length are hashed, others aren't; the smallest doc_id is the original."""
    docs = table(s, d, "documents", "doc_id", "text").where("text is not null").withColumn("size", F.octet_length("text"))
    shared = docs.groupBy("size").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("size")
    hashed = docs.join(shared, "size").select("doc_id", F.sha2("text", 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min("doc_id").alias("original"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return hashed.join(first, "h").where("doc_id <> original").select("doc_id", "original")


def content_hashes(s, d):
    return table(s, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"))


def evidence_missing(s, d):
    """Cited segments that don't exist."""
    have = r.course_segments(s, d).select(F.col("segment_id").alias("evidence_id"))
    return r.evidence(s, d).join(have, "evidence_id", "left_anti").select("id", "evidence_id")


def evidence_coverage(s, d):
    cited = r.evidence(s, d).select("course_id", "evidence_id").distinct()
    have = r.course_segments(s, d).select(F.col("segment_id").alias("evidence_id"), F.lit(1).alias("has"))
    per = cited.join(have, "evidence_id", "left").groupBy("course_id").agg(F.count(F.lit(1)).alias("n_cited"), F.count("has").alias("n_found"))
    return per.withColumn("coverage", F.col("n_found").cast("double") / F.col("n_cited").cast("double"))


def evidence_time_range(s, d):
    have = r.course_segments(s, d).select(F.col("segment_id").alias("evidence_id"), "job_id", "start_ms", "end_ms")
    return r.evidence(s, d).join(have, "evidence_id").groupBy("course_id", "case_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count_distinct("evidence_id").alias("n"))


def _placed(s, d):
    return numbered(r.course_segments(s, d).drop("text"), ["job_id"], ["start_ms", "seg_id"], 900_000)


def _ranges(s, d):
    """Closed ranges of positions of each case in each recording."""
    at = _placed(s, d).select(F.col("segment_id").alias("evidence_id"), "job_id", "pos")
    return r.evidence(s, d).join(at, "evidence_id").groupBy("job_id", "case_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))


def case_slice(s, d):
    return _ranges(s, d).select("job_id", "case_id", F.col("a").alias("first_pos"), F.col("b").alias("last_pos"), (F.col("b") - F.col("a") + 1).alias("n_segments"))


def case_coverage(s, d):
    """How many cases hold each segment: starts and ends as events, and their running sum."""
    ends = _ranges(s, d).select("job_id", F.explode(F.array(F.struct(F.col("a").alias("p"), F.lit(1).alias("d")), F.struct((F.col("b") + 1).alias("p"), F.lit(-1).alias("d")))).alias("e"))
    ends = ends.select("job_id", F.col("e.p").alias("p"), F.col("e.d").alias("d"), F.lit(None).cast("long").alias("seg_id")).groupBy("job_id", "p", "seg_id").agg(F.sum("d").cast("int").alias("d"))
    rows = _placed(s, d).select("job_id", F.col("pos").alias("p"), F.lit(0).alias("d"), "seg_id")
    both = running_sum(blocked(ends.unionByName(rows), ["job_id"], "p", 4096), ["job_id"], ["p", "seg_id"], F.col("d").cast("long"), "n_cases")
    return both.where("seg_id is not null and n_cases > 0").select("seg_id", "n_cases")


def payload_context(s, d):
    """Segments within one place of a cited one, of all of the recording."""
    cited = r.evidence(s, d).select(F.col("evidence_id").alias("segment_id")).distinct().withColumn("hit", F.lit(True))
    rows = r.course_segments(s, d).join(cited, "segment_id", "left")
    near = with_context(rows.drop("text"), ["job_id"], ["start_ms", "seg_id"], F.col("hit"), 1, 1, 900_000)
    return near.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_selected"))


def course_set_difference(s, d):
    a, b = table(s, d, "jobs", "course_id").distinct(), table(s, d, "knowledge_entries", "course_id").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("jobs")).unionByName(b.exceptAll(a).withColumn("side", F.lit("entries")))


def type_histogram(s, d):
    """Counts by course and type, by type, and in all."""
    rows = r.entries(s, d).groupingSets([["course_id", "type"], ["type"], []], "course_id", "type").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))
    return rows.select("course_id", "type", "level", "n")


def case_size_flags(s, d):
    """Cases of a course against the upper median of their sizes."""
    sizes = r.entries(s, d).where("case_id is not null").groupBy("course_id", "case_id").agg(F.count(F.lit(1)).alias("n"))
    mid = sizes.groupBy("course_id").agg(F.sort_array(F.collect_list("n")).alias("a"))
    mid = mid.select("course_id", F.element_at("a", (F.floor(F.size("a") / 2) + 1).cast("int")).alias("median"), F.size("a").cast("long").alias("n_cases"))
    return mid.join(sizes.groupBy("course_id").agg(F.max("n").alias("largest")), "course_id")


def sync_plan(s, d):
    """Each document that has a text against the last copy before it of its title and course: create, update or skip by hash.

    Before: by created_at, then doc_id. Without a title nothing is known of a document, so it is created.
    """
    docs = table(s, d, "documents", "doc_id", "text", "title", "course_id", "created_at").where("text is not null").select("doc_id", "title", "course_id", "created_at", F.sha2("text", 256).alias("h"))
    alone = F.when(F.col("title").isNull(), F.col("doc_id"))  # else all without a title would be one group
    docs = docs.withColumn("old", F.lag("h").over(Window.partitionBy("title", "course_id", alone).orderBy("created_at", "doc_id")))
    act = F.when(F.col("old").isNull(), "create").when(F.col("old") == F.col("h"), "skip").otherwise("update")
    return docs.select("doc_id", act.alias("action"))


def document_frequency(s, d):
    return retrieval.document_frequency(r.entries(s, d), "id", "title")


def bm25_search(s, d):
    queries = table(s, d, "eval_items", "item_id", "text").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(table(s, d, "documents", "doc_id", "text").where("text is not null"), queries, "doc_id", "text")


def ngram_search(s, d):
    queries = table(s, d, "courses", "course_id", "title").where("cast(substring(course_id, 2) as int) % 20 = 0").select(F.col("course_id").alias("query_id"), F.col("title").alias("text"))
    return retrieval.gram_search(r.entries(s, d), queries)


def der_components(s, d):
    """The parts that need no mapping of speakers; all of them: diarization_error."""
    turns = r.turns(s, d)
    return scoring.error_parts(turns.where("source = 'wespeaker'"), turns.where("source = 'campplus'"))


def diarization_error(s, d):
    """Of campplus against wespeaker, for every job that either has."""
    turns = r.turns(s, d)
    return scoring.diarization_error(turns.where("source = 'wespeaker'"), turns.where("source = 'campplus'"))


def iou_consecutive(s, d):
    """Overlap of each board's region with that of the board before."""
    rows = r.boards(s, d).where("region is not null")
    rows = with_neighbor(blocked(rows, ["job_id"], "start_ms", 900_000), ["job_id"], ["start_ms", "board_id"], ["region"], "prev")
    return rows.where("prev is not null").select("board_id", scoring.iou(F.col("region"), F.col("prev.region")).alias("iou"))


def _boxes(s, d):
    """Boxes of the lines of an order, as the survey makes them, numbered as line numbers come twice. Boards of a job don't overlap in time, and their pages have one box."""
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")  # an order has a handful of lines
    x, y, w, h = F.col("l_partkey") % 640, F.col("l_suppkey") % 360, 20 + F.col("l_linenumber") * 30, 20 + F.col("l_quantity").cast("int") * 4
    rows = table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return rows.select("l_orderkey", F.row_number().over(own).alias("id"), F.struct(*[c.cast("long").alias(n) for n, c in (("x", x), ("y", y), ("width", w), ("height", h))]).alias("region"))


def box_best_iou(s, d):
    """Each box's best overlap with the others of its order."""
    return scoring.best_iou(_boxes(s, d), _boxes(s, d), "l_orderkey")


def box_iou_scores(s, d):
    """Mean of the best overlaps and rate of hits of each order."""
    return box_best_iou(s, d).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.avg("best_iou").alias("mean_iou"), F.avg(F.col("hit").cast("double")).alias("top_k_hit_rate"))


def page_rates(s, d):
    rows = r.boards(s, d).where("version_id is not null").groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("version_id").alias("n_distinct"))
    return rows.withColumn("duplicate_rate", 1 - F.col("n_distinct").cast("double") / F.col("n").cast("double"))


def engine_der_ranking(s, d):
    """Engines of each job by their error against its aligned speech of known speakers; ties: the name, as no times are kept.

    Engines of a job without such speech have an error of 1.
    """
    turns = r.turns(s, d)
    sample = F.to_json(F.struct("job_id", "source")).alias("sample")
    engines = turns.select("job_id", "source").distinct().select("job_id", "source", sample)
    said = r.speech(s, d).where("speaker <> 'unknown' and end_ms > start_ms").select("job_id", "speech_id", "start_ms", "end_ms", F.col("speaker").alias("speaker_id"))
    said = said.join(engines, "job_id").select("sample", F.struct("speech_id", "source").alias("turn_id"), "start_ms", "end_ms", "speaker_id")
    der = scoring.diarization_error(said, turns.select(sample, "turn_id", "start_ms", "end_ms", "speaker_id"), "sample")
    best = Window.partitionBy("job_id").orderBy("der", "source")
    return engines.join(der, "sample").drop("sample").withColumn("rank", F.row_number().over(best).cast("long"))


def engine_ranking(s, d):
    """Engines of each job by their number of turns; by their error: engine_der_ranking."""
    per = table(s, d, "speaker_turns", "turn_id", "job_id", "source", "confidence").dropDuplicates(["turn_id"]).groupBy("job_id", "source").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("n"), "source")).cast("long"))


def hash_hamming(s, d):
    """Sign bits of all dimensions, 32 to a long, and their distance to the vector before of the same label."""
    long = lambda k: F.aggregate(F.transform(F.slice("embedding", k * 32 + 1, 32), lambda x: F.when(x > 0, 1).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a * 2 + x)
    bits = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size("embedding"), F.lit(1)) - 1) / 32).cast("int")), long)
    rows = table(s, d, "embeddings", "vec_id", "label", "embedding").where("embedding is not null").select("vec_id", "label", bits.alias("bits"))
    rows = with_neighbor(blocked(rows, ["label"], "vec_id", 65_536), ["label"], ["vec_id"], ["bits"], "prev")
    apart = F.zip_with("bits", "prev.bits", lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("long"))
    return rows.where("prev is not null").select("vec_id", F.aggregate(apart, F.lit(0).cast("long"), lambda a, x: a + x).alias("hamming"))


def nfkc_normalize(s, d):
    return r.segments(s, d).select("seg_id", t.nfkc("text").alias("plain"))


def sequence_ratio(s, d):
    rows = table(s, d, "transcript_segments", "seg_id", "text", "raw_text").dropDuplicates(["seg_id"]).where("raw_text is not null and text is not null")
    return rows.select("seg_id", t.sequence_ratio("raw_text", "text").alias("ratio"), t.word_error_rate("raw_text", "text").alias("wer"))


def evidence_hash(s, d):
    return r.entries(s, d).select("id", t.canonical_hash("evidence_json").alias("hash"))


def line_dedup_fuzzy(s, d):
    return lines.document_lines(table(s, d, "documents", "doc_id", "text"))


def greedy_speaker_map(s, d):
    turns = r.turns(s, d)
    return scoring.greedy_speaker_map(turns.where("source = 'wespeaker'"), turns.where("source = 'campplus'"))


def nms_boxes(s, d):
    return scoring.keep_boxes(_boxes(s, d).select("l_orderkey", "id", "region.*"), "l_orderkey")


QUERIES = {
    f.__name__: f
    for f in (
        text_keys, format_timestamps, character_error_rate, pii_counts, pii_redact, punctuation_rules, safe_names, query_ngrams, speaker_spellings, first_lines, transcript_blocks, transcript_metrics, srt_cues,
        duplicate_sources, content_hashes, evidence_missing, evidence_coverage, evidence_time_range, case_slice, case_coverage, payload_context, course_set_difference, type_histogram, case_size_flags, sync_plan,
        document_frequency, bm25_search, ngram_search, der_components, diarization_error, iou_consecutive, box_best_iou, box_iou_scores, page_rates, engine_ranking, engine_der_ranking, hash_hamming, nfkc_normalize, sequence_ratio, evidence_hash, line_dedup_fuzzy, greedy_speaker_map, nms_boxes,
    )
}

_CLOCK = lambda c, m: f"printf('%02d:%02d:%02d{m}%03d', greatest({c}, 0) // 3600000, greatest({c}, 0) // 60000 % 60, greatest({c}, 0) // 1000 % 60, greatest({c}, 0) % 1000)"
_KEY = "replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), 'ß', 'ss')"
_RANGES = """, pl as (select segment_id as evidence_id, job_id, seg_id, row_number() over (partition by job_id order by start_ms, seg_id) as pos from cs),
rg as (select job_id, case_id, min(pos) as a, max(pos) as b from ev join pl using (evidence_id) group by 1, 2)"""
_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_GRAMS = """unnest(list_concat(flatten(list_transform(regexp_extract_all({0}, '[\\x{{4e00}}-\\x{{9fff}}]+'), lambda r: flatten(list_transform([2, 3, 4], lambda n:
  list_transform(range(1, length(r) - n + 2), lambda i: substr(r, i, n)))))), list_transform(list_filter(regexp_extract_all({0}, '[A-Za-z0-9]+'), lambda w: length(w) >= 2), lambda w: lower(w))))"""
_BOX = """with b as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as id, l_partkey % 640 as x, l_suppkey % 360 as y, 20 + l_linenumber * 30 as w, 20 + cast(floor(l_quantity) as int) * 4 as h from lineitem),
p as (select a.l_orderkey, a.id, b.id as i, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) as o, a.w * a.h + b.w * b.h as s from b a left join b on a.l_orderkey = b.l_orderkey and a.id <> b.id),
m as (select *, case when i is not null then o::double / (s - o) end as v from p)"""
_I = "(greatest(0, least(rk.x + rk.w, q.x + q.w) - greatest(rk.x, q.x)) * greatest(0, least(rk.y + rk.h, q.y + q.h) - greatest(rk.y, q.y)))"
_NMS = f"{_I}::double / greatest(1e-9, rk.w * rk.h + q.w * q.h - {_I})"
_GREEDY = """with recursive tn as (select distinct turn_id, job_id, start_ms, end_ms, speaker_id, source from speaker_turns where end_ms > start_ms and speaker_id is not null),
sums as (select l.job_id, r.speaker_id as hyp, l.speaker_id as ref, sum(least(l.end_ms, r.end_ms) - greatest(l.start_ms, r.start_ms)) as ms from tn l join tn r on l.job_id = r.job_id and l.source = 'wespeaker' and r.source = 'campplus' and l.start_ms < r.end_ms and r.start_ms < l.end_ms group by 1, 2, 3),
rk as (select *, row_number() over (partition by job_id order by ms desc, hyp desc, ref desc) as k from sums),
g as (select job_id, 0::bigint as k, ''::varchar as hyp, ''::varchar as ref, ['']::varchar[] as hs, ['']::varchar[] as rs, false as took from (select distinct job_id from sums)
union all select n.job_id, n.k, n.hyp, n.ref, case when ok then list_append(hs, n.hyp) else hs end, case when ok then list_append(rs, n.ref) else rs end, ok from (
 select rk.job_id, rk.k, rk.hyp, rk.ref, hs, rs, not list_contains(hs, rk.hyp) and not list_contains(rs, rk.ref) as ok from g join rk on rk.job_id = g.job_id and rk.k = g.k + 1) n)"""
_STOP = "('如何', '应该', '分别', '方式', '时候', '怎么', '什么', '进行')"

SQL = {
    k: r.SQL + v
    for k, v in {
        "text_keys": f" select seg_id, {_KEY.format('text')} as key, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) as n from seg",
        "format_timestamps": f" select seg_id, {_CLOCK('start_ms', '.')} as at, {_CLOCK('end_ms', ',')} as until from seg",
        # DuckDB's levenshtein counts bytes, so each character of a pair becomes one of its own
        "character_error_rate": """, k as (select distinct on (seg_id) seg_id, text, raw_text from transcript_segments where raw_text is not null and text is not null),
c as (select *, list_distinct(str_split(text || raw_text, '')) as x from k),
m as (select seg_id, length(raw_text) as n, length(text) as h, array_to_string(list_transform(str_split(raw_text, ''), lambda c: chr(cast(list_position(x, c) as int))), '') as a, array_to_string(list_transform(str_split(text, ''), lambda c: chr(cast(list_position(x, c) as int))), '') as b from c)
select seg_id, case when n = 0 then case when h = 0 then 0.0 else 1.0 end else levenshtein(a, b)::double / n end as cer from m""",
        "pii_counts": """, k as (select seg_id, regexp_extract_all(text, '[0-9]+[Xx]?') as runs, text from seg),
c as (select seg_id, len(list_filter(runs, lambda x: regexp_full_match(x, '1[3-9][0-9]{9}[Xx]?'))) as phones, len(list_filter(runs, lambda x: regexp_full_match(x, '[0-9]{17}[0-9Xx]') or regexp_full_match(x, '[0-9]{18}[Xx]'))) as ids,
len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) as emails from k)
select * from c where phones + ids + emails > 0""",
        "punctuation_rules": """ select seg_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, ',?!', '，？！'), '\\.$', '。'),
'，+', '，', 'g'), '。+', '。', 'g'), '！+', '！', 'g'), '？+', '？', 'g'), '、+', '、', 'g'), '；+', '；', 'g'), '：+', '：', 'g') as marked from seg where text is not null""",
        "speaker_spellings": """ select speech_id, 'speaker_' || cast(nullif(regexp_extract(lower(trim(speaker_id)), '^\\[?(?:speaker|spk|s)[ _-]?([0-9]+)\\]?:?$', 1), '') as int) as speaker from sp""",
        "srt_cues": f""", k as (select *, row_number() over (partition by job_id order by start_ms, speech_id) as cue_no from sp)
select job_id, cue_no, cue_no || chr(10) || {_CLOCK('start_ms', ',')} || ' --> ' || {_CLOCK('end_ms', ',')} || chr(10) || speaker || ': ' || coalesce(text, '') as cue from k""",
        "evidence_missing": " select id, evidence_id from ev where not exists (select 1 from cs where segment_id = evidence_id)",
        "evidence_coverage": """, k as (select distinct course_id, evidence_id from ev)
select k.course_id, count(*) as n_cited, count(segment_id) as n_found, count(segment_id) * 1.0::double / count(*) as coverage from k left join cs on segment_id = evidence_id group by 1""",
        "evidence_time_range": " select ev.course_id, case_id, min(start_ms) as start_ms, max(end_ms) as end_ms, count(distinct evidence_id) as n from ev join cs on segment_id = evidence_id group by 1, 2",
        "case_slice": f"{_RANGES} select job_id, case_id, a as first_pos, b as last_pos, b - a + 1 as n_segments from rg",
        "case_coverage": f"{_RANGES} select seg_id, count(*) as n_cases from pl join rg on pl.job_id = rg.job_id and pos between a and b group by 1",
        "payload_context": """, k as (select job_id, cast(segment_id in (select evidence_id from ev) as int) as hit, row_number() over (partition by job_id order by start_ms, seg_id) as pos from cs),
c as (select job_id, max(hit) over (partition by job_id order by pos rows between 1 preceding and 1 following) as near from k) select job_id, count(*) as n_selected from c where near = 1 group by 1""",
        "type_histogram": " select course_id, type, grouping(course_id, type) as level, count(*) as n from en group by grouping sets ((course_id, type), (type), ())",
        "case_size_flags": """, k as (select course_id, case_id, count(*) as n from en where case_id is not null group by 1, 2)
select course_id, list_sort(list(n))[count(*) // 2 + 1] as median, count(*) as n_cases, max(n) as largest from k group by 1""",
        "document_frequency": f", k as (select distinct id, unnest({_WORDS.format('title')}) as token from en) select token, count(*) as df from k group by 1",
        "der_components": """, o as (select l.turn_id as a, r.turn_id as b, least(l.end_ms, r.end_ms) - greatest(l.start_ms, r.start_ms) as ms from turn l join turn r on l.job_id = r.job_id and l.source = 'wespeaker' and r.source = 'campplus' and l.start_ms < r.end_ms and r.start_ms < l.end_ms),
x as (select job_id, sum(end_ms - start_ms) as ref_ms, sum(greatest(0, end_ms - start_ms - coalesce(ms, 0))) as missed_ms from turn left join (select a, sum(ms) as ms from o group by 1) on a = turn_id where source = 'wespeaker' group by 1),
y as (select job_id, sum(greatest(0, end_ms - start_ms - coalesce(ms, 0))) as fa from turn left join (select b, sum(ms) as ms from o group by 1) on b = turn_id where source = 'campplus' group by 1)
select x.job_id, cast(ref_ms as bigint) as ref_ms, cast(missed_ms as bigint) as missed_ms, cast(coalesce(fa, 0) as bigint) as false_alarm_ms from x left join y using (job_id)""",
        "iou_consecutive": """, k as (select board_id, region as a, lag(region) over (partition by job_id order by start_ms, board_id) as b from board where region is not null),
m as (select *, cast(greatest(0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y)) as double) as i from k where b is not null)
select board_id, i / (a.width * a.height + b.width * b.height - i) as iou from m""",
        "page_rates": " select job_id, count(*) as n, count(distinct version_id) as n_distinct, 1 - count(distinct version_id) * 1.0::double / count(*) as duplicate_rate from board where version_id is not null group by 1",
        "ngram_search": f""", q as (select distinct course_id as query_id, {_GRAMS.format('title')} as token from courses where cast(substr(course_id, 2) as int) % 20 = 0),
g as (select id, true as t, {_GRAMS.format("coalesce(title, '')")} as token from en union all select id, false as t, {_GRAMS.format("coalesce(body, '')")} as token from en),
h as (select id, token, bool_or(t) as t from g where token in (select token from q) and token not in {_STOP} group by 1, 2),
df as (select token, count(*) as df from h group by 1),
x as (select query_id, id, sum(length(token) * (ln(((select count(*) from en) + 1.0) / (df + 1.0)) + 1) * case when t then 2.5 else 1.0 end) as v from h join df using (token) join q using (token) group by 1, 2),
y as (select query_id, id, round(v + coalesce(confidence, 0.0), 6) as score from x join en using (id)),
z as (select *, row_number() over (partition by query_id order by score desc, id) as rank from y) select * from z where rank <= 8""",
    }.items()
} | {
    "pii_redact": """with k as (select distinct seg_id, text from transcript_segments where text is not null),
p as (select seg_id, regexp_replace(regexp_replace(text, '(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])', '\\1[手机号已脱敏]\\2', 'g'), '(^|[^0-9])[0-9]{17}[0-9Xx]($|[^0-9])', '\\1[身份证号已脱敏]\\2', 'g') as t from k)
select seg_id, regexp_replace(regexp_replace(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[邮箱已脱敏]', 'g'), '(?i)(微信(?:号|ID)?|wechat(?:\\s*id)?)\\s*[:：]?\\s*[A-Za-z][-_A-Za-z0-9]{5,19}', '[微信号已脱敏]', 'g') as clean from p""",
    "safe_names": "select course_id, trim(regexp_replace(title, '[^\\p{L}\\p{N}._-]+', '_', 'g'), '_') as name from courses",
    "query_ngrams": f"with k as (select distinct course_id, {_GRAMS.format('title')} as token from courses) select * from k where token not in {_STOP}",
    "first_lines": f"""with l as (select doc_id, unnest(str_split(text, chr(10))) as line, generate_subscripts(str_split(text, chr(10)), 1) - 1 as line_no from documents),
k as (select doc_id, line_no, {_KEY.format('line')} as key from l) select doc_id, min(line_no) as line_no, count(*) as n from k where key <> '' group by doc_id, key""",
    "transcript_blocks": """with b as (select doc_id, unnest(str_split(text, chr(10) || chr(10))) as raw, generate_subscripts(str_split(text, chr(10) || chr(10)), 1) - 1 as block from documents where source = 'transcript_export'),
k as (select *, regexp_extract(raw, '^\\[([0-9]{2,}:[0-9]{2}:[0-9]{2}\\.[0-9]{3}) -> ([0-9]{2,}:[0-9]{2}:[0-9]{2}\\.[0-9]{3})\\] ([^\\n]*)\\n', ['a', 'b', 'label']) as h from b
  where regexp_matches(raw, '^\\[[0-9]{2,}:[0-9]{2}:[0-9]{2}\\.[0-9]{3} -> [0-9]{2,}:[0-9]{2}:[0-9]{2}\\.[0-9]{3}\\] [^\\n]*\\n')),
p as (select *, list_transform(str_split(replace(h.a, '.', ':'), ':'), lambda x: cast(x as bigint)) as a, list_transform(str_split(replace(h.b, '.', ':'), ':'), lambda x: cast(x as bigint)) as b from k)
select doc_id, block, a[1] * 3600000 + a[2] * 60000 + a[3] * 1000 + a[4] as start_ms, b[1] * 3600000 + b[2] * 60000 + b[3] * 1000 + b[4] as end_ms, h.label as label, length(raw) - strpos(raw, chr(10)) as n_chars from p""",
    "transcript_metrics": "select doc_id, octet_length(encode(text)) as n_bytes, len(str_split(text, chr(10))) as n_lines, len(regexp_extract_all(text, '[0-9]{2,}:[0-9]{2}:[0-9]{2}\\.[0-9]{3}')) as n_stamps from documents where text is not null",
    "duplicate_sources": "with k as (select doc_id, min(doc_id) over (partition by text) as original from documents where text is not null) select * from k where doc_id <> original",
    "content_hashes": "select doc_id, sha256(text) as hash from documents where text is not null",
    "course_set_difference": """select course_id, 'jobs' as side from (select course_id from jobs except select course_id from knowledge_entries)
union all select course_id, 'entries' as side from (select course_id from knowledge_entries except select course_id from jobs)""",
    "evidence_hash": f"""with k as (select distinct on (id) id, evidence_json as e, from_json(evidence_json, '["VARCHAR"]') as x from knowledge_entries)
select id, case when e is not null then sha256('[' || coalesce(array_to_string(list_transform(x, lambda i: '"' || i || '"'), ','), '') || ']') end as hash from k""",
    "box_best_iou": f"""{_BOX} select l_orderkey, id, cast(count(i) as bigint) as n_met, coalesce(max(v), 0.0::double) as best_iou, coalesce(max(v), 0.0) >= 0.5 as hit from m group by 1, 2""",
    "box_iou_scores": f"""{_BOX}, o as (select l_orderkey, id, coalesce(max(v), 0.0::double) as v from m group by 1, 2)
select l_orderkey, count(*) as n, avg(v) as mean_iou, avg(case when v >= 0.5 then 1.0::double else 0.0 end) as top_k_hit_rate from o group by 1""",
    "greedy_speaker_map": f"{_GREEDY} select job_id, hyp, ref from g where took",
    "diarization_error": f"""{_GREEDY}, mp as (select job_id, hyp, ref from g where took), oa as (select l.turn_id as a, r.turn_id as b, least(l.end_ms, r.end_ms) - greatest(l.start_ms, r.start_ms) as ms from tn l join tn r on l.job_id = r.job_id and l.source = 'wespeaker' and r.source = 'campplus' and l.start_ms < r.end_ms and r.start_ms < l.end_ms),
x as (select job_id, sum(end_ms - start_ms) as ref_ms, sum(greatest(0, end_ms - start_ms - coalesce(ms, 0))) as missed_ms from tn left join (select a, sum(ms) as ms from oa group by 1) on a = turn_id where source = 'wespeaker' group by 1),
y as (select job_id, sum(greatest(0, end_ms - start_ms - coalesce(ms, 0))) as fa from tn left join (select b, sum(ms) as ms from oa group by 1) on b = turn_id where source = 'campplus' group by 1),
w as (select s.job_id, sum(case when mp.hyp is null then s.ms else 0 end) as se from sums s left join mp on mp.job_id = s.job_id and mp.hyp = s.hyp and mp.ref = s.ref group by 1),
z as (select job_id, cast(coalesce(ref_ms, 0) as bigint) as ref_ms, cast(coalesce(missed_ms, 0) as bigint) as missed_ms, cast(coalesce(se, 0) as bigint) as speaker_error_ms, cast(coalesce(fa, 0) as bigint) as false_alarm_ms from x full join y using (job_id) left join w using (job_id))
select *, case when ref_ms = 0 then 1.0 else (missed_ms + speaker_error_ms + false_alarm_ms)::double / ref_ms end as der from z""",
    "nms_boxes": f"""with recursive {_BOX[5:].split(", p as", 1)[0]}, rk as (select *, row_number() over (partition by l_orderkey order by -(w * h), id) as k from b),
g as (select l_orderkey, 0::bigint as k, 0::bigint as id, [{{'x': 0::bigint, 'y': 0::bigint, 'w': 0::bigint, 'h': 0::bigint}}][1:0] as kept, false as took from (select distinct l_orderkey from b)
union all select n.l_orderkey, n.k, n.id, case when n.ok then list_append(kept, {{'x': n.x::bigint, 'y': n.y::bigint, 'w': n.w::bigint, 'h': n.h::bigint}}) else kept end, n.ok from (
 select rk.l_orderkey, rk.k, rk.id, rk.x, rk.y, rk.w, rk.h, kept, len(kept) < 24 and len(list_filter(kept, lambda q: {_NMS} >= 0.55)) = 0 as ok from g join rk on rk.l_orderkey = g.l_orderkey and rk.k = g.k + 1) n)
select l_orderkey, id from g where took""",
    "sync_plan": """with k as (select doc_id, text, lag(text) over (partition by title, course_id, case when title is null then doc_id end order by created_at, doc_id) as old from documents where text is not null)
select doc_id, case when old is null then 'create' when old = text then 'skip' else 'update' end as action from k""",
    "bm25_search": f"""with q as (select distinct item_id as query_id, unnest({_WORDS.format('text')}) as token from eval_items where item_id % 20 = 0),
d as (select doc_id, {_WORDS.format('text')} as w from documents where text is not null), st as (select count(*) as n, avg(len(w)) as mean from d),
p as (select doc_id, dl, token, count(*) as tf from (select doc_id, len(w) as dl, unnest(w) as token from d) where token in (select token from q) group by 1, 2, 3),
f as (select token, count(*) as df from p group by 1),
s as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / mean))), 6) as score from p join f using (token) join q using (token), st group by 1, 2),
z as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) select * from z where rank <= 8""",
    "engine_ranking": """with k as (select job_id, source, count(distinct turn_id) as n from speaker_turns group by 1, 2)
select *, row_number() over (partition by job_id order by n desc, source) as rank from k""",
    "hash_hamming": """with k as (select vec_id, embedding as a, lag(embedding) over (partition by label order by vec_id) as b from embeddings where embedding is not null)
select vec_id, len(list_filter(list_zip(a, b), lambda p: (p[1] > 0) <> (p[2] > 0))) as hamming from k where b is not null""",
}
