"""Queries of contract checks, layered look-ups, search with a fallback and representative frames, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import rules
from lectern.operators import joins, quality, retrieval
from lectern.plans import relations as r
from lectern.plans import cleaning, reports, texts
from lectern.sources import payloads, sinks
from lectern.sources.tables import table

TYPES = ("observation", "principle", "response", "risk", "scenario")


def entry_contract(s, d):
    """Each course's entries: ids that come once, titles, bodies, known types, confidences from 0 to 1, citations, and that they exist and are of the course."""
    rows = table(s, d, "knowledge_entries", "id", "course_id", "type", "title", "body", "evidence_json", "confidence").dropDuplicates(["id"])
    n = F.size(F.coalesce(F.from_json("evidence_json", "array<string>"), F.array().cast("array<string>")))
    c = F.col("confidence")
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    per = rows.groupBy("course_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(blank("title")).alias("n_untitled"), F.count_if(blank("body")).alias("n_blank"), F.count_if(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False))).alias("n_typeless"),
        F.count_if(c.isNotNull() & ~F.isnan(c) & ~c.between(0, 1)).alias("n_confidence"), F.count_if(n == 0).alias("n_uncited"),
    )
    have = r.course_segments(s, d).select(F.col("segment_id").alias("evidence_id"), F.col("course_id").alias("of"))
    cited = r.evidence(s, d).join(have, "evidence_id", "left").groupBy("course_id").agg(F.count_if(F.col("of").isNull()).alias("n_lost"), F.count_if(F.col("of") != F.col("course_id")).alias("n_foreign"))
    rows = per.join(cited, "course_id", "left").fillna(0)
    zero = {"titled": "n_untitled", "bodies": "n_blank", "types": "n_typeless", "confidences": "n_confidence", "all_cite": "n_uncited", "evidence_exists": "n_lost", "evidence_of_course": "n_foreign"}
    return quality.verdict(rows, {k: F.col(v) == 0 for k, v in zero.items()})


def normalized_checks(s, d):
    """Each recording after the rewrites: ids once, nothing emptied, something changed, and as much as is noted."""
    clean, notes = rules.rewritten(F.col("text"))
    rows = r.segments(s, d).where("trim(text) <> ''").select("job_id", "seg_id", F.col("text").alias("t"), clean.alias("c"), F.size(notes).alias("k"))
    per = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seg_id").alias("n_ids"), F.count_if(F.trim("c") == "").alias("n_emptied"), F.count_if(F.col("c") != F.col("t")).alias("n_changed"), F.count_if(F.col("k") > 0).alias("n_noted"))
    return quality.verdict(per, {"unique_ids": F.col("n") == F.col("n_ids"), "non_empty": F.col("n_emptied") == 0, "effective": F.col("n_changed") > 0, "notes_cover_changes": F.col("n_noted") >= F.col("n_changed")})


def transcript_checks(s, d):
    """Each transcript export: stamps, a start within a minute, times in order, and text."""
    docs = table(s, d, "documents", "doc_id", "source").where("source = 'transcript_export'").select("doc_id")
    rows = reports.document_metrics(s, d).join(docs, "doc_id")
    return quality.verdict(rows, {"has_stamps": F.col("n_stamps") > 0, "early_start": F.col("first_ms") <= 60_000, "in_order": F.col("last_ms") >= F.col("first_ms"), "has_text": F.col("n_chars") > 0}).select("doc_id", "has_stamps", "early_start", "in_order", "has_text", "passed")


def case_readiness(s, d):
    """Whether each case can be sent: all it cites exists, it has statements, and its stretch of time is known."""
    rows = reports.evidence_packages(s, d)
    ready = F.col("complete") & (F.col("n_statements") > 0) & F.col("start_ms").isNotNull()
    return rows.groupBy("course_id").agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(ready).alias("n_ready"), F.bool_and(ready).alias("ready"))


def review_reuse(s, d):
    """Reviews of unchanged cases that were supported are used again; all others are done anew."""
    jobs = table(s, d, "jobs", "job_id", "course_id").dropDuplicates(["job_id"])
    changed = reports.case_changes(s, d).join(jobs, "job_id").groupBy("course_id", "case_id").agg(F.bool_or("changed").alias("changed"))
    rows = reports.entry_reviews(s, d).join(changed, ["course_id", "case_id"], "left")
    keep = (F.col("status") == "supported") & ~F.coalesce("changed", F.lit(True))
    return rows.select("course_id", "case_id", "type", F.when(keep, "reuse").otherwise("redo").alias("action"))


def text_layers(s, d):
    """Each board's text: its own lines, else what the frame at its first moment reads, else nothing."""
    own = sinks.board_bodies(table(s, d, "board_segments", "board_id", "text_lines").dropDuplicates(["board_id"])).select("board_id", "body")
    frame = table(s, d, "frames", "job_id", "timestamp_ms", "ocr_text").where("trim(ocr_text) <> ''").groupBy("job_id", F.col("timestamp_ms").alias("t")).agg(F.min("ocr_text").alias("frame_text"))
    at = r.boards(s, d).select("board_id", "job_id", (F.floor(F.col("start_ms") / 5000) * 5000).cast("long").alias("t"))
    rows = at.join(own, "board_id", "left").join(frame, ["job_id", "t"], "left")
    has = F.coalesce("body", F.lit("")) != ""
    return rows.select("board_id", F.when(has, "board").when(F.col("frame_text").isNotNull(), "frame").otherwise("none").alias("layer"), F.when(has, F.col("body")).otherwise(F.coalesce("frame_text", F.lit(""))).alias("text"))


def representative_frames(s, d):
    """The best frame of each board: text, sharpness against the board's sharpest, and likeness to its neighbours in text; ties: the earliest."""
    frames = table(s, d, "frames", "job_id", "timestamp_ms", "sharpness", "text_score").dropDuplicates(["job_id", "timestamp_ms"])
    points = frames.select("job_id", F.col("timestamp_ms").alias("start_ms"), (F.col("timestamp_ms") + 1).alias("end_ms"), F.coalesce("sharpness", F.lit(0.0)).alias("sharp"), F.coalesce("text_score", F.lit(0.0)).alias("text"))
    rows = joins.overlap_pairs(points, r.boards(s, d).drop("region", "version_id"), "job_id").select(F.col("r_board_id").alias("board_id"), F.col("l_start_ms").alias("t"), F.col("l_sharp").alias("sharp"), F.col("l_text").alias("text"))
    w = Window.partitionBy("board_id")  # the frames during one board
    near = [1 - F.abs(F.col("text") - f("text").over(w.orderBy("t"))) for f in (F.lag, F.lead)]
    rows = rows.withColumn("top", F.max("sharp").over(w)).withColumn("stable", F.coalesce((near[0] + near[1]) / 2, near[0], near[1], F.lit(1.0)))
    score = F.round(0.35 * F.col("text") + 0.45 * F.least(F.lit(1.0), F.col("sharp") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)) + 0.20 * F.col("stable"), 9)
    best = rows.withColumn("score", score).groupBy("board_id").agg(F.max(F.struct("score", (-F.col("t")).alias("t"))).alias("k"), F.count(F.lit(1)).alias("n"))
    return best.select("board_id", (-F.col("k.t")).alias("timestamp_ms"), F.col("k.score").alias("score"), "n")


def _searched(s, d):
    queries = table(s, d, "courses", "course_id", "title").where("cast(substring(course_id, 2) as int) % 20 = 0").select(F.col("course_id").alias("query_id"), F.col("title").alias("text"))
    return r.entries(s, d), queries


def search_with_fallback(s, d):
    """Entries for each query by BM25 over title and body; where that finds none, by n-grams."""
    entries, queries = _searched(s, d)
    docs = entries.select("id", F.concat_ws("\n", "title", "body").alias("text"))
    first = retrieval.bm25(docs, queries, "id", "text").withColumn("found_by", F.lit("bm25"))
    rest = queries.join(first.select("query_id").distinct(), "query_id", "left_anti")
    return first.unionByName(retrieval.gram_search(entries, rest).withColumn("found_by", F.lit("ngram")))


def answer_context(s, d):
    """What an answer is built on: of each query's hits title, length and confidence, in order."""
    hits = search_with_fallback(s, d)
    return hits.join(r.entries(s, d), "id").select("query_id", "rank", "id", F.coalesce("title", F.lit("")).alias("title"), F.length(F.coalesce("body", F.lit(""))).cast("long").alias("chars"), "confidence")


def entry_texts(s, d):
    """The text by which an entry is searched: title, kind and the values of its body's lines."""
    body = F.transform(F.split(F.coalesce("body", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[^:：]{1,20}[:：]", "")))
    return r.entries(s, d).select("id", F.array_join(F.filter(F.concat(F.array(F.coalesce("title", F.lit("")), F.coalesce("type", F.lit(""))), body), lambda x: x != ""), "\n").alias("text"))


def ocr_round_trip(s, d):
    """Lines of boards written as a recogniser's raw page, each in two boxes, and read back: boxes of one line join, in reading order."""
    rows = table(s, d, "board_segments", "board_id", "text_lines").dropDuplicates(["board_id"]).where("size(text_lines) > 0")
    text = F.filter(F.transform("text_lines", lambda x: F.coalesce(x["text"], F.lit(""))), lambda t: F.length(F.trim(t)) > 1)
    half = lambda t: F.floor(F.length(t) / 2).cast("int")
    halves = F.flatten(F.transform(text, lambda t: F.array(F.substring(t, F.lit(1), half(t)), F.substring(t, half(t) + 1, F.length(t)))))
    poly = lambda x, y: F.array(F.array(x, y), F.array(x + 90.0, y), F.array(x + 90.0, y + 20.0), F.array(x, y + 20.0))
    polys = F.flatten(F.transform(text, lambda t, i: F.array(poly(F.lit(0.0), i * F.lit(40.0)), poly(F.lit(100.0), i * F.lit(40.0)))))
    page = F.struct(halves.alias("rec_texts"), F.transform(halves, lambda t: F.lit(0.9)).alias("rec_scores"), polys.alias("rec_polys"))
    read = payloads.ocr_lines(rows.select(F.col("board_id").alias("frame_id"), F.to_json(page).alias("raw")))
    return read.select(F.col("frame_id").alias("board_id"), "line_no", "text", "confidence", "low_confidence")


QUERIES = {f.__name__: f for f in (entry_contract, normalized_checks, transcript_checks, case_readiness, review_reuse, text_layers, representative_frames, search_with_fallback, answer_context, entry_texts, ocr_round_trip)}

_PACK = """, pk as (select ev.course_id, case_id, count(distinct id) as n_statements, count(distinct evidence_id) as n_cited, count(distinct segment_id) as n_found, min(start_ms) as start_ms from ev left join cs on segment_id = evidence_id group by 1, 2)"""
_W = texts._WORDS
_G = texts._GRAMS
_FALL = f"""{r.SQL}, qs as (select distinct course_id as query_id, title as text from courses where cast(substr(course_id, 2) as int) % 20 = 0),
bq as (select distinct query_id, unnest({_W.format('text')}) as token from qs), bd as (select id, {_W.format("concat_ws(chr(10), title, body)")} as w from en), st as (select count(*) as n, avg(len(w)) as mean from bd),
bp as (select id, dl, token, count(*) as tf from (select id, len(w) as dl, unnest(w) as token from bd) where token in (select token from bq) group by 1, 2, 3), bf as (select token, count(*) as df from bp group by 1),
bs as (select query_id, id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / mean))), 6) as score from bp join bf using (token) join bq using (token), st group by 1, 2),
bz as (select *, row_number() over (partition by query_id order by score desc, id) as rank from bs), b1 as (select * from bz where rank <= 8),
gq as (select distinct query_id, {_G.format('text')} as token from qs where query_id not in (select query_id from b1)),
gg as (select id, true as t, {_G.format("coalesce(title, '')")} as token from en union all select id, false as t, {_G.format("coalesce(body, '')")} as token from en),
gh as (select id, token, bool_or(t) as t from gg where token in (select token from gq) and token not in {texts._STOP} group by 1, 2), gf as (select token, count(*) as df from gh group by 1),
gx as (select query_id, id, sum(length(token) * (ln(((select count(*) from en) + 1.0) / (df + 1.0)) + 1) * case when t then 2.5 else 1.0 end) as v from gh join gf using (token) join gq using (token) group by 1, 2),
gy as (select query_id, id, round(v + coalesce(confidence, 0.0), 6) as score from gx join en using (id)), gz as (select *, row_number() over (partition by query_id order by score desc, id) as rank from gy),
hits as (select query_id, id, score, rank, 'bm25' as found_by from b1 union all select query_id, id, score, rank, 'ngram' as found_by from gz where rank <= 8)"""

SQL = {
    k: r.SQL + v
    for k, v in {
        "entry_contract": """, x as (select distinct on (id) id, course_id, type, title, body, confidence, coalesce(len(from_json(evidence_json, '["VARCHAR"]')), 0) as k from knowledge_entries),
p as (select course_id, count(*) as n, count(*) filter (coalesce(trim(title, ' '), '') = '') as n_untitled, count(*) filter (coalesce(trim(body, ' '), '') = '') as n_blank, count(*) filter (not coalesce(type in ('observation', 'principle', 'response', 'risk', 'scenario'), false)) as n_typeless,
 count(*) filter (confidence is not null and not isnan(confidence) and not confidence between 0 and 1) as n_confidence, count(*) filter (k = 0) as n_uncited from x group by 1),
c as (select ev.course_id, count(*) filter (cs.course_id is null) as n_lost, count(*) filter (cs.course_id <> ev.course_id) as n_foreign from ev left join cs on segment_id = evidence_id group by 1),
z as (select p.*, coalesce(n_lost, 0) as n_lost, coalesce(n_foreign, 0) as n_foreign from p left join c using (course_id)),
y as (select *, n_untitled = 0 as titled, n_blank = 0 as bodies, n_typeless = 0 as types, n_confidence = 0 as confidences, n_uncited = 0 as all_cite, n_lost = 0 as evidence_exists, n_foreign = 0 as evidence_of_course from z)
select *, titled and bodies and types and confidences and all_cite and evidence_exists and evidence_of_course as passed from y""",
        "case_readiness": f"{_PACK} select course_id, count(*) as n_cases, count(*) filter (n_cited = n_found and n_statements > 0 and start_ms is not null) as n_ready, bool_and(n_cited = n_found and n_statements > 0 and start_ms is not null) as ready from pk group by 1",
        "text_layers": """, o as (select distinct on (board_id) board_id, coalesce(array_to_string(list_filter(list_transform(text_lines, lambda x: trim(coalesce(x.corrected_text, x.text))), lambda t: t <> ''), chr(10)), '') as body from board_segments),
f as (select job_id, timestamp_ms as t, min(ocr_text) as frame_text from frames where trim(ocr_text) <> '' group by 1, 2)
select board.board_id, case when body <> '' then 'board' when frame_text is not null then 'frame' else 'none' end as layer, case when body <> '' then body else coalesce(frame_text, '') end as text
from board left join o on o.board_id = board.board_id left join f on f.job_id = board.job_id and f.t = start_ms // 5000 * 5000""",
        "representative_frames": """, f as (select distinct on (job_id, timestamp_ms) job_id, timestamp_ms as t, coalesce(sharpness, 0.0) as sharp, coalesce(text_score, 0.0) as text from frames),
m as (select board_id, t, sharp, text from f join board on board.job_id = f.job_id and t >= start_ms and t < end_ms),
n as (select *, max(sharp) over (partition by board_id) as top, 1 - abs(text - lag(text) over w) as l, 1 - abs(text - lead(text) over w) as r from m window w as (partition by board_id order by t)),
k as (select *, round(0.35::double * text + 0.45::double * least(1.0::double, sharp / case when top > 0 then top else 1.0 end) + 0.20::double * coalesce((l + r) / 2, l, r, 1.0::double), 9) as score from n)
select board_id, arg_max(t, (score, -t)) as timestamp_ms, max(score) as score, count(*) as n from k group by 1""",
        "entry_texts": """, k as (select id, list_filter(list_concat([coalesce(title, ''), coalesce(type, '')], list_transform(str_split(coalesce(body, ''), chr(10)), lambda x: trim(regexp_replace(x, '^[^:：]{1,20}[:：]', ''), ' '))), lambda x: x <> '') as x from en)
select id, array_to_string(x, chr(10)) as text from k""",
        "review_reuse": reports.SQL["case_changes"].removeprefix(r.SQL).rsplit(" select vn.job_id", 1)[0] + """, ch as (select vn.job_id, vn.case_id, coalesce(vn.a <> vo.a or vn.b <> vo.b, true) as changed from vn left join vo on vo.job_id = vn.job_id and vo.case_id = vn.case_id),
cc as (select course_id, case_id, bool_or(changed) as changed from ch join (select distinct job_id, course_id from jobs) using (job_id) group by 1, 2), er as (""" + reports.SQL["entry_reviews"].replace("with k as", "with k1 as").replace("left join k on k.", "left join k1 on k1.").replace("and k.case_id", "and k1.case_id").replace("and k.type", "and k1.type") + """)
select er.course_id, er.case_id, er.type, case when status = 'supported' and not coalesce(changed, true) then 'reuse' else 'redo' end as action from er left join cc on cc.course_id = er.course_id and cc.case_id = er.case_id""",
    }.items()
} | {
    "normalized_checks": cleaning.SQL["rewrite_metrics"].rsplit(" select job_id, count(*) as n,", 1)[0].replace("from seg where text is not null", "from seg where trim(text, ' ') <> ''") + f""", z as (select job_id, count(*) as n, count(distinct seg_id) as n_ids, count(*) filter (trim(clean, ' ') = '') as n_emptied, count(*) filter (clean <> text) as n_changed, count(*) filter (d or y or clean <> t{cleaning._N}) as n_noted from ruled group by 1),
w as (select *, n = n_ids as unique_ids, n_emptied = 0 as non_empty, n_changed > 0 as effective, n_noted >= n_changed as notes_cover_changes from z) select *, unique_ids and non_empty and effective and notes_cover_changes as passed from w""",
    "transcript_checks": reports.SQL["document_metrics"].rsplit(" select doc_id,", 1)[0] + f""", z as (select doc_id, n_chars, len(x) as n, cast({reports._MS.format('x[1]')} as bigint) as a, cast({reports._MS.format('x[-1]')} as bigint) as b from m where doc_id in (select doc_id from documents where source = 'transcript_export')),
w as (select doc_id, n > 0 as has_stamps, coalesce(a <= 60000, false) as early_start, coalesce(b >= a, false) as in_order, n_chars > 0 as has_text from z) select *, has_stamps and early_start and in_order and has_text as passed from w""",
    "search_with_fallback": f"{_FALL} select query_id, id, score, rank, found_by from hits",
    "answer_context": f"{_FALL} select query_id, rank, id, coalesce(title, '') as title, length(coalesce(body, '')) as chars, confidence from hits join en using (id)",
    "ocr_round_trip": """with k as (select distinct on (board_id) board_id, list_filter(list_transform(text_lines, lambda x: coalesce(x.text, '')), lambda t: length(trim(t, ' ')) > 1) as l from board_segments where len(text_lines) > 0),
h as (select board_id, unnest(l) as t, generate_subscripts(l, 1) as i from k), j as (select board_id, i, trim(substr(t, 1, length(t) // 2), ' ') || trim(substr(t, length(t) // 2 + 1), ' ') as text from h)
select board_id, row_number() over (partition by board_id order by i) - 1 as line_no, text, 0.9::double as confidence, false as low_confidence from j where text <> ''""",
}
