"""Queries of bundles, payload selection, versions, roll-ups and exports, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.operators import joins, lines
from lectern.operators.positions import even_samples, with_context
from lectern.plans import relations as r
from lectern.plans.cleaning import case_segments
from lectern.plans.texts import _placed, _ranges
from lectern.plans.timeline import align_max_overlap, orphan_boards
from lectern.sources.tables import table


def _cited(s, d):
    return r.evidence(s, d).select(F.col("evidence_id").alias("segment_id")).distinct().withColumn("hit", F.lit(True))


def _selected(s, d, around: int = 1):
    """Cited segments and ``around`` neighbours, with ``hit`` for the cited ones."""
    rows = r.course_segments(s, d).join(_cited(s, d), "segment_id", "left")
    return with_context(rows, ["job_id"], ["start_ms", "seg_id"], F.col("hit"), around, around, 900_000)


def case_bundles(s, d):
    """What a case's bundle holds: its segments, characters and stretch of time."""
    rows = case_segments(s, d).join(r.segments(s, d).drop("job_id"), "seg_id")
    return rows.groupBy("job_id", "case_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def external_payload(s, d):
    """Selection of each recording's payload: cited segments and one neighbour, how much of the citations it covers (1 where
    nothing is cited), what the redaction by patterns finds in it, and whether nothing is left to find afterwards."""
    kinds = {"phones": t.PHONE, "ids": t.IDENTITY, "emails": t.EMAIL}
    count = lambda c: [F.coalesce(F.regexp_count(c, F.lit(p)), F.lit(0)).cast("long").alias(k) for k, p in kinds.items()]
    own = _selected(s, d).select("job_id", "hit", *count(F.col("text")), sum(count(t.redact_patterns(F.col("text"))), F.lit(0)).alias("left"))
    picked = own.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_selected"), F.count("hit").alias("n_required_selected"), *[F.sum(k).alias(k) for k in kinds], (F.sum("left") == 0).alias("safe"))
    whole = r.course_segments(s, d).join(_cited(s, d), "segment_id", "left").groupBy("job_id").agg(F.count(F.lit(1)).alias("n_segments"), F.count("hit").alias("n_required"))
    rows = whole.join(picked, "job_id", "left").fillna(0, ["n_selected", "n_required_selected", *kinds]).fillna({"safe": True})
    return rows.withColumn("n_omitted", F.col("n_segments") - F.col("n_selected")).withColumn("coverage", F.coalesce(F.try_divide(F.col("n_required_selected").cast("double"), F.col("n_required").cast("double")), F.lit(1.0)))


def payload_compare(s, d):
    """Profiles of what is sent of each recording against all of it: segments, characters, tokens (3.5 characters each), and what is saved."""
    c = F.length(F.coalesce("text", F.lit(""))).cast("long").alias("c")
    full = r.course_segments(s, d).select("job_id", c).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("chars"))
    out = full.select("job_id", F.lit("full").alias("profile"), "n", "chars")
    for name, k in (("context_0", 0), ("context_1", 1)):
        out = out.unionByName(_selected(s, d, k).select("job_id", c).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("chars")).select("job_id", F.lit(name).alias("profile"), "n", "chars"))
    rows = out.join(full.select("job_id", F.col("n").alias("all_n"), F.col("chars").alias("all_chars")), "job_id")
    saved = lambda a, b: 1 - F.col(a).cast("double") / F.col(b).cast("double")
    return rows.select("job_id", "profile", "n", "chars", F.ceil(F.col("chars") / 3.5).alias("tokens"), saved("n", "all_n").alias("segments_saved"), F.coalesce(saved("chars", "all_chars"), F.lit(0.0)).alias("chars_saved"))


def entry_reviews(s, d):
    """The last entry of each type of a case as its review, by arrival; types that a case lacks are not reviewed."""
    rows = table(s, d, "knowledge_entries", "id", "course_id", "case_id", "type", "confidence", "ingested_at").where("case_id is not null")
    last = rows.groupBy("course_id", "case_id", "type").agg(F.max(F.struct("ingested_at", "id", F.coalesce("confidence", F.lit(-1.0)).alias("c"))).alias("k"))
    cases = rows.select("course_id", "case_id").distinct()
    wanted = cases.crossJoin(F.broadcast(s.createDataFrame([(k,) for k in ("observation", "risk", "response")], "type string")))  # three rows
    status = F.when(F.col("k").isNull(), "not_reviewed").when(F.col("k.c") >= 0.8, "supported").otherwise("uncertain")
    return wanted.join(last, ["course_id", "case_id", "type"], "left").select("course_id", "case_id", "type", status.alias("status"), F.col("k.id").alias("entry_id"))


def evidence_packages(s, d):
    """Each case's package: statements, distinct citations, those that exist, their stretch of time, and a hash of the ids."""
    have = r.course_segments(s, d).select(F.col("segment_id").alias("evidence_id"), "start_ms", "end_ms")
    rows = r.evidence(s, d).join(have, "evidence_id", "left")
    per = rows.groupBy("course_id", "case_id").agg(F.count_distinct("id").alias("n_statements"), F.count_distinct("evidence_id").alias("n_cited"), F.count_distinct(F.when(F.col("start_ms").isNotNull(), F.col("evidence_id"))).alias("n_found"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("evidence_id").alias("first_id"), F.max("evidence_id").alias("last_id"))
    return per.withColumn("hash", F.sha2(F.concat_ws("|", F.coalesce("course_id", F.lit("")), F.coalesce("case_id", F.lit("")), F.col("n_cited").cast("string"), "first_id", "last_id"), 256)).withColumn("complete", F.col("n_cited") == F.col("n_found"))


def _versions(s, d):
    """Ranges of cases by what scenarios cite (the version before) and by what any entry cites."""
    at = _placed(s, d).select(F.col("segment_id").alias("evidence_id"), "job_id", "pos")
    cited = r.evidence(s, d).join(r.entries(s, d).select("id", "type"), "id")
    side = lambda rows: rows.join(at, "evidence_id").groupBy("job_id", "case_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    return side(cited.where("type = 'scenario'")), side(cited)


def case_changes(s, d):
    """Whether a case's boundaries changed against the version before; a case that wasn't there has changed."""
    old, new = _versions(s, d)
    old = old.select("job_id", "case_id", F.col("a").alias("old_a"), F.col("b").alias("old_b"))
    return new.join(old, ["job_id", "case_id"], "left").select("job_id", "case_id", F.coalesce((F.col("a") != F.col("old_a")) | (F.col("b") != F.col("old_b")), F.lit(True)).alias("changed"))


def version_delta(s, d):
    """Segments that a version newly assigns to cases or no longer does, and the share left without a case, for each recording."""
    old, new = _versions(s, d)
    seg = _placed(s, d).select("job_id", F.col("pos").alias("start_ms"), (F.col("pos") + 1).alias("end_ms"), "seg_id")

    def held(rows, name):
        spans = rows.select("job_id", F.col("a").alias("start_ms"), (F.col("b") + 1).alias("end_ms"))
        return joins.overlap_pairs(seg, spans, "job_id", 256).select(F.col("l_seg_id").alias("seg_id")).distinct().withColumn(name, F.lit(1))

    rows = _placed(s, d).select("job_id", "seg_id").join(held(old, "was"), "seg_id", "left").join(held(new, "is"), "seg_id", "left")
    per = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("was").isNull() & F.col("is").isNotNull()).alias("newly_assigned"), F.count_if(F.col("was").isNotNull() & F.col("is").isNull()).alias("newly_open"), F.count_if(F.col("was").isNull()).alias("open_before"), F.count_if(F.col("is").isNull()).alias("open_now"))
    share = lambda c: F.col(c).cast("double") / F.col("n").cast("double")
    return per.withColumn("version", F.when(share("open_before") - share("open_now") >= 0.03, "new").otherwise("old"))


def media_duplicates(s, d):
    """Documents of one length and hash; the original is that of the course with the lowest ordinal (null last), then the lowest id."""
    docs = table(s, d, "documents", "doc_id", "text", "course_id").where("text is not null").withColumn("size", F.octet_length("text"))
    order = table(s, d, "courses", "course_id", "ordinal").dropDuplicates(["course_id"])
    shared = docs.groupBy("size").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("size")
    rows = docs.join(shared, "size").select("doc_id", "course_id", F.sha2("text", 256).alias("h")).join(order, "course_id", "left")
    key = F.struct(F.col("ordinal").isNull().alias("last"), "ordinal", "doc_id")
    first = rows.groupBy("h").agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", F.col("k.doc_id").alias("original"))
    return rows.join(first, "h").where("doc_id <> original").select("doc_id", "original")


def document_metrics(s, d):
    """All of a transcript's measures: bytes, lines, characters that aren't white space, time stamps, the first and the last time."""
    stamps = F.regexp_extract_all("text", F.lit(lines.STAMP), F.lit(0))
    rows = table(s, d, "documents", "doc_id", "text").where("text is not null")
    return rows.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.length(F.regexp_replace("text", r"[\t\n\x0B\f\r ]+", "")).cast("long").alias("n_chars"), F.size(stamps).cast("long").alias("n_stamps"),
        t.clock_ms(F.try_element_at(stamps, F.lit(1))).alias("first_ms"), t.clock_ms(F.try_element_at(stamps, F.lit(-1))).alias("last_ms"),
    )


def document_deltas(s, d):
    """Each document's measures against the one before it of its course and source."""
    rows = document_metrics(s, d).join(table(s, d, "documents", "doc_id", "course_id", "source", "created_at"), "doc_id").where("course_id is not null and source is not null")
    # a course has a bounded number of documents of a kind in a time; blocks of doc_id keep a large one apart
    from lectern.operators.ordered import blocked, with_neighbor

    rows = with_neighbor(blocked(rows, ["course_id", "source"], "doc_id", 1 << 20), ["course_id", "source"], ["doc_id"], ["n_bytes", "n_lines", "n_chars"], "prev").where("prev is not null")
    return rows.select("doc_id", *[(F.col(c) - F.col(f"prev.{c}")).alias(f"d_{c[2:]}") for c in ("n_bytes", "n_lines", "n_chars")])


def speaker_shares(s, d):
    rows = r.speech(s, d).groupBy("job_id", "speaker").agg(F.count(F.lit(1)).alias("n"))
    whole = rows.groupBy("job_id").agg(F.sum("n").alias("all"))
    return rows.join(whole, "job_id").select("job_id", "speaker", "n", (F.col("n").cast("double") / F.col("all").cast("double")).alias("share"))


def stage_seconds(s, d):
    rows = table(s, d, "jobs", "job_id", "created_at", "updated_at").dropDuplicates(["job_id"])
    sec = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return rows.select("job_id", (sec("updated_at") - sec("created_at")).alias("seconds"))


def job_rollup(s, d):
    """A course's state over its jobs: running before failed, completed only if all are, else pending."""
    rows = table(s, d, "jobs", "job_id", "course_id", "status").dropDuplicates(["job_id"])
    has = lambda k: F.bool_or(F.col("status") == k)
    per = rows.groupBy("course_id").agg(F.count(F.lit(1)).alias("n"), has("running").alias("run"), has("failed").alias("fail"), F.bool_and(F.col("status") == "completed").alias("done"))
    return per.select("course_id", "n", F.when(F.col("run"), "running").when(F.col("fail"), "failed").when(F.col("done"), "completed").otherwise("pending").alias("status"))


def case_flags(s, d):
    """Flags of a recording's cases by their sizes: too fragmented, a single one too narrow or too wide."""
    sizes = _ranges(s, d).select("job_id", (F.col("b") - F.col("a") + 1).alias("size"))
    n = _placed(s, d).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_segments"))
    rows = sizes.join(n, "job_id").withColumn("tiny", (F.col("size") < F.greatest(F.lit(50), F.floor(F.col("n_segments") * 0.02))).cast("long"))
    # the upper median by rank; cases of a recording are few beside its segments
    w = Window.partitionBy("job_id")
    rows = rows.withColumn("rn", F.row_number().over(w.orderBy("size"))).withColumn("k", F.count(F.lit(1)).over(w))
    per = rows.groupBy("job_id").agg(F.max("k").alias("n_cases"), F.max("n_segments").alias("n_segments"), F.sum("tiny").alias("n_tiny"), F.max(F.when(F.expr("rn = k div 2 + 1"), F.col("size"))).alias("median"), F.sum("size").alias("assigned"))
    open_ = F.greatest(F.lit(0.0), 1 - F.col("assigned").cast("double") / F.col("n_segments").cast("double"))
    flags = F.array_compact(F.array(
        F.when(F.col("n_tiny") >= F.greatest(F.lit(2), F.expr("n_cases div 2")), "case_boundaries_too_fragmented"), F.when((F.col("n_cases") == 1) & (open_ > 0.35), "case_boundaries_possibly_too_narrow"),
        F.when((F.col("n_cases") == 1) & (F.col("median") > 0.85 * F.col("n_segments")), "case_boundaries_possibly_too_wide"),
    ))
    return per.select("job_id", "n_cases", "median", "n_tiny", F.array_join(flags, ",").alias("flags"))


def course_quality(s, d):
    """One row for each course: recordings, segments, unknown speakers, boards, entries, and flags."""
    jobs = table(s, d, "jobs", "job_id", "course_id", "status").dropDuplicates(["job_id"])
    out = jobs.groupBy("course_id").agg(F.count(F.lit(1)).alias("n_jobs"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    own = jobs.select("job_id", "course_id")
    parts = {
        "n_segments": r.segments(s, d).join(own, "job_id").groupBy("course_id").agg(F.count(F.lit(1)).alias("n_segments")),
        "n_speech": r.speech(s, d).join(own, "job_id").groupBy("course_id").agg(F.count(F.lit(1)).alias("n_speech"), F.count_if(F.col("speaker") == "unknown").alias("n_unknown")),
        "n_boards": r.boards(s, d).join(own, "job_id").groupBy("course_id").agg(F.count(F.lit(1)).alias("n_boards")),
        "n_entries": r.entries(s, d).groupBy("course_id").agg(F.count(F.lit(1)).alias("n_entries")),
    }
    for part in parts.values():
        out = out.join(part, "course_id", "left")
    out = out.fillna(0)
    ratio = F.coalesce(F.try_divide(F.col("n_unknown").cast("double"), F.col("n_speech").cast("double")), F.lit(0.0))
    flags = F.array_compact(F.array(F.when(F.col("n_failed") > 0, "failed_jobs"), F.when(F.col("n_segments") == 0, "no_transcript"), F.when(ratio > 0.10, "unknown_speakers"), F.when(F.col("n_boards") == 0, "no_boards"), F.when(F.col("n_entries") == 0, "no_entries")))
    return out.withColumn("unknown_ratio", ratio).withColumn("flags", F.array_join(flags, ","))


def quality_totals(s, d):
    rows = course_quality(s, d)
    sums = ("n_jobs", "n_failed", "n_segments", "n_speech", "n_unknown", "n_boards", "n_entries")
    return rows.agg(F.count(F.lit(1)).alias("n_courses"), *[F.sum(c).alias(c) for c in sums], F.count_if(F.col("flags") == "").alias("n_clean"), F.bool_and(F.col("n_failed") == 0).alias("all_ended"))


def page_misses(s, d):
    """Pages of a recording, and the share of them during which nobody speaks: what an export by speech would miss."""
    boards = r.boards(s, d).drop("region").where("version_id is not null")
    shown = joins.overlap_pairs(boards, r.segments(s, d).drop("text"), "job_id").select("job_id", F.col("l_version_id").alias("version_id")).distinct()
    refs = boards.select("job_id", "version_id").distinct()
    lost = refs.join(shown, ["job_id", "version_id"], "left_anti").groupBy("job_id").agg(F.count(F.lit(1)).alias("n_missed"))
    per = refs.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_pages")).join(lost, "job_id", "left").fillna(0)
    return per.withColumn("miss_rate", F.col("n_missed").cast("double") / F.col("n_pages").cast("double"))


def alignment_methods(s, d):
    """How each recording's segments got their speaker, and the milliseconds behind it."""
    rows = align_max_overlap(s, d).join(r.segments(s, d).select("seg_id", "job_id"), "seg_id")
    return rows.groupBy("job_id", "match_method").agg(F.count(F.lit(1)).alias("n"), F.sum("overlap_ms").alias("overlap_ms"))


def speech_preview(s, d):
    """Rows of the preview: the speaker's name where one is given and the speaker is known, else the speaker."""
    rows = table(s, d, "speech_segments", "speech_id", "job_id", "speaker_id", "speaker_name").dropDuplicates(["speech_id"]).withColumn("name", F.nullif(F.trim("speaker_name"), F.lit("")))
    names = rows.where("speaker_id is not null and lower(trim(speaker_id)) <> 'unknown'").groupBy("job_id", "speaker_id").agg(F.max("name").alias("shown"))
    own = r.speech(s, d).select("speech_id", "job_id", "start_ms", "end_ms", "speaker_id", "text")
    return own.join(names, ["job_id", "speaker_id"], "left").select("speech_id", "start_ms", "end_ms", F.coalesce("shown", "speaker_id", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))


def timeline_rows(s, d):
    """Segments and, as rows of their own, boards during which nobody speaks."""
    said = r.segments(s, d).select("job_id", "start_ms", "end_ms", F.lit("speech").alias("kind"), F.col("seg_id").alias("id"))
    return said.unionByName(orphan_boards(s, d).select("job_id", "start_ms", "end_ms", F.lit("board").alias("kind"), F.col("board_id").alias("id")))


def timeline_json(s, d):
    """A line of JSON for each segment, with its boards in order."""
    pairs = joins.overlap_pairs(r.segments(s, d).drop("text"), r.boards(s, d).drop("region"), "job_id")
    held = pairs.groupBy(F.col("l_seg_id").alias("seg_id")).agg(F.sort_array(F.collect_list(F.struct("r_start_ms", "r_board_id"))).alias("b"))
    rows = r.segments(s, d).join(held, "seg_id", "left")
    ids = F.coalesce(F.transform("b", lambda x: x["r_board_id"]), F.array().cast("array<long>"))
    return rows.select("seg_id", F.to_json(F.struct("start_ms", "end_ms", F.coalesce("text", F.lit("")).alias("text"), ids.alias("boards"))).alias("line"))


def frame_upsert(s, d):
    """Of frames that come twice the row that arrived last, whole; of one arrival the larger row."""
    rows = table(s, d, "frames", "job_id", "timestamp_ms", "frame_index", "image_path", "ocr_text", "ingested_at")
    return rows.groupBy("job_id", "timestamp_ms").agg(F.max(F.struct("ingested_at", "frame_index", "image_path", "ocr_text")).alias("k")).select("job_id", "timestamp_ms", "k.frame_index", "k.image_path", "k.ocr_text")


def latest_imports(s, d):
    """The newest source file of each case, and how many were imported."""
    rows = table(s, d, "knowledge_entries", "course_id", "case_id", "source_path", "ingested_at").where("case_id is not null and source_path is not null")
    return rows.groupBy("course_id", "case_id").agg(F.max_by("source_path", F.struct("ingested_at", "source_path")).alias("source_path"), F.count_distinct("source_path").alias("n_files"))


def corrected_lines(s, d):
    """Lines of boards with their correction laid over them; blank corrections leave the text."""
    rows = table(s, d, "board_segments", "board_id", "text_lines").dropDuplicates(["board_id"]).select("board_id", F.posexplode("text_lines").alias("line_no", "x"))
    fix = F.nullif(F.trim("x.corrected_text"), F.lit(""))
    return rows.select("board_id", F.col("line_no").cast("long").alias("line_no"), F.coalesce(fix, "x.text").alias("line"), F.coalesce(fix != F.col("x.text"), F.lit(False)).alias("mended"))


def name_revisions(s, d):
    """Names of speakers after a revision: of each job's names by arrival the later one counts, and a blank one takes the name away."""
    rows = table(s, d, "speech_segments", "job_id", "speaker_id", "speaker_name", "ingested_at", "speech_id").where("speaker_id is not null and speaker_name is not null")
    last = rows.groupBy("job_id", "speaker_id").agg(F.max_by(F.trim("speaker_name"), F.struct("ingested_at", "speech_id", "speaker_name")).alias("name"))
    return last.where("name <> ''")


def speaker_profiles(s, d):
    """Five evenly spread segments of each speaker of a recording, for review."""
    rows = even_samples(r.speech(s, d).drop("text"), ["job_id", "speaker"], ["start_ms", "speech_id"], 5, 900_000)
    return rows.select("job_id", "speaker", "pos", "speech_id")


def cluster_restores(s, d):
    """Segments whose speaker's spelling differs from the canonical one, and all, by canonical speaker."""
    rows = r.speech(s, d)
    return rows.groupBy("job_id", "speaker").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("speaker_id").eqNullSafe(F.col("speaker"))).alias("n_changed"))


def case_set_equality(s, d):
    """Whether the cases of a course that cite something are all of its cases, and how many don't."""
    all_ = r.entries(s, d).where("case_id is not null").select("course_id", "case_id").distinct()
    cited = r.evidence(s, d).where("case_id is not null").select("course_id", "case_id").distinct().withColumn("c", F.lit(1))
    per = all_.join(cited, ["course_id", "case_id"], "left").groupBy("course_id").agg(F.count(F.lit(1)).alias("n"), F.count("c").alias("n_citing"))
    return per.withColumn("equal", F.col("n") == F.col("n_citing"))


def pending_jobs(s, d):
    """What a resumed run has to do: recordings that aren't completed, and those of which no text was read."""
    jobs = table(s, d, "jobs", "job_id", "status").dropDuplicates(["job_id"])
    done = r.segments(s, d).select("job_id").distinct().withColumn("has", F.lit(True))
    return jobs.join(done, "job_id", "left").where("status <> 'completed' or has is null").select("job_id", F.when(F.col("has").isNull(), "transcript").otherwise("rest").alias("stage"))


def entry_sections(s, d):
    """Entries as Markdown: front matter, title, a section for each kind of statement in a fixed order (a dash where there is none), and the evidence."""
    titles = {"观察": "Observation", "主张": "Claim", "场景": "Scenario", "风险": "Risk", "回应": "Response", "阶段": "Stage"}
    body = F.split(F.coalesce("body", F.lit("")), "\n")
    blank = r"[\t\r \x{A0}\x{3000}]*"
    section = lambda k: F.filter(F.transform(body, lambda x: F.regexp_extract(x, rf"^[ \t]*(?:{k}|{titles[k]})[ \t]*[:：]{blank}([^\n]*?){blank}\z", 1)), lambda x: x != "")
    part = lambda k: F.concat(F.lit(f"## {k}\n\n"), F.when(F.size(section(k)) > 0, F.array_join(F.transform(section(k), lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("- 无"))
    cited = F.coalesce(F.from_json("evidence_json", "array<string>"), F.array().cast("array<string>"))
    head = F.concat(F.lit("---\nid: "), F.col("id"), F.lit("\ntype: "), F.coalesce("type", F.lit("")), F.lit("\ncase_id: "), F.coalesce("case_id", F.lit("")), F.lit("\n---\n\n# "), F.coalesce("title", F.lit("")))
    proof = F.concat(F.lit("## evidence\n\n"), F.array_join(F.transform(cited, lambda x: F.concat(F.lit("- "), x)), "\n"))
    return r.entries(s, d).select("id", F.array_join(F.array(head, *[part(k) for k in titles], proof), "\n\n").alias("markdown"))


def front_matter(s, d):
    """Keys and values between the marks at the head of an entry's Markdown, of the allowed keys."""
    from lectern.plans.exports import entry_markdown

    head = F.slice(F.split("markdown", "\n"), 2, 39)
    rows = entry_markdown(s, d).select("id", F.explode(F.slice(head, 1, F.greatest(F.lit(0), (F.array_position(head, "---") - 1).cast("int")))).alias("x"))
    key = F.trim(F.substring_index("x", ":", 1))
    value = F.trim(F.expr("substring(x, instr(x, ':') + 1)"))
    return rows.where(F.col("x").contains(":")).select("id", key.alias("key"), value.alias("value")).where("key in ('id', 'course_id', 'case_id', 'type') and value <> ''")


QUERIES = {
    f.__name__: f
    for f in (
        case_bundles, external_payload, payload_compare, entry_reviews, evidence_packages, case_changes, version_delta, media_duplicates, document_metrics, document_deltas, speaker_shares, stage_seconds, job_rollup, case_flags,
        course_quality, quality_totals, page_misses, alignment_methods, speech_preview, timeline_rows, timeline_json, frame_upsert, latest_imports, corrected_lines, name_revisions, speaker_profiles, cluster_restores, case_set_equality,
        pending_jobs, entry_sections, front_matter,
    )
}

_PL = ", pl as (select segment_id as evidence_id, segment_id, job_id, seg_id, text, row_number() over (partition by job_id order by start_ms, seg_id) as pos from cs)"
_RG = f"{_PL}, rg as (select job_id, case_id, min(pos) as a, max(pos) as b from ev join pl using (evidence_id) group by 1, 2)"
_SEL = f"""{_PL}, h as (select *, segment_id in (select evidence_id from ev) as hit from pl), c as (select *, max(hit::int) over (partition by job_id order by pos rows between 1 preceding and 1 following) = 1 as near from h)"""
_VER = f"""{_PL}, vo as (select job_id, case_id, min(pos) as a, max(pos) as b from ev join en using (id) join pl using (evidence_id) where en.type = 'scenario' group by job_id, ev.case_id, case_id),
vn as (select job_id, case_id, min(pos) as a, max(pos) as b from ev join pl using (evidence_id) group by 1, 2)"""
_VER = _VER.replace("ev join en using (id) join pl using (evidence_id) where en.type = 'scenario' group by job_id, ev.case_id, case_id", "(select ev.id, ev.case_id, evidence_id from ev join en on en.id = ev.id where en.type = 'scenario') join pl using (evidence_id) group by 1, 2")
_PII = {"phones": "1[3-9][0-9]{9}[Xx]?", "ids": "[0-9]{17}[0-9Xx]"}
_QUALITY = """, j as (select distinct job_id, course_id, status from jobs), a as (select course_id, count(*) as n_jobs, count(*) filter (status = 'failed') as n_failed from j group by 1),
b as (select course_id, count(*) as n_segments from seg join j using (job_id) group by 1), c as (select course_id, count(*) as n_speech, count(*) filter (speaker = 'unknown') as n_unknown from sp join j using (job_id) group by 1),
e as (select course_id, count(*) as n_boards from board join j using (job_id) group by 1), f as (select course_id, count(*) as n_entries from en group by 1),
g as (select course_id, n_jobs, n_failed, coalesce(n_segments, 0) as n_segments, coalesce(n_speech, 0) as n_speech, coalesce(n_unknown, 0) as n_unknown, coalesce(n_boards, 0) as n_boards, coalesce(n_entries, 0) as n_entries
 from a left join b using (course_id) left join c using (course_id) left join e using (course_id) left join f using (course_id)),
q as (select *, case when n_speech = 0 then 0.0 else n_unknown::double / n_speech end as unknown_ratio from g),
quality as (select *, concat_ws(',', case when n_failed > 0 then 'failed_jobs' end, case when n_segments = 0 then 'no_transcript' end, case when unknown_ratio > 0.10 then 'unknown_speakers' end, case when n_boards = 0 then 'no_boards' end, case when n_entries = 0 then 'no_entries' end) as flags from q)"""
_OVER = "l.job_id = r.job_id and l.start_ms < r.end_ms and r.start_ms < l.end_ms and l.start_ms < l.end_ms and r.start_ms < r.end_ms"
_STAMP = "[0-9]{2,}:[0-9]{2}:[0-9]{2}\\.[0-9]{3}"
_MS = "list_aggregate(list_transform(str_split(replace({0}, '.', ':'), ':'), lambda x, i: cast(x as bigint) * [3600000, 60000, 1000, 1][i]), 'sum')"
_DOCS = f"""with m as (select doc_id, octet_length(encode(text)) as n_bytes, len(str_split(text, chr(10))) as n_lines, length(regexp_replace(text, '[\\t\\n\\x0B\\f\\r ]+', '', 'g')) as n_chars, regexp_extract_all(text, '{_STAMP}') as x from documents where text is not null)"""
_SECTION = "list_filter(list_transform(str_split(coalesce(body, ''), chr(10)), lambda x: regexp_extract(x, '^[ \\t]*(?:{0}|{1})[ \\t]*[:：][\\t\\r \\x{{A0}}\\x{{3000}}]*([^\\n]*?)[\\t\\r \\x{{A0}}\\x{{3000}}]*\\z', 1)), lambda x: x <> '')"
_PARTS = " || ".join(f"chr(10) || chr(10) || '## {k}' || chr(10) || chr(10) || case when len({_SECTION.format(k, e)}) > 0 then array_to_string(list_transform({_SECTION.format(k, e)}, lambda x: '- ' || x), chr(10)) else '- 无' end" for k, e in (("观察", "Observation"), ("主张", "Claim"), ("场景", "Scenario"), ("风险", "Risk"), ("回应", "Response"), ("阶段", "Stage")))

SQL = {
    k: r.SQL + v
    for k, v in {
        "case_bundles": f"{_RG} select rg.job_id, case_id, count(*) as n, cast(sum(length(coalesce(pl.text, ''))) as bigint) as chars, min(start_ms) as start_ms, max(end_ms) as end_ms from pl join rg on pl.job_id = rg.job_id and pos between a and b join seg on seg.seg_id = pl.seg_id group by 1, 2",
        "external_payload": f"""{_SEL}, k as (select job_id, hit, near, regexp_extract_all(text, '[0-9]+[Xx]?') as runs, text from c),
p as (select job_id, hit, near, coalesce(len(list_filter(runs, lambda x: regexp_full_match(x, '1[3-9][0-9]{{9}}[Xx]?'))), 0) as phones, coalesce(len(list_filter(runs, lambda x: regexp_full_match(x, '[0-9]{{17}}[0-9Xx]') or regexp_full_match(x, '[0-9]{{18}}[Xx]'))), 0) as ids,
 coalesce(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')), 0) as emails from k),
s as (select job_id, count(*) as n_segments, count(*) filter (hit) as n_required, count(*) filter (near) as n_selected, count(*) filter (near and hit) as n_required_selected,
 cast(coalesce(sum(phones) filter (near), 0) as bigint) as phones, cast(coalesce(sum(ids) filter (near), 0) as bigint) as ids, cast(coalesce(sum(emails) filter (near), 0) as bigint) as emails from p group by 1)
select *, true as safe, n_segments - n_selected as n_omitted, case when n_required = 0 then 1.0 else n_required_selected::double / n_required end as coverage from s""",
        "payload_compare": f"""{_SEL}, u as (select job_id, 'full' as profile, length(coalesce(text, '')) as x from c union all select job_id, 'context_0', length(coalesce(text, '')) from c where hit union all select job_id, 'context_1', length(coalesce(text, '')) from c where near),
g as (select job_id, profile, count(*) as n, cast(sum(x) as bigint) as chars from u group by 1, 2), f as (select job_id, n as an, chars as ac from g where profile = 'full')
select job_id, profile, n, chars, cast(ceil(chars / 3.5) as bigint) as tokens, 1 - n::double / an as segments_saved, case when ac = 0 then 0.0 else 1 - chars::double / ac end as chars_saved from g join f using (job_id)""",
        "evidence_packages": """, k as (select ev.course_id, case_id, count(distinct id) as n_statements, count(distinct evidence_id) as n_cited, count(distinct segment_id) as n_found, min(start_ms) as start_ms, max(end_ms) as end_ms, min(evidence_id) as first_id, max(evidence_id) as last_id from ev left join cs on segment_id = evidence_id group by 1, 2)
select *, sha256(coalesce(course_id, '') || '|' || coalesce(case_id, '') || '|' || n_cited || '|' || first_id || '|' || last_id) as hash, n_cited = n_found as complete from k""",
        "case_changes": f"{_VER} select vn.job_id, vn.case_id, coalesce(vn.a <> vo.a or vn.b <> vo.b, true) as changed from vn left join vo on vo.job_id = vn.job_id and vo.case_id = vn.case_id",
        "version_delta": f"""{_VER}, x as (select job_id, exists (select 1 from vo where vo.job_id = pl.job_id and pl.pos between vo.a and vo.b) as was, exists (select 1 from vn where vn.job_id = pl.job_id and pl.pos between vn.a and vn.b) as is_ from pl),
y as (select job_id, count(*) as n, count(*) filter (not was and is_) as newly_assigned, count(*) filter (was and not is_) as newly_open, count(*) filter (not was) as open_before, count(*) filter (not is_) as open_now from x group by 1)
select *, case when open_before::double / n - open_now::double / n >= 0.03 then 'new' else 'old' end as version from y""",
        "speaker_shares": " select job_id, speaker, count(*) as n, count(*)::double / sum(count(*)) over (partition by job_id) as share from sp group by 1, 2",
        "case_flags": f"""{_RG}, n as (select job_id, count(*) as ns from pl group by 1), z as (select rg.job_id, b - a + 1 as size, ns from rg join n on n.job_id = rg.job_id),
y as (select job_id, count(*) as n_cases, list_sort(list(size))[count(*) // 2 + 1] as median, count(*) filter (size < greatest(50, cast(floor(ns * 0.02) as bigint))) as n_tiny, max(ns) as ns, greatest(0.0::double, 1 - sum(size)::double / max(ns)) as open from z group by 1)
select job_id, n_cases, median, n_tiny, concat_ws(',', case when n_tiny >= greatest(2, n_cases // 2) then 'case_boundaries_too_fragmented' end, case when n_cases = 1 and open > 0.35 then 'case_boundaries_possibly_too_narrow' end, case when n_cases = 1 and median > 0.85 * ns then 'case_boundaries_possibly_too_wide' end) as flags from y""",
        "course_quality": f"{_QUALITY} select * from quality",
        "quality_totals": f"""{_QUALITY} select count(*) as n_courses, cast(sum(n_jobs) as bigint) as n_jobs, cast(sum(n_failed) as bigint) as n_failed, cast(sum(n_segments) as bigint) as n_segments, cast(sum(n_speech) as bigint) as n_speech, cast(sum(n_unknown) as bigint) as n_unknown,
cast(sum(n_boards) as bigint) as n_boards, cast(sum(n_entries) as bigint) as n_entries, count(*) filter (flags = '') as n_clean, bool_and(n_failed = 0) as all_ended from quality""",
        "page_misses": f""", p as (select distinct job_id, version_id from board where version_id is not null and job_id is not null), s as (select distinct l.job_id, l.version_id from board l join seg r on {_OVER})
select p.job_id, count(*) as n_pages, count(*) filter (s.version_id is null) as n_missed, count(*) filter (s.version_id is null)::double / count(*) as miss_rate from p left join s on s.job_id = p.job_id and s.version_id = p.version_id group by 1""",
        "alignment_methods": """, sums as (select l.seg_id, r.speaker_id, cast(sum(least(l.end_ms, r.end_ms) - greatest(l.start_ms, r.start_ms)) as bigint) as ms from seg l join turn r on """ + _OVER + """ group by 1, 2),
k as (select *, row_number() over (partition by seg_id order by ms desc, speaker_id) as rn, count(*) over (partition by seg_id, ms) as ties from sums),
b as (select seg.job_id, greatest(1, end_ms - start_ms) as dur, ms, ties from seg left join k on k.seg_id = seg.seg_id and rn = 1)
select job_id, case when ms is null then 'no_overlap' when ties > 1 then 'equal_overlap' when ms::double / dur < 0.5 then 'below_threshold' else 'max_overlap' end as match_method, count(*) as n, cast(sum(coalesce(ms, 0)) as bigint) as overlap_ms from b group by 1, 2""",
        "speech_preview": """, q as (select distinct on (speech_id) * from speech_segments), n as (select job_id, speaker_id, max(nullif(trim(speaker_name), '')) as shown from q where speaker_id is not null and lower(trim(speaker_id)) <> 'unknown' group by 1, 2)
select speech_id, start_ms, end_ms, coalesce(shown, speaker_id, 'unknown') as speaker, coalesce(text, '') as text from sp left join n using (job_id, speaker_id)""",
        "timeline_rows": f" select job_id, start_ms, end_ms, 'speech' as kind, seg_id as id from seg union all select job_id, start_ms, end_ms, 'board' as kind, board_id as id from board l where not exists (select 1 from seg r where {_OVER})",
        "timeline_json": f""", b as (select l.seg_id, list(r.board_id order by r.start_ms, r.board_id) as ids from seg l join board r on {_OVER} group by 1)
select seg.seg_id, to_json({{'start_ms': start_ms, 'end_ms': end_ms, 'text': coalesce(text, ''), 'boards': coalesce(ids, [])}})::varchar as line from seg left join b on b.seg_id = seg.seg_id""",
        "speaker_profiles": """, k as (select job_id, speaker, speech_id, row_number() over w as pos, count(*) over (partition by job_id, speaker) as n from sp window w as (partition by job_id, speaker order by start_ms, speech_id)),
i as (select distinct job_id, speaker, case when n <= 5 then i + 1 else cast(round_even(i * (n - 1) / 4.0, 0) as bigint) + 1 end as pos from (select distinct job_id, speaker, n from k), range(5) as t(i) where n > 5 or i < n)
select job_id, speaker, pos, speech_id from k join i using (job_id, speaker, pos)""",
        "cluster_restores": " select job_id, speaker, count(*) as n, count(*) filter (speaker_id is distinct from speaker) as n_changed from sp group by 1, 2",
        "case_set_equality": """, a as (select distinct course_id, case_id from en where case_id is not null), c as (select distinct course_id, case_id, 1 as c from ev where case_id is not null)
select a.course_id, count(*) as n, count(c) as n_citing, count(*) = count(c) as equal from a left join c using (course_id, case_id) group by 1""",
        "pending_jobs": """, j as (select distinct on (job_id) job_id, status from jobs), h as (select distinct job_id, true as has from seg)
select job_id, case when has is null then 'transcript' else 'rest' end as stage from j left join h using (job_id) where status <> 'completed' or has is null""",
        "entry_sections": f""", k as (select *, coalesce(from_json(evidence_json, '["VARCHAR"]'), []) as c from en)
select id, '---' || chr(10) || 'id: ' || id || chr(10) || 'type: ' || coalesce(type, '') || chr(10) || 'case_id: ' || coalesce(case_id, '') || chr(10) || '---' || chr(10) || chr(10) || '# ' || coalesce(title, '') || {_PARTS}
|| chr(10) || chr(10) || '## evidence' || chr(10) || chr(10) || coalesce(array_to_string(list_transform(c, lambda x: '- ' || x), chr(10)), '') as markdown from k""",
        "front_matter": """ select id, 'id' as key, trim(id) as value from en union all select id, 'course_id', trim(course_id) from en where trim(course_id) <> '' union all select id, 'case_id', trim(case_id) from en where trim(case_id) <> '' union all select id, 'type', trim(type) from en where trim(type) <> ''""",
    }.items()
} | {
    "entry_reviews": """with k as (select course_id, case_id, type, id, confidence, row_number() over (partition by course_id, case_id, type order by ingested_at desc, id desc, coalesce(confidence, -1) desc) as rn from knowledge_entries where case_id is not null),
w as (select distinct course_id, case_id, t.type from knowledge_entries, (values ('observation'), ('risk'), ('response')) as t(type) where case_id is not null)
select w.course_id, w.case_id, w.type, case when id is null then 'not_reviewed' when confidence >= 0.8 then 'supported' else 'uncertain' end as status, id as entry_id from w left join k on k.course_id is not distinct from w.course_id and k.case_id = w.case_id and k.type = w.type and rn = 1""",
    "media_duplicates": """with k as (select doc_id, text, course_id from documents where text is not null), o as (select distinct course_id, ordinal from courses),
m as (select doc_id, first_value(doc_id) over (partition by text order by ordinal is null, ordinal, doc_id) as original from k left join o using (course_id)) select * from m where doc_id <> original""",
    "document_metrics": f"{_DOCS} select doc_id, n_bytes, n_lines, n_chars, len(x) as n_stamps, cast({_MS.format('x[1]')} as bigint) as first_ms, cast({_MS.format('x[-1]')} as bigint) as last_ms from m",
    "document_deltas": f"""{_DOCS}, k as (select m.*, course_id, source from m join documents using (doc_id) where course_id is not null and source is not null),
p as (select doc_id, n_bytes - lag(n_bytes) over w as d_bytes, n_lines - lag(n_lines) over w as d_lines, n_chars - lag(n_chars) over w as d_chars from k window w as (partition by course_id, source order by doc_id)) select * from p where d_bytes is not null""",
    "stage_seconds": "select distinct job_id, epoch_ms(updated_at) // 1000 - epoch_ms(created_at) // 1000 as seconds from jobs",
    "job_rollup": """with j as (select distinct job_id, course_id, status from jobs)
select course_id, count(*) as n, case when bool_or(status = 'running') then 'running' when bool_or(status = 'failed') then 'failed' when bool_and(status = 'completed') then 'completed' else 'pending' end as status from j group by 1""",
    "frame_upsert": """with k as (select *, row_number() over (partition by job_id, timestamp_ms order by ingested_at desc, frame_index desc nulls last, image_path desc nulls last, ocr_text desc nulls last) as rn from frames)
select job_id, timestamp_ms, frame_index, image_path, ocr_text from k where rn = 1""",
    "latest_imports": "select course_id, case_id, arg_max(source_path, (ingested_at, source_path)) as source_path, count(distinct source_path) as n_files from knowledge_entries where case_id is not null and source_path is not null group by 1, 2",
    "corrected_lines": """with k as (select distinct on (board_id) * from board_segments), l as (select board_id, unnest(text_lines) as x, generate_subscripts(text_lines, 1) - 1 as line_no from k)
select board_id, line_no, coalesce(nullif(trim(x.corrected_text), ''), x.text) as line, coalesce(nullif(trim(x.corrected_text), '') <> x.text, false) as mended from l""",
    "name_revisions": """with k as (select job_id, speaker_id, arg_max(trim(speaker_name), (ingested_at, speech_id, speaker_name)) as name from speech_segments where speaker_id is not null and speaker_name is not null group by 1, 2) select * from k where name <> ''""",
}
