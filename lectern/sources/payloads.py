"""Raw outputs of recognisers as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASR = "array<struct<text string, timestamp array<array<long>>, sentence_info array<struct<text string, raw_text string, start long, end long, timestamp array<array<long>>, spk string, speaker string>>>>"
PAGE = "rec_texts array<string>, rec_scores array<double>, rec_polys array<array<array<double>>>, dt_polys array<array<array<double>>>"
BOX = "struct<text string, score double, poly array<array<double>>>"
CONTENT = r"[\p{L}\p{N}_]"


def frame_rate(text: Column) -> Column:
    """``a/b`` or a number as double; 0 where the denominator is 0 or nothing can be read."""
    part = F.split(text, "/")
    a, b = F.try_element_at(part, F.lit(1)).try_cast("double"), F.coalesce(F.try_element_at(part, F.lit(2)), F.lit("1")).try_cast("double")
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def words(text: Column, stamps: Column) -> Column:
    """Units of the text with their times: tokens where there are as many as times, else characters."""
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    chars = F.filter(F.split(F.regexp_replace(text, r"\s+", ""), ""), lambda x: x != "")
    units = F.when(F.size(tokens) == F.size(stamps), tokens).otherwise(chars)
    pairs = F.filter(F.arrays_zip(units.alias("text"), stamps.alias("t")), lambda w: w["text"].isNotNull() & w["t"].isNotNull())
    return F.transform(pairs, lambda w: F.struct(w["t"][0].alias("start_ms"), w["t"][1].alias("end_ms"), w["text"].alias("text")))


def transcripts(raw: DataFrame) -> DataFrame:
    """(job_id, start_ms, end_ms, text, raw_text, words) of column ``raw`` (JSON): sentences, or the whole
    utterance where there are none. Texts without letters and digits, bad times and what isn't JSON are left out."""
    one = raw.select("job_id", F.explode(F.from_json("raw", ASR)).alias("u"))
    whole = F.array(F.struct(F.col("u.text").alias("text"), F.col("u.text").alias("raw_text"), F.col("u.timestamp")[0][0].alias("start"), F.element_at(F.try_element_at(F.col("u.timestamp"), F.lit(-1)), 2).alias("end"), F.col("u.timestamp").alias("timestamp"), F.lit(None).cast("string").alias("spk"), F.lit(None).cast("string").alias("speaker")))
    rows = one.select("job_id", F.explode(F.when(F.size("u.sentence_info") > 0, F.col("u.sentence_info")).otherwise(whole)).alias("s")).select("job_id", "s.*")
    good = rows.where(F.col("text").rlike(CONTENT) & (F.col("start") >= 0) & (F.col("end") > F.col("start")))
    return good.select("job_id", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), F.trim("text").alias("text"), F.coalesce("raw_text", "text").alias("raw_text"), words(F.col("text"), F.col("timestamp")).alias("words"))


def diarization(raw: DataFrame) -> DataFrame:
    """(job_id, start_ms, end_ms, speaker_id) of rows (job_id, start, end in seconds, label): noise (-1) and
    bad times are left out, and labels are numbered from 0 by first appearance."""
    ms = lambda c: F.bround(F.col(c) * 1000).cast("long")
    rows = raw.select("job_id", ms("start").alias("start_ms"), ms("end").alias("end_ms"), F.col("label").cast("string").alias("label"))
    rows = rows.where((F.col("start_ms") >= 0) & (F.col("end_ms") > F.col("start_ms")) & F.col("label").isNotNull() & ~F.coalesce(F.col("label").try_cast("int") == -1, F.lit(False)))
    first = rows.groupBy("job_id", "label").agg(F.min(F.struct("start_ms", "end_ms", "label")).alias("k"))
    # a recording has a handful of labels
    first = first.select("job_id", "label", F.concat(F.lit("speaker_"), F.dense_rank().over(Window.partitionBy("job_id").orderBy("k")) - 1).alias("speaker_id"))
    return rows.join(first, ["job_id", "label"]).select("job_id", "start_ms", "end_ms", "speaker_id")


def campplus_turns(raw: DataFrame) -> DataFrame:
    """:func:`diarization` of column ``raw`` (JSON): a turn for each sentence, by its spk, else speaker."""
    one = raw.select("job_id", F.explode(F.from_json("raw", ASR)).alias("u")).select("job_id", F.explode("u.sentence_info").alias("s"))
    return diarization(one.select("job_id", (F.col("s.start") / 1000).alias("start"), (F.col("s.end") / 1000).alias("end"), F.coalesce("s.spk", "s.speaker").alias("label")))


def ocr_boxes(raw: Column) -> Column:
    """Boxes (text, score, poly) of an OCR payload (JSON); what is no known shape raises an error.

    Known are a page (rec_texts, rec_scores, rec_polys or dt_polys), a list of pages, either in ``res``, a list in a list,
    and the classic [[poly, [text, score]], ...] as a page or a list of pages. Null, [] and {} have no boxes.
    """
    text = F.regexp_replace(F.trim(raw), r"^\s+|\s+$", "")
    # each step is bound to a name, so that it is worked out once for all shapes that are tried on it
    bind = lambda value, then: F.transform(F.array(value), then)[0]
    inner = lambda t: F.coalesce(F.get_json_object(t, "$.res"), t)
    return bind(text, lambda t: bind(inner(t), lambda u: bind(inner(u), _boxes_of)))


def _boxes_of(text: Column) -> Column:
    """The boxes of a payload without its wrapping; see :func:`ocr_boxes`."""
    none = F.array().cast(f"array<{BOX}>")

    def of_page(p: Column) -> Column:
        polys = F.when(F.size(F.coalesce(p["rec_polys"], F.array())) > 0, p["rec_polys"]).otherwise(p["dt_polys"])
        texts = F.coalesce(p["rec_texts"], F.array().cast("array<string>"))
        bad = (F.size(F.coalesce(polys, F.array())) > 0) & (F.size(polys) != F.size(texts))
        boxes = F.transform(texts, lambda x, i: F.struct(x.alias("text"), F.get(p["rec_scores"], i).alias("score"), F.get(polys, i).alias("poly")))
        return F.when(bad, F.raise_error(F.lit("rec_texts and polygons differ in number")).cast(f"array<{BOX}>")).otherwise(boxes)

    def classic(x: Column) -> Column:
        payload = x[1]
        many = F.from_json(payload, "array<string>")
        pair = payload.startswith("[")
        return F.struct(F.when(pair, many[0]).otherwise(payload).alias("text"), F.when(pair, F.get(many, F.lit(1)).try_cast("double")).alias("score"), F.from_json(x[0], "array<array<double>>").alias("poly"))

    start = F.regexp_replace(text, r"\s+", "")
    pages = lambda c: F.flatten(F.transform(F.from_json(c, f"array<struct<{PAGE}>>"), of_page))
    inner = F.from_json(text, "array<string>")
    items = lambda c: F.transform(F.filter(F.from_json(c, "array<array<string>>"), lambda x: x.isNotNull()), classic)
    a_page = F.get_json_object(text, "$.rec_texts").isNotNull() | F.get_json_object(text, "$.dt_polys").isNotNull()
    return (
        F.when(text.isNull() | start.isin("", "null", "[]", "{}", "[[]]", "[null]"), none)
        .when(a_page, of_page(F.from_json(text, f"struct<{PAGE}>")))
        .when(start.startswith("[{") & start.rlike(r'"(rec_texts|dt_polys)":'), pages(text))
        .when(start.startswith("[[{") & start.rlike(r'"(rec_texts|dt_polys)":'), pages(inner[0]))
        .when(start.rlike(r"^\[(null,)*\[\[\[\["), F.flatten(F.transform(F.filter(inner, lambda x: x.isNotNull()), items)))
        .when(start.rlike(r"^\[(null,)*\[\[\["), items(text))
        .otherwise(F.raise_error(F.concat(F.lit("unknown OCR payload: "), F.substring(text, 1, 80))).cast(f"array<{BOX}>"))
    )


def ocr_lines(raw: DataFrame, line_ratio: float = 0.5, low: float = 0.5) -> DataFrame:
    """(frame_id, line_no, text, confidence, low_confidence) of column ``raw`` (JSON).

    Boxes in reading order (centre from top to bottom, then left to right); one
    whose centre is as high as that of the box before, within ``line_ratio`` of
    their mean height, goes on with its line. A line has the least confidence of its boxes.
    """
    boxes = raw.select("frame_id", F.posexplode(ocr_boxes(F.col("raw"))).alias("i", "b"))
    poly = F.coalesce("b.poly", F.array(F.array(F.lit(0.0), F.lit(0.0))))
    ys, xs = F.transform(poly, lambda p: p[1]), F.transform(poly, lambda p: p[0])
    rows = boxes.where(F.trim("b.text") != "").select("frame_id", "i", F.trim("b.text").alias("text"), F.col("b.score").alias("confidence"), ((F.array_min(ys) + F.array_max(ys)) / 2).alias("y"), ((F.array_min(xs) + F.array_max(xs)) / 2).alias("x"), (F.array_max(ys) - F.array_min(ys)).alias("h"))
    w = Window.partitionBy("frame_id").orderBy("y", "x", "i")  # the boxes of one frame
    near = F.abs(F.col("y") - F.lag("y").over(w)) <= line_ratio * (F.col("h") + F.lag("h").over(w)) / 2
    rows = rows.withColumn("new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).withColumn("line_no", F.sum("new").over(w) - 1)
    out = rows.groupBy("frame_id", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "i", "text"))), lambda b: b["text"]), "").alias("text"), F.min("confidence").alias("confidence"))
    return out.withColumn("low_confidence", F.coalesce(F.col("confidence") < low, F.lit(True)))


def media_catalog(paths: DataFrame) -> DataFrame:
    """(path, kind, number, title): video or pdf by suffix, the number in the file name, and the name in words; other files are left out."""
    name = F.regexp_extract("path", r"([^/\\]+)\.[^./\\]+$", 1)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    kind = F.when(suffix.isin("mp4", "mov", "mkv", "avi", "flv", "wmv", "m4v", "webm"), "video").when(suffix == "pdf", "pdf")
    title = F.trim(F.regexp_replace(F.regexp_replace(name, r"\[[0-9]+\]|[0-9]+$", ""), r"[_\-.\s]+", " "))
    return paths.select("path", kind.alias("kind"), F.nullif(F.regexp_extract(name, r"([0-9]+)", 1), F.lit("")).cast("long").alias("number"), title.alias("title")).where("kind is not null")
