"""Queries of region and frame arithmetic, and their SQL. Boards' frames have 1920 x 1080 pixels, boxes' 640 x 360."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import regions as g
from lectern.operators.ordered import blocked, with_neighbor
from lectern.plans import relations as r
from lectern.plans.texts import _boxes
from lectern.sources.tables import table

_R = ("x", "y", "width", "height")


def _flat(df, key: str, region: str = "region"):
    return df.select(key, *[F.col(f"{region}.{c}").cast("long").alias(c) for c in _R])


def _before(s, d):
    rows = r.boards(s, d).where("region is not null")
    return with_neighbor(blocked(rows, ["job_id"], "start_ms", 900_000), ["job_id"], ["start_ms", "board_id"], ["region"], "prev")


def region_clip(s, d):
    """Boards as a frame of 1280 x 720 shows them."""
    rows = r.boards(s, d).where("region is not null").withColumn("region", g.clipped(F.col("region"), 1280, 720))
    return _flat(rows.where("region is not null"), "board_id")


def region_padded(s, d):
    return _flat(r.boards(s, d).where("region is not null").withColumn("region", g.padded(F.col("region"), 1920, 1080, 0.05)), "board_id")


def paired_views(s, d):
    """Each board's view for the comparison with the board before."""
    return _flat(_before(s, d).withColumn("region", g.paired_view(F.col("region"), F.col("prev.region"))), "board_id")


def region_motion(s, d):
    rows = _before(s, d).where("prev is not null")
    shift, ratio = g.motion(F.col("region"), F.col("prev.region"), 1920, 1080)
    return rows.select("board_id", shift.alias("shift"), ratio.alias("area_ratio"), g.redetect_reason(F.col("region"), shift, ratio).alias("reason"))


def _candidates(s, d):
    rect = 1 - F.col("l_discount") * 5
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")  # an order has a handful of lines
    rows = table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    w, h = 20 + F.col("l_linenumber") * 60, 20 + F.col("l_quantity").cast("int") * 6
    return rows.select("l_orderkey", F.row_number().over(own).alias("id"), w.cast("long").alias("width"), h.cast("long").alias("height"), rect.alias("rect"), (F.col("l_tax") * 10).alias("text"), (F.col("l_quantity") / 50).alias("stable"), (F.col("l_discount") * 6).alias("occlusion"))


def candidate_filter(s, d):
    rows = _candidates(s, d)
    return rows.where(g.acceptable(F.struct("width", "height"), F.col("rect"), 230_400.0)).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


def candidate_top(s, d):
    """The three best boxes of an order that are good enough, else the best one that is at least weak."""
    score = g.candidate_score(F.least(F.lit(1.0), F.col("width") * F.col("height") / 230_400.0), F.col("rect"), F.col("text"), F.col("stable"), F.col("occlusion"))
    rows = _candidates(s, d).withColumn("score", F.round(score, 9))
    best = Window.partitionBy("l_orderkey").orderBy(F.desc("score"), "id")
    rows = rows.withColumn("rank", F.row_number().over(best).cast("long")).withColumn("top", F.max("score").over(Window.partitionBy("l_orderkey")))
    return rows.where("score >= 0.35 and rank <= 3 or top < 0.35 and rank = 1 and score >= 0.25").select("l_orderkey", "id", "rank", "score")


def keyframe_scores(s, d):
    """Frames by sharpness, with the text score for what is hidden; the tables have no glare."""
    rows = table(s, d, "frames", "job_id", "timestamp_ms", "sharpness", "text_score").dropDuplicates(["job_id", "timestamp_ms"]).where("sharpness is not null")
    return rows.select("job_id", "timestamp_ms", F.round(g.keyframe_score(F.col("sharpness"), F.coalesce("text_score", F.lit(0.0)), F.lit(0.0)), 9).alias("score"))


def text_presence(s, d):
    """Of boxes as text components: their number, density and area in an order."""
    rows = _candidates(s, d).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.avg("text").alias("density"), (F.sum(F.col("width") * F.col("height")) / 2_304_000).alias("area"))
    return rows.select("l_orderkey", F.round(g.text_presence(F.col("n"), F.col("density"), F.col("area")), 9).alias("score"))


def page_decisions(s, d):
    """Vectors as frames: sign bits as hash, share of equal signs among the largest half as structure."""
    rows = table(s, d, "embeddings", "vec_id", "label", "embedding").where("embedding is not null")
    rows = with_neighbor(blocked(rows, ["label"], "vec_id", 65_536), ["label"], ["vec_id"], ["embedding"], "prev").where("prev is not null")
    apart = F.aggregate(F.zip_with("embedding", "prev.embedding", lambda a, b: F.when((a > 0) == (b > 0), 0).otherwise(1)), F.lit(0), lambda x, y: x + y)
    near = F.aggregate(F.zip_with("embedding", "prev.embedding", lambda a, b: F.when((F.abs(a) < 0.1) | ((a > 0) == (b > 0)), 1).otherwise(0)), F.lit(0), lambda x, y: x + y)
    ssim = near / F.size("embedding")
    return rows.select("vec_id", apart.cast("long").alias("distance"), g.page_decision(apart, ssim).alias("reason"))


def split_decisions(s, d):
    """Neighbouring frames between which another sample is taken; the text score stands for what the image shows."""
    rows = table(s, d, "frames", "job_id", "timestamp_ms", "has_text", "text_score").dropDuplicates(["job_id", "timestamp_ms"]).select("job_id", "timestamp_ms", F.coalesce(F.col("has_text") == 1, F.lit(False)).alias("t"), F.coalesce("text_score", F.lit(0.0)).alias("x"))
    rows = with_neighbor(blocked(rows, ["job_id"], "timestamp_ms", 1_800_000), ["job_id"], ["timestamp_ms"], ["timestamp_ms", "t", "x"], "prev").where("prev is not null")
    alike = 1 - F.abs(F.col("x") - F.col("prev.x"))
    split = g.split_decision(F.col("prev.t"), F.col("t"), alike, alike, F.col("timestamp_ms") - F.col("prev.timestamp_ms"))
    return rows.where(split).select("job_id", "timestamp_ms")


def ocr_presence(s, d):
    """Boards with at least two lines that are read well enough; a line without confidence counts."""
    rows = table(s, d, "board_segments", "board_id", "text_lines").dropDuplicates(["board_id"])
    good = F.filter("text_lines", lambda x: (F.length(F.trim(F.coalesce(x["text"], F.lit("")))) > 0) & (x["confidence"].isNull() | F.isnan(x["confidence"]) | (x["confidence"] >= 0.20)))
    n = F.coalesce(F.size(good), F.lit(0))
    return rows.select("board_id", F.when(n < 0, 0).otherwise(n).cast("long").alias("n_lines"), (n >= 2).alias("has_text"))


def track_counts(s, d):
    """Every state of tracking for every job, zero where it doesn't occur."""
    rows = table(s, d, "board_segments", "board_id", "job_id", "track_status").dropDuplicates(["board_id"])
    states = ("tracked", "redetected", "lost")
    return rows.groupBy("job_id").agg(*[F.count_if(F.col("track_status") == k).alias(k) for k in states], F.count_if(F.col("track_status").isNull()).alias("unknown"))


def sampling_steps(s, d):
    """The step that keeps a recording under 800 frames, at least 5 s, and how many frames it takes."""
    rows = table(s, d, "jobs", "job_id", "duration_ms").where("duration_ms > 0").distinct()
    step = F.greatest(F.lit(5000).cast("long"), F.ceil(F.col("duration_ms") / 800))
    return rows.select("job_id", step.alias("step_ms"), F.ceil(F.col("duration_ms") / step).alias("n_frames"))


def frame_name_times(s, d):
    """The time in the name of a frame's file against its own: numbered files are 5 s apart."""
    n = F.regexp_extract("image_path", r"([0-9]+)\.[A-Za-z]+$", 1)
    rows = table(s, d, "frames", "job_id", "timestamp_ms", "image_path").where("image_path is not null").dropDuplicates(["job_id", "timestamp_ms"])
    return rows.where(n != "").select("job_id", "timestamp_ms", n.cast("long").alias("named_ms"), ((n.cast("long") - 1) * 5000).alias("as_number_ms"))


def ocr_lookup(s, d):
    """Where the text of a board's first moment comes from: the frame at that time, one of the same index, or the recogniser."""
    frames = table(s, d, "frames", "job_id", "timestamp_ms", "frame_index", "ocr_text").where("trim(ocr_text) <> ''")
    at = frames.select("job_id", F.col("timestamp_ms").alias("t")).distinct().withColumn("by_time", F.col("t"))
    index = frames.where("frame_index is not null").groupBy("job_id", F.col("frame_index").alias("i")).agg(F.min("timestamp_ms").alias("by_index"))
    rows = r.boards(s, d).select("board_id", "job_id", F.floor(F.col("start_ms") / 5000).cast("long").alias("k"))
    rows = rows.withColumn("t", F.col("k") * 5000).withColumn("i", F.col("k") * 125).join(at, ["job_id", "t"], "left").join(index, ["job_id", "i"], "left")
    source = F.when(F.col("by_time").isNotNull(), "timestamp").when(F.col("by_index").isNotNull(), "frame_index").otherwise("recognizer")
    return rows.select("board_id", source.alias("source"), F.coalesce("by_time", "by_index").alias("timestamp_ms"))


def board_index(s, d):
    """Rows of the catalog of boards, numbered in their job, and the job's number of boards."""
    rows = table(s, d, "board_segments", "board_id", "job_id", "start_ms", "end_ms", "version_id", "image_path", "region", "text_lines").dropDuplicates(["board_id"])
    body = F.filter(F.transform("text_lines", lambda x: F.trim(F.coalesce(x["corrected_text"], x["text"]))), lambda t: t != "")
    counts = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_boards"))
    return rows.join(counts, "job_id").select("board_id", "job_id", "start_ms", "end_ms", F.coalesce("version_id", "image_path").alias("version"), (F.col("region.width") * F.col("region.height")).cast("long").alias("area"), F.coalesce(F.array_join(body, "\n"), F.lit("")).alias("body"), "n_boards")


def board_new_lines(s, d):
    """Lines of a job's boards that no board showed before, as the text export has them."""
    rows = table(s, d, "board_segments", "board_id", "job_id", "start_ms", "text_lines").dropDuplicates(["board_id"])
    from lectern.functions.text import text_key

    lines = rows.select("board_id", "job_id", "start_ms", F.posexplode("text_lines").alias("line_no", "x")).select("board_id", "job_id", "start_ms", F.col("line_no").cast("long").alias("line_no"), F.trim(F.coalesce("x.corrected_text", "x.text")).alias("line"))
    keyed = lines.withColumn("key", text_key(F.col("line"))).where("key <> ''")
    first = keyed.groupBy("job_id", "key").agg(F.min(F.struct("start_ms", "board_id", "line_no", "line")).alias("k"))
    return first.select("job_id", "k.board_id", "k.line_no", "k.line")


QUERIES = {f.__name__: f for f in (region_clip, region_padded, paired_views, region_motion, candidate_filter, candidate_top, keyframe_scores, text_presence, page_decisions, split_decisions, ocr_presence, track_counts, sampling_steps, frame_name_times, ocr_lookup, board_index, board_new_lines)}

_CAND = """with b as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as id, 20 + l_linenumber * 60 as width, 20 + cast(floor(l_quantity) as int) * 6 as height,
  1 - l_discount * 5 as rect, l_tax * 10 as text, l_quantity / 50 as stable, l_discount * 6 as occlusion from lineitem)"""
_BEFORE = ", k as (select board_id, region as a, lag(region) over (partition by job_id order by start_ms, board_id) as b from board where region is not null)"
_IOU = "(select i / (a.width * a.height + b.width * b.height - i) from (select cast(greatest(0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y)) as double) as i))"
_FR = "with f as (select distinct on (job_id, timestamp_ms) * from frames)"

SQL = {
    k: r.SQL + v
    for k, v in {
        "region_clip": """, e as (select board_id, greatest(0, least(region.x, 1279)) as x1, greatest(0, least(region.y, 719)) as y1, greatest(0, least(region.x + region.width, 1280)) as x2, greatest(0, least(region.y + region.height, 720)) as y2 from board)
select board_id, cast(x1 as bigint) as x, cast(y1 as bigint) as y, cast(x2 - x1 as bigint) as width, cast(y2 - y1 as bigint) as height from e where x2 - x1 > 1 and y2 - y1 > 1""",
        "region_padded": """, p as (select board_id, region as q, cast(round_even(greatest(1, region.width) * 0.05::double, 0) as bigint) as px, cast(round_even(greatest(1, region.height) * 0.05::double, 0) as bigint) as py from board where region is not null),
e as (select board_id, greatest(0, q.x - px) as x1, greatest(0, q.y - py) as y1, least(1920, q.x + q.width + px) as x2, least(1080, q.y + q.height + py) as y2 from p)
select board_id, x1 as x, y1 as y, x2 - x1 as width, y2 - y1 as height from e""",
        "paired_views": f"""{_BEFORE}, m as (select *, b is not null and {_IOU} >= 0.5 as one from k),
e as (select board_id, case when one then round_even((a.x + b.x) / 2.0::double, 0) else a.x end as x1, case when one then round_even((a.y + b.y) / 2.0::double, 0) else a.y end as y1,
 case when one then round_even((a.x + a.width + b.x + b.width) / 2.0::double, 0) else a.x + a.width end as x2, case when one then round_even((a.y + a.height + b.y + b.height) / 2.0::double, 0) else a.y + a.height end as y2 from m)
select board_id, cast(x1 as bigint) as x, cast(y1 as bigint) as y, cast(x2 - x1 as bigint) as width, cast(y2 - y1 as bigint) as height from e""",
        "region_motion": f"""{_BEFORE}, m as (select board_id, sqrt(pow(a.x + a.width / 2.0::double - b.x - b.width / 2.0::double, 2) + pow(a.y + a.height / 2.0::double - b.y - b.height / 2.0::double, 2)) / sqrt(1920.0::double * 1920 + 1080.0::double * 1080) as shift,
 (a.width * a.height)::double / greatest(b.width * b.height, 1) as area_ratio from k where b is not null)
select *, case when shift > 0.28 then 'layout_shift' when abs(area_ratio - 1) > 0.55 then 'layout_area_change' else 'ok' end as reason from m""",
        "ocr_lookup": """, t as (select distinct job_id, timestamp_ms as t from frames where trim(ocr_text) <> ''), i as (select job_id, frame_index as i, min(timestamp_ms) as by_index from frames where trim(ocr_text) <> '' and frame_index is not null group by 1, 2)
select board_id, case when t.t is not null then 'timestamp' when by_index is not null then 'frame_index' else 'recognizer' end as source, coalesce(t.t, by_index) as timestamp_ms
from board left join t on t.job_id = board.job_id and t.t = start_ms // 5000 * 5000 left join i on i.job_id = board.job_id and i.i = start_ms // 5000 * 125""",
    }.items()
} | {
    "candidate_filter": f"{_CAND} select l_orderkey, count(*) as n from b where width * height / 230400.0::double between 0.10 and 0.98 and width * 1.0::double / height between 0.45 and 3.2 and rect >= 0.55 group by 1",
    "candidate_top": f"""{_CAND}, a as (select *, least(1.0::double, width * height / 230400.0::double) as share from b),
w as (select *, (0.30 * case when share <= 0 then 0 when share < 0.18 then 0.15 * share / 0.18 when share < 0.28 then 0.15 + 0.55 * (share - 0.18) / (0.28 - 0.18) when share <= 0.82 then 0.95 when share <= 0.98 then 0.88 else 0.75 end
 + 0.20 * rect + 0.25 * text + 0.15 * stable + 0.10 * (1 - least(1, greatest(0, occlusion / 0.55)))) / 1.0 as raw from a),
x as (select *, raw * case when share < 0.18 then 0.45 + 0.55 * share / 0.18 else 1 end * case when text < 0.10 and stable < 0.65 then 0.35 * text / 0.10 else 1 end as q from w),
y as (select l_orderkey, id, round(least(1.0::double, greatest(0.0::double, q::double)), 9) as score from x),
z as (select *, row_number() over (partition by l_orderkey order by score desc, id) as rank, max(score) over (partition by l_orderkey) as top from y)
select l_orderkey, id, rank, score from z where score >= 0.35 and rank <= 3 or top < 0.35 and rank = 1 and score >= 0.25""",
    "keyframe_scores": f"{_FR} select job_id, timestamp_ms, round(0.55::double * least(1, sharpness / 250) + 0.35::double * (1 - least(1, coalesce(text_score, 0) / 0.45::double)) + 0.10::double, 9) as score from f where sharpness is not null",
    "text_presence": f"{_CAND} select l_orderkey, round(0.50::double * least(1.0::double, count(*) / 8.0::double) + 0.35::double * least(1.0::double, avg(text) / 0.12::double) + 0.15::double * least(1.0::double, sum(width * height) / 2304000.0::double / 0.025::double), 9) as score from b group by 1",
    "page_decisions": """with k as (select vec_id, embedding as a, lag(embedding) over (partition by label order by vec_id) as b from embeddings where embedding is not null),
m as (select vec_id, len(list_filter(list_zip(a, b), lambda p: (p[1] > 0) <> (p[2] > 0))) as distance, len(list_filter(list_zip(a, b), lambda p: abs(p[1]) < 0.1::float or (p[1] > 0) = (p[2] > 0))) / len(a)::double as ssim from k where b is not null)
select vec_id, distance, case when distance <= 18 and ssim >= 0.78 and distance <= 40 then 'phash_and_ssim_similar' when distance <= 18 then 'phash_similar' when ssim >= 0.78 and distance <= 40 then 'ssim_similar' else 'phash_and_ssim_divergent' end as reason from m""",
    "split_decisions": f"""{_FR}, k as (select job_id, timestamp_ms, coalesce(has_text = 1, false) as t, coalesce(text_score, 0.0::double) as x from f),
m as (select *, lag(timestamp_ms) over w as pm, lag(t) over w as pt, 1 - abs(x - lag(x) over w) as alike from k window w as (partition by job_id order by timestamp_ms))
select job_id, timestamp_ms from m where pm is not null and case when pt <> t then true when pt then alike < 0.55 and 1 - alike > 0.45 and alike < 0.88 else (alike < 0.94 and 1 - alike > 0.45) or timestamp_ms - pm > 8000 end""",
    "ocr_presence": """with k as (select distinct on (board_id) board_id, len(list_filter(text_lines, lambda x: length(trim(coalesce(x.text, ''))) > 0 and (x.confidence is null or isnan(x.confidence) or x.confidence >= 0.20))) as n from board_segments)
select board_id, coalesce(n, 0) as n_lines, coalesce(n, 0) >= 2 as has_text from k""",
    "track_counts": "with k as (select distinct board_id, job_id, track_status as s from board_segments) select job_id, count(*) filter (s = 'tracked') as tracked, count(*) filter (s = 'redetected') as redetected, count(*) filter (s = 'lost') as lost, count(*) filter (s is null) as unknown from k group by 1",
    "sampling_steps": """with k as (select distinct job_id, duration_ms, greatest(5000, cast(ceil(duration_ms / 800.0) as bigint)) as step_ms from jobs where duration_ms > 0)
select job_id, step_ms, cast(ceil(duration_ms / step_ms::double) as bigint) as n_frames from k""",
    "frame_name_times": f"""{_FR}, k as (select job_id, timestamp_ms, regexp_extract(image_path, '([0-9]+)\\.[A-Za-z]+$', 1) as n from f where image_path is not null)
select job_id, timestamp_ms, cast(n as bigint) as named_ms, (cast(n as bigint) - 1) * 5000 as as_number_ms from k where n <> ''""",
    "board_index": """with k as (select distinct on (board_id) * from board_segments)
select board_id, job_id, start_ms, end_ms, coalesce(version_id, image_path) as version, cast(region.width * region.height as bigint) as area,
coalesce(array_to_string(list_filter(list_transform(text_lines, lambda x: trim(coalesce(x.corrected_text, x.text))), lambda t: t <> ''), chr(10)), '') as body, count(*) over (partition by job_id) as n_boards from k where job_id is not null""",
    "board_new_lines": """with k as (select distinct on (board_id) * from board_segments), l as (select board_id, job_id, start_ms, unnest(text_lines) as x, generate_subscripts(text_lines, 1) - 1 as line_no from k),
m as (select board_id, job_id, start_ms, line_no, trim(coalesce(x.corrected_text, x.text)) as line from l), n as (select *, replace(regexp_replace(lower(line), '[^\\p{L}\\p{N}]+', '', 'g'), 'ß', 'ss') as key from m),
o as (select *, row_number() over (partition by job_id, key order by start_ms, board_id, line_no) as rn from n where key <> '') select job_id, board_id, line_no, line from o where rn = 1""",
}
