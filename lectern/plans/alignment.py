"""Queries of the alignment by words and by whole segments, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import rules
from lectern.functions.text import content_chars
from lectern.operators import joins
from lectern.plans import relations as r
from lectern.plans.exports import clear_switches
from lectern.plans.timeline import align_max_overlap, word_runs_inherit
from lectern.session import cut
from lectern.sources.tables import table


def word_pieces(s, d):
    """Segments that several speakers share, split by their words: each run of one speaker with its text, and whether it was inherited."""
    words = table(s, d, "transcript_segments", "seg_id", "start_ms", "end_ms", "words").dropDuplicates(["seg_id"])
    good = F.filter("words", lambda w: (w["start_ms"] >= 0) & (w["end_ms"] > w["start_ms"]) & (F.length(w["text"]) > 0))
    clamp = F.filter(F.transform(good, lambda w, i: F.struct(F.greatest(w["start_ms"], F.col("start_ms")).alias("a"), F.least(w["end_ms"], F.col("end_ms")).alias("b"), i.alias("i"), w["text"].alias("t"))), lambda w: w["b"] > w["a"])
    texts = words.select("seg_id", F.posexplode(F.array_sort(clamp)).alias("no", "w")).select("seg_id", (F.col("no") + 1).cast("long").alias("word_no"), F.col("w.t").alias("t"))
    rows = word_runs_inherit(s, d).join(texts, ["seg_id", "word_no"])
    own = Window.partitionBy("seg_id").orderBy("word_no")  # the words of one segment
    rows = rows.withColumn("piece", F.sum(F.when(F.col("filled").eqNullSafe(F.lag("filled").over(own)), 0).otherwise(1)).over(own))
    first = F.struct("word_no")
    out = rows.groupBy("seg_id", "piece").agg(
        F.min("filled").alias("speaker"), F.min_by("start_ms", first).alias("start_ms"), F.max_by("end_ms", first).alias("end_ms"), F.bool_or(F.col("filled") != F.col("speaker")).alias("inferred"),
        F.transform(F.array_sort(F.collect_list(F.struct("word_no", "t"))), lambda x: x["t"]).alias("w"),
    )
    return out.where("end_ms > start_ms").select("seg_id", "piece", "speaker", "start_ms", "end_ms", "inferred", rules.joined_words(F.col("w")).alias("text"))


def assigned_segments(s, d):
    """Segments that aren't split: the speaker of the largest overlap; a short particle that nobody holds goes to the nearest turn, and is inferred."""
    rows = align_max_overlap(s, d).join(r.segments(s, d), "seg_id").join(clear_switches(s, d).select("seg_id"), "seg_id", "left_anti").where("end_ms > start_ms")
    short = (F.col("speaker_id") == "unknown") & (F.col("end_ms") - F.col("start_ms") <= 800) & (content_chars(F.coalesce("text", F.lit(""))) <= 4)
    rows = cut(rows.withColumn("short", short))
    near = joins.nearest_interval(rows.where("short").select("seg_id", "job_id", "start_ms", "end_ms"), r.turns(s, d), "seg_id", "speaker_id").select("seg_id", F.col("speaker_id").alias("near"))
    rows = rows.join(near, "seg_id", "left")
    method = F.when(F.col("short") & F.col("near").isNotNull(), "particle_inherit").when(F.col("speaker_id") == "unknown", "unknown").otherwise("max_overlap")
    return rows.select("seg_id", F.coalesce(F.when(F.col("short"), F.col("near")), "speaker_id").alias("speaker"), method.alias("method"), F.col("match_ratio"))


QUERIES = {f.__name__: f for f in (word_pieces, assigned_segments)}

_SWITCH = """, sw as (select seg_id from (select l.seg_id, r.speaker_id, l.end_ms - l.start_ms as dur, sum(least(l.end_ms, r.end_ms) - greatest(l.start_ms, r.start_ms)) as ms from seg l join turn r
 on l.job_id = r.job_id and l.start_ms < r.end_ms and r.start_ms < l.end_ms and l.start_ms < l.end_ms group by 1, 2, 3) where ms >= 0.15 * dur group by 1 having count(*) >= 2)"""
_FILLED = f"""{_SWITCH}, t0 as (select distinct on (seg_id) seg_id, job_id, start_ms as ss, end_ms as se, words from transcript_segments where len(words) > 0 and seg_id in (select seg_id from sw)),
t1 as (select seg_id, job_id, ss, se, unnest(words) as x, generate_subscripts(words, 1) - 1 as i from t0),
w as (select seg_id, job_id, i, greatest(x.start_ms, ss) as a, least(x.end_ms, se) as b, x.text as t from t1 where x.start_ms >= 0 and x.end_ms > x.start_ms and length(x.text) > 0 and least(x.end_ms, se) > greatest(x.start_ms, ss)),
o as (select seg_id, i, speaker_id, sum(least(b, end_ms) - greatest(a, start_ms)) as ms from w join turn on turn.job_id = w.job_id and a < end_ms and start_ms < b group by 1, 2, 3),
k as (select *, row_number() over (partition by seg_id, i order by ms desc, speaker_id) as rn, count(*) over (partition by seg_id, i, ms) as ties from o),
l as (select w.*, case when ties = 1 and ms::double / (b - a) >= 0.5 then speaker_id else 'unknown' end as speaker from w left join k on k.seg_id = w.seg_id and k.i = w.i and rn = 1),
n as (select *, row_number() over (partition by seg_id order by a, b, i) as word_no from l),
c as (select *, case when lag(speaker) over (partition by seg_id order by word_no) = speaker then 0 else 1 end as f from n),
g as (select *, sum(f) over (partition by seg_id order by word_no rows unbounded preceding) as run from c),
rn as (select seg_id, job_id, run, min(speaker) as who, arg_min(a, word_no) as ra, arg_max(b, word_no) as rb, sum(length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))) as chars from g group by 1, 2, 3),
nb as (select *, coalesce(lag(who) over (partition by seg_id order by run), lead(who) over (partition by seg_id order by run)) as side from rn),
nt as (select seg_id, run, arg_min(turn.speaker_id, (greatest(0, turn.start_ms - rb, ra - turn.end_ms), turn.start_ms, turn.speaker_id)) as near from nb join turn on turn.job_id = nb.job_id where who = 'unknown' and side is null group by 1, 2),
fl as (select g.seg_id, g.word_no, g.a as start_ms, g.b as end_ms, g.speaker, g.t, case when g.speaker = 'unknown' and rb - ra <= 800 and chars <= 4 then coalesce(side, near, 'unknown') else g.speaker end as filled
 from g join nb on nb.seg_id = g.seg_id and nb.run = g.run left join nt on nt.seg_id = g.seg_id and nt.run = g.run)"""

SQL = {
    k: r.SQL + v
    for k, v in {
        "word_runs_inherit": f"{_FILLED} select seg_id, word_no, start_ms, end_ms, speaker, filled from fl",
        "word_pieces": f"""{_FILLED}, pc as (select *, case when lag(filled) over (partition by seg_id order by word_no) = filled then 0 else 1 end as nf from fl), ps as (select *, sum(nf) over (partition by seg_id order by word_no rows unbounded preceding) as piece from pc),
pg as (select seg_id, piece, min(filled) as speaker, arg_min(start_ms, word_no) as start_ms, arg_max(end_ms, word_no) as end_ms, bool_or(filled <> speaker) as inferred, list(t order by word_no) as g from ps group by 1, 2)
select seg_id, cast(piece as bigint) as piece, speaker, start_ms, end_ms, inferred, case when (len(list_filter(g, lambda t: contains(t, ' '))) > 0 or len(list_filter(g, lambda t: length(t) <= 1)) = 0) and len(list_filter(g, lambda t: not regexp_matches(t, '[一-鿿]'))) > 0 then array_to_string(g, ' ') else array_to_string(g, '') end as text from pg where end_ms > start_ms""",
        "assigned_segments": f"""{_SWITCH}, sums as (select l.seg_id, r.speaker_id, cast(sum(least(l.end_ms, r.end_ms) - greatest(l.start_ms, r.start_ms)) as bigint) as ms from seg l join turn r on l.job_id = r.job_id and l.start_ms < r.end_ms and r.start_ms < l.end_ms and l.start_ms < l.end_ms group by 1, 2),
k as (select *, row_number() over (partition by seg_id order by ms desc, speaker_id) as rn, count(*) over (partition by seg_id, ms) as ties from sums),
b as (select seg.*, end_ms - start_ms as dur, speaker_id, coalesce(ms, 0)::double / greatest(1, end_ms - start_ms) as match_ratio, ties from seg left join k on k.seg_id = seg.seg_id and rn = 1 where end_ms > start_ms and seg.seg_id not in (select seg_id from sw)),
m as (select *, case when ties = 1 and match_ratio >= 0.5 then speaker_id else 'unknown' end as who from b),
x as (select *, who = 'unknown' and dur <= 800 and length(regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g')) <= 4 as short from m),
nt as (select seg_id, arg_min(turn.speaker_id, (greatest(0, turn.start_ms - x.end_ms, x.start_ms - turn.end_ms), turn.start_ms, turn.speaker_id)) as near from x join turn on turn.job_id = x.job_id where short group by 1)
select x.seg_id, coalesce(case when short then near end, who) as speaker, case when short and near is not null then 'particle_inherit' when who = 'unknown' then 'unknown' else 'max_overlap' end as method, match_ratio from x left join nt on nt.seg_id = x.seg_id""",
    }.items()
}
QUERIES["word_runs_inherit"] = word_runs_inherit
