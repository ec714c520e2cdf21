"""Queries of the llm problems (pN_...), and their SQL."""

from __future__ import annotations

import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.canon import NARROW, WIDE
from lectern.llm.copies import entry_copies
from lectern.llm.leaks import leaks
from lectern.llm.nearest import nearest_in_time
from lectern.llm.pages import page_stays
from lectern.llm.privacy import personal_information
from lectern.llm.scans import board_lines, board_text
from lectern.llm.tokens import encode_texts, split_texts
from lectern.llm.turns import LABEL, SPEAKER_WORDS, TIME_MARK, clean_utterance, speaker_turns, turn_texts
from lectern.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entry_copies(table(spark, sf_dir, "knowledge_entries", "id", "title", "body"))
    return rows.where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))


def p3_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry of each group, with the number of its copies."""
    return entry_copies(table(spark, sf_dir, "knowledge_entries", "id", "title", "body")).where("id = first_id").select("id", "n_copies").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "transcript_segments", "job_id", "seg_id", "start_ms").toDF("key", "left_id", "start_ms")
    right = table(spark, sf_dir, "speaker_turns", "job_id", "turn_id", "start_ms").toDF("key", "right_id", "start_ms")
    return nearest_in_time(left, right).select(F.col("left_id").alias("seg_id"), F.col("right_id").alias("turn_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stays = page_stays(table(spark, sf_dir, "frames", "job_id", "timestamp_ms", "ocr_text"))
    return stays.where("n_frames >= 2").select("job_id", "first_ms", "last_ms", "n_frames")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    speech = table(spark, sf_dir, "speech_segments", "speech_id", "job_id", "start_ms", "end_ms", "text", "speaker_id")
    return speaker_turns(speech).select("job_id", "speaker", "first_speech_id", "last_speech_id")


def p2_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their place in time."""
    return speaker_turns(table(spark, sf_dir, "speech_segments", "speech_id", "job_id", "start_ms", "end_ms", "text", "speaker_id"))


def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean text of each turn, in parts."""
    return turn_texts(table(spark, sf_dir, "speech_segments", "speech_id", "job_id", "start_ms", "end_ms", "text", "speaker_id"))


def p2_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned text of each transcript segment."""
    rows = table(spark, sf_dir, "transcript_segments", "seg_id", "text")
    return rows.select("seg_id", clean_utterance(F.col("text")).alias("clean")).dropDuplicates(["seg_id"])


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "transcript_segments", "seg_id", "text")
    entries = table(spark, sf_dir, "knowledge_entries", "id", "body")
    return segments.select(F.lit("transcript_segments").alias("tab"), F.col("seg_id").cast("string").alias("rec_id"), "text").unionByName(
        entries.select(F.lit("knowledge_entries").alias("tab"), F.col("id").alias("rec_id"), F.col("body").alias("text"))
    )


def _names(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, str]]:
    # a table of fixed size; the bound is checked
    rows = table(spark, sf_dir, "name_parts", "name_part", "part_kind", "lang").dropna().distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 name parts aren't broadcast")
    return sorted(tuple(r) for r in rows)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_information(_texts(spark, sf_dir), _names(spark, sf_dir), with_text=False)
    return rows.select("tab", "rec_id", F.explode("kinds").alias("kind")).distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts, with placeholders."""
    return personal_information(_texts(spark, sf_dir), _names(spark, sf_dir)).select("tab", "rec_id", "clean").dropDuplicates(["tab", "rec_id"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board_lines(table(spark, sf_dir, "board_segments", "board_id", "job_id", "text_lines"))


def p7_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readable text of each board."""
    return board_text(table(spark, sf_dir, "board_segments", "board_id", "job_id", "text_lines"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def _name_list(spark: SparkSession, sf_dir: str) -> list[str]:
    return sorted({part for part, _, _ in _names(spark, sf_dir)})


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "lang", "text")
    return leaks(docs, items, _name_list(spark, sf_dir), reparameterised=False).select("item_id", "doc_id")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatim and re-parameterised passages."""
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "lang", "text")
    return leaks(docs, items, _name_list(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a text has at least one byte for each token, so a shorter one can't exceed the limit
    docs = table(spark, sf_dir, "documents", "doc_id", "text").where(F.octet_length("text") > 1024)
    return split_texts(docs, "doc_id", "text", with_text=False).where("piece_no = 1").select("doc_id")


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents, with their text."""
    return split_texts(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {"p2_found": p2_found, "p2_turns": p2_turns, "p2_texts": p2_texts, "p2_utterances": p2_utterances, "p4_found": p4_found, "p4_redacted": p4_redacted, "p3_found": p3_found, "p3_entries": p3_entries, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p7_text": p7_text, "p8_ids": p8_ids, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_pieces": p10_pieces}

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _plain(c: str) -> str:
    return f"lower(translate({c}, {_quoted(WIDE)}, {_quoted(NARROW)}))"


def _bare(c: str) -> str:
    return f"regexp_replace({_plain(c)}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def _blank(c: str) -> str:
    return f"not regexp_matches({c}, '[^\\s\\p{{Z}}\\x{{FEFF}}]')"


# RE2 looks neither ahead nor back
_MARK = TIME_MARK.replace("'", "''")
_LABEL = LABEL.replace("-(?![0-9])", "-(?:[^0-9]|$)")
_SOUND = "\\[[^\\[\\]0-9@]{1,40}\\]|\\([^()0-9@]{1,40}\\)|【[^【】0-9@]{1,40}】|<[^<>0-9@]{1,40}>|♪[^♪]{0,40}♪|\\*[^*\\n]{1,40}\\*"
_FILL = "嗯|呃|额|啊|哦|噢|唔|诶|欸|那+个|就是说|\\b(?:u+h+m*|u+m+|e+r+m*|h+m+|m+h*m+|a+h+|o+h+|you know|i mean)\\b"

_SAID = f"""
with k as (select distinct on (speech_id) speech_id, job_id, start_ms, end_ms, {_plain("coalesce(text, '')")} as t, lower(trim(translate(speaker_id, {_quoted(WIDE)}, {_quoted(NARROW)}))) as s
  from speech_segments where job_id is not null and start_ms is not null),
r as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '{_MARK}', ' ', 'g'), '^\\s*{_LABEL}', ' '), '{_SOUND}', ' ', 'g'), '{_FILL}', ' ', 'g') as rest,
  nullif(regexp_extract(s, '^[\\[(<【]?\\s*{SPEAKER_WORDS}[\\s_\\-#.]*0*([0-9]+)\\s*[\\])>】]?\\s*:?$', 1), '') as n,
  nullif(regexp_extract(t, '^\\s*(?:{_MARK})?\\s*{_LABEL}', 1), '') as h1, nullif(regexp_extract(t, '^\\s*(?:{_MARK})?\\s*{_LABEL}', 2), '') as h2 from k),
l as (select *, coalesce('speaker_' || coalesce(n, h1, h2), 'unknown') as speaker from r where regexp_matches(rest, '[\\p{{L}}\\p{{N}}]')),
f as (select *, case when lag(speaker) over w = speaker then 0 else 1 end as cut from l window w as (partition by job_id order by start_ms, speech_id)),
g as (select *, sum(cut) over (partition by job_id order by start_ms, speech_id rows unbounded preceding) as grp from f)
"""

SQL = {
    "p2_found": f"""{_SAID}
select job_id, min(speaker) as speaker, arg_min(speech_id, (start_ms, speech_id)) as first_speech_id, arg_max(speech_id, (start_ms, speech_id)) as last_speech_id from g group by job_id, grp
""",
    # the tables' clocks don't fall, so times are those of the segments; an end that can't be is the start
    "p2_turns": f"""{_SAID}
select job_id, min(speaker) as speaker, arg_min(speech_id, (start_ms, speech_id)) as first_speech_id, arg_max(speech_id, (start_ms, speech_id)) as last_speech_id, min(start_ms) as start_ms,
  arg_max(case when end_ms is null or end_ms < start_ms or end_ms > start_ms + 600000 then start_ms else end_ms end, (start_ms, speech_id)) as end_ms, count(*) as n_segments from g group by job_id, grp
""",
    # characters of a pair become one byte each, as DuckDB's levenshtein counts bytes
    "p6_found": f"""
with a as (select job_id, timestamp_ms as ts, min(case when not ({_blank("ocr_text")}) then {_bare("ocr_text")} end) as t from frames where job_id is not null and timestamp_ms is not null group by 1, 2),
b as (select *, lag(t) over (partition by job_id order by ts) as p from a),
c as (select *, list_distinct(str_split(t || p, '')) as x from b),
d as (select job_id, ts, t, p, case when t is null or p is null then false when t = p then true when abs(length(t) - length(p)) > 0.15 * greatest(length(t), length(p)) then false
  else levenshtein(array_to_string(list_transform(str_split(t, ''), lambda c: chr(cast(list_position(x, c) as int))), ''), array_to_string(list_transform(str_split(p, ''), lambda c: chr(cast(list_position(x, c) as int))), '')) <= 0.15 * greatest(length(t), length(p)) end as same from c),
e as (select *, sum(case when same then 0 else 1 end) over (partition by job_id order by ts rows unbounded preceding) as grp from d)
select job_id, min(ts) as first_ms, max(ts) as last_ms, count(*) as n_frames from e where t is not null group by job_id, grp having count(*) >= 2
""",
    "p3_entries": f"""
with k as (select distinct id, {_bare("coalesce(title, '')")} as t,
  array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(body, '\\r\\n|[\\n\\r\\x0B\\x0C\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {_bare("x")}), lambda x: x <> '')), chr(10)) as b
  from knowledge_entries where body is not null and not ({_blank("body")}))
select min(id) as id, count(*) as n_copies from k group by t, b
""",
    "p3_found": f"""
with k as (select distinct id, {_bare("coalesce(title, '')")} as t,
  array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(body, '\\r\\n|[\\n\\r\\x0B\\x0C\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {_bare("x")}), lambda x: x <> '')), chr(10)) as b
  from knowledge_entries where body is not null and not ({_blank("body")})),
g as (select id, min(id) over (partition by t, b) as first_id from k)
select first_id, id as copy_id from g where id <> first_id
""",
    "p9_found": f"""
with i as (select item_id, lang, regexp_extract_all({_plain("text")}, '[\\p{{L}}\\p{{N}}]+') as w from eval_items),
d as (select doc_id, regexp_extract_all({_plain("text")}, '[\\p{{L}}\\p{{N}}]+') as w from documents where text is not null),
ie as (select distinct item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) as g from i where lang = 'en'),
de as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) as g from d),
iz as (select distinct item_id, unnest(list_transform(range(1, length(array_to_string(w, '')) - 22), lambda k: substr(array_to_string(w, ''), k, 24))) as g from i where lang = 'zh'),
zs as (select doc_id, array_to_string(w, '') as s from d),
dz as (select distinct doc_id, substr(s, k, 24) as g from zs, lateral (select unnest(range(1, length(s) - 22)) as k))
select distinct item_id, doc_id from ie join de using (g) union select distinct item_id, doc_id from iz join dz using (g)
""",
    "p5_found": """
with l as (select distinct seg_id, job_id, start_ms from transcript_segments),
r as (select distinct turn_id, job_id, start_ms from speaker_turns),
c as (select l.seg_id, r.turn_id, row_number() over (partition by l.seg_id
        order by abs(l.start_ms - r.start_ms), r.start_ms, r.turn_id) as k
      from l join r on l.job_id = r.job_id and r.start_ms between l.start_ms - 400 and l.start_ms + 400)
select seg_id, turn_id from c where k = 1
""",
}

MODULES = [types.SimpleNamespace(QUERIES=QUERIES, SQL=SQL)]
