"""Problem 2: clean, ordered speaker turns from speech segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.canon import narrow
from lectern.operators.ordered import blocked, collapse_runs, running, with_neighbor
from lectern.session import cut

# Spellings of speakers, time marks, sounds and empty words.
SPEAKER_WORDS = r"(?:speaker|spkr|spk|s|说话人|发言人|讲话人|说话者)"
STAMP = r"[0-9]{1,5}:[0-9]{2}(?::[0-9]{2})?(?:[.,][0-9]{1,3})?"
TIME_MARK = rf"[\[(<]?{STAMP}(?:\s*-+>\s*{STAMP})?[\])>]?(?:\s*-+>)?"
LABEL = rf"(?:[\[(<]\s*{SPEAKER_WORDS}[\s_\-]*0*([0-9]+)\s*[\])>]\s*[::]?|{SPEAKER_WORDS}[\s_\-]*0*([0-9]+)\s*(?:[::]|-(?![0-9])|$))"
#: Sounds stand between brackets, notes or stars, without digits or at-signs.
SOUND = r"\[(?!at\])[^\[\]0-9@]{1,40}\]|\((?!at\))[^()0-9@]{1,40}\)|【[^【】0-9@]{1,40}】|<[^<>0-9@]{1,40}>|♪[^♪]{0,40}♪|\*[^*\n]{1,40}\*"
FILLERS_ZH = r"嗯|呃|额|啊|哦|噢|唔|诶|欸|那+个|就是说|就是(?=就是)"
FILLERS_EN = r"(?<![a-z0-9])(?:u+h+m*|u+m+|e+r+m*|h+m+|m+h*m+|a+h+|o+h+|you know|you(?=\s+you know)|i mean|i(?=\s+i mean))(?![a-z0-9])"
#: A hesitation at the head of an utterance or after a mark, with the comma that follows it.
HESITATION = rf"(?i)(^|[\s,，。.!！?？…])(?:(?:{FILLERS_ZH}|{FILLERS_EN})(?=$|[\s,，。.!！?？…])[\s,，…]*)+"


def speaker_number(label: Column) -> Column:
    """The number in any spelling of a speaker, without leading zeros; null where that names nobody."""
    plain = F.lower(F.trim(narrow(label)))
    n = F.regexp_extract(plain, rf"^[\[(<【]?\s*{SPEAKER_WORDS}[\s_\-#.]*0*([0-9]+)\s*[\])>】]?\s*:?$", 1)
    return F.nullif(n, F.lit(""))


def plain_text(text: Column) -> Column:
    return F.lower(narrow(F.coalesce(text, F.lit(""))))


def head_label(plain: Column) -> Column:
    """The number of a speaker label at the head, or after a time mark there; else null."""
    head = rf"^[\s\x{{FEFF}}]*(?:{TIME_MARK})?\s*{LABEL}"
    return F.coalesce(F.nullif(F.regexp_extract(plain, head, 1), F.lit("")), F.nullif(F.regexp_extract(plain, head, 2), F.lit("")))


def says_something(plain: Column) -> Column:
    """Whether letters or digits are left without time marks, label, sounds, hesitations and set phrases."""
    rest = F.regexp_replace(plain, TIME_MARK, " ")
    rest = F.regexp_replace(rest, rf"^\s*{LABEL}", " ")
    rest = F.regexp_replace(rest, SOUND, " ")
    rest = F.regexp_replace(rest, rf"{FILLERS_ZH}|{FILLERS_EN}", " ")
    return rest.rlike(r"[\p{L}\p{N}]")


def clean_utterance(text: Column) -> Column:
    """The utterance without time marks, label, sounds and hesitations, with plain spaces."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?i){TIME_MARK.replace('[(<]', '[(<（＜]').replace('[])>]', '[])>）＞]')}", " ")
    t = F.regexp_replace(t, rf"(?i)^\s*{LABEL.replace('[::]', '[:：]')}", " ")
    t = F.regexp_replace(t, rf"(?i){SOUND}|（[^（）0-9@]{{1,40}}）", " ")
    t = F.regexp_replace(t, HESITATION, "$1")
    # a stutter says the head of a word twice: two or more characters of a Chinese word, or a whole English one
    t = F.regexp_replace(t, r"([一-鿿]{2,4})\1", "$1")
    t = F.regexp_replace(t, r"(?i)(?<![\p{L}\p{N}])([a-z']{2,})(?:[\s,]+\1)(?![\p{L}\p{N}])", "$1")
    t = F.regexp_replace(t, r"[\s\x{3000}]+", " ")
    return F.trim(F.regexp_replace(t, r"^[\s,，。…、]+", ""))


def pool(values: np.ndarray) -> np.ndarray:
    """Isotonic regression by pooling adjacent violators (least squares, equal weights)."""
    means, sizes = [], []
    for v in values:
        means.append(float(v))
        sizes.append(1)
        while len(means) > 1 and means[-2] > means[-1]:
            n = sizes[-2] + sizes[-1]
            means[-2:] = [(means[-2] * sizes[-2] + means[-1] * sizes[-1]) / n]
            sizes[-2:] = [n]
    return np.repeat(means, sizes)


def isotonic(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, width: int) -> DataFrame:
    """Adds ``out``: ``value`` made nondecreasing along ``order`` within the key, by isotonic regression.

    Where the largest value so far isn't above the smallest one still to come,
    the regression falls apart into two; so the rows are cut there, and only
    stretches of disorder are pooled, each by itself. Rows in order keep their
    value. Null values and keys: the row is left out.
    """
    rows = blocked(df.where(F.col(value).isNotNull()), keys, order[0], width)
    parts = [*keys, "__block"]
    up = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy("__block").rowsBetween(1, Window.unboundedFollowing)
    edges = rows.groupBy(*parts).agg(F.max(value).alias("__max"), F.min(value).alias("__min"))
    edges = edges.select(*parts, F.max("__max").over(up).alias("__before"), F.min("__min").over(down).alias("__after"))
    here = Window.partitionBy(*parts).orderBy(*order)
    rows = rows.withColumn("__high", F.max(value).over(here.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__low", F.min(value).over(here.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.join(edges, parts, "left").withColumn("__high", F.greatest("__high", "__before")).withColumn("__low", F.least("__low", "__after")).drop("__before", "__after")
    rows = cut(rows)
    fine = rows.where("__high = __low").drop("__high", "__low").withColumn(out, F.col(value).cast("double"))
    # between two stretches of disorder lies a row in order, so the number of such rows before names the stretch
    rough = running(rows, keys, order, (F.col("__high") == F.col("__low")).cast("long"), "__solid").where("__high <> __low")

    def regress(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        part[out] = pool(part[value].to_numpy())
        return part[names]

    names, schema = fine.columns, fine.schema
    return fine.unionByName(rough.groupBy(*keys, "__solid").applyInPandas(regress, schema))


def unreset(df: DataFrame, keys: list[str], order: str, time: str, out: str, drop_ms: int = 60_000, width: int = 4096) -> DataFrame:
    """Adds ``out``: what is lost to clock resets before the row, to be added to its times. In the order of
    the file, a fall of ``time`` by more than ``drop_ms`` begins a new segment of the file, which goes on from the time before it."""
    rows = with_neighbor(blocked(df, keys, order, width), keys, [order], [time], "__prev")
    fall = F.col(f"__prev.{time}") - F.col(time)
    rows = rows.withColumn("__fall", F.when(fall > drop_ms, fall).otherwise(F.lit(0))).drop("__prev")
    return running(rows, keys, [order], F.col("__fall"), out).drop("__fall")


def placed_segments(speech: DataFrame, per_block: int = 16_384, longest_ms: int = 600_000, text: bool = False) -> tuple[DataFrame, list[str]]:
    """Segments that say something (job_id, speech_id, speaker, start_ms, start, end[, clean]), in blocks, and their order.

    ``start`` and ``end`` are repaired in the order of the file, which is that
    of speech_id in a job: clock resets are undone, an end before its start or
    more than ``longest_ms`` after it is set to the start, and isotonic
    regression over each makes the times nondecreasing. The order is then that
    of ``start``; ties: start_ms, then speech_id. A file whose times never fall
    is its own regression; then one pass has shown it, and the order is the file's.
    """
    plain = plain_text(F.col("text"))
    rows = speech.select("speech_id", "job_id", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), plain.alias("plain"), speaker_number(F.col("speaker_id")).alias("n"), *([clean_utterance(F.col("text")).alias("clean")] if text else []))
    rows = rows.where(F.col("job_id").isNotNull() & F.col("start_ms").isNotNull() & F.col("speech_id").isNotNull() & says_something(F.col("plain")))
    n = F.coalesce("n", head_label(F.col("plain")))
    wrong = F.col("end_ms").isNull() | (F.col("end_ms") < F.col("start_ms")) | (F.col("end_ms") > F.col("start_ms") + longest_ms)
    rows = rows.withColumn("speaker", F.coalesce(F.concat(F.lit("speaker_"), n), F.lit("unknown"))).withColumn("end_ms", F.when(wrong, F.col("start_ms")).otherwise(F.col("end_ms"))).drop("plain", "n")
    count, low, high = speech.agg(F.count("speech_id"), F.min("speech_id"), F.max("speech_id")).first()
    width = max(1, (high - low + 1) // max(1, count // per_block)) if count else 1
    cols = ["start_ms", "end_ms", "speaker", *(["clean"] if text else [])]
    rows = blocked(rows, ["job_id"], "speech_id", width)
    rows = cut(rows.groupBy("job_id", "__block", "speech_id").agg(F.min(F.struct(*cols)).alias("x")).select("job_id", "__block", "speech_id", "x.*"))
    keys, file = ["job_id"], ["speech_id"]
    falls = with_neighbor(rows, keys, file, ["start_ms", "end_ms"], "prev").where("prev.start_ms > start_ms or prev.end_ms > end_ms")
    if falls.isEmpty():
        return rows.withColumn("start", F.col("start_ms")).withColumn("end", F.col("end_ms")).drop("end_ms"), file
    rows = unreset(rows, keys, "speech_id", "start_ms", "lost")
    rows = cut(rows.withColumn("a", F.col("start_ms") + F.col("lost")).withColumn("b", F.col("end_ms") + F.col("lost")).drop("end_ms", "lost"))
    for value, fit in (("a", "start"), ("b", "end")):
        rows = cut(isotonic(rows, keys, file, value, fit, width).drop(value)).repartition("job_id", "__block")
    rows = rows.withColumn("start", F.round("start").cast("long"))
    rows = rows.withColumn("end", F.greatest(F.round("end").cast("long"), "start")).drop("__block")
    return cut(blocked(rows, keys, "start", 900_000)), ["start", "start_ms", "speech_id"]


def speaker_turns(speech: DataFrame, **sizes: int) -> DataFrame:
    """(job_id, speaker, first_speech_id, last_speech_id, start_ms, end_ms, n_segments).

    Input: speech_id, job_id, start_ms, end_ms, text, speaker_id. Segments in
    whose text nobody says anything are left out first. The speaker is the
    number in speaker_id in any spelling, else that of a label at the head of
    the text, else ``unknown``, who is a speaker like any other. In the order of
    the repaired start (see :func:`placed_segments`), each maximal run of one
    speaker is a turn, placed from its first repaired start to its last
    repaired end. Where the file's clock never falls, as TESTDATA.md has it,
    that is the order of start_ms.

    Rows that come twice with one speech_id count once. Null job_id, start_ms or
    speech_id, and null or blank texts: the row is left out. A null end_ms counts as the start.
    """
    rows, order = placed_segments(speech, **sizes)
    runs = collapse_runs(rows, ["job_id"], order, 1, ["speaker"], F.col("speaker") == F.col("prev.speaker"), ["speaker", "speech_id", "start"], ["speech_id", "end"])
    return runs.select("job_id", F.col("first_speaker").alias("speaker"), "first_speech_id", "last_speech_id", F.col("first_start").alias("start_ms"), F.col("last_end").alias("end_ms"), F.col("n").alias("n_segments"))


def turn_texts(speech: DataFrame, **sizes: int) -> DataFrame:
    """(job_id, first_speech_id, part, speaker, text): the clean text of each turn of :func:`speaker_turns`.

    A turn can be as long as its recording, so its text comes in parts, one for
    each block of the recording that it reaches into, numbered in order by ``part`` (with gaps).
    """
    rows, order = placed_segments(speech, text=True, **sizes)
    rows = with_neighbor(rows, ["job_id"], order, ["speaker"], "prev")
    place = F.struct(*order, F.col("speech_id").alias("first"))
    rows = running(rows, ["job_id"], order, F.when(~F.col("speaker").eqNullSafe(F.col("prev.speaker")), place), "turn", "max")
    parts = rows.groupBy("job_id", "__block", "turn").agg(F.min("speaker").alias("speaker"), F.sort_array(F.collect_list(F.struct(*order, "clean"))).alias("x"))
    return parts.select("job_id", F.col("turn.first").alias("first_speech_id"), F.col("__block").alias("part"), "speaker", F.array_join(F.filter(F.transform("x", lambda x: x["clean"]), lambda t: t != ""), " ").alias("text"))
