"""Positions in an order, and what is chosen by them; see :mod:`lectern.operators.ordered`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import content_chars
from lectern.operators.joins import nearest_interval
from lectern.operators.ordered import blocked, collapse_runs, running, running_sum, with_neighbor
from lectern.session import cut


def numbered(df: DataFrame, keys: list[str], order: list[str], width: int, name: str = "pos") -> DataFrame:
    """Adds the position from 1 of each row of a key."""
    return running_sum(blocked(df, keys, order[0], width), keys, order, F.lit(1).cast("long"), name).drop("__block")


def even_samples(df: DataFrame, keys: list[str], order: list[str], k: int, width: int) -> DataFrame:
    """At most ``k`` rows of each key, evenly spread over its order: positions round(i (n-1) / (k-1)), half to even."""
    rows = numbered(df, keys, order, width)
    sizes = rows.groupBy(*keys).agg(F.max("pos").alias("n"))
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.bround(i * (F.col("n") - 1) / F.lit(float(k - 1))) + 1).cast("long"))
    picks = sizes.select(*keys, F.explode(F.when(F.col("n") <= k, F.sequence(F.lit(1).cast("long"), F.col("n"))).otherwise(F.array_distinct(at))).alias("pos"))
    return rows.join(picks, [*keys, "pos"])


def with_context(df: DataFrame, keys: list[str], order: list[str], hit: Column, before: int, after: int, width: int) -> DataFrame:
    """Rows within ``before`` and ``after`` places of a row that is hit, by an equi-join on positions."""
    rows = numbered(df.withColumn("__hit", F.coalesce(hit, F.lit(False))), keys, order, width)
    near = rows.where("__hit").select(*keys, F.explode(F.sequence(F.col("pos") - after, F.col("pos") + before)).alias("pos")).distinct()
    # a row at pos p is wanted when a hit lies in p - before .. p + after
    return rows.join(near, [*keys, "pos"]).drop("__hit")


def speaker_runs(df: DataFrame, keys: list[str], order: list[str], label: str, width: int, first: list[str], last: list[str]) -> DataFrame:
    """Gaps and islands: maximal runs of one label."""
    return collapse_runs(df, keys, order, width, [label], F.col(label).eqNullSafe(F.col(f"prev.{label}")), [label, *first], last)


def fill_unknown(runs: DataFrame, keys: list[str], width: int, gap_ms: int = 1000, run_ms: int = 8000, edge_ms: int = 250) -> DataFrame:
    """Adds ``filled`` to runs (first_speaker, first_start, last_end): the speaker a run of ``unknown`` inherits.

    Only runs of at most ``run_ms``; from both neighbours when they are one
    speaker within ``gap_ms``; at a key's edge from the only neighbour within ``edge_ms``.
    """
    cols = ["first_speaker", "first_start", "last_end"]
    rows = blocked(runs, keys, "first_start", width)
    rows = with_neighbor(rows, keys, ["first_start", "first_id"], cols, "left")
    rows = with_neighbor(rows, keys, ["first_start", "first_id"], cols, "right", forward=True)
    a, b = F.col("left"), F.col("right")
    gap_a, gap_b = F.col("first_start") - a["last_end"], b["first_start"] - F.col("last_end")
    short = (F.col("first_speaker") == "unknown") & (F.col("last_end") - F.col("first_start") <= run_ms)
    both = (a["first_speaker"] == b["first_speaker"]) & (gap_a <= gap_ms) & (gap_b <= gap_ms)
    edge = min(edge_ms, gap_ms)
    filled = F.when(short & both, a["first_speaker"]).when(short & b.isNull() & (gap_a <= edge), a["first_speaker"]).when(short & a.isNull() & (gap_b <= edge), b["first_speaker"]).otherwise(F.col("first_speaker"))
    return rows.withColumn("filled", filled).drop("left", "right", "__block")


def fill_unknown_words(words: DataFrame, turns: DataFrame, run_ms: int = 800, chars: int = 4) -> DataFrame:
    """Adds ``word_no`` and ``filled`` to words (seg_id, i, job_id, start_ms, end_ms, text, speaker): what a run of ``unknown`` inherits.

    Only runs within a segment of at most ``run_ms`` and ``chars`` letters and
    digits; from the word before, else the word after, else the nearest turn.
    """
    own = Window.partitionBy("seg_id").orderBy("start_ms", "end_ms", "i")  # the words of one segment
    new = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(own))
    rows = words.withColumn("word_no", F.row_number().over(own).cast("long")).withColumn("run", F.sum(new.cast("long")).over(own))
    by_no = F.struct("word_no")
    runs = rows.groupBy("seg_id", "job_id", "run").agg(F.first("speaker").alias("who"), F.min_by("start_ms", by_no).alias("start_ms"), F.max_by("end_ms", by_no).alias("end_ms"), F.sum(content_chars(F.col("text"))).alias("n"))
    beside = Window.partitionBy("seg_id").orderBy("run")
    runs = runs.withColumn("from", F.coalesce(F.lag("who").over(beside), F.lead("who").over(beside)))
    runs = cut(runs.where((F.col("who") == "unknown") & (F.col("end_ms") - F.col("start_ms") <= run_ms) & (F.col("n") <= chars)))
    # a run without neighbours is all of its segment
    near = nearest_interval(runs.where("from is null").select("seg_id", "job_id", "start_ms", "end_ms"), turns, "seg_id", "speaker_id")
    runs = runs.join(near.select("seg_id", "speaker_id"), "seg_id", "left").select("seg_id", "run", F.coalesce("from", "speaker_id").alias("from"))
    return rows.join(runs, ["seg_id", "run"], "left").withColumn("filled", F.coalesce("from", "speaker")).drop("run", "from")


def reach_before(df: DataFrame, keys: list[str], order: list[str], end: str, width: int) -> DataFrame:
    """Adds ``reach``: the largest ``end`` of the key's rows before this one."""
    rows = running(blocked(df, keys, order[0], width), keys, order, F.col(end), "__reach", "max")
    return with_neighbor(rows, keys, order, ["__reach"], "__p").withColumn("reach", F.col("__p.__reach")).drop("__p", "__reach", "__block")
