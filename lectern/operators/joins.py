"""Interval joins: overlap, nearest, point in interval; all within a key.

Overlap joins cut time into buckets, so that a long recording's rows meet only
where they are near; a pair is kept in the one bucket where both have begun.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.ordered import blocked, running
from lectern.session import cut


def overlap_ms(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


#: An interval over more buckets than this is long: it meets its key's rows as a whole.
LONG = 4096


def overlap_pairs(left: DataFrame, right: DataFrame, key: str, bucket_ms: int = 60_000) -> DataFrame:
    """(key, left columns l_*, right columns r_*, overlap_ms): pairs of half-open
    intervals of one key that overlap. Both sides have key, start_ms, end_ms.

    Intervals meet in the buckets of time they reach into. One over more than
    ``LONG`` buckets - a live channel, or a wrong end - would be in all of them;
    it overlaps most of its key's rows anyway, so it is joined by the key alone.
    Whether there are such rows is looked up before; where there are none, as
    is usual, no row is shuffled for it.

    Touching intervals don't overlap. Intervals with a null bound or an end not
    after the start, and null keys: no pair. Repeated rows pair as often as they come.
    """

    def named(df: DataFrame, p: str) -> DataFrame:
        df = df.where("start_ms < end_ms").where(F.col(key).isNotNull())
        named = df.select(F.col(key).alias(key if p == "l" else f"__{key}"), *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key])
        cells = [F.floor(F.col(f"{p}_start_ms") / bucket_ms), F.floor((F.col(f"{p}_end_ms") - 1) / bucket_ms)]
        return named.withColumn("__from", cells[0]).withColumn("__to", cells[1])

    def spread(df: DataFrame, p: str) -> DataFrame:
        return df.where(~is_long).withColumn(f"__{p}", F.explode(F.sequence("__from", "__to"))).drop("__from", "__to")

    is_long = F.col("__to") - F.col("__from") > LONG
    a, b = named(left, "l"), named(right, "r")
    meet = (F.col(key) == F.col(f"__{key}")) & (F.col("l_start_ms") < F.col("r_end_ms")) & (F.col("r_start_ms") < F.col("l_end_ms"))
    once = F.floor(F.greatest("l_start_ms", "r_start_ms") / bucket_ms) == F.col("__l")
    both = spread(a, "l").join(spread(b, "r"), meet & (F.col("__l") == F.col("__r")) & once).drop("__l", "__r", f"__{key}")
    if _any_long(a, b, is_long):
        plain = lambda df: df.drop("__from", "__to")
        both = both.unionByName(plain(a.where(is_long)).join(plain(b), meet).drop(f"__{key}")).unionByName(plain(a.where(~is_long)).join(plain(b.where(is_long)), meet).drop(f"__{key}"))
    return both.withColumn("overlap_ms", overlap_ms(F.col("l_start_ms"), F.col("l_end_ms"), F.col("r_start_ms"), F.col("r_end_ms")))


def _any_long(a: DataFrame, b: DataFrame, is_long: Column) -> bool:
    """Whether either side has a long interval; one look at the two times of each row."""
    return not a.where(is_long).select("__from").unionByName(b.where(is_long).select("__from")).isEmpty()


def best_speaker(segments: DataFrame, turns: DataFrame, id_col: str, key: str = "job_id", least_ratio: float = 0.5) -> DataFrame:
    """(id, speaker_id, overlap_ms, match_ratio, match_method): each segment's speaker by the largest overlap.

    Method ``max_overlap``; else the speaker is ``unknown``: ``equal_overlap``
    on a tie, ``below_threshold`` under ``least_ratio`` of the segment,
    ``no_overlap`` where no turn overlaps.
    """
    sums = overlap_pairs(segments, turns, key).groupBy(F.col(f"l_{id_col}").alias(id_col), F.col("r_speaker_id").alias("sp")).agg(F.sum("overlap_ms").alias("ms"))
    # a segment meets a handful of speakers
    tops = sums.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("ms", "sp")), asc=False).alias("t"))
    out = segments.select(id_col, F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms")).alias("dur")).join(tops, id_col, "left")
    ms = F.coalesce(F.col("t")[0]["ms"], F.lit(0))
    ratio = ms.cast("double") / F.col("dur").cast("double")
    tie = (F.size("t") > 1) & (F.try_element_at("t", F.lit(2))["ms"] == ms)
    method = F.when(F.col("t").isNull(), "no_overlap").when(tie, "equal_overlap").when(ratio < least_ratio, "below_threshold").otherwise("max_overlap")
    return out.select(id_col, F.when(method == "max_overlap", F.col("t")[0]["sp"]).otherwise("unknown").alias("speaker_id"), ms.alias("overlap_ms"), ratio.alias("match_ratio"), method.alias("match_method"))


def nearest_interval(left: DataFrame, right: DataFrame, id_col: str, label: str, key: str = "job_id", width: int = 900_000) -> DataFrame:
    """(id, label, distance_ms): the interval of the key nearest to each left one.

    Distance 0 where they overlap; ties: the earlier start, then the smaller
    label. Beside overlaps only the last interval to end before and the first to
    start after can be nearest; both come from running minima over one ordered
    union, in blocks, without any pairs.
    """
    left = cut(left.select(key, id_col, "start_ms", "end_ms"))  # read three times
    good = cut(right.select(key, label, "start_ms", "end_ms").where(F.col(key).isNotNull() & (F.col("start_ms") < F.col("end_ms"))))
    over = overlap_pairs(left, right, key).groupBy(F.col(f"l_{id_col}").alias(id_col)).agg(F.min(F.struct(F.lit(0).cast("long").alias("d"), F.col("r_start_ms").alias("s"), F.col(f"r_{label}").alias("x"))).alias("best"))
    none = F.lit(None)

    def side(at_left: str, at_right: str, backward: bool) -> DataFrame:
        asked = left.select(key, F.col(at_left).alias("t"), F.lit(1 if not backward else 0).alias("o"), F.col(id_col).alias("id"), none.cast("long").alias("e"), none.cast("long").alias("s"), none.cast(good.schema[label].dataType).alias("x"))
        given = good.select(key, F.col(at_right).alias("t"), F.lit(0 if not backward else 1).alias("o"), none.cast(left.schema[id_col].dataType).alias("id"), (-F.col("end_ms") if not backward else F.col("start_ms")).alias("e"), F.col("start_ms").alias("s"), F.col(label).alias("x"))
        rows = blocked(asked.unionByName(given), [key], "t", width)
        rows = running(rows, [key], ["t", "o"], F.when(F.col("e").isNotNull(), F.struct("e", "s", "x")), "n", "min", backward)
        rows = rows.where("id is not null and n is not null")
        d = F.col("t") + F.col("n.e") if not backward else F.col("n.e") - F.col("t")
        return rows.select(F.col("id").alias(id_col), F.struct(d.alias("d"), F.col("n.s").alias("s"), F.col("n.x").alias("x")).alias("best"))

    both = over.unionByName(side("start_ms", "end_ms", False)).unionByName(side("end_ms", "start_ms", True))
    return both.groupBy(id_col).agg(F.min("best").alias("b")).select(id_col, F.col("b.x").alias(label), F.col("b.d").alias("distance_ms"))


def point_lookup(points: DataFrame, intervals: DataFrame, id_col: str, label: str, key: str = "job_id", width: int = 900_000) -> DataFrame:
    """(id, label, inside): for each point (key, id, t) the interval that holds it,
    of several the one that starts first; else the one whose start is nearest. Ties: earlier start, smaller label."""
    spots = points.select(key, id_col, F.col("t").alias("start_ms"), (F.col("t") + 1).alias("end_ms"))
    held = overlap_pairs(spots, intervals, key).groupBy(F.col(f"l_{id_col}").alias(id_col)).agg(F.min(F.struct(F.lit(0).alias("far"), F.lit(0).cast("long").alias("d"), F.col("r_start_ms").alias("s"), F.col(f"r_{label}").alias("x"))).alias("best"))
    good = intervals.where(F.col(key).isNotNull() & F.col("start_ms").isNotNull())
    none = F.lit(None)
    found = held
    for backward in (False, True):
        asked = points.select(key, "t", F.lit(0 if backward else 1).alias("o"), F.col(id_col).alias("id"), none.cast("long").alias("e"), none.cast("long").alias("s"), none.cast(good.schema[label].dataType).alias("x"))
        given = good.select(key, F.col("start_ms").alias("t"), F.lit(1 if backward else 0).alias("o"), none.cast(points.schema[id_col].dataType).alias("id"), (F.col("start_ms") if backward else -F.col("start_ms")).alias("e"), F.col("start_ms").alias("s"), F.col(label).alias("x"))
        rows = running(blocked(asked.unionByName(given), [key], "t", width), [key], ["t", "o"], F.when(F.col("e").isNotNull(), F.struct("e", "s", "x")), "n", "min", backward)
        rows = rows.where("id is not null and n is not null")
        found = found.unionByName(rows.select(F.col("id").alias(id_col), F.struct(F.lit(1).alias("far"), F.abs(F.col("t") - F.col("n.s")).alias("d"), F.col("n.s").alias("s"), F.col("n.x").alias("x")).alias("best")))
    return found.groupBy(id_col).agg(F.min("best").alias("b")).select(id_col, F.col("b.x").alias(label), (F.col("b.far") == 0).alias("inside"))
