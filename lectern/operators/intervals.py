"""Intervals: half-open [start_ms, end_ms) in whole milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.ordered import blocked, running_sum, with_neighbor


def periods_and_gaps(df: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms", width: int = 900_000) -> DataFrame:
    """Sweep line: maximal covered periods of each key, and the gaps between them.

    Each interval becomes +1 at its start and -1 at its end; the running sum
    counts the active intervals. A period begins where it leaves zero and ends
    where it comes back; the stretch from an end to the next start is a gap.
    The sum runs in blocks of ``width`` (see :mod:`lectern.operators.ordered`),
    so one key with a third of all intervals is spread over many tasks.

    Result: keys, kind (``period``, ``gap``), start_ms, end_ms. Touching
    intervals join; repeated rows change nothing. Intervals with a null bound, a
    null key, or an end not after the start are left out. No rows: empty result.
    """
    good = df.select(*keys, F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__e")).where("__s < __e")
    marks = good.select(*keys, F.explode(F.array(F.struct(F.col("__s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("__e").alias("t"), F.lit(-1).alias("d")))).alias("m"))
    marks = blocked(marks.select(*keys, "m.t", "m.d"), keys, "t", width)
    # touching intervals cancel out here; the grouping reuses the partitioning by block
    marks = marks.groupBy(*keys, "__block", "t").agg(F.sum("d").alias("d")).where("d <> 0")
    marks = running_sum(marks, keys, ["t"], F.col("d"), "active")
    bounds = marks.where("active = 0 or active = d").select(*keys, "__block", "t", (F.col("active") > 0).alias("opens"))
    bounds = with_neighbor(bounds, keys, ["t"], ["t"], "next", forward=True).where("next is not null")
    return bounds.select(*keys, F.when(F.col("opens"), "period").otherwise("gap").alias("kind"), F.col("t").alias("start_ms"), F.col("next.t").alias("end_ms"))
