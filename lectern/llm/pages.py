"""Problem 6: stays of a page in a job's frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.canon import bare, blank
from lectern.operators.ordered import blocked, collapse_runs


def page_stays(frames: DataFrame, near: float = 0.15, width: int = 1_800_000) -> DataFrame:
    """Collapses runs of frames that read nearly the same, by boundary-only rows.

    A frame goes on with the run of the frame before when the edit distance of
    their texts is at most ``near`` of the longer one; white space, punctuation,
    symbols, letter case and width don't count. Frames without text (null,
    blank) belong to no run and end it; a missing sample doesn't. Two texts of
    nothing but symbols are equal. Rows that come twice with one job_id and
    timestamp_ms count once; the row with the smaller text stays. A null job_id
    or timestamp_ms: the row is left out.

    A job's frames are cut into blocks of ``width`` ms, so no job is one task.
    Result: job_id, first_ms, last_ms, n_frames (1 for a single frame), duration_ms.
    """
    rows = frames.select("job_id", F.col("timestamp_ms").cast("long").alias("ts"), F.when(~blank(F.col("ocr_text")), bare(F.col("ocr_text"))).alias("t"))
    # the block is in the grouping so that one exchange serves it and the windows
    rows = blocked(rows, ["job_id"], "ts", width).groupBy("job_id", "__block", "ts").agg(F.min("t").alias("t"))
    longer = F.greatest(F.length("t"), F.length("prev.t"))
    apart = F.abs(F.length("t") - F.length("prev.t"))
    most = F.floor(near * longer).cast("int")
    # with a bound the distance is worked out in a band about the diagonal only; over it, it is -1
    close = F.call_function("levenshtein", F.col("t"), F.col("prev.t"), most) >= 0
    same = (F.col("t") == F.col("prev.t")) | ((apart <= most) & close)
    runs = collapse_runs(rows, ["job_id"], ["ts"], width, ["t"], same, ["ts"], ["ts"], F.col("t").isNotNull())
    return runs.select("job_id", F.col("first_ts").alias("first_ms"), F.col("last_ts").alias("last_ms"), F.col("n").alias("n_frames"), (F.col("last_ts") - F.col("first_ts")).alias("duration_ms"))
