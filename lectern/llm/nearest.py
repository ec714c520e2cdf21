"""Problem 5: the nearest record in time, by a stateful stream-stream join."""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import replay
from lectern.session import forget_dir, fresh_dir

#: Rows of both sides that one slice of media time may hold in each shuffle partition, about: what a task keeps as state.
SLICE_ROWS = 250_000
#: Cells of media time that are counted to find the slices, at most.
CELLS = 1 << 16
DAY_MS = 86_400_000


def nearest_stream(left: DataFrame, right: DataFrame, tolerance_ms: int, late_ms: int, cell_ms: int = 60_000) -> DataFrame:
    """Streaming: for each left row (key, left_id, start_ms) the nearest right row
    (key, right_id, start_ms) of its key within the tolerance.

    Both sides are kept in the join's state per key and cell of ``cell_ms``; the
    right side also stands in the neighbouring cell it reaches into, so a hot
    key is spread over its cells and each pair is made once. The join drops a
    candidate once the watermark is past its horizon, and the aggregation emits
    a left row once the watermark has passed the row's own. Ties: the earlier
    start_ms, then the smaller right_id. Left rows without a partner don't come out.
    """
    stamp = F.timestamp_millis(F.col("start_ms"))
    own = left.select("key", "left_id", F.col("start_ms").alias("l_ms"), stamp.alias("l_ts")).withWatermark("l_ts", f"{late_ms} milliseconds")
    own = own.withColumn("cell", F.floor(F.col("l_ms") / cell_ms))
    other = right.select(F.col("key").alias("r_key"), "right_id", F.col("start_ms").alias("r_ms"), stamp.alias("r_ts")).withWatermark("r_ts", f"{late_ms} milliseconds")
    reach = F.array_distinct(F.array(*[F.floor((F.col("r_ms") + d) / cell_ms) for d in (-tolerance_ms, tolerance_ms)]))
    other = other.withColumn("r_cell", F.explode(reach))
    span = F.expr(f"interval {tolerance_ms // 1000} seconds {tolerance_ms % 1000} milliseconds")
    near = (F.col("r_ts") >= F.col("l_ts") - span) & (F.col("r_ts") <= F.col("l_ts") + span)
    pairs = own.join(other, (F.col("key") == F.col("r_key")) & (F.col("cell") == F.col("r_cell")) & near)
    best = F.struct(F.abs(F.col("l_ms") - F.col("r_ms")).alias("apart"), F.col("r_ms"), F.col("right_id"))
    return pairs.groupBy("l_ts", "key", "left_id").agg(F.min(best).alias("best")).select("key", "left_id", F.col("best.right_id").alias("right_id"), F.col("best.apart").alias("apart_ms"))


def slices(rows: DataFrame, low: int, high: int, slice_rows: int) -> DataFrame:
    """Adds ``slice``: slices of media time of about ``slice_rows`` rows each, numbered from 0 in order.

    Rows are counted in at most ``CELLS`` cells of equal length, whatever their
    number; successive cells make a slice. The cells' table is what is broadcast.
    """
    width = max(1, -(-(high - low + 1) // CELLS))
    rows = rows.withColumn("__cell", F.expr(f"(start_ms - {low}L) div {width}L"))
    counts = sorted(tuple(r) for r in rows.groupBy("__cell").agg(F.count(F.lit(1))).collect())  # bounded: CELLS rows
    at, before, table = 0, 0, []
    for cell, n in counts:
        if before and before + n > slice_rows:
            at, before = at + 1, 0
        before += n
        table.append((cell, at))
    cells = rows.sparkSession.createDataFrame(table, "__cell long, slice int")
    return rows.join(F.broadcast(cells), "__cell").drop("__cell")


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_ms: int = 400, slice_rows: int | None = None) -> DataFrame:
    """Replays two tables through :func:`nearest_stream` in the order of media time.

    The tables are ordered by arrival, days late in part, so no watermark over
    arrival keeps all rows. They are therefore staged in slices of media time
    (all keys from 0 on; ``slice_rows`` rows, by default ``SLICE_ROWS`` for each
    shuffle partition), and one running query takes one slice after the other:
    state holds one slice and the tolerance, and no row is late. Two last
    slices with an end mark on both sides push the watermark past all horizons.

    ``left``: key, left_id, start_ms; ``right``: key, right_id, start_ms. Rows
    that come twice with one id count once. Nulls in key, id or start_ms, and
    rows without a partner within the tolerance: no result row. Stage, state and
    result lie in the shared folder; the result (key, left_id, right_id,
    apart_ms) is read from there, and goes when the application ends.
    """
    spark: SparkSession = left.sparkSession
    base = fresh_dir(spark, "nearest")
    sides = {"left": (left, "left_id"), "right": (right, "right_id")}
    clean = {side: df.select("key", F.col(i).alias("id"), F.col("start_ms").cast("long").alias("start_ms")).dropna() for side, (df, i) in sides.items()}
    rows = clean["left"].select(F.lit(0).alias("side"), "*").unionByName(clean["right"].select(F.lit(1).alias("side"), "*"))
    total, low, high = rows.agg(F.count(F.lit(1)), F.min("start_ms"), F.max("start_ms")).first()
    if not total:
        return spark.createDataFrame([], "key string, left_id long, right_id long, apart_ms long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = slices(rows, low, high, slice_rows or SLICE_ROWS * parts)
    # event time begins a day after the epoch, as what is not after the first watermark counts as late
    staged = staged.withColumn("start_ms", F.col("start_ms") - low + DAY_MS)
    staged.repartition(parts, "slice", "id").dropDuplicates(["slice", "side", "id"]).write.partitionBy("slice", "side").parquet(f"{base}/stage")
    last = staged.agg(F.max("slice")).first()[0]
    schema = "key string, id long, start_ms long"
    for k in (1, 2):  # the end marks lie two horizons past everything
        for side in (0, 1):
            spark.createDataFrame([("", -k, high - low + DAY_MS + 10 * k * tolerance_ms + k)], schema).coalesce(1).write.parquet(f"{base}/stage/slice={last + k}/side={side}")
    streams = [spark.readStream.schema(schema).parquet(f"{base}/in/*/side={side}") for side in (0, 1)]
    found = nearest_stream(streams[0].withColumnRenamed("id", "left_id"), streams[1].withColumnRenamed("id", "right_id"), tolerance_ms, 0)
    replay.run(spark, found, base, last + 3)
    atexit.register(forget_dir, spark, base)
    return spark.read.schema(found.schema).parquet(f"{base}/out")

