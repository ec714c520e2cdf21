"""One streaming query that is fed with slices of a staged table, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.session import remove_dir

NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def run(spark: SparkSession, found: DataFrame, base: str, n: int) -> None:
    """Runs ``found``, which reads ``base``/in, to ``base``/out. Slice k of ``n`` is moved there from
    ``base``/stage/slice=k, as a whole and once all before it are done.

    Moving a folder is all that is done for each slice here; the query, its plan
    and its state are the same throughout. Batches without rows are off: each
    slice brings the watermark that the next one uses.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{base}/in"))
    before = spark.conf.get(NO_DATA)
    spark.conf.set(NO_DATA, "false")
    try:
        query = found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").start()
    finally:
        spark.conf.set(NO_DATA, before)
    try:
        for k in range(n):
            stage = path(f"{base}/stage/slice={k}")
            for side in (0, 1):  # both are listed, also where a slice has rows of one side only
                fs.mkdirs(path(f"{base}/stage/slice={k}/side={side}"))
            fs.rename(stage, path(f"{base}/in/{k:09d}"))
            query.processAllAvailable()
    finally:
        query.stop()
    for folder in ("stage", "in", "state"):
        remove_dir(spark, f"{base}/{folder}")
