"""Session settings and the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lectern")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local master may do without
    the setting: there a temporary folder is as good as a shared one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(folder)
        return folder
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    master = sc.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
    return sc.getCheckpointDir()


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new, not yet existing folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/lectern-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint: written once to the shared folder, so that later readers neither
    recompute it nor depend on the executor that made it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """Like :func:`cut`, as a Parquet table in the shared folder: for wide or long results of which later
    readers take some columns. It goes when the application ends."""
    spark = df.sparkSession
    folder = fresh_dir(spark, what)
    df.write.parquet(folder)
    atexit.register(forget_dir, spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def forget_dir(spark: SparkSession, folder: str) -> None:
    """Removes a folder at the end of the application, where it still can."""
    try:
        remove_dir(spark, folder)
    except Exception:  # noqa: BLE001 - the session can be gone by now
        pass


def remove_dir(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
