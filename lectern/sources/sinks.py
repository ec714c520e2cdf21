"""Sinks. A folder is written once; writing the same rows again is allowed, others raise."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Row count and a sum of row hashes, whatever the order."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return int(row.n), int(row.h)


def write_once(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes ``df``; where ``path`` holds the same rows already nothing is done, and where it holds others it raises."""
    try:
        old = df.sparkSession.read.schema(df.schema).format(kind).load(path)
    except AnalysisException:
        old = None
    if old is not None:
        if fingerprint(old) != fingerprint(df):
            raise FileExistsError(path)
        return
    df.write.format(kind).mode("errorifexists").save(path)


def write_jobs_text(df: DataFrame, path: str, key: str, order: str, text: str) -> None:
    """Text files in one folder for each key, ordered by ``order`` within each file. A
    key's rows are range-partitioned by (key, order), so a large one is several files in order."""
    rows = df.repartitionByRange(key, order).sortWithinPartitions(key, order).select(key, text)
    rows.write.partitionBy(key).mode("errorifexists").text(path)


def entry_markdown(entries: DataFrame) -> DataFrame:
    """(id, markdown): front matter, title and body of each entry."""
    line = lambda k: F.concat(F.lit(f"{k}: "), F.coalesce(F.col(k).cast("string"), F.lit("")))
    head = F.concat_ws("\n", F.lit("---"), *[line(k) for k in ("id", "course_id", "case_id", "type")], F.lit("---"))
    return entries.select("id", F.concat_ws("\n\n", head, F.concat(F.lit("# "), F.coalesce("title", F.lit(""))), F.coalesce("body", F.lit(""))).alias("markdown"))


def board_bodies(boards: DataFrame) -> DataFrame:
    """(board_id, n_lines, body): corrected or read text of each line, trimmed, without empty ones."""
    kept = F.filter(F.transform("text_lines", lambda x: F.trim(F.coalesce(x["corrected_text"], x["text"]))), lambda t: t != "")
    return boards.select("board_id", F.coalesce(F.size(kept), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.array_join(kept, "\n"), F.lit("")).alias("body"))
