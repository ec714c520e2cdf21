"""Postings, document frequency, BM25 and n-gram ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import query_grams
from lectern.session import cut


#: Query tokens (a row for each query and token) that are broadcast at most; more are joined by shuffle.
BROADCAST_TOKENS = 200_000


def _small(asked: DataFrame) -> tuple[DataFrame, bool]:
    """The queries' tokens, cut, and whether they may be broadcast: then a token that a
    third of all documents hold doesn't bring them together in one task."""
    asked = cut(asked)
    return asked, asked.count() <= BROADCAST_TOKENS


def _with_tokens(rows: DataFrame, tokens: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(tokens) if small else tokens, "token", how)


def words(text):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame | None = None, small: bool = False) -> DataFrame:
    """(id, token, tf, dl). With ``wanted`` (token) only these tokens are kept, before the shuffle."""
    rows = docs.select(id_col, words(F.col(text_col)).alias("w")).withColumn("dl", F.size("w").cast("long"))
    rows = rows.select(id_col, "dl", F.explode("w").alias("token"))
    if wanted is not None:
        rows = _with_tokens(rows, wanted.select("token").distinct(), small, "left_semi")
    return rows.groupBy(id_col, "dl", "token").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return postings(docs, id_col, text_col).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int = 8, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best documents of each query by BM25; ties: the smaller id.

    ``queries``: query_id, text. Only postings of the queries' tokens are shuffled.
    """
    asked, small = _small(queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("token")))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(words(F.coalesce(F.col(text_col), F.lit(""))))).alias("mean")).first()
    n, mean = stats["n"], stats["mean"] or 1.0
    post = cut(postings(docs, id_col, text_col, asked, small))  # of the queries' tokens alone; read twice
    df = post.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(mean)))
    asked = asked.join(df, "token")
    hits = _with_tokens(post, asked, small).groupBy("query_id", id_col).agg(F.round(F.sum(gain), 6).alias("score"))
    return _best(hits, id_col, k)


def _best(hits: DataFrame, id_col: str, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def gram_search(entries: DataFrame, queries: DataFrame, k: int = 8, boost: float = 2.5) -> DataFrame:
    """(query_id, id, score, rank): fallback ranking by n-grams that stand in title or body.

    Score: length times idf, ``boost`` times that for the title, plus the entry's
    confidence. N-grams of entries are kept only where a query has them; that
    list is small, and joined by equality.
    """
    asked, small = _small(queries.select("query_id", F.explode(query_grams(F.col("text"))).alias("token")))
    n = entries.count()
    grams = lambda c: F.explode(query_grams(F.coalesce(F.col(c), F.lit(""))))
    rows = entries.select("id", F.lit(True).alias("in_title"), grams("title").alias("token")).unionByName(entries.select("id", F.lit(False).alias("in_title"), grams("body").alias("token")))
    held = cut(_with_tokens(rows, asked.select("token").distinct(), small, "left_semi").groupBy("id", "token").agg(F.max("in_title").alias("in_title")))
    df = held.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    gain = F.length("token") * (F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1) * F.when(F.col("in_title"), boost).otherwise(1.0)
    hits = _with_tokens(held, asked.join(df, "token"), small).groupBy("query_id", "id").agg(F.sum(gain).alias("s"))
    hits = hits.join(entries.select("id", F.coalesce("confidence", F.lit(0.0)).alias("c")), "id").select("query_id", "id", F.round(F.col("s") + F.col("c"), 6).alias("score"))
    return _best(hits, "id", k)
