"""Text functions on literal cases."""

from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.operators import lines, retrieval, scoring


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


def test_functions(spark):
    assert one(spark, t.error_rate(F.col("a"), F.col("b")), a="abcd", b="abxd") == 0.25
    assert one(spark, t.word_error_rate("a", "b"), a="hello world", b="hello there") == 0.5
    assert one(spark, t.clock(F.col("a")), a=3_723_004) == "01:02:03.004"
    assert one(spark, t.clock_ms(F.col("a")), a="01:02:03.004") == 3_723_004
    assert one(spark, t.clock_ms(F.col("a")), a="no time") is None
    assert one(spark, t.text_key(F.col("a")), a="Große, 你好！ 1") == "grosse你好1"
    assert one(spark, t.redact_patterns(F.col("a")), a="打13800138000或a.b@c.de，110101199003070011") == "打[手机号已脱敏]或[邮箱已脱敏]，[身份证号已脱敏]"
    assert one(spark, t.full_width_marks(F.col("a")), a="好,,吗??.") == "好，吗？。"
    assert one(spark, t.sequence_ratio("a", "b"), a="abcd", b="bcde") == 0.75
    assert one(spark, t.nfkc("a"), a=" Ａ　 b\n") == "A b"
    assert one(spark, t.canonical_hash("a"), a='{"b": 1, "a": 2}') == one(spark, t.canonical_hash("a"), a='{"a":2,"b":1}')


def test_nulls(spark):
    df = spark.createDataFrame([(None, None), ("", "")], "a string, b string")
    for c in (t.word_error_rate("a", "b"), t.sequence_ratio("a", "b"), t.nfkc("a"), t.canonical_hash("a"), t.text_key(F.col("a")), t.clock_ms(F.col("a"))):
        assert df.select(c.alias("x")).collect()[0].x is None


def test_near_lines(spark):
    docs = spark.createDataFrame([(1, "现在我们可以开始聊天了\n现在我们可以开始聊夭了\nab\nab\n别的一行文字"), (2, None), (3, "")], "doc_id long, text string")
    got = {(r.doc_id, r.line_no) for r in lines.near_line_dedup(lines.doc_lines(docs)).collect()}
    assert got == {(1, 0), (1, 2), (1, 4)}


def test_search_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    assert retrieval.bm25(docs, asked, "doc_id", "text").count() == 0


def test_matching(spark):
    schema = "job_id string, turn_id long, start_ms long, end_ms long, speaker_id string"
    ref = spark.createDataFrame([("j", 1, 0, 1000, "A"), ("j", 2, 1000, 2000, "B")], schema)
    hyp = spark.createDataFrame([("j", 3, 0, 1000, "x"), ("j", 4, 1000, 2000, "y")], schema)
    assert {tuple(r) for r in scoring.greedy_speaker_map(ref, hyp).collect()} == {("j", "x", "A"), ("j", "y", "B")}
    assert tuple(scoring.error_parts(ref, hyp).first()) == ("j", 2000, 0, 0)
