"""Rules, regions and lines on literal and random cases; parity with SQL is in test_parity."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import rules
from lectern.operators import lines, regions


def one(spark, value, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return row.select(value.alias("v")).first().v


@pytest.mark.parametrize(
    "text,clean,notes",
    [
        ("然后然后我们今今天忘忘记记", "然后我们今天忘记", [rules.DISFLUENCY, rules.TYPO]), ("就就就是很很好,真的??", "就是很好，真的？", [rules.DISFLUENCY, rules.PUNCTUATION]), ("好的.", "好的。", [rules.PUNCTUATION]), ("什么么", "什么", [rules.TYPO]),
        ("没有", "没有", []), ("", "", []), (None, None, []),
    ],
)
def test_rewrites(spark, text, clean, notes):
    row = spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for c, k in zip(rules.rewritten(F.col("t")), "cn")]).first()
    assert (row.c, row.n) == (clean, notes)


def test_fields(spark):
    cases = {'{"confidence": 0.4}': 0.4, '{"confidence": null, "score": 87}': 0.87, '{"confidence": "x", "confidence_score": 1}': 1.0, '{"score": 101}': None, "no json": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.c for r in df.select("t", rules.payload_confidence(F.col("t")).alias("c")).collect()} == cases
    labels = {"课板[v1]": ("unknown", "board_ocr"), "speaker 12": ("speaker_12", "speech"), "导师": ("teacher_a", "speech"), "": ("unknown", "speech"), "Speaker x": ("unknown", "speech")}
    df = spark.createDataFrame([(k,) for k in labels], "t string")
    assert {r.t: (r.a, r.b) for r in df.select("t", rules.label_speaker(F.col("t")).alias("a"), rules.label_type(F.col("t")).alias("b")).collect()} == labels
    secrets = {"x Bearer abc, y bearer def": "x Bearer [REDACTED], y bearer def", "none": "none", "bearer ": "bearer "}
    df = spark.createDataFrame([(k,) for k in secrets], "t string")
    assert {r.t: r.c for r in df.select("t", rules.without_bearer(F.col("t")).alias("c")).collect()} == secrets
    words = [(["a", "bc"], "abc"), (["ab", "cd"], "ab cd"), (["你好", "世界"], "你好世界"), (["a b", "c"], "a b c"), ([], "")]
    df = spark.createDataFrame([(k, w) for k, (w, _) in enumerate(words)], "k int, w array<string>")
    assert [r.c for r in df.select("k", rules.joined_words(F.col("w")).alias("c")).orderBy("k").collect()] == [t for _, t in words]


def test_regions(spark):
    box = "struct<x:int,y:int,width:int,height:int>"
    cases = [((-5, -5, 20, 20), (0, 0, 15, 15)), ((95, 0, 50, 10), (95, 0, 5, 10)), ((99, 0, 50, 10), None), ((0, 0, 1, 50), None), (None, None)]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], f"k int, r {box}")
    got = [r.c and tuple(r.c) for r in df.select("k", regions.clipped(F.col("r"), 100, 80).alias("c")).orderBy("k").collect()]
    assert got == [c[1] for c in cases]
    a, b = (100, 100, 100, 100), (110, 100, 100, 101)
    views = [(a, b, (105, 100, 100, 100)), (a, None, a), (None, b, b), (a, (300, 300, 9, 9), a), (None, None, None)]
    df = spark.createDataFrame([(k, *v[:2]) for k, v in enumerate(views)], f"k int, a {box}, b {box}")
    got = [r.c and tuple(r.c) for r in df.select("k", regions.paired_view(F.col("a"), F.col("b")).alias("c")).orderBy("k").collect()]
    assert got == [v[2] for v in views]


def test_combined_lines(spark):
    rnd = random.Random(6)
    words = ["the careful hinge of it", "the careful hlnge of it", "The Careful Hinge, of it", "短行", "短行！", "……", "", "another line entirely", None]
    rows = [(k, [(rnd.choice(words), rnd.choice([None, None, "", "the careful hinge of it"]), rnd.choice([None, 0.2, 0.9, float("nan")])) for _ in range(rnd.randint(0, 8))]) for k in range(60)] + [(60, None), (None, [("x", None, 0.1)])]
    df = spark.createDataFrame(rows, "board_id long, text_lines array<struct<text string, corrected_text string, confidence double>>").withColumn("line", F.lit(1))
    got = {}
    for r in lines.combined_lines(df).orderBy("board_id", "pos").collect():
        got.setdefault(r.board_id, []).append((r.line_no, r.line))
    want = {}
    for board, own in rows[:60]:
        out, keys = [], []
        for no, (text, fix, conf) in enumerate(own):
            t = (fix or text or "").strip()
            key = re.sub(r"[\W_]+", "", t).casefold()
            if not key:
                continue
            conf = 0.0 if conf is None or conf != conf else conf
            at = next((i for i, old in enumerate(keys) if key == old or min(len(key), len(old)) >= 6 and difflib.SequenceMatcher(None, key, old, autojunk=False).ratio() >= 0.92), None)
            if at is None:
                out.append((no, t, conf)), keys.append(key)
            elif conf > out[at][2]:
                out[at], keys[at] = (no, t, conf), key
        if out:
            want[board] = [o[:2] for o in out]
    assert got == want
    assert lines.combined_lines(df.where("false")).count() == 0


def test_kept_lines_like_brute_force(spark):
    rnd = random.Random(9)
    base = ["the careful hinge of it", "一行不太短的文字在这里", "short", "another line entirely here"]

    def noisy(t):
        t = list(t)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = rnd.choice("abc字")
        return "".join(t)

    docs = [(k, "\n".join(noisy(rnd.choice(base)) if rnd.random() < 0.9 else rnd.choice(["", "…", "!"]) for _ in range(rnd.randint(0, 120)))) for k in range(12)] + [(12, None), (13, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = set()
    for i, text in docs:
        kept = []
        for no, line in enumerate((text or "").split("\n")):
            key = re.sub(r"[\W_]+", "", line).casefold()
            if key and not any(key == old or len(key) >= 6 and len(old) >= 6 and difflib.SequenceMatcher(None, key, old, autojunk=False).ratio() >= 0.9 for old in kept):
                kept.append(key)
                want.add((i, no))
    assert {tuple(r) for r in lines.document_lines(df).collect()} == {tuple(r) for r in lines.near_line_dedup(lines.doc_lines(df)).collect()} == want
