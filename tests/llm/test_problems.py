"""The llm problems on small tables, against brute force, libraries and literal cases."""

import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import copies, leaks, nearest, pages, privacy, scans, tokens, turns
from lectern.llm.boost import Boosted

SF = "/root/testdata/sf0.001"


# --- 2 ---------------------------------------------------------------------
SPEECH = "speech_id long, job_id string, start_ms long, end_ms long, text string, speaker_id string, n int"


def test_turns(spark):
    rows = [
        (1, "j", 0, 900, "hello", "ｓｐｅａｋｅｒ＿１", 0), (1, "j", 0, 900, "hello", "ｓｐｅａｋｅｒ＿１", 0),
        (2, "j", 1000, 1500, "[音乐] 嗯，", "speaker_2", 0), (3, "j", 2000, 1900, "(0:02) Speaker 01: yes", "未知", 0),
        (4, "j", 3000, 9_999_999, "[S2] no", None, 0), (5, "j", 4000, 4500, "just talk", "?", 0), (6, "j", 4000, 4500, "00:00:04.000 ->  um, 那那个", "SPEAKER_03", 0),
        (7, None, 0, 1, "x", "spk1", 0), (8, "j", None, 1, "x", "spk1", 0), (9, "j", 5000, 5100, None, "spk1", 0), (10, "j", 6000, None, "(415) 555-0174", "Spk-12", 0),
    ]
    got = [tuple(r) for r in turns.speaker_turns(spark.createDataFrame(rows, SPEECH), per_block=3).orderBy("start_ms").collect()]
    assert [g[:4] for g in got] == [("j", "speaker_1", 1, 3), ("j", "speaker_2", 4, 4), ("j", "unknown", 5, 5), ("j", "speaker_12", 10, 10)]
    assert all(g[5] >= g[4] for g in got)
    assert turns.speaker_turns(spark.createDataFrame([], SPEECH)).count() == 0


def test_isotonic(spark):
    rnd = random.Random(1)
    rows = [("j", k, 10 * k + rnd.choice([0, 0, 0, 35, -35])) for k in range(200)]
    df = spark.createDataFrame(rows, "job_id string, k long, v long")
    got = [r.fit for r in turns.isotonic(df, ["job_id"], ["k"], "v", "fit", 16).orderBy("k").collect()]
    assert got == pytest.approx(list(turns.pool([v for _, _, v in rows])))
    back = turns.unreset(spark.createDataFrame([("j", k, t) for k, t in enumerate([0, 50_000, 100_000, 5, 60_000])], "job_id string, k long, t long"), ["job_id"], "k", "t", "lost").orderBy("k").collect()
    assert [r.t + r.lost for r in back] == [0, 50_000, 100_000, 100_000, 159_995]


@pytest.mark.parametrize("per_block", [2, 7, 16_384])
def test_turns_after_clock_resets(spark, per_block):
    """Planted resets and jitter, against the repair and the runs in plain Python; without the repair the turns would be others."""
    rnd = random.Random(3)
    rows, clock = [], 0
    for k in range(120):
        if k in (40, 41, 90):
            clock = rnd.randint(0, 2000)
        clock += rnd.randint(1000, 9000)
        jitter = rnd.choice([0, 0, 0, 12_000])
        rows.append((100 + k, "j", clock - jitter, clock + 800, f"word{k}", f"spk{rnd.choice([1, 1, 2])}", 0))
    lost, last, raw = 0, None, []
    for i, _, a, b, t, s, _ in rows:
        if last is not None and last - a > 60_000:
            lost += last - a
        raw.append((a + lost, (b if a <= b else a) + lost))
        last = a
    starts, ends = ([int(x + 0.5) if x >= 0 else -int(0.5 - x) for x in turns.pool([r[k] for r in raw])] for k in (0, 1))
    placed = sorted((a, r[2], r[0], r[5].replace("spk", "speaker_"), max(a, b), r[4]) for a, b, r in zip(starts, ends, rows))
    want, texts = [], []
    for a, _, i, s, b, t in placed:
        if want and want[-1][0] == s:
            want[-1][2:] = [i, want[-1][3], b, want[-1][5] + 1]
            texts[-1].append(t)
        else:
            want.append([s, i, i, a, b, 1])
            texts.append([t])
    df = spark.createDataFrame(rnd.sample(rows, len(rows)) + rows[:9], SPEECH)
    got = sorted(turns.speaker_turns(df, per_block=per_block).collect(), key=lambda r: (r.start_ms, r.first_speech_id))
    assert [tuple(r[1:]) for r in got] == sorted((tuple(w) for w in want), key=lambda w: (w[3], w[1]))
    by_start = sorted((r[2], r[0], r[5]) for r in rows)
    assert len(got) != sum(k == 0 or by_start[k][2] != by_start[k - 1][2] for k in range(len(rows)))
    parts = {}
    for r in sorted(turns.turn_texts(df, per_block=per_block).collect(), key=lambda r: r.part):
        parts.setdefault(r.first_speech_id, []).append(r.text)
    assert {i: " ".join(p) for i, p in parts.items()} == {w[1]: " ".join(t) for w, t in zip(want, texts)}


def test_clean(spark):
    cases = {"[00:03:05] 啊，有人问比例 ♪音乐♪": "有人问比例", "Speaker 1: um, I mean keep the the ratio": "keep the ratio", None: "", "多数多数学员": "多数学员"}
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    assert {r.text: r.c for r in df.select("text", turns.clean_utterance(F.col("text")).alias("c")).collect()} == cases


# --- 3 ---------------------------------------------------------------------
def test_copies(spark):
    rows = [("b", "Ａ title", "x: 1\ny: 2"), ("a", "a TITLE!", "Y：2\n\n  X:１ "), ("a", "a TITLE!", "Y：2\n\n  X:１ "), ("c", "a title", "x: 1\ny: 3"), ("d", None, "z"), ("e", "", "z"), ("f", "t", " \n"), ("g", "t", None), (None, "a title", "x1")]
    df = spark.createDataFrame(rows, "id string, title string, body string").withColumn("key", F.lit(1))
    got = {tuple(r) for r in copies.entry_copies(df).collect()}
    assert got == {("a", "a", 2), ("b", "a", 2), ("c", "c", 1), ("d", "d", 2), ("e", "d", 2)}
    assert copies.entry_copies(df.where("false")).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"shard_bits": 1 << 12, "broadcast_bytes": 0}, {"shard_bits": 1 << 12, "broadcast_bytes": 0, "hot": 1000}])
def test_copies_in_bulk(spark, sizes):
    """A third in one group, filters broadcast or in shards."""
    df = spark.range(6000).select(F.format_string("%05d", "id").alias("id"), F.unhex(F.sha2(F.when(F.col("id") % 3 == 0, 0).otherwise((F.col("id") / 2).cast("long")).cast("string"), 256)).alias("key"))
    got = {r.id: (r.first_id, r.n_copies) for r in copies.with_copies(df, **sizes).collect()}
    groups = {}
    for k in range(6000):
        groups.setdefault(0 if k % 3 == 0 else k // 2, []).append(f"{k:05d}")
    assert got == {i: (min(g), len(g)) for g in groups.values() for i in g}


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0}, {"shard_bits": 1 << 14, "broadcast_bytes": 0}])
def test_few_singletons_pass_the_filters(spark, sizes):
    """At one, 40 and 293 shards alike, under a twentieth of the singletons is shuffled, and no repeated row is missed."""
    n = 300_000
    df = spark.range(n).select("id", F.unhex(F.sha2(F.when(F.col("id") < 1000, F.col("id") % 500).otherwise(F.col("id")).cast("string"), 256)).alias("key"))
    again = copies.mark_repeats(df, n, **sizes).where("again").select(F.count_if(F.col("id") < 1000), F.count_if(F.col("id") >= 1000)).first()
    assert again[0] == 1000 and again[1] < 0.05 * n


# --- 4 ---------------------------------------------------------------------
NAMES = [("沈", "family", "zh"), ("知微", "given", "zh"), ("高", "family", "zh"), ("Grace", "given", "en"), ("Brondt", "family", "en"), ("Ostrander-Vey", "family", "en")]
PII = [
    ("write to K.BRONDT@example.com now", {"email"}), ("k dot brondt at mail dot example dot net", {"email"}), ("room498 [at] inbox.test", {"email"}), ("ｐ．ｖ＠ｅｘａｍｐｌｅ．ｏｒｇ", {"email"}),
    ("slides at 6 @ 30 each", set()), ("ping @desk please", set()), ("请 @助教 看一下", set()),
    ("电话 138-0013-8000", {"phone"}), ("(+86)147-00081457", {"phone"}), ("幺五八零零零八六三零七", {"phone"}), ("call (415) 555-0174", {"phone"}), ("four one five five five five zero one seven four", {"phone"}),
    ("订单 10727047931", set()), ("条码 69528400569996846710", set()), ("443 by 6187 pixels", set()), ("SEG-C0042-00008583", set()),
    ("身份证 519999 19960219 3763", {"id_number"}), ("449999200505128091？", {"id_number"}), ("my id is 000-20-5781", {"id_number"}), ("SSN 000905253", {"id_number"}),
    ("就在锦麦区砚池路265 号", {"address"}), ("杏园大道３７２号359室", {"address"}), ("在第49号课板上", set()), ("at 377 Copperbeck Close, Unit #34", {"address"}), ("Hollin Rd 134", {"address"}), ("somewhere off Hollin Lane", set()), ("page 80 of lane B", set()),
    ("感谢沈 知微", {"name"}), ("沈老师说", set()), ("提高效率", set()), ("Grace K. Brondt", {"name"}), ("BRONDT, Grace", {"name"}), ("with grace at home", set()), ("Ms. Brondt says", set()), ("Grace Ostrander-Vey", {"name"}),
    ("", set()), ("long " * 50_000, set()),
    ("编号 519999199602193764", set()), ("身份证 519999199602193764", {"id_number"}), ("my identity, as the office has it in that old and rather thick green book of theirs, is 000905253", {"id_number"}), ("my identity is secret. Code 000905253", set()),
    ("mail " + "ab." * 70 + "cd@example.com now", {"email"}), ("mail " + "ab dot " * 70 + "cd at example dot com now", {"email"}), ("at 12 " + "long" * 40 + " street", {"address"}), ("Brondt,  K.  Grace", {"name"}),
]


@pytest.mark.parametrize("text,kinds", PII)
def test_personal_information(text, kinds):
    finder = privacy.Finder(NAMES)
    spans = finder.spans(text)
    assert {k for _, _, k in spans} == kinds
    clean = privacy.redact(text, spans)
    assert not finder.spans(clean)
    if text.startswith("mail "):
        assert clean == "mail [EMAIL] now"
    if not kinds:
        assert clean == text


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([("t", "1", "email k@example.com, thanks"), ("t", "2", None), ("t", "3", "")], "tab string, rec_id string, text string")
    got = {r.rec_id: (r.kinds, r.clean) for r in privacy.personal_information(df, NAMES).collect()}
    assert got == {"1": (["email"], "email [EMAIL], thanks"), "2": ([], None), "3": ([], "")}


# --- 5 ---------------------------------------------------------------------
@pytest.mark.parametrize("slice_rows", [8, 40, None])
def test_nearest(spark, slice_rows, monkeypatch):
    from lectern.llm import replay

    runs, run = [], replay.run
    monkeypatch.setattr(replay, "run", lambda *args: (runs.append(args[3]), run(*args)))
    rnd = random.Random(4)
    left = [(rnd.choice("ab"), k, rnd.randint(0, 60) * 100) for k in range(120)]
    right = [(rnd.choice("ab"), k, rnd.randint(0, 60) * 100 + 50) for k in range(60)]
    extra = [("a", None, 5), (None, 900, 5), ("a", 901, None), left[0]]
    a = spark.createDataFrame(left + extra, "key string, left_id long, start_ms long")
    b = spark.createDataFrame(right + [right[0]], "key string, right_id long, start_ms long")
    got = [(r.left_id, r.right_id) for r in nearest.nearest_in_time(a, b, 120, slice_rows=slice_rows).collect()]
    want = []
    for key, i, t in left:
        near = [(abs(t - u), u, r) for k, r, u in right if k == key and abs(t - u) <= 120]
        if near:
            want.append((i, min(near)[2]))
    assert sorted(got) == sorted(want)
    # one query, however many slices
    assert len(runs) == 1 and (runs[0] > 15 if slice_rows == 8 else runs[0] >= 3)
    assert nearest.nearest_in_time(a.where("false"), b.where("false")).count() == 0
    assert nearest.nearest_in_time(a, b.where("false")).count() == 0


# --- 6 ---------------------------------------------------------------------
def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("width", [4, 10_000])
def test_page_stays(spark, width):
    rnd = random.Random(2)
    texts = ["the quick brown fox", "The quick brown f0x!", "ｔｈｅ quick brown fox", "other words here", None, "  ", "……"]
    rows = [("j", 2 * k, rnd.choice(texts[:3] * 3 + texts)) for k in range(150)]
    df = spark.createDataFrame(rows + rows[:5] + [(None, 1, "x"), ("j", None, "x")], "job_id string, timestamp_ms long, ocr_text string")
    got = {tuple(r)[:4] for r in pages.page_stays(df, width=width).collect()}
    bare = [None if t is None or not t.strip() else re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", t)).lower() if t != "……" else "" for _, _, t in rows]
    want, k = set(), 0
    while k < len(rows):
        m = k
        if bare[k] is not None:
            while m + 1 < len(rows) and bare[m + 1] is not None and edit(bare[m], bare[m + 1]) <= 0.15 * max(len(bare[m]), len(bare[m + 1])):
                m += 1
            want.add(("j", rows[k][1], rows[m][1], m - k + 1))
        k = m + 1
    assert got == want
    assert pages.page_stays(df.where("false")).count() == 0


# --- 7 ---------------------------------------------------------------------
BOARD = "board_id long, job_id string, text_lines array<struct<text string, corrected_text string, confidence double>>"


def test_boards(spark):
    from lectern.sources.tables import table

    boards = table(spark, SF, "board_segments", "board_id", "job_id", "text_lines")
    got = {}
    for r in scans.board_lines(boards).collect():
        got.setdefault(r.kind, set()).add((r.board_id, r.line_no))
    rows = {r.board_id: r.text_lines for r in boards.collect()}
    cut = {(b, k) for b, ls in rows.items() for k, x in enumerate(ls[:-1]) if re.search(r"[A-Za-z][-‐­¬]\s*$", x.text)}
    assert got["hyphen"] == cut
    mended = {(b, k) for b, ls in rows.items() for k, x in enumerate(ls) if x.corrected_text and x.corrected_text != x.text}
    assert len(mended & got["misread"]) >= 0.8 * len(mended)


def test_odd_boards(spark):
    rows = [(1, "j", None), (2, "j", []), (3, None, [(None, None, None), ("12 / 40", None, 0.5)]), (4, "j", [("a" * 100_000, None, 0.1)]), (4, "j", [("a" * 100_000, None, 0.1)])]
    df = spark.createDataFrame(rows, BOARD)
    assert {tuple(r) for r in scans.board_lines(df).collect()} == {(3, 1, "page_number")}
    assert scans.board_lines(df.where("false")).count() == 0
    assert scans.page_number("第 26 页 共 104 页") == (26, False) and scans.page_number("3 + 4 = 7") is None and scans.page_number("= 42") is None


def test_assemble():
    kinds = {(0, "header"), (3, "page_number"), (1, "hyphen")}
    assert scans.assemble(["Head", "We keep the b0r-", "der here.", "- 7 -"], kinds, [{"kind": "w", "tok": "b0rder", "cand": "border", "line_no": 1}]) == "We keep the border here."


def test_boosting():
    rnd = random.Random(0)
    x = [[rnd.random(), rnd.random()] for _ in range(400)]
    y = [float((a > 0.5) != (b > 0.5)) for a, b in x]
    p = Boosted().fit(x[:300], y[:300]).score(x[300:])
    assert sum((q >= 0.5) == bool(t) for q, t in zip(p, y[300:])) >= 90
    assert Boosted().fit([], []).score([[0, 0]]) < 0.5


# --- 8 and 10 --------------------------------------------------------------
@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


ODD = ["", " ", "  a", "a'sword 's 'S ''s it's we'll they've I'm 'll", "a" * 300, "\n\n\n a \t b　c \r\n", "<|endoftext|> x", "😀👍🏽 中文're測試١٢٣½Ⅻ", "'", "x'", "a​b﻿\x1c\x1fz", "\x85\xa0q", "中" * 5000]


def test_ids(spark, libraries):
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("a's \n1.l've中　é😀'rtd") for _ in range(rnd.randint(1, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").withColumn("ids", F.lit(0))
    got = {r.doc_id: r.ids for r in tokens.encode_texts(df, "doc_id", "text").collect()}
    for k, t in enumerate([*texts, None]):
        assert got[k] == libraries.encode(t or "", add_special_tokens=False).ids
    assert tokens.encode_texts(df.where("false"), "doc_id", "text").count() == 0


def test_ids_where_hashes_clash(libraries, monkeypatch):
    spans = tokens.span_hashes
    monkeypatch.setattr(tokens, "span_hashes", lambda codes, a, b, seed: spans(codes, a, b, seed) % 7 if seed == 1 else spans(codes, a, b, seed))
    with open(tokens.VOCABULARY, "rb") as f:
        enc = tokens.Encoder(f.read())
    for _ in range(2):
        ids, begin, _, _ = enc.encode(ODD)
        assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [libraries.encode(t, add_special_tokens=False).ids for t in ODD]


def test_very_long_texts_in_parts(libraries, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 50)
    text = "it's a  test\n\nof 分段 'll  and\t more " * 40
    parts = tokens.safe_parts(text, 50)
    assert len(parts) > 5 and "".join(parts) == text
    assert [i for p in parts for i in libraries.encode(p).ids] == libraries.encode(text).ids


def test_pieces(spark, libraries):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(["word ", "另一个词", "end. ", "\n", "\n\n", "x"]) for _ in range(rnd.randint(1, 900))) for _ in range(40)] + ODD + ["中" * 900]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    by = {}
    for r in tokens.split_texts(df, "doc_id", "text", limit=100, overlap=20).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {k for k, t in enumerate(texts) if t}
    for k, ps in by.items():
        t = texts[k]
        ps.sort(key=lambda r: r.piece_no)
        assert ps[0].start_char == 0 and ps[-1].end_char == len(t)
        assert (len(ps) > 1) == (len(libraries.encode(t).ids) > 100)
        for p in ps:
            assert p.piece == t[p.start_char : p.end_char]
            assert p.n_tokens == len(libraries.encode(p.piece).ids) <= 100
        for a, b in zip(ps, ps[1:]):
            assert a.start_char < b.start_char < a.end_char < b.end_char
            # 20 tokens, or at most half of that more or less; counted by itself, a cut inside a pre-token adds a few
            assert 9 <= len(libraries.encode(t[b.start_char : a.end_char]).ids) <= 34


# --- 9 ---------------------------------------------------------------------
def test_leaks(spark):
    items = [(1, "en", "At Marrowdene a leeward signalman inspects 6271 crates near the splintered sextant behind Fennick today."), (2, "zh", "编号5372的桅杆属于栖潮埠，它只升起背风桅杆。若灯塔每刻钟清点一次铜制罗盘。"), (3, "en", "too short to count"), (4, None, None)]
    docs = [
        (1, "x at MARROWDENE, a leeward — signalman\ninspects 6271 crates near the splintered sextant y"),
        (2, "at Marrowdene a leeward signalman inspects 6271 crates near the splintered"),
        (3, "前文编号５３７２的桅杆 属于栖潮埠它只升起背风桅杆若灯塔每后文"),
        (4, "At Quillhaven a leeward signalman inspects 9999 crates near the splintered sextant behind Ostrey today."),
        (5, None), (6, ""), (7, "word " * 100_000),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("how", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, lang string, text string")
    names = ["Marrowdene", "Quillhaven", "Fennick", "Ostrey"]
    got = {tuple(r) for r in leaks.leaks(d, i, names).collect()}
    assert {g[:2] for g in got if g[2] == "verbatim"} == {(1, 1), (3, 2)}
    assert (4, 1, "reparameterised") in got and (2, 1, "verbatim") not in got
    assert leaks.leaks(d.where("false"), i, names).count() == 0
    assert leaks.leaks(d, i.where("false"), names).count() == 0


def passages(text, zh):
    fold = lambda t: unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    w = re.findall(r"[^\W_]+", fold(text))
    return {s[k : k + 24] for s in ["".join(w)] for k in range(len(s) - 23)} if zh else {tuple(w[k : k + 12]) for k in range(len(w) - 11)}


@pytest.mark.parametrize("sizes", [{}, {"index_items": 0}])
def test_runs_of_slots_and_forms_of_letters(spark, sizes):
    """Runs of numbers longer than the item's, items of nothing but slots, decomposed letters alone and in company; brute force on random ones."""
    rnd = random.Random(5)
    word = lambda: rnd.choice(["7", "8", "19", "Anna", "Ben", "seconds", "the", "é", "cle\u0301", "STRASSE", "straße"])
    han = lambda: rnd.choice("一二三9年城高港人我的１")
    items = [(1, "en", "The code is " + " ".join(map(str, range(11, 23)))), (2, "en", "Le café fermé était déjà plein à Orléans où René mangeait encore"), (3, "en", " ".join(map(str, range(40, 60))))]
    items += [(10 + k, "en", " ".join(word() for _ in range(30))) for k in range(10)] + [(30 + k, "zh", "".join(han() for _ in range(60))) for k in range(10)]
    docs = [(1, "xx " + " ".join(map(str, range(7, 23)))), (2, unicodedata.normalize("NFD", "le café fermé était déjà plein à Orléans où René mangeait encore")), (3, "… ß"), (4, " ".join(map(str, range(48, 80))))]
    for k in range(60):
        i, lang, t = rnd.choice(items[3:])
        w = t.split() if lang == "en" else list(t)
        a = rnd.randint(0, len(w) - 14)
        cut_ = w[a : a + rnd.randint(10, 30)]
        docs.append((10 + k, (" " if lang == "en" else "").join([word() if lang == "en" else han() for _ in range(3)] + cut_ + [word() if lang == "en" else han() for _ in range(3)])))
    d = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, lang string, text string")
    got = {tuple(r) for r in leaks.leaks(d, i, ["Anna", "Ben"], **sizes).collect()}
    want = {(k, j) for j, lang, t in items for k, u in docs if passages(t, lang == "zh") & passages(u, lang == "zh")}
    assert {g[:2] for g in got if g[2] == "verbatim"} == want and {(1, 1), (2, 2), (4, 3)} <= want
    alone = d.where("doc_id = 2").coalesce(1)
    assert {tuple(r) for r in leaks.leaks(alone, i, reparameterised=False, **sizes).collect()} == {(2, 2, "verbatim")}


def test_many_items_like_few(spark):
    items = [(1, "en", "At Marrowdene a leeward signalman inspects 6271 crates near the splintered sextant behind Fennick today.")]
    docs = [(4, "At Quillhaven a leeward signalman inspects 9999 crates near the splintered sextant behind Ostrey today."), (5, "At Ostrey a leeward signalman inspects 9999 crates near the splintered sextant behind Ostrey today.")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, lang string, text string")
    names = ["Marrowdene", "Quillhaven", "Fennick", "Ostrey"]
    assert {tuple(r) for r in leaks.leaks(d, i, names).collect()} == {tuple(r) for r in leaks.leaks(d, i, names, index_items=0).collect()} == {(4, 1, "reparameterised")}


def test_passages_over_the_border_of_parts(spark, monkeypatch):
    monkeypatch.setattr(leaks, "CHUNK", 500)
    monkeypatch.setattr(leaks, "OVERLAP", 64)
    item = "one two three four five six seven eight nine ten eleven twelve"
    names = leaks.word_hashes(["none"])
    index = (leaks.build_index([(1, "en", item)], names), names)
    for gap in (" ", " " * 90, "\u0301" * 40 + " "):
        for before in range(900, 1100, 7):
            text = "ab " * (before // 3) + "x" * (before % 3) + " " + item.replace(" ", gap) + " cd" * 2000
            out = [r for b in leaks._search(iter([pa.RecordBatch.from_arrays([pa.array([9]), pa.array([text])], ["doc_id", "text"])]), type("B", (), {"value": index}), False) for r in b.to_pylist()]
            assert len(out) == (0 if "\u0301" in gap else 1)


def test_leaks_like_brute_force(spark):
    from lectern.llm import plans
    from lectern.sources.tables import table

    grams = passages
    items = table(spark, SF, "eval_items").collect()
    want = set()
    index = {zh: [(r.item_id, grams(r.text, zh)) for r in items if (r.lang == "zh") == zh] for zh in (False, True)}
    for r in table(spark, SF, "documents").where("text is not null").collect():
        for zh, own in index.items():
            g = grams(r.text, zh)
            want |= {(i, r.doc_id) for i, x in own if g & x}
    assert {tuple(r) for r in plans.p9_found(spark, SF).collect()} == want


def test_misread_lines_held_out(spark):
    """Corrections of one half of the boards, of the other, and of all are hidden from the fit; the
    hidden mended lines are found, and lines left as they are aren't. Nothing else says which characters are misread."""
    from lectern.sources.tables import table

    boards = table(spark, "/root/testdata/sf0.01", "board_segments", "board_id", "job_id", "text_lines").dropDuplicates(["board_id"]).cache()
    bare = F.transform("text_lines", lambda x: F.struct(x["text"].alias("text"), F.lit(None).cast("string").alias("corrected_text"), x["confidence"].alias("confidence")))
    half = F.pmod(F.xxhash64("board_id"), F.lit(2))
    tally = []
    for hide in (half == 0, half == 1, F.lit(True)):
        part = boards.withColumn("text_lines", F.when(hide, bare).otherwise(F.col("text_lines")))
        found = {(r.board_id, r.line_no) for r in scans.board_lines(part).where("kind = 'misread'").collect()}
        lines = [(r.board_id, k, x) for r in boards.where(hide).collect() for k, x in enumerate(r.text_lines or []) if x.corrected_text is not None]
        mended = {(b, k) for b, k, x in lines if x.corrected_text != x.text}
        same = {(b, k) for b, k, x in lines if x.corrected_text == x.text}
        tally.append((len(mended), len(found & mended), len(same), len(found & same)))
    (a, b, c, d), (e, f, g, h), (i, j, k, m) = tally
    assert a and e and b + f >= 0.9 * (a + e) and d + h <= 0.05 * (c + g)
    assert j >= 0.8 * i and m <= 0.05 * k
