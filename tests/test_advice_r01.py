"""Places where a query did less than its whole job; small tables in the layout of the data."""

import json
import random

import pytest

import __spark_entry__ as entry
from lectern.sources import payloads


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_character_error_rate_of_all_texts(spark, tmp_path):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("ab 你好吗的😀é") for _ in range(rnd.randint(0, 9)))
    rows = [(k, word(), word()) for k in range(80)] + [(80, None, "你"), (81, "你", None)]
    put(spark, tmp_path, "transcript_segments", rows, "seg_id long, text string, raw_text string")
    got = {r.seg_id: r.cer for r in entry.queries()["character_error_rate"](spark, str(tmp_path)).collect()}
    assert got == {k: edits(raw, text) / len(raw) if raw else float(bool(text)) for k, text, raw in rows[:80]}


def test_sync_plan_of_all_documents(spark, tmp_path):
    rows = [(4, "a", "T", "C", 1), (2, "a", "T", "C", 2), (3, "b", "T", "C", 2), (1, "b", "T", "C", 4), (6, "a", "T", "D", 9), (7, "z", None, "C", 1), (9, "z", None, "C", 2), (10, None, "T", "C", 3)]
    rnd = random.Random(2)
    rows += [(k, rnd.choice("ab"), rnd.choice(["U", "V", None]), rnd.choice("CD"), rnd.randint(0, 20)) for k in range(100, 180)]
    put(spark, tmp_path, "documents", rows, "doc_id long, text string, title string, course_id string, created_at long")
    known, want = {}, {}
    for k, text, title, course, _ in sorted((x for x in rows if x[1] is not None), key=lambda x: (x[4], x[0])):
        old = known.get((title, course)) if title is not None else None
        want[k] = "create" if old is None else "skip" if old == text else "update"
        known[title, course] = text
    assert [want[k] for k in (4, 2, 3, 1, 6, 7, 9)] == ["create", "skip", "update", "skip", "create", "create", "create"]
    assert {r.doc_id: r.action for r in entry.queries()["sync_plan"](spark, str(tmp_path)).collect()} == want


def test_unknown_runs_with_the_gaps_of_the_reference(spark, tmp_path):
    at = {"a": [(0, 100, "s1"), (1100, 1200, None), (2200, 2300, "s1")], "b": [(0, 100, "s1"), (1101, 1200, None), (2200, 2300, "s1")], "c": [(0, 100, "s1"), (350, 400, None)], "d": [(0, 100, "s1"), (351, 400, None)], "e": [(0, 100, None), (350, 400, "s1")], "f": [(0, 100, None), (351, 400, "s1")]}
    rows = [(k * 10 + i, job, a, b, who, "x", None, None, False) for k, (job, spans) in enumerate(at.items()) for i, (a, b, who) in enumerate(spans)]
    put(spark, tmp_path, "speech_segments", rows, "speech_id long, job_id string, start_ms long, end_ms long, speaker_id string, text string, confidence double, match_ratio double, inferred boolean")
    got = {r.job_id: r.filled for r in entry.queries()["unknown_run_inherit"](spark, str(tmp_path)).collect() if r.speaker == "unknown"}
    assert got == {"a": "speaker_1", "b": "unknown", "c": "speaker_1", "d": "unknown", "e": "speaker_1", "f": "unknown"}


def test_word_runs(spark, tmp_path):
    rnd = random.Random(3)
    turns, segs = [], []
    for k in range(40):
        at = k * 5000
        turns += [(2 * k, "j", at, at + rnd.randint(200, 1500), "A"), (2 * k + 1, "j", at + rnd.randint(1500, 2500), at + 3500, "B")]
        cuts = sorted(rnd.sample(range(0, 4000, 50), 9))
        words = [(at + a, at + b - rnd.choice([0, 0, 60]), rnd.choice(["嗯", "好的", "，", "hello", ""])) for a, b in zip(cuts, cuts[1:])]
        segs.append((k, "j", at, at + 4000, "x", rnd.sample(words, len(words))))
    segs.append((99, "j", 0, 4000, "x", None))
    put(spark, tmp_path, "speaker_turns", [(*x, "wespeaker") for x in turns], "turn_id long, job_id string, start_ms long, end_ms long, speaker_id string, source string")
    put(spark, tmp_path, "transcript_segments", segs, "seg_id long, job_id string, start_ms long, end_ms long, text string, words array<struct<start_ms long, end_ms long, text string>>")

    def shares(a, b):
        out = {}
        for _, _, x, y, who in turns:
            if min(b, y) > max(a, x):
                out[who] = out.get(who, 0) + min(b, y) - max(a, x)
        return out

    want = {}
    for seg, _, a, b, _, words in segs:
        if not words or sum(v >= 0.15 * (b - a) for v in shares(a, b).values()) < 2:
            continue
        own, who = sorted(w for w in words if w[2] and w[1] > w[0]), []
        for x, y, _ in own:
            top = sorted(shares(x, y).items(), key=lambda p: -p[1])
            who.append("unknown" if not top or len(top) > 1 and top[0][1] == top[1][1] or top[0][1] / (y - x) < 0.5 else top[0][0])
        i, filled = 0, list(who)
        while i < len(who):
            j = i
            while j < len(who) and who[j] == who[i]:
                j += 1
            n = sum(len(w[2].strip("，")) for w in own[i:j])
            if who[i] == "unknown" and own[j - 1][1] - own[i][0] <= 800 and n <= 4:
                left, right = (who[i - 1] if i else None), (who[j] if j < len(who) else None)
                near = min((0 if min(own[j - 1][1], y) > max(own[i][0], x) else own[i][0] - y if y <= own[i][0] else x - own[j - 1][1], x, sp) for _, _, x, y, sp in turns)[2]
                filled[i:j] = [left or right or near] * (j - i)
            i = j
        want |= {(seg, k): (w[0], w[1], who[k - 1], filled[k - 1]) for k, w in enumerate(own, 1)}
    got = {(r.seg_id, r.word_no): (r.start_ms, r.end_ms, r.speaker, r.filled) for r in entry.queries()["word_runs_inherit"](spark, str(tmp_path)).collect()}
    assert got == want
    assert any(x[2] != x[3] for x in want.values()) and any(x[3] == "unknown" for x in want.values())


def test_confidence_of_inferred_and_shared_segments(spark, tmp_path):
    rows = [(1, 0, "s1", 0.9, None, False), (2, 0, "s1", 0.9, None, True), (3, 0, "s1", None, 0.5, True), (4, 0, None, 0.9, 0.9, True), (5, 100, "s1", 0.8, None, False), (6, 100, "s1", 0.8, None, True), (7, 100, "x", 0.8, None, False), (8, 200, "s1", 0.8, None, False), (9, 300, "s1", 0.8, None, None), (10, 100, "s1", 1.9, None, False), (11, 100, "s1", None, None, False)]
    put(spark, tmp_path, "speech_segments", [(k, "j", at, at + 100, who, "x", c, m, inf) for k, at, who, c, m, inf in rows], "speech_id long, job_id string, start_ms long, end_ms long, speaker_id string, text string, confidence double, match_ratio double, inferred boolean")
    # 100..200: A and B hold 15 % and more; 200..300: B holds 14 %; 300..400: one speaker under two engines' labels
    turns = [(1, 0, 100, "A", "wespeaker"), (2, 100, 185, "A", "wespeaker"), (3, 185, 200, "B", "wespeaker"), (4, 200, 286, "A", "wespeaker"), (5, 286, 300, "B", "wespeaker"), (6, 300, 400, "A", "wespeaker"), (7, 300, 400, "0", "campplus")]
    put(spark, tmp_path, "speaker_turns", [(k, "j", a, b, who, src) for k, a, b, who, src in turns], "turn_id long, job_id string, start_ms long, end_ms long, speaker_id string, source string")
    got = {r.speech_id: r.resolved and round(r.resolved, 9) for r in entry.queries()["resolved_confidence"](spark, str(tmp_path)).collect()}
    assert got == {1: 0.9, 2: 0.72, 3: 0.4, 4: 0.3, 5: 0.4, 6: 0.64, 7: 0.3, 8: 0.8, 9: 0.8, 10: 0.95, 11: None}


def brute_error(ref, hyp):
    """(ref, missed, speaker error, false alarm, der) of lists of (start, end, speaker)."""
    over = lambda x, y: max(0, min(x[1], y[1]) - max(x[0], y[0]))
    total = sum(b - a for a, b, _ in ref)
    if not total:
        return 0, 0, 0, sum(b - a for a, b, _ in hyp), 1.0
    scores = {}
    for h in hyp:
        for x in ref:
            scores[h[2], x[2]] = scores.get((h[2], x[2]), 0) + over(h, x)
    mapped = {}
    for (h, x), v in sorted(scores.items(), key=lambda p: (p[1], *p[0]), reverse=True):
        if v and h not in mapped and x not in mapped.values():
            mapped[h] = x
    missed = sum(max(0, x[1] - x[0] - sum(over(x, h) for h in hyp)) for x in ref)
    wrong = sum(over(x, h) for x in ref for h in hyp if mapped.get(h[2]) != x[2])
    false = sum(max(0, h[1] - h[0] - sum(over(x, h) for x in ref)) for h in hyp)
    return total, missed, wrong, false, (missed + wrong + false) / total


def test_diarization_error_and_ranking(spark, tmp_path):
    rnd = random.Random(4)
    span = lambda: (a := rnd.randint(0, 90_000), a + rnd.randint(1, 9000))
    turns = [(k, rnd.choice("abcde"), *span(), rnd.choice("xyz"), rnd.choice(["wespeaker", "campplus"])) for k in range(120)]
    turns += [(200, "only_w", 0, 9, "x", "wespeaker"), (201, "only_c", 0, 9, "x", "campplus"), (202, "w", 0, 1000, "A", "wespeaker"), (203, "w", 1000, 1900, "B", "wespeaker"), (204, "w", 0, 1900, "x", "campplus")]
    said = [(k, rnd.choice("abcd"), *span(), rnd.choice(["s1", "spk 2", None])) for k in range(60)]
    put(spark, tmp_path, "speaker_turns", turns, "turn_id long, job_id string, start_ms long, end_ms long, speaker_id string, source string")
    put(spark, tmp_path, "speech_segments", [(*x, "t", None, None, False) for x in said], "speech_id long, job_id string, start_ms long, end_ms long, speaker_id string, text string, confidence double, match_ratio double, inferred boolean")
    of = lambda job, source: [x[2:5] for x in turns if x[1] == job and x[5] == source]
    got = {r.job_id: (r.ref_ms, r.missed_ms, r.speaker_error_ms, r.false_alarm_ms, r.der) for r in entry.queries()["diarization_error"](spark, str(tmp_path)).collect()}
    assert got == {j: brute_error(of(j, "wespeaker"), of(j, "campplus")) for j in {x[1] for x in turns}}
    assert got["w"] == (1900, 0, 900, 0, 900 / 1900)
    want = {}
    for job in {x[1] for x in turns}:
        ref = [(a, b, {"s1": "speaker_1", "spk 2": "speaker_2"}[w]) for _, j, a, b, w in said if j == job and w]
        ranked = sorted((brute_error(ref, of(job, e))[4], e) for e in ("campplus", "wespeaker") if of(job, e))
        want |= {(job, e): (k, der) for k, (der, e) in enumerate(ranked, 1)}
    assert {(r.job_id, r.source): (r.rank, r.der) for r in entry.queries()["engine_der_ranking"](spark, str(tmp_path)).collect()} == want


def brute_iou(a, b):
    w, h = (max(0, min(a[i] + a[i + 2], b[i] + b[i + 2]) - max(a[i], b[i])) for i in (0, 1))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / union if union else 0.0


def boxes(spark, folder):
    rnd = random.Random(7)
    rows = [(order, k, rnd.randint(0, 40), rnd.randint(0, 40), float(rnd.randint(1, 50))) for order in range(30) for k in range(1, 8)] + [(98, 1, 5, 5, 5.0), (98, 1, 6, 6, 6.0), (99, 1, 5, 5, 5.0)]
    put(spark, folder, "lineitem", rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")
    return rows, {(o, i): (p, q, 20 + 30 * k, 20 + 4 * int(n)) for order in {x[0] for x in rows} for i, (o, k, p, q, n) in enumerate(sorted(x for x in rows if x[0] == order), 1)}


def test_best_iou(spark, tmp_path):
    _, box = boxes(spark, tmp_path)
    want = {}
    for o, k in box:
        near = [brute_iou(box[o, k], b) for (p, q), b in box.items() if p == o and q != k]
        want[o, k] = (len(near), max(near, default=0.0), max(near, default=0.0) >= 0.5)
    assert {(r.l_orderkey, r.id): (r.n_met, r.best_iou, r.hit) for r in entry.queries()["box_best_iou"](spark, str(tmp_path)).collect()} == want
    for r in entry.queries()["box_iou_scores"](spark, str(tmp_path)).collect():
        own = [v for (o, _), v in want.items() if o == r.l_orderkey]
        assert r.n == len(own) and abs(r.mean_iou - sum(v[1] for v in own) / len(own)) < 1e-12 and abs(r.top_k_hit_rate - sum(v[2] for v in own) / len(own)) < 1e-12


def test_hamming_of_all_dimensions(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(k, k % 2, [rnd.choice([-1.0, 0.0, 1.0]) for _ in range(64)]) for k in range(20)]
    put(spark, tmp_path, "embeddings", rows, "vec_id long, label int, embedding array<float>")
    want = {k: sum((x > 0) != (y > 0) for x, y in zip(v, rows[k - 2][2])) for k, _, v in rows[2:]}
    assert {r.vec_id: r.hamming for r in entry.queries()["hash_hamming"](spark, str(tmp_path)).collect()} == want


def test_nms_suppresses(spark, tmp_path):
    rows, box = boxes(spark, tmp_path)
    kept = []
    for at in sorted(box, key=lambda o: (o[0], -box[o][2] * box[o][3], o[1])):
        if all(brute_iou(box[at], box[k]) < 0.55 for k in kept if k[0] == at[0]):
            kept.append(at)
    assert {tuple(r) for r in entry.queries()["nms_boxes"](spark, str(tmp_path)).collect()} == set(kept)
    assert len(kept) < len(rows)


def test_ocr_shapes(spark):
    poly = lambda y: [[0, y], [10, y], [10, y + 10], [0, y + 10]]
    page = lambda *t: {"rec_texts": list(t), "rec_scores": [0.9] * len(t), "rec_polys": [poly(50 * k) for k in range(len(t))]}
    old = lambda *t: [[poly(50 * k), [x, 0.9]] for k, x in enumerate(t)]
    late = {"rec_texts": ["B"], "rec_scores": [0.9], "rec_polys": [], "dt_polys": [poly(50)]}
    shapes = [page("A", "B"), [page("A"), late], {"res": page("A", "B")}, {"res": [page("A"), late]}, [[page("A"), late]], old("A", "B"), [old("A", "B")], [None, old("A", "B")], [[poly(0), "A"], [poly(50), ["B", None]]]]
    raw = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(shapes)] + [(90, None), (91, "[]"), (92, "{}"), (93, "[[]]")], "frame_id long, raw string")
    got = {}
    for r in payloads.ocr_lines(raw).orderBy("frame_id", "line_no").collect():
        got.setdefault(r.frame_id, []).append((r.text, r.confidence))
    assert got == {k: [("A", 0.9), ("B", 0.9)] for k in range(8)} | {8: [("A", None), ("B", None)]}
    for bad in ('{"x": 1}', "text", "[1]", '[{"x": 1}]', '{"rec_texts": ["A"], "rec_polys": [[[0, 0]], [[0, 0]]]}'):
        with pytest.raises(Exception, match="unknown OCR payload|differ in number"):
            payloads.ocr_lines(spark.createDataFrame([(1, bad)], "frame_id long, raw string")).collect()


def test_campplus_turns(spark):
    raw = [{"text": "x", "sentence_info": [{"text": "a", "start": 500, "end": 900, "spk": 1}, {"text": "b", "start": 0, "end": 400, "speaker": "0"}, {"text": "c", "start": 950, "end": 990, "spk": -1}]}, {"text": "y"}]
    df = spark.createDataFrame([("j", json.dumps(raw)), ("k", None)], "job_id string, raw string")
    assert {tuple(r) for r in payloads.campplus_turns(df).collect()} == {("j", 500, 900, "speaker_1"), ("j", 0, 400, "speaker_0")}
