"""Findings of round 2: what is fitted is fitted on all rows, and sizes don't change results."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import boost, leaks, scans
from lectern.llm.boost import Boosted


# --- F1 --------------------------------------------------------------------
def test_fit_of_all_boards(spark):
    """More boards than the 3,000 that were fitted: each labelled line and pair counts."""
    rnd = random.Random(5)
    boards = [(b, [rnd.choice(["Running head", "Other words"]), "We keep it.", f"seen at the bor{rnd.choice('-,')}", "der of it all", "the old border was here"], [{"key": "runninghead", "share": 0.5, "n": 9}]) for b in range(4100)]
    fitted = scans.fit_lines(spark.createDataFrame(boards, "board_id long, lines array<string>, shares array<struct<key string, share double, n long>>"))
    heads, hyphens = (sum(b[1][k] in ("Running head", "seen at the bor-") for b in boards) for k in (0, 2))
    # of five lines one is inside; of the other lines only those whose share says what they are have a label
    assert math.isclose(fitted.furniture.base, math.log(heads / (5 * len(boards) - heads)))
    assert math.isclose(fitted.joins.base, math.log(hyphens / (4 * len(boards) - hyphens)))


def test_labels_of_all_lines(spark):
    """More corrected lines than the 20,000 that were read."""
    lines = spark.range(20_300).select(F.concat(F.lit("c0de "), F.col("id")).alias("lines"), F.concat(F.lit("code "), F.col("id")).alias("fixed"))
    told = scans.labels(lines.unionByName(lines))
    assert scans.word_pairs(told) == {("0", "o"): 20_300}
    assert [tuple(r) for r in told.where("what = 'good'").select("kind", "tok", "cand", "n").collect()] == [("w", "c0de", "code", 20_300)]
    assert [tuple(r) for r in told.where("what = 'seen'").select("kind", "tok", "n").collect()] == [("w", "c0de", 20_300)]


def test_labels_of_lines_apart(spark):
    """Lines that are read together say what each says alone."""
    rows = [("c0de 三木 x", "code 三本 x"), ("同い 年", "同じ 年"), ("a b", "ab"), ("", "x"), ("don't g0", "don't go"), ("Straße l0w", "Straße low")]
    schema = "lines string, fixed string"
    together = {tuple(r) for r in scans.labels(spark.createDataFrame(rows, schema).coalesce(1)).collect()}
    alone = {}
    for r in rows:
        for x in scans.labels(spark.createDataFrame([r], schema)).collect():
            alone[tuple(x)[:4]] = alone.get(tuple(x)[:4], 0) + x.n
    assert together == {(*k, n) for k, n in alone.items()} and len(together) > 10


def test_boosting_over_blocks(spark):
    """Rows in blocks give the model that they give on one machine, however they are spread."""
    rnd = np.random.default_rng(3)
    x = np.rint(rnd.normal(size=(3000, 4)) * 1000)
    y = ((x[:, 0] > 300) ^ (x[:, 1] > 0)).astype(float)
    want = Boosted().fit(x, y)
    cuts = [np.unique(np.quantile(c, want.shares())) for c in x.T]
    codes = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1).astype(np.uint8)
    models = []
    for parts, size in ((1, 3000), (3, 170)):
        blocks = [("w", codes[a : a + size], y[a : a + size]) for a in range(0, len(x), size)] + [("z", codes[:5], np.zeros(5))]
        models.append(boost.fit_blocks(spark.sparkContext.parallelize(blocks, parts), {"w": cuts, "z": cuts}, {"w": (len(y), int(y.sum())), "z": (5, 0)}))
    assert models[0]["w"].trees == models[1]["w"].trees and not models[0]["z"].trees
    assert np.allclose(models[0]["w"].score(x), want.score(x), atol=1e-6)
    cells, at, n = np.unique(np.column_stack([codes, y]), axis=0, return_index=True, return_counts=True)
    assert np.allclose(Boosted().fit_cells(cells[:, :4], cells[:, 4], n, cuts).score(x), want.score(x), atol=1e-6)


# --- F2 --------------------------------------------------------------------
def both_ways(d, i, names=()):
    few, many = ([tuple(r) for r in leaks.leaks(d, i, names, **sizes).collect()] for sizes in ({}, {"index_items": 0}))
    assert sorted(few) == sorted(many)
    assert len(few) == len(set(few))
    return set(few)


def test_names_of_items_by_any_plan(spark):
    """Names that only the items tell, in capitals and never otherwise, however many the items are."""
    text = "a leeward signalman inspects {} crates near {} and the splintered sextant behind it all"
    items = [(1, "en", text.format(6271, "Marrowdene")), (2, "en", "We came by Quillhaven and Ostrey, and by Rose. A rose is red.")]
    docs = [(k, text.format(9999, w)) for k, w in ((4, "Quillhaven"), (5, "Ostrey"), (6, "Rose"), (7, "Anna"))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, lang string, text string")
    assert both_ways(d, i) == {(4, 1, "reparameterised"), (5, 1, "reparameterised")}
    assert both_ways(d, i, ["Anna B."]) == {(k, 1, "reparameterised") for k in (4, 5, 7)}


def test_repeated_ids_by_any_plan(spark):
    """Each text of a repeated document or item counts, and a row comes once."""
    one, two = "the watch of a leeward signalman counts 6271 crates near the splintered sextant today", "we grow {} plums and {} pears beside the wall of the old garden there"
    items = [(1, "en", one), (1, "en", two.format(3, 4)), (1, "en", one)]
    docs = [(4, None), (4, ""), (4, "nothing"), (4, two.format(8, 9)), (4, one), (4, one), (5, two.format(8, 8))]
    i = spark.createDataFrame(items, "item_id long, lang string, text string")
    for parts in (1, 7):
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        assert both_ways(d, i) == {(4, 1, "verbatim"), (4, 1, "reparameterised")}


def test_places_at_borders_of_texts(spark):
    """The characters of the text before don't make a place of a text's first one."""
    body = "市我们在这里看见了许多奇怪的东西并且把它们都记录在本子上面了"
    alone, company = (leaks.char_stream(*leaks.folded(texts)) for texts in ([body], ["前文", body]))
    assert alone.kind.tolist() == company.kind.tolist()[2:] and not any(company.kind[:2])


def test_random_leaks_by_any_plan(spark):
    rnd = random.Random(11)
    word = lambda: rnd.choice(["7", "8", "19", "Anna", "Ben", "Cleo", "anna", "seconds", "the", "of", "keeps", "old."])
    han = lambda: rnd.choice("一二9年城市高港人我的看")
    items = [(k % 25, "zh" if k % 2 else "en", "".join(han() for _ in range(40)) if k % 2 else " ".join(word() for _ in range(24))) for k in range(40)]
    docs = []
    for k in range(120):
        _, lang, t = rnd.choice(items)
        w = [x if x.isalpha() or rnd.random() < 0.6 else {"7": "70", "8": "80", "19": "190"}.get(x, x) for x in (t.split() if lang == "en" else list(t))]
        docs.append((k % 90, (" " if lang == "en" else "").join(w)))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, lang string, text string")
    got = both_ways(d, i, ["Cleo"])
    assert both_ways(d.repartition(13), i.repartition(5), ["Cleo"]) == got == both_ways(d.coalesce(1), i.coalesce(1), ["Cleo"])
    assert {"verbatim", "reparameterised"} == {how for *_, how in got}
