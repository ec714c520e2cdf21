"""Problem 7: noise in the text of scanned boards.

Running headers and footers, page numbers and words cut at line ends are told
by classifiers over lines and pairs of lines; misread characters by candidates
that character q-grams retrieve from the corpus's own words and contexts, of
which boosted trees choose. All of them are fitted on all boards.
"""

from __future__ import annotations

import difflib
import functools
import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.boost import Boosted, fit_blocks
from lectern.session import cut, stored

#: Rows of a partition from which the ranking is fitted; the result doesn't depend on it.
FIT_ROWS = 250_000

#: Changes of characters by which a word may differ from what it is read for.
EDITS = 3

# Marks that cut a word.
HYPHENS = "-‐‑­¬"
PAGE = re.compile(r"[\s\-\[(·•–—~]*(?:第\s*|page\s*|pg\.?\s*|p\.?\s*)?([0-9]{1,5})\s*页?(?:\s*(?:/|of|共|,)\s*(?:共\s*)?([0-9]{1,5})\s*页?)?[\s\-\])·•–—~]*")
WORD = re.compile(r"[^\W_][^\W_!'’]*(?:[!'’][^\W_]+)*|![^\W_]+")


def line_key(text: str) -> str:
    """A line's letters without case, width, digits and marks: what repeats of a header."""
    return re.sub(r"[\W\d_]+", "", unicodedata.normalize("NFKC", text or "")).casefold()


def edges(n: int) -> list[int]:
    """Positions at which headers and footers stand: the first two and the last two lines."""
    return sorted(k for k in {0, 1, n - 2, n - 1} if 0 <= k < n)


def page_number(text: str) -> tuple[int, bool] | None:
    """The number of a line that looks like a page number, and whether it is bare."""
    plain = unicodedata.normalize("NFKC", text or "").lower()
    m = PAGE.fullmatch(plain)
    return (int(m.group(1)), bool(re.fullmatch(r"\s*[0-9]+\s*", plain))) if m else None


def line_features(lines: list[str], k: int, shares: dict[str, tuple[float, int]]) -> list[float]:
    t, n = lines[k] or "", len(lines)
    share, count = shares.get(line_key(t), (0.0, 1))
    return [share, math.log1p(count), float(k == 0), float(k == n - 1), float(k in edges(n)), min(len(t), 80), float(t.rstrip()[-1:] in "。！？.!?;；"), float(t.rstrip()[-1:].isalnum())]


def pair_features(a: str, b: str | None) -> list[float]:
    end = a.rstrip()
    mark, before = end[-1:], end[-2:-1]
    return [float(mark in HYPHENS and mark != ""), float(before.isalpha() and before.isascii() or before.isalpha() and not "㐀" <= before <= "鿿"), float((b or "")[:1].islower()), float((b or "")[:1].isalpha()), float(mark == "—"), float(len(end) - len(a) < 0)]


class Lines:
    """The fitted classifiers of lines and of line pairs; see :func:`fit_lines`."""

    def __init__(self, furniture: Boosted, joins: Boosted):
        self.furniture, self.joins = furniture, joins

    def kinds(self, boards: list[tuple[list[str], dict[str, tuple[float, int]], float | None]]) -> list[tuple[list[str | None], list[bool]]]:
        """For each board (lines, shares, usual page number): header, page_number or None
        for each line, and whether its last word is cut. All boards are scored at once."""
        at = [(b, k) for b, (lines, _, _) in enumerate(boards) for k in edges(len(lines)) if not page_number(lines[k]) and line_key(lines[k])]
        p = self.furniture.score(np.array([line_features(boards[b][0], k, boards[b][1]) for b, k in at]).reshape(-1, 8))
        kinds: list[list[str | None]] = [[None] * len(lines) for lines, _, _ in boards]
        for (b, k), q in zip(at, p):
            if q >= 0.5:
                kinds[b][k] = "header"
        for own, (lines, _, usual) in zip(kinds, boards):
            _page_numbers(own, lines, usual)
        bodies = [[k for k, kind in enumerate(own) if kind is None] for own in kinds]
        pairs = [(b, k, m) for b, body in enumerate(bodies) for k, m in zip(body, body[1:])]
        q = self.joins.score(np.array([pair_features(boards[b][0][k], boards[b][0][m]) for b, k, m in pairs]).reshape(-1, 6))
        cuts = [[False] * len(own) for own in kinds]
        for (b, k, _), s in zip(pairs, q):
            cuts[b][k] = bool(s >= 0.5)
        return list(zip(kinds, cuts))


def _page_numbers(kinds: list[str | None], lines: list[str], usual: float | None) -> None:
    """Marks page numbers. Furniture lies at the outside: a second line is only under another piece of it."""
    n = len(lines)
    for k in edges(n):
        number = page_number(lines[k])
        if number is None:
            continue
        outer = k in (0, n - 1) or (k == 1 and kinds[0]) or (k == n - 2 and (kinds[n - 1] or page_number(lines[n - 1])))
        value, bare = number
        if outer and (not bare or value < 1000 or (usual is not None and usual / 2 <= value <= usual * 2)):
            kinds[k] = "page_number"


def _inner_words(t: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[^\W\d_]+", t or "")[1:-1] if w.isascii()]


def _last_piece(t: str) -> str:
    m = re.search(r"([^\W\d_]+)\W*$", t or "")
    return m.group(1) if m else ""


def _first_piece(t: str) -> str:
    m = re.match(r"\W*([^\W\d_]+)", t or "")
    return m.group(1) if m else ""


def han(c: str) -> bool:
    return "㐀" <= c <= "鿿"


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters or digits, and which are ideographs."""
    alnum = np.zeros(0x110000, bool)
    alnum[[c for c in range(0x40000) if chr(c).isalnum()]] = True
    ideograph = np.zeros(0x110000, bool)
    ideograph[0x3400:0xA000] = True
    return alnum, ideograph


def body_text(lines: list[str], kinds: list[str | None], cuts: list[bool]) -> tuple[list[str], list[int]]:
    """The body's lines without the marks of cut words, each followed by a line feed where it ends, and the line each piece is of."""
    body = [k for k in range(len(lines)) if kinds[k] is None]
    text, at = [], []
    for k, nxt in zip(body, [*body[1:], None]):
        t = lines[k] or ""
        if not t.isascii() and not unicodedata.is_normalized("NFC", t):
            n = unicodedata.normalize("NFC", t)
            t = n if len(n) == len(t) else t
        if cuts[k]:
            t = t.rstrip()[:-1]
        # in Chinese text a line end is no border, else it is one
        elif nxt is not None and not (t[-1:] and han(t[-1]) and han((lines[nxt] or "")[:1] or " ")):
            t += "\n"
        text.append(t)
        at.append(k)
    return text, at


def units(boards: list[tuple[list[str], list[str | None], list[bool]]]) -> dict[str, tuple]:
    """Words (``w``) and windows of three Chinese characters (``z``) of all boards' bodies, over the line ends.

    For each kind arrays of board (position in ``boards``), first line, last
    line, ``split`` - where a word goes on in another line, else -1 -, and the
    list of tokens. All boards are one array of code points.
    """
    pieces, board, line = [], [], []
    for b, (lines, kinds, cuts) in enumerate(boards):
        text, at = body_text(lines, kinds, cuts)
        pieces += [*text, "\n"]
        board += [b] * (len(text) + 1)
        line += [*at, -1]
    joined = "".join(pieces)
    size = np.array([len(t) for t in pieces], np.int64)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.concatenate([[0], np.cumsum(size)])
    piece = np.repeat(np.arange(len(pieces)), size)
    board, line = np.array(board, np.int64), np.array(line, np.int64)
    alnum, ideograph = _tables()
    letter = np.append(alnum[codes], False)
    # a mark inside a word, or an exclamation mark read for its first letter
    inner = np.isin(codes, [0x21, 0x27, 0x2019])
    member = letter[:-1] | (inner & letter[1:] & (np.append(False, letter[:-2]) if len(codes) else letter[:-1]) | (codes == 0x21) & letter[1:])
    edge = np.diff(np.concatenate([[0], member.astype(np.int8), [0]]))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    odd = np.concatenate([[0], np.cumsum(codes > 127)])
    plain = (codes | 32) - 97 < 26
    alpha = np.concatenate([[0], np.cumsum(plain)])
    good = (odd[e] == odd[s]) & (alpha[e] > alpha[s])
    s, e = s[good], e[good]
    low = joined.lower() if len(joined.lower()) == len(joined) else "".join(c.lower() if len(c.lower()) == 1 else c for c in joined)
    p, q = piece[s], piece[np.maximum(e - 1, 0)] if len(e) else e
    words = (board[p], line[p], line[q], np.where(p == q, -1, begin[p + 1] - s), [low[x:y] for x, y in zip(s.tolist(), e.tolist())])
    z = np.flatnonzero(letter[:-1] & (codes > 127) | np.isin(codes, [ord(c) for c in "，。！？；：、"]))
    own, c = board[piece[z]], codes[z]
    same = own[1:] == own[:-1]
    l = np.append(np.uint32(94), np.where(same, c[:-1], np.uint32(94))) if len(z) else c
    r = np.append(np.where(same, c[1:], np.uint32(36)), np.uint32(36)) if len(z) else c
    k = np.flatnonzero(ideograph[c])
    tok = np.ascontiguousarray(np.stack([l[k], c[k], r[k]], 1).astype(np.uint32)).view("<U3").ravel()
    at = line[piece[z[k]]]
    return {"w": words, "z": (own[k], at, at, np.full(len(k), -1), tok)}


ROWS = "board_id long, line_no int, kind string, tok string, split int, line_b int, conf double"


def _shares(row) -> dict[str, tuple[float, int]]:
    return {s["key"]: (s["share"], s["n"]) for s in row or []}


def board_rows(boards: DataFrame) -> DataFrame:
    """board_id, job_id, lines, fixed (corrected_text), conf; one row for each board_id, then the job's
    repeated edge lines (``shares``) and its usual page number (``usual``)."""
    rows = boards.select("board_id", "job_id", F.transform("text_lines", lambda x: F.coalesce(x["text"], F.lit(""))).alias("lines"), F.transform("text_lines", lambda x: x["corrected_text"]).alias("fixed"), F.transform("text_lines", lambda x: x["confidence"]).alias("conf"))
    rows = rows.where("board_id is not null and size(lines) > 0").withColumn("job_id", F.coalesce("job_id", F.lit(""))).dropDuplicates(["board_id"])

    def keys(batches):
        for batch in batches:
            jobs, key, page = [], [], []
            for job, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set()
                for k in edges(len(lines)):
                    number = page_number(lines[k])
                    if number:
                        jobs.append(job), key.append(None), page.append(number[0])
                    else:
                        own.add(line_key(lines[k]))
                jobs.append(job), key.append(""), page.append(None)  # counts the board
                for t in own - {""}:
                    jobs.append(job), key.append(t), page.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(jobs, pa.string()), pa.array(key, pa.string()), pa.array(page, pa.int64())], ["job_id", "key", "page"])

    marks = rows.select("job_id", "lines").mapInArrow(keys, "job_id string, key string, page long")
    counted = marks.groupBy("job_id", "key").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.5) within group (order by page)").cast("double").alias("page"))
    total = counted.groupBy("job_id").agg(F.max(F.when(F.col("key") == "", F.col("n"))).alias("boards"), F.max(F.when(F.col("key").isNull(), F.col("page"))).alias("usual"))
    # at most 4 / 0.05 keys of a job can stand on a twentieth of its boards
    often = counted.join(total, "job_id").where("key <> '' and n >= 2 and n >= 0.05 * boards").groupBy("job_id").agg(F.collect_list(F.struct("key", (F.col("n") / F.col("boards")).alias("share"), "n")).alias("shares"))
    per_job = total.select("job_id", "usual").join(often, "job_id", "left")
    salts = 16  # one job can hold a third of the boards
    per_job = per_job.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.hash("board_id"), F.lit(salts))).join(per_job, ["job_id", "salt"], "left").drop("salt")


EXAMPLES = "what string, x array<double>, y double, a string, b string, ab string, n long"


def _examples(batches):
    """EXAMPLES of boards (lines, shares), counted: ``line`` with its label, ``pair`` of lines with the
    pieces of what can be a cut word, and ``word`` of a line's inside."""
    for batch in batches:
        out = Counter()
        for lines, shares in zip(*(c.to_pylist() for c in batch.columns)):
            shares, border = _shares(shares), set(edges(len(lines)))
            for k, t in enumerate(lines):
                for w in _inner_words(t):
                    out["word", None, None, w, None, None] += 1
                if page_number(t):
                    continue
                share, count = shares.get(line_key(t), (0.0, 1)) if shares else (0.0, 1)
                # what repeats at the edges is furniture, what stands inside is not; the rest has no label
                inside = k not in border
                # two sentences that end alike can repeat by chance in a small job
                chance = count <= 2 and t.rstrip()[-1:] in "。！？.!?"
                if inside or share >= 0.3 or share < 0.02 or chance:
                    out["line", tuple(line_features(lines, k, shares)), float(not inside and share >= 0.3 and not chance), None, None, None] += 1
                if k + 1 < len(lines):
                    x = tuple(pair_features(t, lines[k + 1]))
                    a, b = (_last_piece(t), _first_piece(lines[k + 1])) if x[0] > 0 else ("", "")
                    out["pair", x, None, *((a.lower(), b.lower(), (a + b).lower()) if a and b else (None, None, None))] += 1
        cols = list(zip(*((*key, n) for key, n in out.items()))) or [[]] * 7
        types = [pa.string(), pa.list_(pa.float64()), pa.float64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["what", "x", "y", "a", "b", "ab", "n"])


def _cuts(x: DataFrame, width: int, by: str | None = None) -> dict[str | None, list[np.ndarray]]:
    """Where Boosted cuts each of the columns x[0] to x[width - 1] of rows that stand ``n`` times, by all rows."""
    shares = ", ".join(repr(float(s)) for s in Boosted().shares())
    rows = x.groupBy(*([by] if by else [])).agg(*[F.expr(f"percentile(x[{k}], array({shares}), n)").alias(f"x{k}") for k in range(width)]).collect()
    return {r[by] if by else None: [np.unique(np.array(r[f"x{k}"] or [], float)) for k in range(width)] for r in rows}


def _fit_cells(x: DataFrame, width: int, rounds: int = 30) -> Boosted:
    """A model of all rows (x, y, n), from their numbers in the cells between cuts: at most some
    hundred thousand cells of furniture and 128 of pairs, however many the rows are."""
    cuts = _cuts(x, width)[None]
    code = [F.expr(f"size(filter(array({', '.join(f'double({float(c)!r})' for c in own)}), c -> c < x[{k}]))") if len(own) else F.lit(0) for k, own in enumerate(cuts)]
    cells = x.groupBy(F.array(*code).alias("code"), "y").agg(F.sum("n").alias("n")).collect()
    cells = sorted((tuple(r.code), r.y, r.n) for r in cells)
    return Boosted(rounds).fit_cells(np.array([c for c, _, _ in cells], float).reshape(-1, width), np.array([y for _, y, _ in cells]), np.array([n for _, _, n in cells], float), cuts)


def fit_lines(rows: DataFrame) -> Lines:
    """Fits the line classifiers on all boards (lines, shares)."""
    seen = cut(rows.select("lines", "shares").mapInArrow(_examples, EXAMPLES).groupBy("what", "x", "y", "a", "b", "ab").agg(F.sum("n").alias("n")))
    words, pairs = seen.where("what = 'word'"), seen.where("what = 'pair'")
    told = pairs.where("ab is not null")
    for k in ("ab", "a", "b"):
        told = told.join(words.select(F.col("a").alias(k), F.col("n").alias(f"{k}_n")), k, "left")
    # cut words are known whole from the insides of other lines
    told = told.select("x", F.expr("double(coalesce(ab_n, 0) > greatest(coalesce(a_n, 0), coalesce(b_n, 0)) / 4)").alias("y"), "n")
    told = cut(told.unionByName(pairs.where("ab is null").select("x", F.lit(0.0).alias("y"), "n")).groupBy("x", "y").agg(F.sum("n").alias("n")))
    return Lines(_fit_cells(seen.where("what = 'line'"), 8), _fit_cells(told, 6))


def _batch(board, first, last, split, kind, tok, conf) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) if isinstance(x, list | tuple) else pa.array(x, from_pandas=True).cast(t) for x, t in zip((board, first, kind, tok, split, last, conf), types)], ["board_id", "line_no", "kind", "tok", "split", "line_b", "conf"])


def read_boards(rows: DataFrame, model: Lines) -> DataFrame:
    """All boards as ROWS: one for each found line kind, and the words and windows of the body with their line's confidence."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        fitted = shared.value
        for batch in batches:
            boards = [(b, lines, _shares(shares), usual, conf) for b, lines, shares, usual, conf in zip(*(c.to_pylist() for c in batch.columns))]
            ids = np.array([b[0] for b in boards], np.int64)
            fits = fitted.kinds([b[1:4] for b in boards])
            out = [(b, k, kind) for b, (kinds, cuts) in enumerate(fits) for k, (own, c) in enumerate(zip(kinds, cuts)) for kind in (own, "hyphen" if c else None) if kind]
            cols = list(zip(*out)) or [[]] * 3
            yield _batch(ids[np.array(cols[0], np.int64)], cols[1], cols[1], [-1] * len(out), cols[2], [None] * len(out), [None] * len(out))
            begin = np.concatenate([[0], np.cumsum([len(x[1]) for x in boards])]).astype(np.int64)
            conf = np.array([c if c is not None else np.nan for x in boards for c in x[4]], float)
            for kind, (b, first, last, split, toks) in units([(x[1], *y) for x, y in zip(boards, fits)]).items():
                yield _batch(ids[b], first, last, split, [kind] * len(b), toks, conf[begin[b] + first])

    return rows.select("board_id", "lines", "shares", "usual", "conf").mapInArrow(run, ROWS)


def changes(a: str, b: str) -> list[tuple[str, str]]:
    """What stands for what; of texts of one length, place by place."""
    if len(a) == len(b):
        return [(x, y) for x, y in zip(a, b) if x != y]
    return [(a[i:j], b[k:m]) for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, False).get_opcodes() if op != "equal"]


TOLD = "what string, kind string, tok string, cand string, n long"


def labels(lines: DataFrame) -> DataFrame:
    """TOLD, counted: what all corrected lines (lines, fixed) say.

    what ``pair``: characters ``tok`` that stand for ``cand``; ``good``: a word
    or window that was mended; ``seen``: one that a corrected line holds.
    """

    def run(batches):
        for batch in batches:
            old, new = (c.to_pylist() for c in batch.columns)
            out = Counter()
            for a, b in zip(old, new):
                for op in changes(a.lower(), b.lower()):
                    if len(op[0]) <= 2 and len(op[1]) <= 2 and op[0] and op[1]:
                        out["pair", None, *op] += 1
            tokens = []
            for texts in (old, new):
                own: list[list[tuple[str, str]]] = [[] for _ in texts]
                for kind, (at, *_, toks) in units([([t], [None], [False]) for t in texts]).items():
                    for k, t in zip(at.tolist(), toks):
                        own[k].append((kind, str(t)))
                tokens.append(own)
            for a, b in zip(*tokens):
                if len(a) == len(b):
                    for (kind, x), (_, y) in zip(a, b):
                        out["seen", kind, x, None] += 1
                        if x != y and (kind == "w" or x[1] != y[1]):
                            out["good", kind, x, y if kind == "w" else y[1]] += 1
            cols = list(zip(*((*key, n) for key, n in out.items()))) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.int64())], ["what", "kind", "tok", "cand", "n"])

    return cut(lines.distinct().select("lines", "fixed").mapInArrow(run, TOLD).groupBy("what", "kind", "tok", "cand").agg(F.sum("n").alias("n")))


def word_pairs(told: DataFrame) -> Counter:
    """The pairs that can stand in words: at most a million, as these have 38 characters and their candidates 26, however large the corpus."""
    found = told.where("what = 'pair' and tok rlike '^[a-z0-9!\\']{1,2}$' and cand rlike '^[a-z]{1,2}$'").select("tok", "cand", "n").toArrow()
    return Counter(dict(zip(zip(found.column(0).to_pylist(), found.column(1).to_pylist()), found.column(2).to_pylist())))


def pair_weight(a: str, b: str, pairs: Counter, less: int = 0) -> float:
    """How well the changes from a to b are known: the least known one counts. ``less``: how often they are so from a to b itself."""
    weights = []
    for x, y in changes(a, b):
        best = pairs.get((x, y), 0)
        if not best and len(x) > 1 and len(x) <= 4:
            # two neighbouring changes in one
            for i in range(1, len(x)):
                for j in range(1, len(y)):
                    best = max(best, min(pairs.get((x[:i], y[:j]), 0), pairs.get((x[i:], y[j:]), 0)))
        weights.append(best)
    return math.log1p(max(0, min(weights) - less)) if weights else 0.0


NAMES = ["kind", "tok", "cand", "n", "m", "conf", "left_n", "left_m", "right_n", "right_m", "mid_n", "mid_m", "alike", "edits", "share", "known"]
FEATURES = ["n", "m", "ratio", "known", "alike", "size", "strange", "left", "right", "side", "both", "mid", "conf", "edits", "share"]


def word_candidates(words: DataFrame) -> DataFrame:
    """(w, c, w_n, c_n, conf): words that positional bigrams bring together.

    c are words of letters that have at least twice the count of w, or the same
    where w holds digits or marks. ``EDITS`` changes destroy at most twice as
    many bigrams, so one of the 2 EDITS + 1 rarest bigrams of w is one of c's;
    only those are joined, and no frequent bigram brings all words together.
    """

    def grams(df: DataFrame, name: str) -> DataFrame:
        padded = F.concat(F.lit("^"), F.col("tok"), F.lit("$"))
        at = F.sequence(F.lit(1), F.length("tok") + 1)
        return df.select(F.col("tok").alias(name), F.col("n").alias(f"{name}_n"), *([F.col("conf")] if name == "w" else []), F.posexplode(F.transform(at, lambda i: F.substring(padded, i, F.lit(2)))).alias("pos", "gram"))

    other = grams(words.where("n >= 2 and tok rlike '^[a-z]+$'"), "c")
    often = other.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    rarest = Window.partitionBy("w").orderBy("often", "pos")  # a word has 41 bigrams at most
    own = grams(words, "w").join(often, "gram", "left").withColumn("rank", F.row_number().over(rarest)).where(F.col("rank") <= 2 * EDITS + 1)
    own = own.withColumn("pos", F.explode(F.array(F.col("pos") - 1, F.col("pos"), F.col("pos") + 1)))
    near = own.join(other, ["gram", "pos"]).where("(c_n >= 2 * w_n or w rlike '[^a-z]' and c_n >= w_n) and abs(length(w) - length(c)) <= 2 and w <> c").groupBy("w", "c", "w_n", "c_n", "conf").agg(F.count(F.lit(1)).alias("shared"))
    return near.withColumn("edits", F.expr(f"levenshtein(w, c, {EDITS})").cast("long")).where("edits between 0 and greatest(1, length(w) div 2)")


def alike_pairs(words: DataFrame) -> Counter:
    """How many different words each change between letters explains, of those that explain two or more.

    At most 120,000 changes of three characters in all from the letters, digits
    and marks that words have, however large the corpus.
    """

    def run(batches):
        for batch in batches:
            out = Counter()
            for w, c in zip(*(x.to_pylist() for x in batch.columns)):
                for x, y in set(changes(w, c)):
                    if x and y and len(x) + len(y) <= 3:
                        out[x, y] += 1
            cols = [list(x) for x in zip(*((x, y, n) for (x, y), n in out.items()))] or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["x", "y", "n"])

    # only the nearest of a word's candidates, and only where they are much more frequent
    close = words.groupBy("w").agg(F.min("edits").alias("least"))
    near = words.join(close, "w").where("edits = least and (c_n >= 8 * w_n or w rlike '[^a-z]')")
    found = near.select("w", "c").mapInArrow(run, "x string, y string, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).where("n >= 2")
    return Counter({(r.x, r.y): r.n for r in found.collect()})


def candidates(tokens: DataFrame, told: DataFrame) -> tuple[DataFrame, Counter]:
    """(NAMES): replacements that q-gram joins retrieve, from counts over all boards; and :func:`alike_pairs` of the words.

    Words: see :func:`word_candidates`. Windows: those with the same left and
    right neighbour and at least three times the count; the new pairs of
    neighbours must be at least ten times as frequent as the old ones, as a
    product. Windows of which no other of their neighbours' is that much more
    frequent are left out before. ``alike``: how many windows the change of the
    character explains where both pairs of neighbours are four times as frequent.
    Where it explains two, or corrected lines hold it (``known`` times, see
    :func:`labels`), it is tried in every window, also where the whole new one
    never occurs.
    """
    counts = cut(tokens.where("tok is not null").groupBy("kind", "tok").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("conf")))
    words = cut(word_candidates(counts.where("kind = 'w' and length(tok) between 2 and 40")))
    zero = F.lit(0).cast("long")
    of_words = words.select(F.lit("w").alias("kind"), F.col("w").alias("tok"), F.col("c").alias("cand"), F.col("w_n").alias("n"), F.col("c_n").alias("m"), "conf", *[zero.alias(k) for k in NAMES[6:-3]], "edits", zero.alias("share"), zero.alias("known"))

    z = counts.where("kind = 'z'").select(F.substring("tok", 1, 1).alias("l"), F.substring("tok", 2, 1).alias("c"), F.substring("tok", 3, 1).alias("r"), "n", "conf")
    for keys, name in ((["l", "c"], "left"), (["c", "r"], "right"), (["c"], "mid")):
        z = z.join(z.groupBy(*keys).agg(F.sum("n").alias(name)), keys)
    z = z.join(z.groupBy("c").agg(F.count(F.lit(1)).alias("windows")), "c")
    z = cut(z.withColumn("both", (F.col("left") + 1).cast("double") * (F.col("right") + 1)))
    most = z.where("n >= 3").groupBy("l", "r").agg(F.max("both").alias("most"), F.max("n").alias("top"))
    own = z.join(most, ["l", "r"]).where("most >= 10 * both and top >= 3 * n")
    least = own.groupBy("l", "r").agg(F.min("both").alias("least"))
    other = z.where("n >= 3").join(least, ["l", "r"]).where("both >= 10 * least")
    other = other.select("l", "r", F.col("c").alias("cand"), F.col("n").alias("m"), F.col("left").alias("left_m"), F.col("right").alias("right_m"), F.col("mid").alias("mid_m"), F.col("both").alias("new"))
    near = own.join(other, ["l", "r"]).where("m >= 3 * n and new >= 10 * both and c <> cand")
    near = cut(near.select("l", "c", "r", "cand", "n", "m", "conf", F.col("left").alias("left_n"), "left_m", F.col("right").alias("right_n"), "right_m", F.col("mid").alias("mid_n"), "mid_m"))
    alike = near.groupBy("c", "cand").agg(F.count_if(F.expr("left_m >= 4 * left_n and right_m >= 4 * right_n")).alias("alike"))
    listed = told.where("what = 'pair' and tok rlike '^[\u3400-\u9fff]$' and cand rlike '^[\u3400-\u9fff]$'").select(F.col("tok").alias("c"), "cand", F.col("n").alias("known"))
    # thousandths of the character's windows that the change explains: high for what is hardly ever right
    alike = cut(alike.join(z.groupBy("c").agg(F.max("windows").alias("windows")), "c").select("c", "cand", "alike", F.expr("alike * 1000 div windows").alias("share")))
    tried = alike.where("alike >= 2").select("c", "cand", F.lit(0).alias("told")).unionByName(listed.select("c", "cand", F.lit(1).alias("told"))).groupBy("c", "cand").agg(F.max("told").alias("told")).join(alike.select("c", "cand", "share"), ["c", "cand"], "left")
    new = z.select("l", F.col("c").alias("cand"), "r", F.col("n").alias("m"))
    wide = z.join(tried, "c").join(new, ["l", "cand", "r"], "left")
    for keys, name in ((["l", "c"], "left"), (["c", "r"], "right"), (["c"], "mid")):
        swapped = [("cand" if k == "c" else k) for k in keys]
        wide = wide.join(z.groupBy(*[F.col(k).alias(x) for k, x in zip(keys, swapped)]).agg(F.max(name).alias(f"{name}_m")), swapped, "left")
    wide = wide.where("(coalesce(left_m, 0) + 1) * (coalesce(right_m, 0) + 1) >= if(share >= 300 or told = 1, 1, 10) * both")
    wide = wide.select("l", "c", "r", "cand", "n", F.coalesce("m", zero).alias("m"), "conf", F.col("left").alias("left_n"), F.coalesce("left_m", zero).alias("left_m"), F.col("right").alias("right_n"), F.coalesce("right_m", zero).alias("right_m"), F.col("mid").alias("mid_n"), F.coalesce("mid_m", zero).alias("mid_m"))
    all_ = near.unionByName(wide).dropDuplicates(["l", "c", "r", "cand"])
    of_windows = all_.join(alike, ["c", "cand"], "left").join(listed, ["c", "cand"], "left")
    of_windows = of_windows.select(F.lit("z").alias("kind"), F.concat("l", "c", "r").alias("tok"), *NAMES[2:-4], F.coalesce("alike", zero).alias("alike"), F.lit(1).cast("long").alias("edits"), F.coalesce("share", zero).alias("share"), F.coalesce("known", zero).alias("known"))
    return of_words.unionByName(of_windows), alike_pairs(words)


def _features(batch: pa.RecordBatch, pairs: Counter, alike: Counter) -> np.ndarray:
    """FEATURES of each candidate, in whole thousandths, so that a column has some ten thousand values.
    A column ``less`` says how often a candidate itself is among the known pairs: that is taken off."""
    col = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
    less = col.get("less") or [0] * batch.num_rows
    out = []
    for kind, tok, cand, n, m, conf, ln, lm, rn, rm, mid_n, mid_m, like, edits, share, told, off in zip(*(col[k] for k in NAMES), less):
        own = tok if kind == "w" else tok[1]
        left, right = math.log((lm + 1) / (ln + 1)), math.log((rm + 1) / (rn + 1))
        known = pair_weight(own, cand, pairs, off) if kind == "w" else math.log1p(max(0, told - off))
        out.append([math.log1p(n), math.log1p(m), math.log((m + 0.5) / (n + 0.5)), known, pair_weight(own, cand, alike) if kind == "w" else math.log1p(like), len(own), float(kind == "w" and not tok.isalpha()), left, right, min(left, right), left + right, math.log((mid_m + 1) / (mid_n + 1)), 0.7 if conf is None else conf, edits, share / 1000])
    return np.rint(np.array(out, float).reshape(-1, len(FEATURES)) * 1000)


#: What a ranking knows before it sees a label: (n, m, known, alike, size, strange, left, right, edits, share) and whether it is right.
PRIOR = {
    "w": [((1, 50, 0, 3, 6, 1, 0, 0, 1, 0), 1), ((1, 50, 0, 4, 7, 0, 0, 0, 2, 0), 1), ((1, 50, 0, 0, 6, 0, 0, 0, 1, 0), 0), ((3, 50, 0, 0, 6, 0, 0, 0, 2, 0), 0), ((3, 50, 0, 0, 6, 0, 0, 0, 3, 0), 0), ((6, 60, 0, 0, 6, 0, 0, 0, 2, 0), 0), ((2, 2, 0, 0, 6, 1, 0, 0, 2, 0), 0)],
    "z": [
        ((1, 30, 0, 3, 1, 0, 3.5, 3.5, 1, 0.1), 1), ((1, 10, 0, 3, 1, 0, 4, 2, 1, 0.1), 1), ((2, 30, 0, 8, 1, 0, 4.5, 0.8, 1, 0.1), 1), ((1, 0, 1.5, 3, 1, 0, 0.5, 4, 1, 0.1), 1), ((1, 0, 1.5, 3, 1, 0, 4, 0.5, 1, 0.1), 1), ((1, 0, 0, 3, 1, 0, 1, 1, 1, 0.6), 1),
        ((1, 30, 0, 1, 1, 0, 0.2, 3.5, 1, 0), 0), ((1, 30, 0, 1, 1, 0, 3.5, 0.2, 1, 0), 0), ((3, 30, 0, 0, 1, 0, 1, 1.5, 1, 0), 0), ((1, 0, 0, 2, 1, 0, 0.5, 2.5, 1, 0.05), 0), ((1, 0, 0, 2, 1, 0, 2.5, 0.5, 1, 0.05), 0), ((1, 0, 0, 3, 1, 0, 1, 1, 1, 0.05), 0),
    ],
}


def _prior(kind: str) -> tuple[np.ndarray, np.ndarray]:
    rows = [[math.log1p(n), math.log1p(m), math.log((m + 0.5) / (n + 0.5)), known, math.log1p(alike), size, strange, left, right, min(left, right), left + right, 1.0, 0.7, edits, share] for (n, m, known, alike, size, strange, left, right, edits, share), _ in PRIOR[kind]]
    return np.rint(np.array(rows, float) * 1000), np.array([y for _, y in PRIOR[kind]], float)


def fit_ranking(cands: DataFrame, told: DataFrame, pairs: Counter, alike: Counter) -> dict[str, Boosted]:
    """A ranking for each kind, from all candidates of what the corrected lines hold: mended as they
    say it is right, anything else is wrong. A few made-up rows steady small tables (``PRIOR``)."""
    spark = cands.sparkSession
    seen = told.where("what = 'seen'").select("kind", "tok")
    good = told.where("what = 'good'").select("kind", "tok", "cand", F.col("n").alias("less"))
    own = cands.join(seen, ["kind", "tok"], "left_semi").join(good, ["kind", "tok", "cand"], "left").select(*NAMES, F.coalesce("less", F.lit(0).cast("long")).alias("less"))
    shared = spark.sparkContext.broadcast((pairs, alike))

    def features(batches):
        for batch in batches:
            x = _features(batch, *shared.value)
            y = np.array(batch.column(len(NAMES)).to_pylist(), float).reshape(-1) > 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x.astype(np.int32)), pa.list_(pa.int32())), pa.array(y.astype(np.int32)), pa.array(np.ones(len(x), np.int64))], ["kind", "x", "y", "n"])

    schema = "kind string, x array<int>, y int, n long"
    made_up = spark.createDataFrame([(kind, [int(v) for v in x], int(y), 1) for kind in PRIOR for x, y in zip(*_prior(kind)) for _ in range(3)], schema)
    rows = cut(own.mapInArrow(features, schema).unionByName(made_up))
    totals = {r.kind: (r.n, r.ones) for r in rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).collect()}
    cuts = _cuts(rows, len(FEATURES), "kind")

    def codes(batches):
        for batch in batches:
            kinds, y = np.array(batch.column(0).to_pylist(), object), np.array(batch.column(2), np.uint8)
            x = np.array(batch.column(1).flatten(), float).reshape(-1, len(FEATURES))
            out = []
            for kind, own in cuts.items():
                of = kinds == kind
                if of.any():
                    code = np.stack([np.searchsorted(c, x[of, k], "left") for k, c in enumerate(own)], 1).astype(np.uint8)
                    out.append((kind, code.tobytes(), y[of].tobytes()))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["kind", "codes", "y"])

    parts = max(1, -(-sum(n for n, _ in totals.values()) // FIT_ROWS))
    blocks = cut(rows.coalesce(parts).mapInArrow(codes, "kind string, codes binary, y binary")).rdd
    blocks = blocks.map(lambda r: (r[0], np.frombuffer(bytes(r[1]), np.uint8).reshape(-1, len(FEATURES)), np.frombuffer(bytes(r[2]), np.uint8).astype(float)))
    return fit_blocks(blocks, cuts, totals)


def choose(cands: DataFrame, told: DataFrame, alike: Counter) -> DataFrame:
    """(kind, tok, cand): the chosen replacement of each word or window that has one; see :func:`fit_ranking`."""
    cands, pairs = cut(cands), word_pairs(told)
    models = fit_ranking(cands, told, pairs, alike)
    shared = cands.sparkSession.sparkContext.broadcast((models, pairs, alike))

    def run(batches):
        fitted, pairs, like = shared.value
        for batch in batches:
            x, kinds = _features(batch, pairs, like), np.array(batch.column(0).to_pylist(), object)
            p = np.zeros(len(x))
            for kind, model in fitted.items():
                of = kinds == kind
                if of.any():
                    p[of] = model.score(x[of])
            keep = pa.array(p >= 0.5)
            out = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p), batch.column(4)], ["kind", "tok", "cand", "p", "m"])
            yield out.filter(keep)

    scored = cands.select(*NAMES).mapInArrow(run, "kind string, tok string, cand string, p double, m long")
    return scored.groupBy("kind", "tok").agg(F.max_by("cand", F.struct("p", "m", "cand")).alias("cand"))


def first_change(tok: str, cand: str) -> int:
    k = 0
    while k < min(len(tok), len(cand)) and tok[k] == cand[k]:
        k += 1
    return k


def corrections(boards: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of boards, line kinds, misread tokens with their line); see :func:`board_lines`."""
    rows = cut(board_rows(boards))
    lines = rows.select(F.explode(F.arrays_zip("lines", "fixed")).alias("x")).select("x.lines", "x.fixed").where("fixed is not null and fixed <> lines")
    told = labels(lines)
    found = stored(read_boards(rows, fit_lines(rows)), "boards")
    cands, alike = candidates(found, told)
    chosen = choose(cands, told, alike)
    hits = found.where("tok is not null").join(chosen, ["kind", "tok"])
    # the line of a cut word's misread character: where the first change lies
    at = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length("tok"), F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substring("tok", i, F.lit(1)) == F.substring("cand", i, F.lit(1))), i).otherwise(acc)
    )
    hits = hits.withColumn("line", F.when((F.col("split") > 0) & (at >= F.col("split")), F.col("line_b")).otherwise(F.col("line_no")))
    return rows, found.where("tok is null").select("board_id", "line_no", "kind"), hits.select("board_id", F.col("line").alias("line_no"), "kind", "tok", "cand")


def board_lines(boards: DataFrame) -> DataFrame:
    """(board_id, line_no, kind): what is wrong with which line.

    kind ``header``: a running header or footer; ``page_number``: a line that is
    only one; ``hyphen``: its last word is cut and goes on in the next line;
    ``misread``: a line of the body with a wrongly read character. A line can
    have two kinds. Boards that come twice with one board_id count once; null
    texts of lines are empty ones; null or empty text_lines give no row; boards
    without job_id form a job of their own. Classifiers, labels, ranking, counts
    and candidates cover all boards.
    """
    _, lines, hits = corrections(boards)
    return lines.unionByName(hits.select("board_id", "line_no", F.lit("misread").alias("kind"))).distinct()


def board_text(boards: DataFrame) -> DataFrame:
    """(board_id, text): each board's body as continuous text, corrected, without furniture.

    Cut words are joined, Chinese lines without a space; lines that are numbers or formulas stand alone."""
    rows, lines, hits = corrections(boards)
    kinds = lines.groupBy("board_id").agg(F.collect_list(F.struct("line_no", "kind")).alias("kinds"))
    fixes = hits.groupBy("board_id").agg(F.collect_set(F.struct("line_no", "kind", "tok", "cand")).alias("fixes"))
    whole = rows.select("board_id", "lines").join(kinds, "board_id", "left").join(fixes, "board_id", "left")

    def run(batches):
        for batch in batches:
            out = [assemble(lines, {(k["line_no"], k["kind"]) for k in kinds or []}, fixes or []) for lines, kinds, fixes in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["board_id", "text"])

    return whole.select("board_id", "lines", "kinds", "fixes").mapInArrow(run, "board_id long, text string")


def assemble(lines: list[str], kinds: set[tuple[int, str]], fixes: list[dict]) -> str:
    out = ""
    cut_before = False
    for k, t in enumerate(lines):
        if (k, "header") in kinds or (k, "page_number") in kinds:
            continue
        if (k, "hyphen") in kinds:
            t = t.rstrip()[:-1]
        for f in fixes:
            if f["kind"] == "z" and f["line_no"] == k:
                l, c, r = (x for x in f["tok"])
                t = re.sub(f"(?:(?<={re.escape(l)})|^){re.escape(c)}(?={re.escape(r)}|$)", f["cand"], t)
        glue = "" if cut_before or not out or (han(out[-1:] or " ") or out[-1:] in "，。！？；：、") and (han(t[:1] or " ") or t[:1] in "，。！？；：、") else " "
        out += glue + t
        cut_before = (k, "hyphen") in kinds
    for f in fixes:
        if f["kind"] == "w":
            out = re.sub(rf"(?i)(?<![^\W_]){re.escape(f['tok'])}(?![^\W_])", lambda m, c=f["cand"]: c.capitalize() if m.group()[:1].isupper() else c, out)
    return out
