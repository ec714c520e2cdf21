"""Problems 8 and 10: byte-level BPE over whole columns, and cutting by its counts.

Texts are handled many at a time as one array of code points. Pre-tokens are
found by class changes, hashed by prefix sums, and each distinct one is merged
once; the merges of all distinct pre-tokens of a chunk share one rank queue.
"""

from __future__ import annotations

import base64
import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The vocabulary file where the session names none in ``spark.lectern.vocabulary``; read on the driver.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Code points handled at once; a chunk takes about 60 bytes for each.
CHUNK = 1_000_000
#: Distinct pre-tokens kept by a worker between chunks.
KEEP = 400_000

LETTER, NUMBER, OTHER, SPACE = range(4)
#: The code points of Unicode's White_Space property.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def char_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE for each code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x40000):  # none of them are letters or numbers above
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = NUMBER
    kinds[WHITE_SPACE] = SPACE
    return kinds


@functools.cache
def _random_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 0x110000, np.uint64, False)


@functools.cache
def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(np.random.default_rng(seed + 100).integers(1 << 62, 1 << 63)) | 1
    back = pow(base, -1, 1 << 64)
    out = []
    for b in (base, back):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit polynomial hash of codes[start:end] for each span, by prefix sums."""
    n = 1 << max(16, int(len(codes)).bit_length())
    power, back = _powers(n, seed)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_random_values(seed)[codes] * power[: len(codes)], out=sums[1:])
    return (sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array, and where each begins; lone surrogates become U+FFFD."""
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return codes, bounds


def pre_token_starts(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions at which the pre-tokens begin.

    The same cuts as the public pattern: contractions in lower case, runs of
    letters, of numbers and of other marks, each with at most one space (U+0020)
    before it, and white space whose last character stands alone before text.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[codes]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = codes == 32
    starts = run.copy()
    # a plain space before a run of text belongs to that run
    joined = np.zeros(n, bool)
    joined[1:] = run[1:] & ~first[1:n] & (kind[1:] != SPACE) & space[:-1]
    starts[joined] = False
    # the last character of white space that text follows is cut from the rest
    follows = np.zeros(n, bool)
    follows[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n]
    starts |= follows
    marks = np.flatnonzero((codes == 39) & starts)
    if len(marks):
        padded = np.concatenate([codes, np.zeros(3, np.uint32)])
        a, b = padded[marks + 1], padded[marks + 2]
        open1 = ~first[np.minimum(marks + 1, n)]
        open2 = open1 & ~first[np.minimum(marks + 2, n)]
        one = open1 & np.isin(a, [ord(c) for c in "stmd"])
        two = open2 & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for hits, k in ((marks[one], 2), (marks[two], 3)):
            starts[hits + 1] = False
            after = hits + k
            starts[after[after < n]] |= kind[after[after < n]] == LETTER
    return np.flatnonzero(starts)


class RankQueue:
    """Positions waiting for their merge, one bucket for each rank.

    Three levels of 64-bit words say which buckets hold something, so the next
    rank is found by three find-first-set steps, however many ranks there are.
    """

    def __init__(self, ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0

    def push(self, ranks: list[int], places: list[int]) -> None:
        buckets, low, mid = self.buckets, self.low, self.mid
        for r, p in zip(ranks, places):
            bucket = buckets[r]
            if not bucket:
                low[r >> 6] |= 1 << (r & 63)
                mid[r >> 12] |= 1 << (r >> 6 & 63)
                self.top |= 1 << (r >> 12)
            bucket.append(p)

    def pop(self) -> tuple[int, list[int]] | None:
        if not self.top:
            return None
        k = (self.top & -self.top).bit_length() - 1
        j = k << 6 | (self.mid[k] & -self.mid[k]).bit_length() - 1
        r = j << 6 | (self.low[j] & -self.low[j]).bit_length() - 1
        self.low[j] &= self.low[j] - 1
        if not self.low[j]:
            self.mid[k] &= self.mid[k] - 1
            if not self.mid[k]:
                self.top &= self.top - 1
        places, self.buckets[r] = self.buckets[r], []
        return r, places


class Encoder:
    """Byte-level BPE by the ranks of a vocabulary file (lines of base64 and rank)."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.size = max(ranks.values()) + 1
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pairs, self.pair_rank = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.check = np.zeros(0, np.uint64)
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.chars = np.zeros(0, np.int32)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[k] == key, self.pair_rank[k], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in one array, where each word's begin, and the byte each id begins at."""
        at = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(w) for w in words], out=at[1:])
        n = int(at[-1])
        ids = np.append(self.of_byte[np.frombuffer(b"".join(words), np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        last = np.zeros(n + 1, bool)  # no pair goes over the end of a word
        last[at[1:] - 1] = True
        last[n] = True
        after[last] = n
        before[at[:-1]] = n
        rank = np.full(n + 1, -1, np.int64)
        body = np.flatnonzero(~last)
        rank[body] = self._rank(ids[body], ids[body + 1])
        queue = RankQueue(self.size)
        wait = body[rank[body] >= 0]
        queue.push(rank[wait].tolist(), wait.tolist())
        alive = np.ones(n + 1, bool)
        while (got := queue.pop()) is not None:
            r, places = got
            if len(places) > 1:
                p = np.unique(np.array(places, np.int64))
                p = p[rank[p] == r]  # stale entries have another rank by now
                if len(p) > 1:
                    # of overlapping pairs every second one merges, from the left
                    chained = np.append(False, after[p[:-1]] == p[1:])
                    if chained.any():
                        k = np.arange(len(p))
                        p = p[(k - np.maximum.accumulate(np.where(chained, 0, k))) % 2 == 0]
            else:
                p = np.array(places, np.int64)
                if rank[p[0]] != r:
                    continue
            if not len(p):
                continue
            q = after[p]
            ids[p] = r
            alive[q] = False
            rank[q] = -1
            far = after[q]
            after[p] = far
            before[far] = p
            before[n] = n
            near = before[p]
            touched = np.concatenate([p, near[near < n]])
            nxt = after[touched]
            new = np.where(nxt < n, self._rank(ids[touched], ids[nxt]), -1)
            rank[touched] = new
            good = new >= 0
            queue.push(new[good].tolist(), touched[good].tolist())
        left = np.flatnonzero(alive[:n])
        return ids[left].astype(np.int32), np.searchsorted(left, at), left - np.repeat(at[:-1], np.diff(np.searchsorted(left, at)))

    def places(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pre-tokens, where each pre-token's begin, and the code point of it that each id begins at (-1: inside one)."""
        ids, begin, byte = self.merge(raw)
        # code points that begin at or before each id's first byte, so that ids can be placed in the text
        lead = (np.frombuffer(b"".join(raw), np.uint8) & 0xC0) != 0x80
        places = np.cumsum(lead)
        size = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(w) for w in raw], out=size[1:])
        base = np.repeat(size[:-1], np.diff(begin))
        first = base + byte
        return ids, begin, np.where(lead[first], places[first] - places[base], -1).astype(np.int32)

    def _learn(self, text: str, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each pre-token in what is known, after adding what isn't; and which share the hash of another one."""
        h, check = span_hashes(codes, starts, ends, 1), span_hashes(codes, starts, ends, 2)
        keys, one, back = np.unique(h, return_index=True, return_inverse=True)
        k = np.minimum(np.searchsorted(self.known, keys), max(0, len(self.known) - 1))
        new = np.ones(len(keys), bool) if not len(self.known) else self.known[k] != keys
        if new.any():
            if len(self.known) > KEEP:
                self.forget()
                new[:] = True
            at = one[new]
            ids, begin, char = self.places([text[s:e].encode("utf-8", "replace") for s, e in zip(starts[at].tolist(), ends[at].tolist())])
            all_keys = np.concatenate([self.known, keys[new]])
            order = np.argsort(all_keys, kind="stable")
            sizes = np.concatenate([np.diff(self.at), np.diff(begin)])
            starts_old = np.concatenate([self.at[:-1], len(self.ids) + begin[:-1]])
            flat_ids, flat_chars = np.concatenate([self.ids, ids]), np.concatenate([self.chars, char])
            take = ranges(starts_old[order], sizes[order])
            self.known, self.check = all_keys[order], np.concatenate([self.check, check[at]])[order]
            self.at = np.concatenate([[0], np.cumsum(sizes[order])])
            self.ids, self.chars = flat_ids[take], flat_chars[take]
            k = np.searchsorted(self.known, keys)
        rows = k[back.ravel()]
        return rows, np.flatnonzero(self.check[rows] != check)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For a chunk: ids, where each text's ids begin, the code point each id begins at (-1: inside one),
        and where each text begins; ids that begin a pre-token are those at its start."""
        codes, bounds = code_points(texts)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), bounds
        text = "".join(texts)
        starts = pre_token_starts(codes, bounds)
        ends = np.append(starts[1:], len(codes))
        rows, clash = self._learn(text, codes, starts, ends)
        at, sizes = self.at[:-1][rows], (self.at[1:] - self.at[:-1])[rows]
        flat_ids, flat_chars = self.ids, self.chars
        if len(clash):  # two pre-tokens of one 64-bit hash: those that aren't known are merged by themselves
            ids, begin, chars = self.places([text[s:e].encode("utf-8", "replace") for s, e in zip(starts[clash].tolist(), ends[clash].tolist())])
            at[clash], sizes[clash] = len(flat_ids) + begin[:-1], np.diff(begin)
            flat_ids, flat_chars = np.concatenate([flat_ids, ids]), np.concatenate([flat_chars, chars])
        take = ranges(at, sizes)
        total = np.concatenate([[0], np.cumsum(sizes)])
        begin = total[np.searchsorted(starts, bounds)]
        char = flat_chars[take]
        return flat_ids[take], begin, np.where(char < 0, -1, np.repeat(starts, sizes) + char), bounds


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


_encoders: dict[int, Encoder] = {}


def encoder(vocabulary: bytes) -> Encoder:
    """A worker's encoder; it stays with the worker between tasks."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def chunks(texts: list[str], size: int = CHUNK):
    """(first, last) index of texts that together have about ``size`` code points; a longer text is alone."""
    first = total = 0
    for k, t in enumerate(texts):
        if total and total + len(t) > size:
            yield first, k
            first, total = k, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


def safe_parts(text: str, size: int = CHUNK) -> list[str]:
    """A very long text in parts whose pre-tokens are those of the whole: each
    part but the first begins with a plain space or line feed between two other characters."""
    if len(text) <= 2 * size:
        return [text]
    parts, at = [], 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) - 1 and not (text[cut] in " \n" and not text[cut - 1].isspace() and not text[cut + 1].isspace()):
            cut += 1
        if cut >= len(text) - 1:
            break
        parts.append(text[at:cut])
        at = cut
    return [*parts, text[at:]]


def read_vocabulary(spark: SparkSession, path: str | None = None):
    """The vocabulary file as a broadcast: 16 MB at most, checked, and executors need no copy of their own."""
    with open(path or spark.conf.get("spark.lectern.vocabulary", VOCABULARY), "rb") as f:
        raw = f.read()
    if len(raw) > 16_000_000:
        raise ValueError("a vocabulary of over 16 MB isn't broadcast")
    return spark.sparkContext.broadcast(raw)


def encode_texts(docs: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """(id, ids): the token ids of each text, without special tokens.

    Strings that look like special tokens are ordinary text. Null and empty
    texts both give an empty list. Rows stay as they are: no shuffle, and
    repeated rows are encoded as often as they come.
    """
    vocabulary = read_vocabulary(docs.sparkSession, path)

    def run(batches):
        enc = encoder(vocabulary.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                part = texts[a:b]
                if len(part) == 1 and len(part[0]) > 2 * CHUNK:
                    ids = np.concatenate([enc.encode([p])[0] for p in safe_parts(part[0])])
                    begin = np.array([0, len(ids)])
                else:
                    ids, begin, _, _ = enc.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], [id_col, "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def boundary_strength(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How natural a cut before each place is: 3 after an empty line, 2 after a
    line, 1 after the end of a sentence, 0 elsewhere at a pre-token's start."""
    n = len(codes)
    padded = np.concatenate([np.zeros(2, np.uint32), codes])
    one, two = padded[places + 1], padded[places]
    newline = np.isin(one, [10, 13])
    empty = newline & ((two == 10) | ((two == 13) & (one != 10)))
    stop = np.isin(one, [0x3002, 0xFF01, 0xFF1F, 0xFF1B, 0x2026])
    west = np.isin(one, [0x2E, 0x21, 0x3F, 0x3B]) & (np.append(codes, 32)[np.minimum(places, n)] == 32)
    return np.where(empty, 3, np.where(newline, 2, np.where(stop | west, 1, 0)))


class Boundaries:
    """Boundaries at sorted token offsets, by strength; finds where a piece ends and the next begins by binary search."""

    def __init__(self, tokens_before: np.ndarray, strength: np.ndarray, limit: int, overlap: int):
        self.by_strength = [tokens_before[strength >= s] for s in range(4)]
        self.limit, self.overlap = limit, overlap

    def end(self, start: int) -> int:
        """The strongest boundary of the piece's second half that lies under the limit, of equal ones the last; else the hard limit."""
        hard = start + self.limit
        floor = start + max(self.limit // 2, self.overlap + 1)
        for s in (3, 2, 1, 0):
            k = np.searchsorted(self.by_strength[s], hard, "right") - 1
            if k >= 0 and self.by_strength[s][k] >= floor:
                return int(self.by_strength[s][k])
        return hard

    def next_start(self, start: int, end: int) -> int:
        """The boundary nearest to ``overlap`` tokens before the end, of two the earlier; without one within half an overlap, that point itself."""
        back, words = end - self.overlap, self.by_strength[0]
        k = int(np.searchsorted(words, back, "left"))
        near = [int(w) for w in words[max(0, k - 1) : k + 1] if start < w < end and abs(int(w) - back) <= self.overlap // 2]
        return min(near, key=lambda w: (abs(w - back), w), default=back)


def split_texts(docs: DataFrame, id_col: str, text_col: str, limit: int = 1024, overlap: int = 128, path: str | None = None, with_text: bool = True) -> DataFrame:
    """(id, piece_no, start_char, end_char, n_tokens[, piece]): each text in pieces of at most ``limit`` tokens.

    Offsets of tokens are prefix sums over the encoded text; natural boundaries
    (after an empty line, a line, a sentence, before a word) are a sorted array
    of token offsets in which the last one under the limit is found by binary
    search. Each piece begins with the last ``overlap`` tokens of the one before,
    or at the next boundary after that point. Where a stretch has no boundary,
    the cut is a hard one at a token that begins a code point. A text under the
    limit is one piece; null and empty texts give no row. Rows that come twice
    are cut twice. ``start_char`` and ``end_char`` count code points from 0.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be under half the limit")
    vocabulary = read_vocabulary(docs.sparkSession, path)
    kind = dict(docs.dtypes)[id_col]

    def pieces(enc: Encoder, codes: np.ndarray, text: str, chars: np.ndarray, is_start: np.ndarray) -> list[tuple[int, int, int]]:
        total = len(chars)
        if total <= limit:
            return [(0, len(codes), total)]
        # hard cuts may fall on tokens inside a pre-token, but not inside a code point
        at = np.flatnonzero(is_start)
        strength = boundary_strength(codes, chars[at])
        whole = np.append(np.flatnonzero(chars >= 0), total)
        edge = np.append(chars, len(codes))
        clean = np.append(is_start, True)
        before = lambda x: int(whole[np.searchsorted(whole, x, "right") - 1])

        def size(a: int, b: int) -> int:
            """Tokens of the piece by itself."""
            s, e = int(edge[a]), int(edge[b])
            if not (clean[a] and clean[b]):
                return len(enc.encode([text[s:e]])[0])
            # alone, the white space at a piece's end is one pre-token
            tail = e - s - len(text[s:e].rstrip())
            if tail <= 1 or b == total:
                return b - a
            first = int(np.searchsorted(np.maximum.accumulate(chars[a:b]), e - tail)) + a
            return first - a + len(enc.encode([text[e - tail : e]])[0])

        out, found, a = [], Boundaries(at, strength, limit, overlap), 0
        while True:
            b = total if total - a <= limit else before(found.end(a))
            n = size(a, b)
            while n > limit:  # a cut inside a pre-token can give more tokens than the text had there
                b = before(b - 1)
                n = size(a, b)
            out.append((int(edge[a]), int(edge[b]), n))
            if b == total:
                return out
            # from where the piece really ends, and on from where it began
            a = max(before(found.next_start(a, b)), int(whole[np.searchsorted(whole, a, "right")]))

    def spread(enc: Encoder, texts: list[str]):
        """(code points, places of the ids, whether they begin a pre-token) of each text."""
        parts = safe_parts(texts[0]) if len(texts) == 1 else texts
        _, begin, chars, bounds = enc.encode(parts)
        codes, _ = code_points(parts)
        starts = np.zeros(len(codes) + 1, bool)
        starts[pre_token_starts(codes, bounds)] = True
        is_start = (chars >= 0) & starts[chars]
        if len(texts) == 1:
            begin, bounds = begin[[0, -1]], bounds[[0, -1]]
        for k in range(len(texts)):
            own, c = chars[begin[k] : begin[k + 1]], int(bounds[k])
            yield codes[c : bounds[k + 1]], np.where(own < 0, -1, own - c), is_start[begin[k] : begin[k + 1]]

    def run(batches):
        enc = encoder(vocabulary.value)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = [k for k, t in enumerate(texts) if t]
            ids, texts = [ids[k] for k in keep], [texts[k] for k in keep]
            for a, b in chunks(texts):
                rows = []
                for i, t, view in zip(ids[a:b], texts[a:b], spread(enc, texts[a:b])):
                    codes, chars, is_start = view
                    rows += [(i, no, s, e, n, *([t[s:e]] if with_text else [])) for no, (s, e, n) in enumerate(pieces(enc, codes, t, chars, is_start))]
                cols = list(zip(*rows))
                types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), *([pa.string()] if with_text else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [id_col, "piece_no", "start_char", "end_char", "n_tokens", *(["piece"] if with_text else [])])

    schema = f"`{id_col}` {kind}, piece_no int, start_char long, end_char long, n_tokens int" + ", piece string" * with_text
    return docs.select(id_col, text_col).mapInArrow(run, schema)
