"""Problem 9: evaluation texts in training text, by hashes of template windows.

Numbers, names and units become typed placeholders, so a passage and its
re-parameterised twin give the same template. Windows of template tokens of the
corpus are joined by hash with those of the items; the slots behind the
placeholders then tell a verbatim passage from a re-parameterised one.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tokens import CHUNK, LETTER, NUMBER, _powers, char_classes, chunks, code_points, ranges, span_hashes
from lectern.session import cut

#: Items whose index is broadcast whole; it takes a few hundred bytes for each character of an item.
INDEX_ITEMS = 4000
INDEX_CHARS = 2_000_000
#: Bits of the filter that is broadcast where items are more: 16 for each window, so about 30 million windows at full size.
FILTER_BITS = 1 << 29
#: A very long text is read in parts that share so many words or characters.
OVERLAP = 4096

# Common units behind a number, last characters of place names, numerals.
UNITS_EN = "second seconds minute minutes hour hours day days week weeks month months year years millimetre millimetres centimetre centimetres metre metres meter meters kilometre kilometres kilometer kilometers mile miles inch inches foot feet yard yards gram grams kilo kilos kilogram kilograms ounce ounces pound pounds ton tons tonne tonnes litre litres liter liters gallon gallons degree degrees percent dollar dollars euro euros cent cents watt watts volt volts".split()
UNITS_ZH = "秒分时天日周月年米寸尺丈里克斤吨升度元角个只"
PLACE_ZH = "省市县区镇乡村州城港湾岛山河湖路街"
NUMERALS_ZH = "〇零一二三四五六七八九十百千万亿两"

NUM, NAME, UNIT = (np.uint64(x) for x in (0x1F3D5B79A2C4E6F1, 0x2F3D5B79A2C4E6F3, 0x3F3D5B79A2C4E6F5))


def fold(text: str) -> str:
    """Usual width and lower case, by the rules of the whole text."""
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


@functools.cache
def fold_table() -> tuple[np.ndarray, np.ndarray]:
    """Each code point folded by itself, and which can't be: those that give
    several, and those that can join with the one before (combining marks and other second halves)."""
    one, whole = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    # the ideographs, Hangul syllables, surrogates and higher planes without foldings are themselves
    for c in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xE000, 0x17000), *range(0x1B000, 0x20000), *range(0x2F800, 0x2FA20)]:
        t = fold(chr(c))
        if len(t) == 1:
            one[c] = ord(t)
        else:
            whole[c] = True
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            whole[int(parts[1], 16)] = True
        if unicodedata.combining(chr(c)):
            whole[c] = True
    whole[0x1100:0x1200] = True  # Hangul letters join into syllables
    return one, whole | whole[one]


@functools.cache
def class_table() -> np.ndarray:
    return char_classes()


@functools.cache
def zh_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    number, place, unit = (np.zeros(0x110000, bool) for _ in range(3))
    number[class_table() == NUMBER] = True
    number[[ord(c) for c in NUMERALS_ZH]] = True
    place[[ord(c) for c in PLACE_ZH]] = True
    unit[[ord(c) for c in UNITS_ZH]] = True
    return number, place, unit


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts folded, as one array, and where each begins. A text's own
    characters alone decide whether it is folded as a whole or by the table."""
    codes, bounds = code_points(texts)
    one, whole = fold_table()
    odd = np.unique(np.searchsorted(bounds, np.flatnonzero(whole[codes]), "right") - 1)
    if len(odd):
        texts = list(texts)
        for k in odd.tolist():
            texts[k] = fold(texts[k])
        codes, bounds = code_points(texts)
    return one[codes], bounds


@dataclass
class Stream:
    """Raw units (words, or letters and digits) and template tokens of several texts.

    ``raw``: a hash of each unit; ``bounds``: where each text's units begin;
    ``kind``: 0 or the kind of slot that the unit is; ``at``: where it begins in
    the code points. Template tokens stand for one unit each (``tokens``); in
    the short template runs of numbers and of names are one token
    (``short``; ``unit``: its first raw unit; ``short_bounds``).
    """

    raw: np.ndarray
    bounds: np.ndarray
    kind: np.ndarray
    at: np.ndarray

    @functools.cached_property
    def tokens(self) -> np.ndarray:
        return np.array([0, NUM, NAME, UNIT], np.uint64)[self.kind] + np.where(self.kind == 0, self.raw, np.uint64(0))

    @functools.cached_property
    def unit(self) -> np.ndarray:
        keep = np.ones(len(self.raw), bool)
        keep[1:] = (self.kind[1:] != self.kind[:-1]) | (self.kind[1:] == 0) | (self.kind[1:] == 3)
        keep[self.bounds[:-1][self.bounds[:-1] < len(self.raw)]] = True
        return np.flatnonzero(keep)

    @functools.cached_property
    def short(self) -> np.ndarray:
        return self.tokens[self.unit]

    @functools.cached_property
    def short_bounds(self) -> np.ndarray:
        return np.searchsorted(self.unit, self.bounds)


def word_stream(codes: np.ndarray, bounds: np.ndarray, names: Members) -> Stream:
    """English view: runs of letters and digits as units; ``names``: hashes of name words."""
    kind = class_table()[codes]
    text = kind <= NUMBER
    edge = np.zeros(len(codes) + 1, bool)
    edge[bounds] = True
    open_ = text.copy()
    open_[1:] &= ~text[:-1] | edge[1:-1]
    starts = np.flatnonzero(open_)
    close = text.copy()
    close[:-1] &= ~text[1:] | edge[1:-1]
    ends = np.flatnonzero(close) + 1
    raw = span_hashes(codes, starts, ends, 3)
    letters = np.concatenate([[0], np.cumsum(kind == LETTER)])
    number = letters[ends] == letters[starts]
    slots = np.where(number, 1, np.where(names.has(raw), 2, np.where(unit_words().has(raw), 3, 0)))
    return Stream(raw, np.searchsorted(starts, bounds), slots, starts)


def char_stream(codes: np.ndarray, bounds: np.ndarray) -> Stream:
    """Chinese view: letters and digits as units; a place name is two characters and a last one of PLACE_ZH, all of one text."""
    at = np.flatnonzero(class_table()[codes] <= NUMBER)
    own = codes[at]
    number, place, unit = zh_tables()
    kind = np.where(number[own], 1, np.where(unit[own], 3, 0))
    last = np.flatnonzero(place[own])
    han = (own >= 0x4E00) & (own < 0xA000) & ~number[own]
    edges = np.searchsorted(at, bounds)
    last = last[last - edges[np.searchsorted(edges, last, "right") - 1] >= 2]
    last = last[han[last - 1] & han[last - 2]]
    for d in (0, 1, 2):
        kind[last - d] = 2
    raw = span_hashes(codes, at, at + 1, 3)
    return Stream(raw, edges, kind, at)


class Members:
    """A set of hashes; a table of their low bits rules out nearly all that isn't in it."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.mask = np.uint64((1 << max(10, (16 * len(self.sorted)).bit_length())) - 1)
        self.table = np.zeros(int(self.mask) + 1, bool)
        self.table[(self.sorted & self.mask).astype(np.int64)] = True

    def has(self, values: np.ndarray) -> np.ndarray:
        out = self.table[(values & self.mask).view(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            k = np.minimum(np.searchsorted(self.sorted, values[at]), len(self.sorted) - 1)
            out[at] = self.sorted[k] == values[at]
        return out


def word_hashes(words: list[str]) -> Members:
    codes, bounds = folded(words)
    return Members(span_hashes(codes, bounds[:-1], bounds[1:], 3))


@functools.cache
def unit_words() -> Members:
    return word_hashes(UNITS_EN)


def window_hashes(values: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """A hash of each ``size`` successive values; entry k is of values[k:k+size]."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, back = _powers(1 << max(16, len(values).bit_length()), seed)
    mixed = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mixed * power[: len(values)], out=sums[1:])
    return (sums[size:] - sums[:n]) * back[:n]


def _inside(bounds: np.ndarray, total: int, size: int) -> np.ndarray:
    """Which windows of ``size`` lie in one text; and nothing else."""
    n = max(0, total - size + 1)
    text = np.searchsorted(bounds, np.arange(n), "right") - 1
    return np.arange(n) + size <= bounds[text + 1]


@dataclass
class View:
    """Index of the items of one language, by hash.

    A passage is ``units`` successive units. Whether a unit is a slot can depend
    on the ``edge`` units beside it, so a passage's template window is what
    remains without its edges; one unit is one token there, so a window of that
    size lies in each passage, whatever it says. ``short`` windows of half as
    many tokens, in which runs are one token, are for re-parameterised passages.
    """

    units: int
    edge: int
    items: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    template: Members | None = None
    exact: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    exact_item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    short: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    short_at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    short_set: Members | None = None
    stream: Stream | None = None

    @property
    def tokens(self) -> int:
        return self.units // 2

    def build(self, ids: list[int], s: Stream) -> View:
        self.items, self.stream = np.array(ids, np.int64), s
        places, text, template, exact = self.windows(s)
        pairs = np.unique(np.rec.fromarrays([exact, text]))
        self.exact, self.exact_item = pairs.f0.copy(), pairs.f1.copy()
        self.template = Members(template)
        t = window_hashes(s.short, self.tokens)
        at = np.flatnonzero(_inside(s.short_bounds, len(s.short), self.tokens))
        order = np.argsort(t[at], kind="stable")
        self.short, self.short_at = t[at][order], at[order]
        self.short_set = Members(self.short)
        return self

    def windows(self, s: Stream, among: Members | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, text, template hash, raw hash) of each passage; with ``among`` of those whose template is in it."""
        t = window_hashes(s.tokens, self.units - 2 * self.edge)[self.edge :]
        t = t[: max(0, len(s.raw) - self.units + 1)]
        places = np.arange(len(t)) if among is None else np.flatnonzero(among.has(t))
        text = np.searchsorted(s.bounds, places, "right") - 1
        good = places + self.units <= s.bounds[text + 1]
        places, text = places[good], text[good]
        raw = window_hashes(s.raw, self.units)[places] if len(places) else np.zeros(0, np.uint64)
        return places, text, t[places], raw

    def verbatim(self, s: Stream) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) pairs with a verbatim passage: its template is an item's, and so are the raw units at the same places."""
        _, text, _, h = self.windows(s, self.template)
        a, b = np.searchsorted(self.exact, h, "left"), np.searchsorted(self.exact, h, "right")
        take = ranges(a, b - a)
        pairs = np.unique(np.stack([np.repeat(text, b - a), self.exact_item[take]], 1), axis=0).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    def reparameterised(self, s: Stream) -> list[tuple[int, int]]:
        """(text, item) pairs that share a template passage of ``units`` raw units with other, but consistent slots."""
        t = window_hashes(s.short, self.tokens)
        hits = np.flatnonzero(self.short_set.has(t))
        hits = hits[_inside(s.short_bounds, len(s.short), self.tokens)[hits]]
        if not len(hits):
            return []
        h = t[hits]
        a, b = np.searchsorted(self.short, h, "left"), np.searchsorted(self.short, h, "right")
        own = np.repeat(hits, b - a)
        other = self.short_at[ranges(a, b - a)]
        item = np.searchsorted(self.stream.short_bounds, other, "right") - 1
        order = np.lexsort((own, own - other, item))
        own, other, item = own[order], other[order], item[order]
        fresh = np.ones(len(own), bool)
        text = np.searchsorted(s.short_bounds, own, "right")
        fresh[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (own[1:] != own[:-1] + 1) | (other[1:] != other[:-1] + 1)
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:], len(own)) - 1
        units = lambda st, x, y: np.append(st.unit, len(st.raw))[y] - st.unit[x]
        long_ = (units(s, own[begin], own[end] + self.tokens) >= self.units) & (units(self.stream, other[begin], other[end] + self.tokens) >= self.units)
        out = set()
        for k, e in zip(begin[long_].tolist(), end[long_].tolist()):
            x, y, n = int(own[k]), int(other[k]), int(e - k) + self.tokens
            pair = (int(np.searchsorted(s.short_bounds, x, "right")) - 1, int(item[k]))
            if pair not in out and consistent(self.slots(s, x, n), self.slots(self.stream, y, n)):
                out.add(pair)
        return sorted(out)

    @staticmethod
    def slots(s: Stream, first: int, n: int) -> list[bytes]:
        ends = np.append(s.unit, len(s.raw))
        return [s.raw[s.unit[k] : ends[k + 1]].tobytes() for k in range(first, first + n) if s.kind[s.unit[k]] in (1, 2)]


def consistent(own: list[bytes], other: list[bytes]) -> bool:
    """Equal slots of the item are equal in the text as well, and unequal ones unequal."""
    return len(own) == len(other) and len(set(zip(own, other))) == len(set(own)) == len(set(other))


def _forms(texts: list[str]) -> tuple[set[str], set[str]]:
    """Words that the texts write in capitals inside sentences, and words that they write in small letters."""
    import regex

    upper, lower = set(), set()
    for t in texts:
        for m in regex.finditer(r"[\p{L}\p{N}]+", t):
            w = m.group()
            before = t[: m.start()].rstrip(" \t\n\"'“‘(")
            if w[:1].islower():
                lower.add(w.casefold())
            elif w[:1].isupper() and before and before[-1] not in ".?!…:;":
                upper.add(w.casefold())
    return upper, lower


def _given(names: list[str]) -> set[str]:
    import regex

    return {w for n in names for w in regex.findall(r"[\p{L}\p{N}]+", n.casefold())}


def _name_words(texts: list[str], names: list[str]) -> Members:
    """Words of the given names, and words that the items write in capitals inside sentences and never otherwise."""
    upper, lower = _forms(texts)
    return word_hashes(sorted((upper - lower) | _given(names)))


def _all_name_words(items: DataFrame, names: list[str]) -> Members:
    """:func:`_name_words` of items (text, lang) of any number; only the words' hashes come to the driver."""

    def forms(batches):
        for batch in batches:
            upper, lower = _forms([t for t in batch.column(0).to_pylist() if t])
            words = sorted(upper | lower)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([w in lower for w in words], pa.bool_())], ["word", "small"])

    def hashes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes(batch.column(0).to_pylist()).sorted.view(np.int64))], ["word"])

    words = items.where("lang <> 'zh'").select("text").mapInArrow(forms, "word string, small boolean").groupBy("word").agg(F.bool_or("small").alias("small"))
    found = words.where("not small").select("word").mapInArrow(hashes, "word long").toArrow().column(0)
    return Members(np.concatenate([np.array(found, np.int64).view(np.uint64), word_hashes(sorted(_given(names))).sorted]))


def streams(codes: np.ndarray, bounds: np.ndarray, names: Members) -> list[Stream]:
    return [word_stream(codes, bounds, names), char_stream(codes, bounds)]


def build_index(rows: list[tuple[int, str, str]], names: Members, words: int = 12, chars: int = 24) -> tuple[View, View]:
    en, zh = ([(i, t) for i, own, t in rows if (own == "zh") == (k == 1)] for k in (0, 1))
    views = (View(words, 0), View(chars, 3))
    for k, (view, own) in enumerate(zip(views, (en, zh))):
        if own:
            codes, bounds = folded([t for _, t in own])
            view.build([i for i, _ in own], word_stream(codes, bounds, names) if k == 0 else char_stream(codes, bounds))
    return views


FOUND = "doc_id long, item_id long, how string"


def leaks(docs: DataFrame, items: DataFrame, names: list[str] = (), words: int = 12, chars: int = 24, reparameterised: bool = True, index_items: int = INDEX_ITEMS, index_chars: int = INDEX_CHARS) -> DataFrame:
    """(doc_id, item_id, how): documents that hold a passage of an item.

    how ``verbatim``: ``words`` successive words of an English item or ``chars``
    successive letters and digits of a Chinese one, whatever the case, width,
    white space and punctuation. how ``reparameterised``: a passage of that
    length, of at least half as many template tokens, whose numbers, places and
    names are others, but the same where the item's are the same. A pair can
    have both. In English a name is a word of ``names``, or one that the items
    write in capitals inside a sentence and never otherwise; a passage with a
    name that is neither isn't found as re-parameterised.

    Each passage has its own template window, so no verbatim passage is missed.
    The index of up to ``index_items`` items and ``index_chars`` characters is
    broadcast, and documents aren't shuffled. With more items the windows of
    both sides are joined by hash: a filter over the items' windows, of bounded
    size, leaves out documents' windows that no item can have, and the rest is
    shuffled; the documents are read once, however many items there are. The
    rows are the same either way. A very long text is read in parts that share
    ``OVERLAP`` units. Null and empty texts give no row; items shorter than a
    passage neither. A row comes once, however often documents and items do;
    where an id has several texts, each of them counts.
    """
    spark = docs.sparkSession
    items = items.select("item_id", F.coalesce("lang", F.when(F.col("text").rlike(r"\p{IsHan}"), "zh").otherwise("en")).alias("lang"), "text").where("item_id is not null and text is not null").distinct()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if n > index_items or size > index_chars:
        return _joined(docs, items, list(names), words, chars, reparameterised, size)
    rows = [tuple(r) for r in items.collect()]  # bounded: checked just now
    known = _name_words([t for _, own, t in rows if own != "zh"], list(names))
    shared = spark.sparkContext.broadcast((build_index(rows, known, words, chars), known))
    return docs.mapInArrow(functools.partial(_search, index=shared, both=reparameterised), FOUND).distinct()


def _parts(s: Stream, codes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of code points of a very long text: each begins with a unit and shares ``OVERLAP`` units with the one before."""
    out, k = [], 0
    while k < len(s.at):
        e = int(np.searchsorted(s.at, s.at[k] + 2 * CHUNK))
        e = max(e, k + 2 * OVERLAP)
        if e >= len(s.at):
            out.append((int(s.at[k]), len(codes)))
            break
        out.append((int(s.at[k]), int(s.at[e])))
        k = e - OVERLAP
    return out


def _views(texts: list[str], names: Members):
    """(first text, Streams) of texts in chunks; a very long text comes in parts, each with the one Stream it was cut for."""
    for a, b in chunks(texts):
        codes, bounds = folded(texts[a:b])
        if not len(codes):
            continue
        both = streams(codes, bounds, names)
        if b - a > 1 or len(codes) <= 4 * CHUNK:
            yield a, both
            continue
        for k in (0, 1):
            for x, y in _parts(both[k], codes):
                part, edges = codes[x:y], np.array([0, y - x])
                yield a, [word_stream(part, edges, names), None] if k == 0 else [None, char_stream(part, edges)]


def _search(batches, index, both):
    views, names = index.value
    for batch in batches:
        rows = [(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if i is not None and t]
        found = set()
        for first, own in _views([t for _, t in rows], names):
            for view, s in zip(views, own):
                if s is None or view.stream is None:
                    continue
                text, item = view.verbatim(s)
                found.update((rows[first + x][0], int(view.items[y]), "verbatim") for x, y in zip(text.tolist(), item.tolist()))
                if both:
                    found.update((rows[first + x][0], int(view.items[y]), "reparameterised") for x, y in view.reparameterised(s))
        cols = list(zip(*sorted(found))) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "item_id", "how"])


WINDOWS = "id long, how string, template long, raw long"


def _windows(batches, names, words, chars, both, bits, lang):
    """Windows of texts (id, text[, lang]) by hash: verbatim ones with template and raw hash, re-parameterised ones with the short template."""
    blank = [View(words, 0), View(chars, 3)]
    packed = None if bits is None else np.frombuffer(bits.value, np.uint8)
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        rows = [(i, t, g) for i, t, g in zip(cols[0], cols[1], cols[2] if lang else [None] * len(cols[0])) if i is not None and t]
        ids = np.array([r[0] for r in rows], np.int64)
        for first, own in _views([r[1] for r in rows], names.value):
            for k, (view, s) in enumerate(zip(blank, own)):
                if s is None:
                    continue
                _, text, t, raw = view.windows(s)
                found = [(text, "verbatim", t, raw)]
                if both:
                    t = window_hashes(s.short, view.tokens)
                    at = np.flatnonzero(_inside(s.short_bounds, len(s.short), view.tokens))
                    found.append((np.searchsorted(s.short_bounds, at, "right") - 1, "reparameterised", t[at], np.zeros(len(at), np.uint64)))
                for text, how, t, raw in found:
                    t = t + np.uint64(k)  # languages don't meet
                    keep = np.ones(len(t), bool)
                    if lang:
                        keep &= np.array([(rows[first + x][2] == "zh") == (k == 1) for x in range(len(rows) - first)], bool)[text]
                    if packed is not None:
                        at = (t & np.uint64(8 * len(packed) - 1)).astype(np.int64)
                        keep &= (packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                    cols = np.unique(np.rec.fromarrays([ids[first + text[keep]], t[keep], raw[keep]]))
                    yield pa.RecordBatch.from_arrays([pa.array(cols.f0), pa.array([how] * len(cols), pa.string()), pa.array(cols.f1.view(np.int64)), pa.array(cols.f2.view(np.int64))], ["id", "how", "template", "raw"])


def _joined(docs: DataFrame, items: DataFrame, names: list[str], words: int, chars: int, both: bool, size: int) -> DataFrame:
    """:func:`leaks` for items of any number, by a join of window hashes; see there."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(_all_name_words(items, names))
    find = functools.partial(_windows, names=known, words=words, chars=chars, both=both)
    own = cut(items.select(F.col("item_id").cast("long"), "text", "lang").mapInArrow(functools.partial(find, bits=None, lang=True), WINDOWS))
    bits = min(FILTER_BITS, 1 << max(16, int(np.ceil(np.log2(16 * max(1, size))))))

    def places(batches):
        for batch in batches:
            at = np.unique(np.array(batch.column(0), np.int64).view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
            bytes_, begin = np.unique(at >> 3, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(bytes_), pa.array(np.bitwise_or.reduceat(1 << (at & 7), begin) if len(at) else np.zeros(0, np.int64))], ["byte", "bits"])

    merged = own.select("template").mapInArrow(places, "byte long, bits long").groupBy("byte").agg(F.bit_or("bits").cast("int").alias("bits"))
    packed = np.zeros(bits // 8, np.uint8)
    got = merged.toArrow()  # bounded: a row for each byte of the filter at most
    packed[np.array(got.column(0))] = np.array(got.column(1)).astype(np.uint8)
    shared = spark.sparkContext.broadcast(packed.tobytes())
    seen = docs.mapInArrow(functools.partial(find, bits=shared, lang=False), WINDOWS)
    pairs = seen.withColumnRenamed("id", "doc_id").join(own.distinct().withColumnRenamed("id", "item_id"), ["how", "template", "raw"]).select("doc_id", "item_id", "how").distinct()
    if not both:
        return pairs
    pairs = cut(pairs)
    # a shared template window only makes a candidate: its slots and length are checked on the two texts
    maybe = pairs.where("how = 'reparameterised'").join(docs.where("text <> ''"), "doc_id").join(items.select("item_id", "lang", F.col("text").alias("item")), "item_id")

    def verify(batches):
        for batch in batches:
            docs_, texts, *own_items = (c.to_pylist() for c in batch.columns)
            rows, found = sorted(set(zip(docs_, texts))), set()
            # a batch's texts and items at once: what a pair gives doesn't depend on the others
            views = build_index(sorted(set(zip(*own_items))), known.value, words, chars)
            for first, own in _views([t for _, t in rows], known.value):
                for view, s in zip(views, own):
                    if s is not None and view.stream is not None:
                        found.update((rows[first + x][0], int(view.items[y]), "reparameterised") for x, y in view.reparameterised(s))
            cols = list(zip(*sorted(found))) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "item_id", "how"])

    checked = maybe.select("doc_id", "text", F.col("item_id").cast("long"), "lang", "item").mapInArrow(verify, FOUND)
    return pairs.where("how = 'verbatim'").unionByName(checked.distinct())
