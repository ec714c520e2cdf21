"""Problem 4: personal information in free text, by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs and their
spellings, digits and spoken digits, words that say a number is an identity's or
a telephone's, street words, and name parts. Only around an anchor a local
parser reads on to both sides, as far as its own form goes, and accepts a span
if its form is valid. Everything is deterministic, and positions are those of the text.
"""

from __future__ import annotations

import bisect
import functools
import re
import unicodedata

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# Spellings of the at-sign and of digits, and words of streets.
AT_WORDS = ["@", "[at]", "(at)", "{at}", "<at>", " at ", "艾特", "圈a", "小老鼠"]
SPOKEN_ZH = "零〇一幺二两三四五六七八九"
SPOKEN_EN = "zero oh one two three four five six seven eight nine double triple".split()
STREETS_ZH = ["路", "街", "大道", "道", "巷", "弄", "里", "胡同"]
STREETS_EN = "road rd street st lane ln avenue ave close drive dr court ct way place pl square sq terrace boulevard blvd crescent gardens row hill".split()
ID_CUES = ("ssn", "social security", "my id", "identity", "身份证", "证件", "社保", "社会安全")
PHONE_CUES = ("call", "text", "phone", "tel", "mobile", "number is", "reach", "dial", "ring", "电话", "手机", "号码", "回拨", "拨打", "致电")
NO_STREET_NAMES = frozenset("of by the and at a an in on to for or is are was be each with from per that this it as than page unit pixels pm am minutes hours days".split())

_HOST = r"[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?"
_DOT = r"(?:\.|\s*[\[(]dot[\])]\s*|\s+dot\s+|\s*点\s*)"
#: Right of an at-sign; spoken dots stand between the parts.
_AFTER = re.compile(rf"\s*({_HOST}(?:{_DOT}{_HOST})*{_DOT}[a-z]{{2,}})(?![a-z0-9])")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_%+-")
#: The weights and check characters of the 18-character identity number (ISO 7064, MOD 11-2), stated as fixed values.
_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
_CHECKS = "10x98765432"
#: Where what a cue says of a number ends.
_CLAUSE = re.compile(r"[.!?。！？;；\n](?!\S)|[。！？；\n]")

_CELL = r"1[3-9][0-9][ \-]?[0-9]{4}[ \-]?[0-9]{4}"
_ID = re.compile(r"(?<![0-9a-z])[1-9][0-9]{5}[ \-]?(?:18|19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[ \-]?[0-9]{3}[0-9x](?![0-9a-z])")
_SSN = re.compile(r"(?<![0-9a-z])[0-9]{3}([ \-])[0-9]{2}\1[0-9]{4}(?![0-9a-z])")
_NINE = re.compile(r"(?<![0-9a-z\-])[0-9]{9}(?![0-9a-z])")
_PHONE_CN = re.compile(rf"(?<![0-9a-z])(?:\(?(?:\+|00)86\)?[ \-]?|86[ \-])?{_CELL}(?![0-9a-z])")
_PHONE_US = re.compile(r"(?<![0-9a-z])(?:(?:\+|00)?1[ \-.]?)?(?:\([0-9]{3}\)[ \-.]?|[0-9]{3}[ \-.])[0-9]{3}[ \-.][0-9]{4}(?![0-9a-z])")
_TEN = re.compile(r"(?<![0-9a-z])(?:\+?1)?[2-9][0-9]{2}[2-9][0-9]{6}(?![0-9a-z])")
_RUN = re.compile(r"[0-9+(][0-9 \-.()+]*[0-9x]")
_SPOKEN_ZH = re.compile(rf"[{SPOKEN_ZH}](?:[ \-—,，、]?[{SPOKEN_ZH}])*")
_CELL_ZH = re.compile(r"(?:(?:[零〇]{2})?八六)?[一幺][三四五六七八九][零〇一幺二两三四五六七八九]{9}")
_SPOKEN_EN = re.compile(rf"(?<![a-z])(?:{'|'.join(SPOKEN_EN)})(?:[ ,\-]+(?:{'|'.join(SPOKEN_EN)}))*(?![a-z])")
_HOUSE_ZH = re.compile(r"\s*(?:[0-9]{1,5}[a-z]?(?:\s*-\s*[0-9]{1,4})?|[一二三四五六七八九十百零〇]{1,6})\s*号(?!课|码|线|台)(?:\s*(?:[0-9a-z一二三四五六七八九十]{1,5}\s*(?:单元|栋|幢|号楼|楼|层|室|房)))*")
_DISTRICT_ZH = re.compile(r"(?:[一-鿿]{2,3}[省市])?(?:[一-鿿]{2,3}[区县镇])?[一-鿿]{1,3}$")
_UNIT_EN = r"(?:,?\s*(?:apt|flat|unit|suite|room|apartment)\.?\s*#?\s*[0-9]{1,4}[a-z]?)?"
_NUMBER_EN = re.compile(r"(?:no\.?\s*)?(?<![0-9a-z.,\-])[0-9]{1,5}[a-z]?(?:-[0-9]{1,4})?,?\s+((?:[a-z][a-z'\-]*\s+){1,3})$")
_NAME_EN = re.compile(r"(?<![a-z0-9])((?:[a-z][a-z'\-]+\s+){1,2})$")
_HOUSE_EN = re.compile(rf"\.?,?\s+(?:no\.?\s*)?[0-9]{{1,5}}[a-z]?(?![0-9a-z%]){_UNIT_EN}")
_TAIL_EN = re.compile(rf"\.?{_UNIT_EN}")
_GLUE_ZH = re.compile(r"[\s·]{0,2}")
_GLUE_EN = re.compile(r"(?:,\s{0,2}|\s{1,2})(?:[a-z]\.?\s{1,2})?")


@functools.cache
def _fold_map() -> dict[int, str]:
    """Full width forms and odd dashes and spaces as plain ones, one character each."""
    out = {c: unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFF5F) if c not in (0xFF0C, 0xFF1B, 0xFF1A, 0xFF01, 0xFF1F)}
    out |= {0x3000: " ", 0xA0: " ", 0x2007: " ", 0x202F: " ", 0x2009: " ", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2212: "-", 0x200B: " "}
    return out


def fold(text: str) -> str:
    """Lower case and usual width, of the same length as the text."""
    text = text.translate(_fold_map())
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Finder:
    """Anchors and their parsers; ``names``: (part, kind, lang) with kind family or given."""

    def __init__(self, names: list[tuple[str, str, str]]):
        self.names: dict[str, set[tuple[str, bool]]] = {}
        anchors: dict[str, list] = {}
        for part, kind, lang in names:
            part = fold(part)
            cjk = any("㐀" <= c <= "鿿" for c in part)
            self.names.setdefault(part, set()).add((kind, cjk))
            anchors.setdefault(part, []).append("part")
        for w in AT_WORDS:
            anchors.setdefault(w, []).append("at")
        for d in "0123456789":
            anchors.setdefault(d, []).append("digit")
        for d in "一幺零〇八":
            anchors.setdefault(d, []).append("spoken")
        for d in ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "zero"):
            anchors.setdefault(d, []).append("words")
        for w in STREETS_ZH:
            anchors.setdefault(w, []).append("street")
        for w in STREETS_EN:
            anchors.setdefault(f" {w}", []).append("road")
        for cues, kind in ((ID_CUES, "id cue"), (PHONE_CUES, "phone cue")):
            for w in cues:
                anchors.setdefault(w, []).append(kind)
        self.automaton = ahocorasick.Automaton()
        for w, kinds in anchors.items():
            self.automaton.add_word(w, (len(w), w, tuple(kinds)))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind), sorted; spans of one kind don't overlap."""
        low = fold(text)
        found: list[tuple[int, int, str]] = []
        parts: list[tuple[int, int, str]] = []
        digits_to = spoken_to = words_to = -1
        cues = Cues(low)
        for last, (size, word, kinds) in self.automaton.iter(low):
            first, end = last - size + 1, last + 1
            for kind in kinds:
                if kind == "digit":
                    if first >= digits_to:
                        digits_to = self._digits(low, first, found, cues)
                elif kind in ("id cue", "phone cue"):
                    cues.last[kind] = end
                elif kind == "at":
                    self._email(low, first, end, word, found)
                elif kind == "part":
                    parts.append((first, end, word))
                elif kind == "street":
                    self._street_zh(low, first, end, found)
                elif kind == "road":
                    self._street_en(low, first, end, found)
                elif kind == "spoken":
                    if first >= spoken_to:
                        spoken_to = self._spoken_zh(low, first, found)
                elif first >= words_to:
                    words_to = self._spoken_en(low, first, found)
        if len(parts) > 1:
            self._pairs(low, parts, found)
        return _settle(found)

    @staticmethod
    def _email(low: str, first: int, end: int, word: str, found: list) -> None:
        after = _AFTER.match(low, end)
        if not after:
            return
        host = re.sub(_DOT, ".", after.group(1))
        if host.replace(".", "").isdigit():
            return
        spoken = word not in ("@", "<at>", "{at}", "[at]", "(at)")
        start = _local_start(low, first, spoken)
        if start is None or not re.search("[a-z0-9]", low[start:first]):
            return
        if word == " at " and " dot " not in after.group(1) and "." not in after.group(1):
            return
        if low.endswith("mailto:", 0, start):
            start -= 7
        found.append((start, after.end(1), "email"))

    @staticmethod
    def _digits(low: str, first: int, found: list, cues: Cues) -> int:
        start = first
        while start and low[start - 1] in "+(":
            start -= 1
        run = _RUN.match(low, start)
        if not run:
            return first + 1
        stop = run.end()
        if stop - start < 9:
            return stop
        near = (max(0, start - 1), min(len(low), stop + 1))
        taken = []

        def take(pattern: re.Pattern, kind: str, cue: str | None = None) -> None:
            for m in pattern.finditer(low, near[0], near[1]):
                a, b = m.span()
                if pattern is _ID and not (_checked(m.group()) or cues.tell("id cue", a)):
                    continue
                if cue and not cues.tell(cue, a):
                    continue
                if all(b <= x or a >= y for x, y in taken):
                    taken.append((a, b))
                    found.append((a, b, kind))

        take(_ID, "id_number")
        take(_PHONE_CN, "phone")
        take(_PHONE_US, "phone")
        take(_SSN, "id_number")
        take(_NINE, "id_number", "id cue")
        take(_TEN, "phone", "phone cue")
        return stop

    @staticmethod
    def _spoken_zh(low: str, first: int, found: list) -> int:
        run = _SPOKEN_ZH.match(low, first)
        # the run begins at the first of its digits, not at the anchor
        start = first
        while start and (low[start - 1] in SPOKEN_ZH or (low[start - 1] in " -—" and start > 1 and low[start - 2] in SPOKEN_ZH)):
            start -= 1
        run = _SPOKEN_ZH.match(low, start)
        if not run:
            return first + 1
        if len(run.group()) >= 11 and _CELL_ZH.fullmatch(re.sub(r"[ \-—,，、]", "", run.group())):
            found.append((start, run.end(), "phone"))
        return run.end()

    @staticmethod
    def _spoken_en(low: str, first: int, found: list) -> int:
        run = _SPOKEN_EN.match(low, first)
        if not run:
            return first + 1
        words = re.findall("[a-z]+", run.group())
        n, times = 0, 1
        for w in words:
            if w in ("double", "triple"):
                times = 2 if w == "double" else 3
            else:
                n, times = n + times, 1
        if n in (10, 11):
            found.append((first, run.end(), "phone"))
        return run.end()

    @staticmethod
    def _street_zh(low: str, first: int, end: int, found: list) -> None:
        house = _HOUSE_ZH.match(low, end)
        if not house:
            return
        before = _DISTRICT_ZH.search(low, max(0, first - 12), first)  # the form has 11 characters at most
        if before:
            start = before.start()
            while start < first - 1 and low[start] in "在到住于就寄是":
                start += 1
            found.append((start, house.end(), "address"))

    @staticmethod
    def _street_en(low: str, first: int, end: int, found: list) -> None:
        if end < len(low) and (low[end].isalnum() or low[end] in "'-"):
            return
        base = first
        for _ in range(5):  # a number and up to three words before the street word, whatever their length
            while base and low[base - 1].isspace():
                base -= 1
            while base and not low[base - 1].isspace():
                base -= 1
        left = low[base : first + 1]
        number = _NUMBER_EN.search(left)
        if number and not NO_STREET_NAMES & set(number.group(1).split()):
            found.append((base + number.start(), _TAIL_EN.match(low, end).end(), "address"))
            return
        name, house = _NAME_EN.search(left), _HOUSE_EN.match(low, end)
        if name and house and name.group(1).split()[-1] not in NO_STREET_NAMES:
            found.append((base + name.start(1) + len(name.group(1)) - len(name.group(1).split()[-1]) - 1, house.end(), "address"))

    def _pairs(self, low: str, parts: list[tuple[int, int, str]], found: list) -> None:
        parts.sort()
        taken = -1  # a part that ends one name doesn't begin the next
        for k, (a, b, one) in enumerate(parts):
            if a < taken:
                continue
            cjk_one = {c for _, c in self.names[one]}
            if cjk_one == {False} and not _whole(low, a, b):
                continue
            for c, d, other in parts[k + 1 :]:
                if c < b:
                    continue
                if c - b > 7:  # the longest that can stand between
                    break
                for kind, cjk in self.names[one]:
                    wanted = ("given" if kind == "family" else "family", cjk)
                    if wanted not in self.names[other]:
                        continue
                    if cjk:
                        if _GLUE_ZH.fullmatch(low, b, c):
                            found.append((a, d, "name"))
                            taken = max(taken, d)
                    elif _whole(low, c, d) and _GLUE_EN.fullmatch(low, b, c):
                        found.append((a, d, "name"))
                        taken = max(taken, d)


class Cues:
    """Where words that tell the kind of a number stood last, and whether they are of the same sentence as a place."""

    def __init__(self, low: str):
        self.low, self.last, self.ends = low, {}, None

    def tell(self, kind: str, place: int) -> bool:
        cue = self.last.get(kind)
        if cue is None or cue > place:
            return False
        if self.ends is None:
            self.ends = [m.start() for m in _CLAUSE.finditer(self.low)]
        return bisect.bisect_left(self.ends, cue) == bisect.bisect_left(self.ends, place)


def _checked(number: str) -> bool:
    """Whether the last character of an 18-character identity number is the check of the others."""
    digits = [c for c in number if c not in " -"]
    return _CHECKS[sum(int(c) * w for c, w in zip(digits, _WEIGHTS)) % 11] == digits[-1]


def _local_start(low: str, end: int, spoken: bool) -> int | None:
    """Where the local part of an address before ``end`` begins: words and the dots between them, read backwards.

    Dots spoken as ``dot`` belong to it; those as 点 where the at-sign is spoken as well.
    """
    while end and low[end - 1].isspace():
        end -= 1
    start = None
    while True:
        word = end
        while word and low[word - 1] in _LOCAL:
            word -= 1
        if word == end:
            return start
        start = word
        if word and low[word - 1] == ".":
            end = word - 1
            continue
        gap = word
        while gap and low[gap - 1].isspace():
            gap -= 1
        if low.endswith(("(dot)", "[dot]"), 0, gap):
            gap -= 5
        elif gap < word and low.endswith("dot", 0, gap) and low[gap - 4 : gap - 3].isspace():
            gap -= 3
        elif spoken and low.endswith("点", 0, gap):
            gap -= 1
        else:
            return start
        while gap and low[gap - 1].isspace():
            gap -= 1
        end = gap


def _whole(low: str, a: int, b: int) -> bool:
    """A whole word: no letter or digit stands before or after it."""
    return not (a and low[a - 1].isascii() and (low[a - 1].isalnum())) and not (b < len(low) and low[b].isascii() and low[b].isalnum())


def _settle(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of overlapping spans of one kind, the union; the result is sorted."""
    out: list[tuple[int, int, str]] = []
    latest: dict[str, int] = {}
    for a, b, kind in sorted(set(found)):
        k = latest.get(kind)
        if k is not None and a < out[k][1]:
            out[k] = (out[k][0], max(out[k][1], b), kind)
        else:
            latest[kind] = len(out)
            out.append((a, b, kind))
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a placeholder for each span; of overlapping ones, the first and longest stays."""
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], PLACEHOLDERS[kind]]
            at = b
    return "".join([*out, text[at:]])


def personal_information(rows: DataFrame, names: list[tuple[str, str, str]], with_text: bool = True) -> DataFrame:
    """(tab, rec_id, kinds, clean): the kinds of personal information in each text, and the
    text with typed placeholders. Input: tab, rec_id, text.

    ``names`` is a small list (family and given names with their language); its
    bound is the caller's to check. A null text: no kinds, clean is null. An
    empty one stays empty. A text is read whole, in one pass; no shuffle.
    Repeated rows come out as often as they come in.
    """
    listed = rows.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        finder = Finder(listed.value)
        for batch in batches:
            kinds, clean = [], []
            for text in batch.column(2).to_pylist():
                spans = finder.spans(text) if text else []
                kinds.append(sorted({k for _, _, k in spans}))
                if with_text:
                    clean.append(redact(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.list_(pa.string())), *([pa.array(clean, pa.string())] if with_text else [])], ["tab", "rec_id", "kinds", *(["clean"] if with_text else [])])

    return rows.select(F.col("tab").cast("string"), F.col("rec_id").cast("string"), "text").mapInArrow(run, "tab string, rec_id string, kinds array<string>" + ", clean string" * with_text)
