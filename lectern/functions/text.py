"""Text functions; native expressions where Spark has them, Arrow UDFs where not."""

from __future__ import annotations

import difflib
import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

KEEP = r"[^\p{L}\p{N}]+"
# Patterns and placeholders of the redaction by patterns.
PHONE = r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])"
IDENTITY = r"(?<![0-9])[0-9]{17}[0-9Xx](?![0-9])"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
ACCOUNT = r"(?i)(微信(?:号|ID)?|wechat(?:\s*id)?)\s*[:：]?\s*[A-Za-z][-_A-Za-z0-9]{5,19}"
STOP_GRAMS = ["如何", "应该", "分别", "方式", "时候", "怎么", "什么", "进行"]


def text_key(text: Column) -> Column:
    """Letters and digits in lower case; ß counts as ss."""
    return F.replace(F.regexp_replace(F.lower(text), KEEP, ""), F.lit("ß"), F.lit("ss"))


def content_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, KEEP, "")).cast("long")


def clock(ms: Column, mark: str = ".") -> Column:
    """HH:MM:SS and milliseconds; negative times count as 0."""
    t = F.greatest(ms, F.lit(0))
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(t / 3_600_000), F.floor(t / 60_000) % 60, F.floor(t / 1000) % 60, t % 1000)


def clock_ms(text: Column) -> Column:
    """Milliseconds of HH:MM:SS.mmm; null where it isn't one."""
    part = lambda k: F.try_to_number(F.nullif(F.regexp_extract(text, r"^([0-9]{2,}):([0-9]{2}):([0-9]{2})[.,]([0-9]{3})$", k), F.lit("")), F.lit("999999999")).cast("long")
    return part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + part(4)


def error_rate(ref: Column, hyp: Column) -> Column:
    """Character error rate; with an empty reference 0 or 1."""
    n = F.length(ref)
    return F.when(n == 0, F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(ref, hyp).cast("double") / n.cast("double"))


def redact_patterns(text: Column) -> Column:
    """Mainland phone, identity number, e-mail and chat account by pattern, in this order."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, PHONE, "[手机号已脱敏]"), IDENTITY, "[身份证号已脱敏]"), EMAIL, "[邮箱已脱敏]"), ACCOUNT, "[微信号已脱敏]")


def full_width_marks(text: Column) -> Column:
    """Commas, question and exclamation marks in full width, a final full stop too; repeated ones once."""
    t = F.regexp_replace(F.translate(text, ",?!", "，？！"), r"\.$", "。")
    return F.regexp_replace(t, r"([，。！？、；：])\1+", "$1")


def safe_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}._-]+", "_"), F.lit("_"))


def query_grams(text: Column, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """Search tokens: runs of Chinese characters as n-grams, other runs of two or more letters or digits in lower case."""
    han = F.regexp_extract_all(text, F.lit(r"[\x{4e00}-\x{9fff}]+"), F.lit(0))
    word = F.transform(F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 2), F.lower)

    def of(run: Column, n: int) -> Column:
        at = F.sequence(F.lit(1), F.length(run) - n + 1)
        return F.when(F.length(run) >= n, F.transform(at, lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    # a lambda of two parameters would get the index as its second
    grams = [F.flatten(F.transform(han, (lambda n: lambda run: of(run, n))(n))) for n in sizes]
    return F.array_except(F.array_distinct(F.concat(*grams, word)), F.array(*[F.lit(w) for w in STOP_GRAMS]))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC, with white space collapsed and stripped; null stays null."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks over characters; 0 where either is empty, null where either is null."""
    return pd.Series([None if x is None or y is None else (difflib.SequenceMatcher(None, x, y, False).ratio() if x and y else 0.0) for x, y in zip(a, b)], dtype="float64")


def _edits(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@F.pandas_udf(DoubleType())
def word_error_rate(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Word error rate over tokens; texts without spaces are compared by characters."""

    def rate(x, y):
        if x is None or y is None:
            return None
        a, b = (list(t) if " " not in t.strip() else t.split() for t in (x, y))
        return _edits(a, b) / len(a) if a else float(bool(b))

    return pd.Series([rate(x, y) for x, y in zip(ref, hyp)], dtype="float64")


@F.pandas_udf(StringType())
def canonical_hash(text: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text in canonical form (sorted keys, compact); of what isn't JSON, of the text itself."""

    def one(t):
        if t is None:
            return None
        try:
            t = json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            pass
        return hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()

    return text.map(one)
