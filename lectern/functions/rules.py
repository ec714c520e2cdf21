"""Rule tables over text: ordered rewrites with notes, labels, payload fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import full_width_marks

DISFLUENCY, TYPO, PUNCTUATION = "disfluency_normalized", "obvious_typo_fixed", "punctuation_normalized"
# Rewrites in the order in which they are applied (pattern, replacement); TYPOS are those noted as typing errors.
REWRITES = [
    ("(?:然后){2,}", "然后"), ("(?:你跟){2,}", "你跟"), ("(?:人家){2,}", "人家"), ("(?:为什么){2,}", "为什么"), ("怎么怎么样", "怎么样"), ("中中层", "中层"), ("回回家", "回家"), ("玩玩完", "玩完"), ("忘忘记记", "忘记"),
    ("什么么", "什么"), ("会会加", "会加"), ("直直回", "直回"), ("维维持", "维持"), ("一一起", "一起"), ("情情感", "情感"), ("就是是", "就是"), ("关关系", "关系"), ("原原因", "原因"), ("总总结", "总结"), ("(?:因为){2,}", "因为"),
    ("(?:大家){2,}", "大家"), ("洗洗完", "洗完"), ("熊熊猫", "熊猫"), ("家家里", "家里"), ("你你们", "你们"), ("今今年", "今年"), ("今今天", "今天"), ("昨昨+晚", "昨晚"), ("第第+一次", "第一次"), ("跟跟+", "跟"), ("约约+", "约"),
    ("在在+", "在"), ("就{2,}", "就"), ("很{2,}", "很"),
]
TYPOS = ["忘忘记记", "什么么"]
AMBIGUOUS = "什么什么|好好好+|啊啊+|对对对+"
LABELS = {"导师": "teacher_a", "学员": "student"}
BOARD_LABEL = "课板"


def rewritten(text: Column) -> tuple[Column, Column]:
    """(text after all rewrites and the marks' rules, notes in the order of their first rule).

    A rule of its own kind is noted where it changes the text; the text before
    each rule is looked at, so the order matters as it does for the text itself.
    A text in which no pattern stands is left by all of them, which one look tells.
    """
    any_ = text.rlike("|".join(p for p, _ in REWRITES))
    kinds: dict[str, Column] = {DISFLUENCY: F.lit(False), TYPO: F.lit(False)}
    now = text
    for pattern, to in REWRITES:
        kind = TYPO if pattern in TYPOS else DISFLUENCY
        kinds[kind] = kinds[kind] | now.rlike(pattern)
        now = F.regexp_replace(now, pattern, to)
    now = F.when(any_, now).otherwise(text)
    kinds = {k: any_ & c for k, c in kinds.items()}
    marked = full_width_marks(now)
    order = [F.when(kinds[DISFLUENCY], DISFLUENCY), F.when(kinds[TYPO], TYPO), F.when(marked != now, PUNCTUATION)]
    return marked, F.array_compact(F.array(*order))


def label_speaker(label: Column) -> Column:
    """The speaker that a transcript's label names; boards and other labels are ``unknown``."""
    n = F.regexp_extract(label, r"(?i)^Speaker\s+([0-9]+)$", 1)
    out = F.when(label.startswith(BOARD_LABEL), "unknown").when(n != "", F.concat(F.lit("speaker_"), n))
    for name, speaker in LABELS.items():
        out = out.when(label == name, speaker)
    return out.otherwise("unknown")


def label_type(label: Column) -> Column:
    return F.when(label.startswith(BOARD_LABEL), "board_ocr").otherwise("speech")


def payload_confidence(payload: Column) -> Column:
    """The first of three fields of a JSON payload that is a confidence, as 0 to 1; of 100 where it is above 1."""
    def one(name: str) -> Column:
        v = F.get_json_object(payload, f"$.{name}").try_cast("double")
        return F.when(v.between(0, 1), v).when(v.between(0, 100), v / 100)

    return F.coalesce(*[one(k) for k in ("confidence", "score", "confidence_score")])


def fenced_object(text: Column) -> Column:
    """The JSON object in a text with a fence or other words about it: from the first opening brace to the last closing one."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def without_bearer(text: Column) -> Column:
    """The first secret after ``bearer`` is left out."""
    m = F.regexp_extract(text, r"(?i)^(.*?bearer )[^\s,\"'}]+", 1)
    return F.when(text.rlike(r"(?i)bearer [^\s,\"'}]+"), F.concat(m, F.lit("[REDACTED]"), F.regexp_replace(text, r"(?is)^.*?bearer [^\s,\"'}]+", ""))).otherwise(text)


def joined_words(words: Column) -> Column:
    """Words as one text: with spaces where they are tokens of several characters, none of them Chinese."""
    tokens = F.exists(words, lambda w: w.contains(" ")) | F.forall(words, lambda w: F.length(w) > 1)
    chinese = F.forall(words, lambda w: w.rlike("[一-鿿]"))
    return F.when(tokens & ~chinese, F.array_join(words, " ")).otherwise(F.array_join(words, ""))


def metric_text(text: Column, keep_spaces: bool = False) -> Column:
    """Lower case without marks and, unless kept, white space: what error rates compare."""
    t = F.lower(text)
    return F.trim(F.regexp_replace(t, r"\s+", " ")) if keep_spaces else F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")


def file_name(text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(text, "[^0-9A-Za-z._-]+", "_"), F.lit("_")), F.lit("")), F.lit("entry"))
