"""Text made comparable: width, case, white space, punctuation."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _width_pairs() -> tuple[str, str]:
    """Characters of the full and half width blocks that NFKC maps to one other character."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in [0x3000, *range(0xFF01, 0xFFEF)]]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


WIDE, NARROW = _width_pairs()


def narrow(text: Column) -> Column:
    """Full and half width forms as their usual ones, in the JVM."""
    return F.translate(text, WIDE, NARROW)


def bare(text: Column) -> Column:
    """Letters and digits only, in lower case and usual width."""
    return F.regexp_replace(F.lower(narrow(text)), r"[^\p{L}\p{N}]+", "")


def blank(text: Column) -> Column:
    """Null, empty or nothing but white space."""
    return F.coalesce(~text.rlike(r"[^\s\p{Z}\x{FEFF}]"), F.lit(True))
