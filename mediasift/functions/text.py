"""Text normalization shared by operators, as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every decimal digit outside ASCII with the ASCII digit of its value, by rule.
OTHER_DIGITS = "".join(chr(c) for c in range(128, 0x10000) if not 0xD800 <= c < 0xE000 and unicodedata.decimal(chr(c), None) is not None)
ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in OTHER_DIGITS)


def fold_digits(c: Column) -> Column:
    """Digits of other scripts (Devanagari, Arabic, full width ...) as ASCII digits."""
    return F.translate(c, OTHER_DIGITS, ASCII_DIGITS)


def alnum(c: Column) -> Column:
    """Lower case letters and digits only, digits folded; null stays null."""
    return F.regexp_replace(F.lower(fold_digits(c)), r"[^\p{L}\p{Nd}]+", "")


BLANKS = r"[\s\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000\ufeff]"


def blank_trim(c: Column) -> Column:
    """Without blanks of any kind (tabs, line breaks, no-break spaces) at both ends."""
    return F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", "")


_MARKED = [chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1 and unicodedata.normalize("NFD", chr(c))[0].isascii()]
#: Latin letters with marks and the letters they are built on, by rule; then strokes and ligatures that have no decomposition.
MARKED = "".join(_MARKED) + "øØłŁđĐ"
UNMARKED = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED) + "oOlLdD"


def fold_marks(c: Column) -> Column:
    """Latin letters without accents; loose combining marks dropped."""
    return F.regexp_replace(F.translate(c, MARKED, UNMARKED), r"[\u0300-\u036f]", "")
