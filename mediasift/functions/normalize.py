"""Match keys of contact values, digests and signatures, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits that phone keys fold, and characters that may separate them.
DEVANAGARI = "०१२३४५६७८९"
PHONE_SEPARATORS = r" \t\u00a0\-()."
NAME_BLANKS = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def fold_phone_digits(c: Column) -> Column:
    """STR-03: Devanagari digits as ASCII digits; others stay."""
    return F.translate(c, DEVANAGARI, "0123456789")


def phone_keys(c: Column) -> Column:
    """STR-01: match keys of a phone value, an empty array where it is none, null for null.

    A plain phone has one ``+`` at most, before any digit, separators, and four digits or more.
    ``s:`` has all digits; ``n:`` the last ten of an international number with more, or the ten of a national one.
    """
    folded = fold_phone_digits(c)
    digits = F.regexp_replace(folded, r"[^0-9]", "")
    n = F.length(digits)
    plain = folded.rlike(rf"^[{PHONE_SEPARATORS}]*\+?[{PHONE_SEPARATORS}0-9]*$") & (n >= 4)
    plus = F.contains(folded, F.lit("+"))
    national = F.when(plus & (n > 10), F.concat(F.lit("n:"), F.right(digits, F.lit(10)))).when(~plus & (n == 10), F.concat(F.lit("n:"), digits))
    return F.when(plain, F.array_compact(F.array(F.concat(F.lit("s:"), digits), national))).when(c.isNotNull(), F.array().cast("array<string>"))


def phone_key(c: Column) -> Column:
    """STR-02: the strict key, null where the value is no plain phone."""
    return F.get(phone_keys(c), F.lit(0))


def email_key(c: Column) -> Column:
    """STR-04: trimmed lower case address with exactly one ``@`` and both sides, else null."""
    low = F.lower(F.regexp_replace(c, f"^{NAME_BLANKS}+|{NAME_BLANKS}+$", ""))
    return F.when(low.rlike(r"^[^@]+@[^@]+$"), low)


def name_key(c: Column) -> Column:
    """STR-05: words joined by single blanks in lower case; null if there is none. Accents stay."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(c, f"{NAME_BLANKS}+", " "))), F.lit(""))


_LOW = 0xFFFFFFFF
#: Fixed value: the multiplier of the digest. It is 2^44 + 435, not the 2^40 + 435 of
#: published FNV-1a, so digests agree with those of existing group identifiers, not with FNV test vectors.
FNV_MULTIPLIER = 0x1000000001B3


def fnv1a(c: Column) -> Column:
    """HSH-01: 64-bit FNV-1a (with ``FNV_MULTIPLIER``) over UTF-8, as a signed number with the same bits.

    The 64-bit product is taken in two halves, so nothing leaves the range of a bigint.
    """
    text = F.encode(c, "UTF-8")
    octets = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.conv(F.hex(F.substring(text, i, F.lit(1))), 16, 10).cast("bigint"))

    def step(h: Column, byte: Column) -> Column:
        x = h.bitwiseXOR(byte)
        low, high = x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 32)
        product = low * (FNV_MULTIPLIER & _LOW)
        upper = (high * (FNV_MULTIPLIER & _LOW) + low * (FNV_MULTIPLIER >> 32) + F.shiftrightunsigned(product, 32)).bitwiseAND(F.lit(_LOW))
        return F.shiftleft(upper, 32).bitwiseOR(product.bitwiseAND(F.lit(_LOW)))

    seed = F.lit(0xCBF29CE484222325 - (1 << 64)).cast("bigint")
    return F.when(F.length(text) == 0, seed).otherwise(F.aggregate(octets, seed, step))


def fnv_hex(c: Column) -> Column:
    """The FNV-1a digest in lower case hexadecimal without leading zeros."""
    return F.lower(F.hex(fnv1a(c)))


def group_id(members: Column) -> Column:
    """HSH-02: identifier of a contact group from its sorted member identifiers."""
    return F.concat(F.lit("g-"), fnv_hex(F.array_join(members, "\x01")))


def set_signature(ids: Column) -> Column:
    """HSH-03: count and sorted identifiers of a set given as an array."""
    return F.concat_ws("|", F.size(ids).cast("string"), F.array_join(F.array_sort(ids), ","))
