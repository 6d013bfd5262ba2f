"""Masking, token repair, folding and speakable text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

DOT = "•"
# Characters without width.
ZERO_WIDTH = "[\\u200b\\u200c\\u200d\\u2060-\\u2064\\ufeff]"


def mask_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]", DOT)


def mask_alnum(c: Column) -> Column:
    return F.regexp_replace(c, "[A-Za-z0-9]", DOT)


def _count(c: Column, p: str) -> Column:
    return F.regexp_count(c, F.lit(p))


def mask_sample(c: Column) -> Column:
    """A sample that shows a kind but not a value."""
    v = F.trim(c)
    n = F.length(v)
    at = F.instr(v, "@")
    email = (at > 1) & v.contains(".") & (n > at + 1)
    digits = _count(v, "[0-9]")
    mixed = v.rlike("[A-Za-z]") & (digits > 0) & (_count(v, "[A-Za-z0-9]") >= 6) & ~v.rlike("\\s")
    return (
        F.when(n <= 2, F.lit(DOT * 2))
        .when(email, F.concat(F.substring(v, F.lit(1), F.least(at - 1, F.lit(2))), F.lit(DOT * 3 + "@"), F.substring(v, at + 1, n)))
        .when(mixed, mask_alnum(v))
        .when(digits >= 4, mask_digits(v))
        .otherwise(F.concat(F.substring(v, 1, 2), F.repeat(F.lit(DOT), F.least(F.lit(10), F.greatest(F.lit(6), n - 2)))))
    )


def repair_tokens(c: Column) -> Column:
    """Characters without width go, and digits glued to a vault token."""
    out = F.regexp_replace(c, ZERO_WIDTH, "")
    out = F.regexp_replace(out, "(?<![A-Za-z0-9])[0-9]+<([A-Z]+_[0-9]+)>", "<$1>")
    return F.regexp_replace(out, "<([A-Z]+_[0-9]+)>[0-9]+(?![A-Za-z0-9])", "<$1>")


def tokens_in(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(P.WIRE_TOKEN), F.lit(0))))


def has_token(c: Column) -> Column:
    return c.rlike(P.TOKEN)


def strip_tokens(c: Column) -> Column:
    return F.regexp_replace(c, P.TOKEN, "redacted")


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def speakable(c: Column, most: int = 600) -> Column:
    """Tokens are spoken as a word, links lose their targets, marks go, white space is squeezed."""
    out = F.regexp_replace(strip_tokens(c), "\\[([^\\]]*)\\]\\([^)]*\\)", "$1")
    return F.substring(squeezed(F.regexp_replace(out, "[*_`#>~]", "")), 1, most)


def normal_for_match(c: Column) -> Column:
    return F.lower(squeezed(F.regexp_replace(c, ZERO_WIDTH, "")))


def fold_for_reading(c: Column) -> Column:
    """Glyphs that readers of images confuse become one: pairs first, then single ones."""
    out = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    out = F.replace(F.replace(out, F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))
    return F.translate(out, "01i582", "ollsbz")


def edit_budget(folded: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(folded) / 6).cast("int"))


def shorten(c: Column, most: int = 220) -> Column:
    v = squeezed(c)
    return F.when(F.length(v) <= most, v).otherwise(F.concat(F.substring(v, 1, most), F.lit("…")))


def words_of(c: Column) -> Column:
    """Lower-case words; all but letters, marks and digits separates."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{M}\\p{N}]+", " "), " "), lambda x: x != "")
