"""Spans of personal data in text: extraction with offsets, overlap resolution, splicing.

Offsets are half-open and count code points. Extraction stays in built-in
expressions: a pattern's matches and the text between them give all offsets by
running sums, so there is no row per candidate position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checksums as C
from ..functions import patterns as P

SPAN = "struct<start: int, value: string>"


def none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def matches(text: Column, source: str, group: int = 0) -> Column:
    """array<struct<start, value>> of all matches (of a group of them), in a time linear in the text.

    Texts that fail the pattern's gate are passed over. Matches and the gaps between
    them are zipped once and folded with a running place.
    """
    p = P.java(source)
    whole = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    own = F.regexp_extract_all(text, F.lit(p), F.lit(group)) if group else whole
    rows = F.arrays_zip(whole.alias("w"), own.alias("v"), F.split(text, p, -1).alias("gap"))
    zero = F.struct(F.lit(0).alias("pos"), none(SPAN).alias("out"))

    def step(acc, s):
        at = acc["pos"] + F.length(s["gap"])
        start = at + F.position(s["v"], s["w"]) - 1 if group else at
        span = F.struct(start.cast("int").alias("start"), s["v"].alias("value"))
        # the last gap has no match behind it
        return F.struct((at + F.coalesce(F.length(s["w"]), F.lit(0))).cast("int").alias("pos"), F.when(s["w"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], span)).alias("out"))

    return F.when(text.rlike(P.gate(source)), F.aggregate(rows, zero, step, lambda acc: acc["out"])).otherwise(none(SPAN))


def looks_like_secret(v: Column) -> Column:
    """Six characters or more, no white space, and a digit or a symbol."""
    t = F.trim(v)
    return (F.length(t) >= 6) & ~t.rlike(r"\s") & t.rlike("[^A-Za-z]")


def _tagged(spans: Column, kind: str, label: str, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(order).alias("emit_ord"), F.lit(kind).alias("kind"), F.lit(label).alias("label"), s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end"), s["value"].alias("value")))


def cued_secrets(text: Column, order: int = 0) -> Column:
    """Values after one-time-code, labelled and bare secret cues."""
    out = []
    for i, (source, label) in enumerate(P.CUED):
        found = F.filter(matches(text, source, 1), lambda s: s["value"] != "")
        if label != "OTP code":
            found = F.filter(found, lambda s: looks_like_secret(s["value"]))
        out.append(_tagged(found, "credential", label, order + i))
    return F.concat(*out)


def passing(spans: Column, check) -> Column:
    """Spans whose value passes check."""
    return F.filter(spans, lambda s: check(s["value"]))


def candidates(text: Column) -> Column:
    """All spans of all shapes, in the order in which shapes are tried; null for texts under six characters."""
    out = [
        _tagged(matches(text, "(?i)" + P.EMAIL), "email", "Email address", 0),
        _tagged(matches(text, P.PHONE), "phone", "Phone number", 1),
        _tagged(matches(text, P.HONORIFIC_NAME), "name_text", "Person name", 2),
    ]
    valid = {"aadhaar": C.is_aadhaar, "card": C.is_card}
    for i, (source, label, check) in enumerate(P.ID_SHAPES):
        found = matches(text, source)
        if check:
            found = passing(found, valid[check])
        out.append(_tagged(found, "id_text", label, 10 + i))
    for i, (source, label) in enumerate(P.API_KEYS):
        out.append(_tagged(matches(text, source), "api_key", label, 20 + i))
    out.append(cued_secrets(text, 40))
    out.append(_tagged(matches(text, P.CUE_NAME, 1), "name_text", "Person name", 50))
    return F.when(F.length(text) >= 6, F.concat(*out))


def match_pii(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, emit_ord, kind, label, start, end, value of the spans that stay; a row's spans are resolved within it."""
    return texts.select(key, F.inline(resolved(F.col(text))))


def resolved(text: Column, more: Column | None = None) -> Column:
    """The spans (and more of them) not inside one that sorts before them (start, longest first, order), in that order; partial overlaps stay."""
    every = candidates(text) if more is None else F.concat(candidates(text), more)
    found = F.array_sort(every, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(a["emit_ord"] - b["emit_ord"]))
    zero = F.struct(F.lit(-1).alias("reach"), none("struct<emit_ord: int, kind: string, label: string, start: int, end: int, value: string>").alias("out"))
    return F.aggregate(
        found, zero,
        lambda acc, s: F.when(s["end"] > acc["reach"], F.struct(s["end"].alias("reach"), F.array_append(acc["out"], s).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )


def in_prompts(text: Column) -> Column:
    """What a user's own text has besides: bare digits that pass a checksum, and digits that a cue names whatever their checksum."""
    count = lambda v: F.length(C.digits_of(v))
    return F.concat(
        _tagged(passing(matches(text, r"\b\d{13,19}\b"), C.is_card), "credential", "Card number", 60),
        _tagged(passing(matches(text, r"\b\d{12}\b"), C.is_aadhaar), "id_text", "Aadhaar number", 61),
        _tagged(passing(matches(text, P.CUED_AADHAAR, 1), lambda v: count(v) == 12), "id_text", "Aadhaar number", 62),
        _tagged(passing(matches(text, P.CUED_CARD, 1), lambda v: count(v).between(13, 19)), "credential", "Card number", 63),
    )


def match_prompts(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """match_pii, and in_prompts."""
    return texts.select(key, F.inline(resolved(F.col(text), in_prompts(F.col(text)))))


def spliced(text: Column, spans: Column, write) -> Column:
    """text with every span replaced by write(span), left to right; an overlap goes on at the later end."""
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    done = F.aggregate(
        spans, zero,
        lambda acc, s: F.struct(s["end"].alias("pos"), F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.greatest(s["start"] - acc["pos"], F.lit(0))), write(s)).alias("out")),
    )
    return F.concat(done["out"], F.substring(text, done["pos"] + 1, F.length(text)))
