"""Pieces of the SQL that checks the queries, for an engine without these functions."""

from __future__ import annotations

from .checksums import VERHOEFF_D, VERHOEFF_P


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def luhn_sum(d: str, doubled: int) -> str:
    digit = f"(substr({d}, length({d}) - i, 1))::INT"
    return f"coalesce(list_sum(list_transform(range(length({d})), lambda i: CASE WHEN i % 2 = {doubled} THEN CASE WHEN {digit} * 2 > 9 THEN {digit} * 2 - 9 ELSE {digit} * 2 END ELSE {digit} END)), 0)"


def luhn(x: str) -> str:
    d = f"regexp_replace({x}, '[\\s-]', '', 'g')"
    return f"(CASE WHEN regexp_full_match({d}, '[0-9]{{13,19}}') THEN {luhn_sum(d, 1)} % 10 = 0 ELSE false END)"


def verhoeff(d: str, shift: int) -> str:
    P, D = (f"['{"','".join(t)}']" for t in (VERHOEFF_P, VERHOEFF_D))
    y = f"(substr(({P})[(i + {shift}) % 8 + 1], (substr({d}, length({d}) - i, 1))::INT + 1, 1))::INT"
    return f"list_reduce(list_prepend(0, range(length({d})))::INT[], lambda acc, i: (substr(({D})[acc + 1], {y} + 1, 1))::INT)"


def aadhaar(x: str) -> str:
    d = digits(x)
    return f"(CASE WHEN regexp_full_match({d}, '[2-9][0-9]{{11}}') THEN {verhoeff(d, 0)} = 0 ELSE false END)"


def secret(x: str) -> str:
    return f"(length(trim({x})) >= 6 AND NOT regexp_matches(trim({x}), '\\s') AND regexp_matches(trim({x}), '[^A-Za-z]'))"


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def spans(pattern: str, group: int, source: str) -> str:
    """Rows (id, n, whole, value, start) of all matches of a pattern in source (id, text)."""
    p = text(pattern)
    return f"""SELECT id, n, whole, value, before + strpos(whole, value) - 1 AS start FROM (
  SELECT id, n, wholes[n] AS whole, vals[n] AS value, (list_sum(list_transform(parts[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(wholes[1:n-1], lambda x: length(x))), 0))::BIGINT AS before
  FROM (SELECT id, wholes, vals, parts, unnest(range(1, len(wholes) + 1)) AS n FROM (
    SELECT id, regexp_extract_all(text, {p}) AS wholes, regexp_extract_all(text, {p}, {group}) AS vals, string_split_regex(text, {p}) AS parts FROM {source})))"""


def fnv(x: str, seed: int = 0x811C9DC5) -> str:
    return f"list_reduce(list_prepend({seed}::BIGINT, list_transform(range(length({x})), lambda i: ord(substr({x}, i + 1, 1))::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


def in_fours(x: str) -> str:
    return f"rtrim(regexp_replace({x}, '(.{{4}})', '\\1 ', 'g'))"


def hash_digits(h: str, first: str, stop: str, places: int, step: int) -> str:
    return f"array_to_string(list_transform(range({first}, {stop}), lambda i: (({h} // pow(10, i % {places})::BIGINT + i * {step}) % 10)::VARCHAR), '')"


def encoded(x: str) -> str:
    """Percent encoding that leaves - _ . ! ~ * ' ( )."""
    out = f"url_encode({x})"
    for code, char in (("%21", "!"), ("%2A", "*"), ("%27", "''"), ("%28", "("), ("%29", ")")):
        out = f"replace({out}, '{code}', '{char}')"
    return out


def case(pairs, otherwise: str = "NULL") -> str:
    """CASE of (condition, value) pairs."""
    return "(CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END)"
