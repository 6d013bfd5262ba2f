"""Checksums of cards and identity numbers, and keyed hashes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The dihedral group D5, the permutation and the inverses of the Verhoeff scheme.
VERHOEFF_D = ["0123456789", "1234067895", "2340178956", "3401289567", "4012395678", "5987604321", "6598710432", "7659821043", "8765932104", "9876543210"]
VERHOEFF_P = ["0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258"]
VERHOEFF_INV = "0432156789"
FNV_OFFSET, FNV_PRIME = 0x811C9DC5, 0x01000193


def let(value: Column, use) -> Column:
    """use(value) with value computed once: inside higher-order functions the engine does not share subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _at(table: str, i: Column) -> Column:
    return F.substring(F.lit(table), i + 1, F.lit(1)).cast("int")


def _luhn_sum(d: Column, doubled: int) -> Column:
    """Sum of the digits of d, those whose place from the right is `doubled` modulo 2 doubled."""
    return let(d, lambda x: _luhn_sum_of(x, doubled))


def _luhn_sum_of(d: Column, doubled: int) -> Column:
    n = F.length(d)

    def add(acc, i):
        x = F.substring(d, n - i, F.lit(1)).cast("int")
        y = F.when(i % 2 == doubled, F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)).otherwise(x)
        return acc + y

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)).otherwise(0)


def luhn_valid(c: Column) -> Column:
    """Luhn over 13 to 19 digits once spaces and hyphens are gone."""
    bare = F.regexp_replace(c, "[\\s-]", "")
    return F.coalesce(F.when(bare.rlike("^[0-9]{13,19}$"), _luhn_sum(bare, 1) % 10 == 0), F.lit(False))


def luhn_check_digit(c: Column) -> Column:
    return (10 - _luhn_sum(digits_of(c), 0) % 10) % 10


def _verhoeff(d: Column, shift: int) -> Column:
    return let(d, lambda x: _verhoeff_of(x, shift))


def _verhoeff_of(d: Column, shift: int) -> Column:
    n = F.length(d)

    def step(acc, i):
        x = F.substring(d, n - i, F.lit(1)).cast("int")
        p = F.element_at(F.array(*[F.lit(r) for r in VERHOEFF_P]), (i + shift) % 8 + 1)
        y = F.substring(p, x + 1, F.lit(1)).cast("int")
        row = F.element_at(F.array(*[F.lit(r) for r in VERHOEFF_D]), acc + 1)
        return F.substring(row, y + 1, F.lit(1)).cast("int")

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step)).otherwise(0)


def verhoeff_valid(c: Column) -> Column:
    d = digits_of(c)
    return F.coalesce(F.when(F.length(d) >= 2, _verhoeff(d, 0) == 0), F.lit(False))


def verhoeff_check_digit(c: Column) -> Column:
    return _at(VERHOEFF_INV, _verhoeff(digits_of(c), 1))


def is_aadhaar(c: Column) -> Column:
    d = digits_of(c)
    return F.coalesce(d.rlike("^[2-9][0-9]{11}$") & verhoeff_valid(d), F.lit(False))


def is_card(c: Column) -> Column:
    return luhn_valid(c)


def is_indian_phone(c: Column) -> Column:
    return F.coalesce(digits_of(c).rlike("^[6-9][0-9]{9}$"), F.lit(False))


def fnv1a(c: Column, seed: int = FNV_OFFSET) -> Column:
    """32-bit FNV-1a over code points (UTF-16 units agree outside the astral planes)."""
    mask = F.lit(0xFFFFFFFF).cast("long")

    def step(h, ch):
        return (h.bitwiseXOR(F.ascii(ch).cast("long")) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(mask)

    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.aggregate(chars, F.lit(seed).cast("long"), step)


# Stand-ins that belong to nobody; the first two end in their check digits.
STAND_INS = {
    "aadhaar": "9999 0123 4563", "card": "4000 0012 3456 7899", "pan": "ABCDE1234F", "email": "alex.surrogate@safe-example.internal",
    "name": "Alex Morgan", "phone": "+91 98765 43210", "secret": "••••••••••••", "other": "[CONFIDENTIAL SURROGATE]",
}


def in_fours(c: Column) -> Column:
    return F.regexp_replace(c, "(.{4})(?=.)", "$1 ")


def stand_in(kind: str) -> Column:
    return F.lit(STAND_INS[kind])


def _hash_digits(d: Column, first: Column, last: Column, places: int, step: int) -> Column:
    """Digits first to last of a keyed number: each is a decimal place of the hash, shifted by its position."""
    one = lambda h, i: ((F.floor(h / F.pow(F.lit(10.0), i % places)) + i * step) % 10).cast("string")
    return let(fnv1a(d), lambda h: F.array_join(F.transform(F.sequence(first, last), lambda i: one(h, i)), ""))


def card_surrogate(c: Column) -> Column:
    """Keeps the first four digits and the length, takes the rest from a hash of all, and closes with the Luhn digit."""

    def of(d):
        body = F.concat(F.substring(d, 1, 4), _hash_digits(d, F.lit(0), F.length(d) - 6, 9, 3))
        return F.when(F.length(d) >= 13, in_fours(let(body, lambda b: F.concat(b, luhn_check_digit(b).cast("string")))))

    return F.coalesce(let(digits_of(c), of), stand_in("card"))


def aadhaar_surrogate(c: Column) -> Column:
    """99, nine digits of a hash, and the Verhoeff digit, in fours."""

    def of(d):
        body = F.concat(F.lit("99"), _hash_digits(d, F.lit(2), F.lit(10), 8, 7))
        return F.when(F.length(d) == 12, in_fours(let(body, lambda b: F.concat(b, verhoeff_check_digit(b).cast("string")))))

    return F.coalesce(let(digits_of(c), of), stand_in("aadhaar"))


def surrogate_for(kind: Column, value: Column) -> Column:
    """The stand-in of a kind, by the first name that the kind holds; cards and identity numbers follow a value if there is one."""
    k = F.lower(kind)
    holds = lambda *names: k.rlike("|".join(names))
    there = F.coalesce(F.length(value) > 0, F.lit(False))
    return (
        F.when(holds("aadhaar", "id_number", "national_id"), F.when(there, aadhaar_surrogate(value)).otherwise(stand_in("aadhaar")))
        .when(holds("card", "credit", "cvv"), F.when(there, card_surrogate(value)).otherwise(stand_in("card")))
        .when(holds("pan"), stand_in("pan")).when(holds("email"), stand_in("email")).when(holds("phone", "mobile"), stand_in("phone"))
        .when(holds("name", "person"), stand_in("name")).when(holds("pass", "token", "cred"), stand_in("secret")).otherwise(stand_in("other"))
    )
