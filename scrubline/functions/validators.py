"""Normalisers and checksum validators as Spark Column functions.

Each one is a pure expression over the matched string, evaluated inside the
JVM, so validation runs as a ``filter`` over the extracted match array.
"""

from __future__ import annotations

import sys
import unicodedata
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_spaces_dashes(s: Column) -> Column:
    """Remove every ' ' and '-'."""
    return F.translate(s, " -", "")


#: Every decimal digit of Unicode beyond ASCII, and the ASCII digit of its value.
_DIGITS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_VALUES = [str(unicodedata.decimal(c)) for c in _DIGITS]


def fold_digits(s: Column) -> Column:
    """Decimal digits of any script as ASCII digits, one for one."""
    return F.translate(s, "".join(_DIGITS), "".join(_VALUES))


def luhn(s: Column) -> Column:
    """V1: digits only, 13..19 of them, mod-10 checksum."""
    digits = F.regexp_replace(s, r"[^0-9]", "")
    n = F.length(digits)
    return F.coalesce((n >= 13) & (n <= 19) & F.call_function("luhn_check", digits), F.lit(False))


def iban(s: Column) -> Column:
    """V2: spaces removed, upper case, 15..34 long, first four moved to the
    end, letters A..Z read as 10..35, whole number mod 97 == 1.  Any other
    character fails.  The remainder is carried character by character:
    a digit shifts by 10, a letter (two decimal digits) by 100."""
    u = F.upper(F.replace(s, F.lit(" "), F.lit("")))
    n = F.length(u)
    rearr = F.concat(F.substr(u, F.lit(5), n), F.substr(u, F.lit(1), F.lit(4)))
    chars = F.split(rearr, "", -1)

    def step(acc, ch):
        code = F.ascii(ch)
        is_digit = (code >= 48) & (code <= 57)
        is_alpha = (code >= 65) & (code <= 90)
        return (F.when(acc < 0, acc)
                .when(is_digit, (acc * 10 + (code - 48)) % 97)
                .when(is_alpha, (acc * 100 + (code - 55)) % 97)
                .otherwise(F.lit(-1)))

    rem = F.aggregate(chars, F.lit(0), step)
    return F.coalesce((n >= 15) & (n <= 34) & (rem == 1), F.lit(False))


# V3: registries by the names used in rule packs.  Unknown names are skipped.
NORMALIZERS: dict[str, Callable[[Column], Column]] = {
    "strip_spaces_dashes": strip_spaces_dashes,
    "fold_digits": fold_digits,
}

VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "luhn": luhn,
    "iban": iban,
}


def normalise(s: Column, names: list[str]) -> Column:
    for n in names:
        fn = NORMALIZERS.get(n)
        if fn is not None:
            s = fn(s)
    return s


def validate(s: Column, names: list[str]) -> Column | None:
    """Conjunction of the named validators, or None when nothing validates."""
    cond = None
    for n in names:
        fn = VALIDATORS.get(n)
        if fn is None:
            continue
        c = fn(s)
        cond = c if cond is None else (cond & c)
    return cond
