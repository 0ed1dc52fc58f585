"""Number rules: rounding, parsing typed numbers, numerals, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import trimmed


def half_up(value: Column) -> Column:
    """Round halves towards positive infinity (differs from ``round`` below zero)."""
    return F.floor(value + 0.5)


def half_up_to(value: Column, places: int) -> Column:
    scale = float(10**places)
    return half_up(value * scale) / scale


NUMERAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parsed_number(value: Column) -> Column:
    """A plain decimal or exponent number, or a ``0x`` integer; otherwise null."""
    hexadecimal = F.conv(F.substring(value, 3, 16), 16, 10).cast("double")
    return (
        F.when(value.rlike(NUMERAL), value.try_cast("double"))
        .when(value.rlike(r"^0[xX][0-9a-fA-F]{1,15}$"), hexadecimal)
        .otherwise(F.lit(None).cast("double"))
    )


def typed_number(value: Column) -> Column:
    """What people type: grouping marks, spaces and a leading currency mark go."""
    clean = F.regexp_replace(trimmed(value), r"[\s,\u00a0]", "")
    clean = F.regexp_replace(clean, r"^[^\d+-.]+", "")
    number = parsed_number(clean)
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def cell_number(value: Column) -> Column:
    """A table cell as a number when it reads as one, else null."""
    clean = F.regexp_replace(value, r"[\s,\u00a0]", "")
    number = parsed_number(clean)
    return F.when(clean.rlike(r"\d") & (F.abs(number) < float("inf")), number)


# The numerals and what each is worth.
NUMERALS = [
    (1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"),
    (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"),
]


def roman(value: Column) -> Column:
    """Every numeral repeated as often as it fits what the larger ones left."""
    n = F.greatest(value.cast("int"), F.lit(1))
    parts, left = [], n
    for amount, mark in NUMERALS:
        parts.append(F.repeat(F.lit(mark), F.floor(left / amount).cast("int")))
        left = left % amount
    return F.concat(*parts)


def letters(value: Column) -> Column:
    """A..Z, AA, BB ... (the letter repeats)."""
    n = F.greatest(value.cast("int"), F.lit(1))
    return F.repeat(
        F.char(F.lit(65) + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int")
    )


def page_label(style: Column, prefix: Column, value: Column) -> Column:
    n = F.greatest(value.cast("int"), F.lit(1))
    body = (
        F.when(style == "decimal", n.cast("string"))
        .when(style == "romanLower", F.lower(roman(n)))
        .when(style == "romanUpper", roman(n))
        .when(style == "letterLower", F.lower(letters(n)))
        .when(style == "letterUpper", letters(n))
        .otherwise(F.lit(""))
    )
    return F.concat(prefix, body)


def plain_number(value: Column) -> Column:
    """A double without a trailing ``.0``; up to six decimals."""
    text = F.format_string("%.6f", value)
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def byte_size(value: Column) -> Column:
    """``1.4 MB``: steps of 1024 up to TB, whole numbers from 100 on."""
    v = value.cast("double")
    unit = (
        F.when(v < 1024.0**2, F.lit(1))
        .when(v < 1024.0**3, F.lit(2))
        .when(v < 1024.0**4, F.lit(3))
        .otherwise(F.lit(4))
    )
    scaled = v / F.pow(F.lit(1024.0), unit)
    shown = F.when(scaled >= 100, half_up(scaled).cast("double")).otherwise(
        half_up(scaled * 10) / 10
    )
    name = F.element_at(F.array(*[F.lit(u) for u in ("KB", "MB", "GB", "TB")]), unit)
    return (
        F.when(v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf")), F.lit("unknown"))
        .when(
            v < 1024,
            F.concat(plain_number(v), F.when(v == 1, F.lit(" byte")).otherwise(F.lit(" bytes"))),
        )
        .otherwise(F.concat(plain_number(shown), F.lit(" "), name))
    )


def quarter_turns(degrees: Column) -> Column:
    return F.pmod(half_up(degrees / 90).cast("int"), F.lit(4))


def rotation(degrees: Column) -> Column:
    return F.pmod((half_up(degrees / 90) * 90).cast("int"), F.lit(360))
