"""Date rules: document date strings, typed dates, relative time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.numbers import half_up
from quire.functions.text import trimmed

# A document date is an optional "D" and ":", a year of four digits, then
# month, day, hour, minute and second of two digits each, then perhaps an offset: a sign,
# two digits of hours, two of minutes, each perhaps with an apostrophe behind the hours.
WIDTHS = {"year": (1, 4), "month": (5, 2), "day": (7, 2), "hour": (9, 2), "minute": (11, 2), "second": (13, 2)}
FIRST = {"year": 0, "month": 1, "day": 1, "hour": 0, "minute": 0, "second": 0}


def _digits(text: Column) -> Column:
    """How many digits a text begins with."""
    return F.length(text) - F.length(F.ltrim(text, F.lit("0123456789")))


def _cut(value: Column, signs: Column | None = None) -> dict[str, Column]:
    """A document date cut by position.

    ``dated`` tells whether there is a year, ``sign``, ``hours`` and ``minutes`` are the
    offset.  Digits are taken in whole parts, so an odd one at the end belongs to what
    follows.  ``signs`` narrows which signs begin an offset.
    """
    text = trimmed(value)
    text = F.when(F.startswith(text, F.lit("D")), F.substring(text, 2, 2147483647)).otherwise(text)
    text = F.when(F.startswith(text, F.lit(":")), F.substring(text, 2, 2147483647)).otherwise(text)
    run = _digits(text)
    used = F.when(run < 4, F.lit(0)).otherwise(F.least(F.lit(14), run - run % 2))
    cut = {
        name: F.when(used >= at + size - 1, F.substring(text, at, size).try_cast("int")).otherwise(F.lit(FIRST[name]))
        for name, (at, size) in WIDTHS.items()
    }
    rest = F.substr(text, used + 1, F.lit(2147483647))
    sign, behind = F.substring(rest, 1, 1), F.substring(rest, 2, 2147483647)
    offset = _digits(behind) >= 2
    offset = offset & (sign.between("+", "Z") if signs is None else sign.isin(signs))
    late = F.substring(behind, 3, 2147483647)
    late = F.when(F.startswith(late, F.lit("'")), F.substring(late, 2, 2147483647)).otherwise(late)
    return {
        **cut,
        "dated": run >= 4,
        "sign": F.when(offset, sign).otherwise(F.lit("")),
        "hours": F.when(offset, F.substring(behind, 1, 2).try_cast("int")).otherwise(F.lit(0)),
        "minutes": F.when(offset & (_digits(late) >= 2), F.substring(late, 1, 2).try_cast("int")).otherwise(F.lit(0)),
    }


def _offset(cut: dict[str, Column]) -> Column:
    """Minutes east of Greenwich; no sign and Z are Greenwich."""
    size = cut["hours"] * 60 + cut["minutes"]
    return F.when(cut["sign"].isin("", "Z"), F.lit(0)).when(cut["sign"] == "-", -size).otherwise(size)


def _rolled(year, month, day, hour, minute, second, offset_minutes) -> Column:
    """Seconds since the epoch with every part allowed to roll over."""
    first = F.make_date(year, F.lit(1), F.lit(1))
    days = F.date_add(F.add_months(first, month - 1), day - 1)
    return (
        F.unix_date(days).cast("bigint") * 86400
        + hour * 3600
        + minute * 60
        + second
        - offset_minutes * 60
    )


def lenient_document_date(value: Column) -> Column:
    """Metadata reader: invalid parts roll over; the year must be 1..9999; any sign from + to Z."""
    cut = _cut(value)
    year = cut["year"]
    seconds = _rolled(
        F.when(year < 100, year + 1900).otherwise(year), *[cut[n] for n in ("month", "day", "hour", "minute", "second")], _offset(cut)
    )
    return F.when(cut["dated"] & year.between(1, 9999), F.timestamp_seconds(seconds))


def strict_document_date(value: Column) -> Column:
    """Annotation reader: parts outside their range make the whole date unknown."""
    cut = _cut(value, ["Z", "+", "-"])
    midnight = (cut["hour"] == 24) & (cut["minute"] == 0) & (cut["second"] == 0)
    valid = cut["dated"] & (cut["hour"].between(0, 23) | midnight)
    for name, low, high in (("month", 1, 12), ("day", 1, 31), ("minute", 0, 59), ("second", 0, 59), ("hours", 0, 23), ("minutes", 0, 59)):
        valid = valid & cut[name].between(low, high)
    seconds = _rolled(*[cut[n] for n in WIDTHS], _offset(cut))
    return F.when(valid, F.timestamp_seconds(seconds))


def written_document_date(value: Column) -> Column:
    """A timestamp as a document date, in UTC."""
    return F.concat(F.lit("D:"), F.date_format(value, "yyyyMMddHHmmss"), F.lit("Z00'00"))


def typed_date(value: Column) -> Column:
    """``Y-M-D``, ``D/M/Y`` or ``D.M.Y``; two-digit years are 2000 on; impossible days are null."""
    text = trimmed(value)
    marks = F.translate(text, "0123456789", "")
    parts = F.split(text, "[-./]")

    def number(at: int, least: int, most: int) -> Column:
        part = F.get(parts, at)
        return F.when(F.length(part).between(least, most), part.try_cast("int"))

    def day(year: Column, month: Column, of_month: Column) -> Column:
        padded = [F.lpad(x.cast("string"), n, "0") for x, n in ((year, 4), (month, 2), (of_month, 2))]
        return F.concat(padded[0], F.lit("-"), padded[1], F.lit("-"), padded[2]).try_cast("date")

    typed_year = number(2, 2, 4)
    full_year = F.when(typed_year < 100, typed_year + 2000).otherwise(typed_year)
    return F.when(marks == "--", day(number(0, 4, 4), number(1, 1, 2), number(2, 1, 2))).when(
        marks.isin("//", "..", "/.", "./"), day(full_year, number(1, 1, 2), number(0, 1, 2))
    )


# Seconds of each unit, largest first.
UNITS = [("year", 31536000), ("month", 2592000), ("week", 604800), ("day", 86400), ("hour", 3600), ("minute", 60)]


def relative_time(value: Column, now: Column) -> Column:
    """``3 days ago``, ``in 2 hours``: the largest unit that fits; under a minute is just now."""
    delta = (F.unix_millis(value.cast("timestamp")) - F.unix_millis(now.cast("timestamp"))) / 1000.0
    worded = None
    for unit, seconds in UNITS:
        count = half_up(delta / seconds).cast("bigint")
        size = F.abs(count)
        noun = F.concat(size.cast("string"), F.lit(f" {unit}"), F.when(size == 1, F.lit("")).otherwise(F.lit("s")))
        said = F.when(count > 0, F.concat(F.lit("in "), noun)).otherwise(F.concat(noun, F.lit(" ago")))
        fits = F.abs(delta) >= seconds
        worded = F.when(fits, said) if worded is None else worded.when(fits, said)
    return worded.otherwise(F.lit("just now"))
