"""Functions that go by name in the dialect that users come from, as Column expressions: all of them stay in the JVM.

Timestamps are taken without a zone, so nothing here depends on the session's.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "1970-01-01 00:00:00"
_MICROS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 7 * 86_400_000_000}
_MONTHS = {"month": 1, "quarter": 3, "year": 12, "decade": 120, "century": 1200}
#: Directives of strftime, and the letters that stand for them here.
_DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a"}


def _plain(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")


def _micros(ts: Column, since: str = _EPOCH) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit(since).cast("timestamp_ntz"), _plain(ts))


def _floor(x: Column, by: int) -> Column:
    """Whole division that rounds down, without a detour over doubles."""
    return (x - F.pmod(x, F.lit(by).cast("long"))) / F.lit(by)


def epoch(ts: Column) -> Column:
    """Seconds since 1970, with their fraction."""
    return _micros(ts) / 1e6


def date_diff(unit: str, start: Column, end: Column) -> Column:
    """How many boundaries of a unit lie between two times; weeks begin on Mondays."""
    unit = unit.lower().removesuffix("s")
    if unit in _MONTHS:
        months = lambda ts: F.year(_plain(ts)) * 12 + F.month(_plain(ts)) - 1
        whole = lambda ts: F.floor(months(ts) / _MONTHS[unit])
        return (whole(end) - whole(start)).cast("long")
    if unit not in _MICROS:
        raise ValueError(f"there is no unit {unit}")
    since = "1970-01-05 00:00:00" if unit == "week" else _EPOCH
    return (_floor(_micros(end, since), _MICROS[unit]) - _floor(_micros(start, since), _MICROS[unit])).cast("long")


def time_bucket(width: str, ts: Column) -> Column:
    """The start of the bucket of a width ('90 minutes', '7 days', '2 months') that a time lies in. Buckets of days and less
    are counted from Monday, 3 January 2000, others from its first day."""
    m = re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", width.lower())
    if not m or int(m[1]) < 1 or m[2] not in _MICROS | _MONTHS:
        raise ValueError(f"{width} is no width")
    n, unit = int(m[1]), m[2]
    if unit in _MONTHS:
        size = n * _MONTHS[unit]
        months = (F.year(_plain(ts)) - 2000) * 12 + F.month(_plain(ts)) - 1
        return _plain(F.add_months(F.lit("2000-01-01").cast("date"), (F.floor(months / size) * size).cast("int")))
    origin, size = "2000-01-03 00:00:00", n * _MICROS[unit]
    gone = _micros(ts, origin)
    return F.timestamp_add("MICROSECOND", gone - F.pmod(gone, F.lit(size).cast("long")), F.lit(origin).cast("timestamp_ntz"))


def pattern(form: str) -> str:
    """A strftime form as the pattern that Spark takes; literal text is quoted."""
    out, literal = [], []

    def quote() -> None:
        if literal:
            out.append("'" + "".join(literal).replace("'", "''") + "'")
            literal.clear()

    i = 0
    while i < len(form):
        if form[i] == "%":
            i += 1
            if i == len(form) or form[i] not in _DIRECTIVES | {"%": ""}:
                raise ValueError(f"%{form[i : i + 1]} is no directive")
            if form[i] == "%":
                literal.append("%")
            else:
                quote()
                out.append(_DIRECTIVES[form[i]])
        else:
            literal.append(form[i])
        i += 1
    quote()
    return "".join(out)


def strftime(ts: Column, form: str) -> Column:
    return F.date_format(_plain(ts), pattern(form))


def strptime(text: Column, form: str) -> Column:
    return F.to_timestamp_ntz(text, F.lit(pattern(form)))


def nullifzero(x: Column) -> Column:
    return F.when(x != 0, x)


def trunc(x: Column) -> Column:
    """Without its fraction, towards zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def list_value(*xs: Column) -> Column:
    return F.array(*xs)


def regexp_matches(text: Column, expression: str) -> Column:
    """Whether the expression is found anywhere in the text."""
    return text.rlike(expression)
