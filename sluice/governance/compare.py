"""Are two results the same answer? Values are compared with tolerance, and reasons given when they differ.

Row order counts only where the statement orders; column names and order don't count; repeated rows do. A null isn't an empty
string, a text isn't a number, a boolean isn't either, and times are compared in UTC.
"""

from __future__ import annotations

import datetime
import decimal
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.governance.model import ResultSet

RELATIVE, ABSOLUTE = 1e-9, 1e-12


@dataclass(frozen=True)
class Verdict:
    equal: bool
    reason: str = ""


def cell_class(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, (int, float, decimal.Decimal)):
        return "number"
    if isinstance(x, str):
        return "text"
    if isinstance(x, datetime.datetime):
        return "timestamp"
    if isinstance(x, datetime.date):
        return "date"
    if isinstance(x, (bytes, bytearray)):
        return "blob"
    return "list" if isinstance(x, (list, tuple)) else "other"


def _utc(x: datetime.datetime) -> datetime.datetime:
    return x.astimezone(datetime.timezone.utc).replace(tzinfo=None) if x.tzinfo else x


def same(a, b) -> bool:
    kind = cell_class(a)
    if kind != cell_class(b):
        return False
    if kind == "number":
        if isinstance(a, int) and isinstance(b, int):
            return a == b
        x, y = float(a), float(b)
        return math.isnan(x) and math.isnan(y) or math.isclose(x, y, rel_tol=RELATIVE, abs_tol=ABSOLUTE)
    if kind == "timestamp":
        return _utc(a) == _utc(b)
    if kind == "list":
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def key(x) -> tuple:
    """A total order over cells; numbers by twelve significant digits, so that close ones meet."""
    kind = cell_class(x)
    if kind == "number":
        x = float(x)
        return (kind, "nan") if math.isnan(x) else (kind, f"{x + 0.0:.12g}")
    if kind == "timestamp":
        x = _utc(x)
    return kind, "[" + ",".join(map(repr, map(key, x))) + "]" if kind == "list" else str(x)


def _aligned(rows: list[tuple]) -> list[tuple]:
    """Columns in the order of their contents."""
    if not rows:
        return rows
    width = len(rows[0])
    order = sorted(range(width), key=lambda i: sorted(key(r[i]) for r in rows))
    return [tuple(r[i] for i in order) for r in rows]


def compare(found: ResultSet, expected: ResultSet, ordered: bool = False) -> Verdict:
    if len(found.columns) != len(expected.columns):
        return Verdict(False, "column count")
    if len(found.rows) != len(expected.rows):
        return Verdict(False, "row count")
    a, b = _aligned(list(found.rows)), _aligned(list(expected.rows))
    if not ordered:
        a, b = (sorted(x, key=lambda r: [key(c) for c in r]) for x in (a, b))
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            if not same(p, q):
                kinds = cell_class(p), cell_class(q)
                return Verdict(False, "null against value" if "null" in kinds else "type" if kinds[0] != kinds[1] else "row order" if ordered and _again(a, b) else "value")
    return Verdict(True)


def _again(a: list[tuple], b: list[tuple]) -> bool:
    a, b = (sorted(x, key=lambda r: [key(c) for c in r]) for x in (a, b))
    return all(same(p, q) for x, y in zip(a, b, strict=True) for p, q in zip(x, y, strict=True))


def outcome(found: ResultSet | None, expected: ResultSet | None, timed_out: bool = False, ordered: bool = False) -> Verdict:
    """Of a run that may have been refused (None) or timed out. A refusal that was expected is a success."""
    if timed_out:
        return Verdict(False, "timeout")
    if found is None or expected is None:
        return Verdict(found is expected, "" if found is expected else "refused" if found is None else "not refused")
    return compare(found, expected, ordered)


def fingerprint(df: DataFrame) -> DataFrame:
    """(n, digest): a multiset fingerprint of a frame of any size, from sums of the halves of each row's MD5. Doubles count by
    six decimals, columns by name; rows in any order give the same, in any engine that has MD5."""
    cells = []
    for c in sorted(df.columns):
        text = F.col(c).cast("string")
        if dict(df.dtypes)[c] in ("double", "float"):
            text = F.coalesce(F.col(c).try_cast("decimal(38,6)").cast("string"), text)
        cells.append(F.coalesce(F.concat(F.lit("v"), text), F.lit("n")))
    h = F.md5(F.encode(F.concat_ws("|", *cells), "utf-8"))
    part = lambda i: F.conv(F.substring(h, i, 8), 16, 10).cast("decimal(20,0)")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)").cast("string")
    return df.select(part(1).alias("h"), part(9).alias("l")).agg(F.count(F.lit(1)).alias("n"), F.concat_ws("-", total("h"), total("l")).alias("digest"))
