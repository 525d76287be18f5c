"""The dialect's functions against another engine, on times around every kind of boundary."""

import datetime

import compare
import pytest
from pyspark.sql import functions as F

from sluice.functions import dialect

TIMES = ["1969-12-31 23:59:59.999999", "1970-01-01 00:00:00", "1999-12-31 23:00:00", "2000-01-01 00:00:00", "2000-01-02 23:59:59", "2000-01-03 00:00:00", "2000-02-29 12:00:00", "2024-02-29 00:00:00.000001", "2024-03-31 02:30:00", "2023-12-31 23:59:59.5", "2100-07-04 08:09:10"]


def test_times_of_all_kinds(spark):
    import duckdb

    rows = [(i, datetime.datetime.fromisoformat(a), datetime.datetime.fromisoformat(b)) for i, (a, b) in enumerate((a, b) for a in TIMES for b in TIMES)]
    df = spark.createDataFrame(rows, "id int, a timestamp_ntz, b timestamp_ntz")
    units = ("microsecond", "millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade", "century")
    widths = ("10 seconds", "7 minutes", "5 hours", "1 day", "11 days", "3 weeks", "1 month", "7 months", "2 quarters", "3 years")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id INT, a TIMESTAMP, b TIMESTAMP)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    want = con.execute("SELECT id, " + ", ".join(f"date_diff('{u}', a, b) AS d_{u}" if u != "week" else "CAST((CAST(date_trunc('week', b) AS DATE) - CAST(date_trunc('week', a) AS DATE)) // 7 AS BIGINT) AS d_week" for u in units) + ", " + ", ".join(f"time_bucket(INTERVAL '{w.replace(' quarter', '3 month').replace('23 months', '6 months')}', a) AS w_{i}" for i, w in enumerate(widths)) + ", strftime(a, '%Y-%m-%d %H:%M:%S.%f %j %y %I %p %b %B %a %A %% it''s') AS s FROM t")
    want = compare.rows([d[0] for d in want.description], want.fetchall())
    a, b = F.col("a"), F.col("b")
    found = df.select("id", *[dialect.date_diff(u, a, b).alias(f"d_{u}") for u in units], *[dialect.time_bucket(w, a).alias(f"w_{i}") for i, w in enumerate(widths)], dialect.strftime(a, "%Y-%m-%d %H:%M:%S.%f %j %y %I %p %b %B %a %A %% it's").alias("s"))
    got = compare.of_spark(found)
    for c, x, y in zip(got[0], zip(*got[1], strict=True), zip(*want[1], strict=True), strict=True):
        assert x == y, c
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_what_is_no_unit_form_or_width():
    for bad in (lambda: dialect.date_diff("fortnight", F.lit(1), F.lit(2)), lambda: dialect.pattern("%q"), lambda: dialect.pattern("5%"), lambda: dialect.time_bucket("0 days", F.lit(1)), lambda: dialect.time_bucket("soon", F.lit(1))):
        with pytest.raises(ValueError):
            bad()
