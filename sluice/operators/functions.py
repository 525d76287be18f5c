"""Scalar functions: dates and times, strings, numbers, and functions that are admitted by name.

The inventory's names are those of another dialect; where Spark's function of that name differs, the expression here gives the
inventory's meaning.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import dialect
from sluice.registry import case, query, table

case(
    "date_parts",
    """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, weekofyear(o_orderdate) AS w, quarter(o_orderdate) AS q,
    dayofweek(o_orderdate) - 1 AS dow, dayofmonth(o_orderdate) AS dom, dayofyear(o_orderdate) AS doy, CAST(extract(YEAR FROM o_orderdate) AS INT) AS ey, CAST(date_part('month', o_orderdate) AS INT) AS pm FROM {orders}""",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(week(o_orderdate) AS INT) AS w, CAST(quarter(o_orderdate) AS INT) AS q,
    CAST(dayofweek(o_orderdate) AS INT) AS dow, CAST(dayofmonth(o_orderdate) AS INT) AS dom, CAST(dayofyear(o_orderdate) AS INT) AS doy, CAST(extract(YEAR FROM o_orderdate) AS INT) AS ey, CAST(date_part('month', o_orderdate) AS INT) AS pm FROM {orders}""",
)
case(
    "date_trunc_units",
    "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, CAST(date_trunc('year', o_orderdate) AS DATE) AS y, CAST(date_trunc('week', o_orderdate) AS DATE) AS w, last_day(o_orderdate) AS last FROM {orders}",
)
case("timestamp_trunc", "SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS h FROM {events}", "SELECT event_id, date_trunc('hour', ts) AS h FROM {events}")
case(
    "date_arith",
    "SELECT o_orderkey, date_add(CAST(o_orderdate AS DATE), 10) AS later, date_sub(CAST(o_orderdate AS DATE), 10) AS earlier, CAST(add_months(o_orderdate, 1) AS DATE) AS next_month FROM {orders}",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 10 AS later, CAST(o_orderdate AS DATE) - 10 AS earlier, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS next_month FROM {orders}",
)
case(
    "date_diff_boundaries",
    """SELECT o_orderkey, CAST(datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, CAST(12 * (2002 - year(o_orderdate)) + 1 - month(o_orderdate) AS BIGINT) AS months, CAST(2002 - year(o_orderdate) AS BIGINT) AS years FROM {orders}""",
    "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS days, date_diff('month', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS months, date_diff('year', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS years FROM {orders}",
)
case(
    "timestamp_diff",
    "SELECT event_id, CAST(unix_timestamp(TIMESTAMP '2024-02-01 00:00:00') - unix_timestamp(CAST(date_trunc('second', ts) AS TIMESTAMP)) AS BIGINT) AS seconds FROM {events}",
    "SELECT event_id, CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(date_trunc('second', ts)) AS BIGINT) AS seconds FROM {events}",
)
case(
    "date_format_parse",
    "SELECT o_orderkey, date_format(o_orderdate, 'yyyy/MM/dd') AS shown, to_date(date_format(o_orderdate, 'dd.MM.yyyy'), 'dd.MM.yyyy') AS parsed, CAST(to_timestamp('2024-03-05 06:07:08', 'yyyy-MM-dd HH:mm:ss') AS TIMESTAMP_NTZ) AS stamp, CAST('1999-12-31' AS DATE) AS lit, CAST(o_orderdate AS DATE) AS d, date_format(CAST(o_orderdate AS DATE), 'yyyy-MM-dd') AS ds FROM {orders}",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS shown, CAST(strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y') AS DATE) AS parsed, strptime('2024-03-05 06:07:08', '%Y-%m-%d %H:%M:%S') AS stamp, CAST('1999-12-31' AS DATE) AS lit, CAST(o_orderdate AS DATE) AS d, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS ds FROM {orders}",
)
case(
    "epoch_seconds",
    "SELECT event_id, CAST(unix_timestamp(CAST(date_trunc('second', ts) AS TIMESTAMP)) AS BIGINT) AS s, CAST(timestamp_seconds(1700000000) AS TIMESTAMP_NTZ) AS t FROM {events}",
    "SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s, CAST(to_timestamp(1700000000) AT TIME ZONE 'UTC' AS TIMESTAMP) AS t FROM {events}",
)
case(
    "time_bucket_tumbling",
    "SELECT CAST(window.start AS TIMESTAMP_NTZ) AS bucket, count(*) AS n, count(DISTINCT user_id) AS users FROM {events} GROUP BY window(ts, '1 hour')",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS n, count(DISTINCT user_id) AS users FROM {events} GROUP BY 1",
)
case(
    "time_bucket_weeks",
    "SELECT CAST(window.start AS TIMESTAMP_NTZ) AS bucket, count(*) AS n FROM {events} GROUP BY window(ts, '7 days', '7 days', '4 days')",
    "SELECT time_bucket(INTERVAL 7 DAY, ts) AS bucket, count(*) AS n FROM {events} GROUP BY 1",
)
case(
    "string_suite",
    """SELECT p_partkey, concat(coalesce(p_brand, ''), coalesce(nullif(p_type, p_type), ''), 'x') AS joined, concat_ws('-', p_brand, nullif(p_type, p_type), p_name) AS spaced, lower(p_name) AS lo, upper(p_name) AS hi, length(p_name) AS n,
    substring(p_name, 2, 3) AS cut, trim('  a b ') AS tr, ltrim('  a') AS tl, rtrim('a  ') AS tt, left(p_name, 3) AS l, right(p_name, 3) AS r, repeat('ab', 3) AS rep, split(p_name, ' ')[0] AS w,
    instr(p_name, 'a') AS at, lpad(CAST(p_size AS STRING), 5, '0') AS lp, rpad(CAST(p_size AS STRING), 5, '.') AS rp FROM {part}""",
    """SELECT p_partkey, concat(p_brand, nullif(p_type, p_type), 'x') AS joined, concat_ws('-', p_brand, nullif(p_type, p_type), p_name) AS spaced, lower(p_name) AS lo, upper(p_name) AS hi, CAST(length(p_name) AS INT) AS n,
    substring(p_name, 2, 3) AS cut, trim('  a b ') AS tr, ltrim('  a') AS tl, rtrim('a  ') AS tt, left(p_name, 3) AS l, right(p_name, 3) AS r, repeat('ab', 3) AS rep, string_split(p_name, ' ')[1] AS w,
    CAST(strpos(p_name, 'a') AS INT) AS at, lpad(CAST(p_size AS VARCHAR), 5, '0') AS lp, rpad(CAST(p_size AS VARCHAR), 5, '.') AS rp FROM {part}""",
)
case("string_initcap", "SELECT DISTINCT initcap(lower(c_mktsegment)) AS segment FROM {customer}", "SELECT DISTINCT upper(left(c_mktsegment, 1)) || lower(substring(c_mktsegment, 2)) AS segment FROM customer")
case(
    "regex_suite",
    r"SELECT doc_id, text RLIKE '[0-9][0-9]' AS has_number, regexp_extract(text, '([A-Za-z]+)', 1) AS word, length(regexp_replace(text, '[^a-z]', '')) AS letters FROM {documents}",
    r"SELECT doc_id, regexp_matches(text, '[0-9][0-9]') AS has_number, regexp_extract(text, '([A-Za-z]+)', 1) AS word, CAST(length(regexp_replace(text, '[^a-z]', '', 'g')) AS INT) AS letters FROM {documents}",
)
case(
    "math_suite",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / 7, 2) AS rounded, CAST(floor(l_extendedprice / 7) AS DOUBLE) AS fl, CAST(ceil(l_extendedprice / 7) AS DOUBLE) AS ce, abs(l_discount - 0.5) AS ab, CAST(signum(l_quantity - 25) AS INT) AS sg,
    round(sqrt(l_quantity), 9) AS sq, round(exp(l_discount), 9) AS ex, round(ln(l_quantity), 9) AS lg, round(log10(l_quantity), 9) AS lt, round(cbrt(l_quantity), 9) AS cb, least(l_quantity, 10.0, NULL) AS lo, greatest(l_quantity, 10.0, NULL) AS hi FROM {lineitem}""",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / 7, 2) AS rounded, CAST(floor(l_extendedprice / 7) AS DOUBLE) AS fl, CAST(ceil(l_extendedprice / 7) AS DOUBLE) AS ce, abs(l_discount - 0.5) AS ab, CAST(sign(l_quantity - 25) AS INT) AS sg,
    round(sqrt(l_quantity), 9) AS sq, round(exp(l_discount), 9) AS ex, round(ln(l_quantity), 9) AS lg, round(log(l_quantity), 9) AS lt, round(cbrt(l_quantity), 9) AS cb, least(l_quantity, 10.0, NULL) AS lo, greatest(l_quantity, 10.0, NULL) AS hi FROM {lineitem}""",
)
case(
    "named_functions",
    "SELECT p_partkey, nullif(p_size, 0) AS nz, nullifzero(p_size - p_size) AS z, CASE WHEN p_retailprice - 1200 < 0 THEN CAST(ceil(p_retailprice - 1200) AS DOUBLE) ELSE CAST(floor(p_retailprice - 1200) AS DOUBLE) END AS tr, array(p_size, 1)[1] AS lv, p_name RLIKE 'a.*e' AS rm FROM {part}",
    "SELECT p_partkey, nullif(p_size, 0) AS nz, nullif(p_size - p_size, 0) AS z, trunc(p_retailprice - 1200) AS tr, list_value(p_size, 1)[2] AS lv, regexp_matches(p_name, 'a.*e') AS rm FROM {part}",
)
case("free_text_probe", "SELECT doc_id, lang FROM {documents} WHERE text ILIKE '%license%'")

_UNITS = ("second", "minute", "hour", "day", "month", "quarter", "year")


@query(f"SELECT event_id, {', '.join(f"date_diff('{u}', TIMESTAMP '2023-11-05 13:59:30.5', ts) AS {u}s" for u in _UNITS)}, epoch(ts) AS at, strftime(ts, '%d/%m/%y %H:%M o''clock, day %j') AS shown, strptime(strftime(ts, '%Y%m%dT%H%M%S'), '%Y%m%dT%H%M%S') AS parsed FROM {{events}}")
def dialect_times(spark, folder):
    """The dialect's functions of time, as Column expressions."""
    at, ts = F.lit("2023-11-05 13:59:30.5").cast("timestamp_ntz"), F.col("ts")
    form = "%Y%m%dT%H%M%S"
    found = [dialect.date_diff(u, at, ts).alias(f"{u}s") for u in _UNITS]
    return table(spark, folder, "events").select("event_id", *found, dialect.epoch(ts).alias("at"), dialect.strftime(ts, "%d/%m/%y %H:%M o'clock, day %j").alias("shown"), dialect.strptime(dialect.strftime(ts, form), form).alias("parsed"))


_WIDTHS = {"quarter_hours": "15 minutes", "odd_hours": "7 hours", "days": "3 days", "weeks": "2 weeks", "months": "5 months", "years": "1 year"}


@query(f"SELECT o_orderkey, {', '.join(f"time_bucket(INTERVAL '{w}', o_orderdate) AS {n}" for n, w in _WIDTHS.items())}, list_value(o_orderkey, o_custkey)[2] AS second, trunc(100000 - o_totalprice) AS whole, nullif(o_custkey % 2, 0) AS odd, regexp_matches(o_orderpriority, '^[12]') AS urgent FROM {{orders}}")
def dialect_buckets(spark, folder):
    day = F.col("o_orderdate")
    found = [dialect.time_bucket(w, day).alias(n) for n, w in _WIDTHS.items()]
    more = [F.get(dialect.list_value(F.col("o_orderkey"), F.col("o_custkey")), F.lit(1)).alias("second"), dialect.trunc(100000 - F.col("o_totalprice")).alias("whole"), dialect.nullifzero(F.col("o_custkey") % 2).alias("odd"), dialect.regexp_matches(F.col("o_orderpriority"), "^[12]").alias("urgent")]
    return table(spark, folder, "orders").select("o_orderkey", *found, *more)
