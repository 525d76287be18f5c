"""Views and derived tables over the driver's tables, the data-quality invariants and the trap measurements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sluice.registry import case, cents, query, sql

#: An attempt is a line item; the same order and line number may have come in more than once.
DEDUP = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM {lineitem}) AS t WHERE rn = 1"
case("view_attempt_dedup", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice FROM ({DEDUP}) AS d")
case("view_customer", "SELECT c_custkey, concat_ws(' ', c_name, c_mktsegment) AS label, c_acctbal < 0 AS in_debt, CAST(floor(c_acctbal / 1000) AS BIGINT) AS band FROM {customer}")
case(
    "view_payment_intent",
    f"""SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(*) AS attempts, bool_or(l_returnflag = 'R') AS returned,
    max(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END) AS top_final FROM ({DEDUP}) AS d GROUP BY l_orderkey""",
)
case("view_shared_device", f"SELECT event_type, date_format(ts, 'yyyy-MM-dd') AS day, count(DISTINCT user_id) AS users, CAST(sum({cents('value')}) AS BIGINT) AS cents FROM {{events}} GROUP BY 1, 2 HAVING count(DISTINCT user_id) > 1", f"SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS users, CAST(sum({cents('value')}) AS BIGINT) AS cents FROM events GROUP BY 1, 2 HAVING count(DISTINCT user_id) > 1")
case("view_money_flow", f"SELECT c.c_name AS payer, s.s_name AS payee, n.n_name AS payee_nation, CAST(sum({cents('l.l_extendedprice')}) AS BIGINT) AS cents FROM {{lineitem}} l JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey JOIN {{customer}} c ON c.c_custkey = o.o_custkey JOIN {{supplier}} s ON s.s_suppkey = l.l_suppkey JOIN {{nation}} n ON n.n_nationkey = s.s_nationkey WHERE l.l_linestatus = 'F' GROUP BY c.c_name, s.s_name, n.n_name")
#: A customer's orders are the versions of a slowly changing row.
VERSIONS = "SELECT o_custkey, o_orderkey AS version_key, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS version_no, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL AS is_current, o_orderpriority FROM {orders}"
case("scd2_versions", VERSIONS)
case("scd2_current", f"SELECT o_custkey, version_key, o_orderpriority FROM ({VERSIONS}) AS v WHERE is_current")
case("scd2_trap", f"SELECT (SELECT count(*) FROM {{orders}} o JOIN ({VERSIONS}) v ON v.o_custkey = o.o_custkey) AS by_natural_key, (SELECT count(*) FROM {{orders}} o JOIN ({VERSIONS}) v ON v.version_key = o.o_orderkey) AS by_version_key")
BATCHES = f"""SELECT l_suppkey, date_format(l_shipdate, 'yyyy-MM') AS month, count(*) AS payment_count, CAST(sum({cents('l_extendedprice')}) AS BIGINT) AS gross, CAST(sum({cents('l_extendedprice * l_discount')}) AS BIGINT) AS fee,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN {cents('l_extendedprice')} ELSE 0 END) AS BIGINT) AS reserve, CASE WHEN max(l_shipdate) >= TIMESTAMP '2001-01-01 00:00:00' THEN 'open' ELSE 'paid' END AS status FROM {{lineitem}} GROUP BY 1, 2"""
DUCK_BATCHES = BATCHES.replace("date_format(l_shipdate, 'yyyy-MM')", "strftime(l_shipdate, '%Y-%m')")
case("settlement_build", f"SELECT *, gross - fee AS net FROM ({BATCHES}) AS b", f"SELECT *, gross - fee AS net FROM ({DUCK_BATCHES}) AS b")
PAYOUT = "SELECT s_nationkey, month, concat('P-', month, '-', lpad(CAST(row_number() OVER (PARTITION BY month ORDER BY s_nationkey) AS {text}), 4, '0')) AS reference, suppliers, batches, paid FROM (SELECT s_nationkey, month, count(DISTINCT l_suppkey) AS suppliers, count(*) AS batches, CAST(sum(gross - fee) AS BIGINT) AS paid FROM ({batches}) AS b JOIN {{supplier}} ON s_suppkey = l_suppkey GROUP BY s_nationkey, month) AS p"
case("payout_build", PAYOUT.replace("{text}", "STRING").replace("{batches}", BATCHES).replace("{{", "{").replace("}}", "}"), PAYOUT.replace("{text}", "VARCHAR").replace("{batches}", DUCK_BATCHES).replace("{{", "{").replace("}}", "}"))
case("dispute_stage_expand", "SELECT o_orderkey, stage, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY stage) AS INT) AS stage_no, stage = last_stage AS is_final FROM (SELECT o_orderkey, stage, 1 + o_orderkey % 4 AS last_stage FROM {orders} CROSS JOIN (VALUES (1), (2), (3), (4)) AS s(stage) WHERE o_totalprice > 250000) AS t WHERE stage <= last_stage")


_SPARK_DRAW = "CAST(conv(substring(md5(concat('{salt}', l_orderkey, '-', l_linenumber)), 1, 8), 16, 10) AS DOUBLE) / 4294967296"
_DUCK_DRAW = "CAST(CAST('0x' || substring(md5(concat('{salt}', l_orderkey, '-', l_linenumber)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296"
#: A sample by a hash of the key, and partial amounts drawn by others.
_REFUND = """SELECT l_orderkey, l_linenumber, cents, CASE WHEN whole < 0.7 THEN cents ELSE CAST(floor(cents * (floor(sqrt(part) * 100) / 100)) AS BIGINT) END AS refund_cents
    FROM (SELECT l_orderkey, l_linenumber, {cents} AS cents, {refund} AS draw, {whole} AS whole, {part} AS part FROM {{lineitem}} WHERE l_linestatus = 'F') AS t WHERE draw < 0.03"""
case("refund_build", *[_REFUND.format(cents=cents("l_extendedprice"), **{k: d.replace("{salt}", k) for k in ("refund", "whole", "part")}) for d in (_SPARK_DRAW, _DUCK_DRAW)])


_STARTS = [f"{y}-{m:02}-01" for y in range(1992, 2003) for m in (1, 4, 7, 10)]
QUARTERS = ", ".join(f"('{a}', '{b}')" for a, b in zip(_STARTS, _STARTS[1:], strict=False))
#: Name, and SQL for the violating rows.
INVARIANTS = (
    ("lines have an order", "SELECT count(*) AS n FROM {lineitem} l LEFT ANTI JOIN {orders} o ON o.o_orderkey = l.l_orderkey", "SELECT count(*) AS n FROM {lineitem} l ANTI JOIN {orders} o ON o.o_orderkey = l.l_orderkey"),
    ("lines have a part", "SELECT count(*) AS n FROM {lineitem} a WHERE NOT EXISTS (SELECT 1 FROM {part} b WHERE b.p_partkey = a.l_partkey)", None),
    ("lines have a supplier", "SELECT count(*) AS n FROM {lineitem} a WHERE NOT EXISTS (SELECT 1 FROM {supplier} b WHERE b.s_suppkey = a.l_suppkey)", None),
    ("orders have a customer", "SELECT count(*) AS n FROM {orders} a WHERE NOT EXISTS (SELECT 1 FROM {customer} b WHERE b.c_custkey = a.o_custkey)", None),
    ("customers have a nation", "SELECT count(*) AS n FROM {customer} a WHERE NOT EXISTS (SELECT 1 FROM {nation} b WHERE b.n_nationkey = a.c_nationkey)", None),
    ("nations have a region", "SELECT count(*) AS n FROM {nation} a WHERE NOT EXISTS (SELECT 1 FROM {region} b WHERE b.r_regionkey = a.n_regionkey)", None),
    ("every order lies in one quarter of the calendar", f"SELECT count(*) AS n FROM (SELECT o_orderkey FROM {{orders}} LEFT JOIN (VALUES {QUARTERS}) AS q(first_day, next_day) ON o_orderdate >= CAST(first_day AS TIMESTAMP) AND o_orderdate < CAST(next_day AS TIMESTAMP) GROUP BY o_orderkey HAVING count(first_day) <> 1) AS t", None),
    ("one current version a customer", "SELECT count(*) AS n FROM (SELECT o.o_custkey FROM {orders} o JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM {orders} GROUP BY o_custkey) m ON m.o_custkey = o.o_custkey AND m.last = o.o_orderdate GROUP BY o.o_custkey HAVING count(*) <> 1) AS t", None),
    ("versions were issued in order of time", "SELECT count(*) AS n FROM (SELECT o_orderkey, max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top, max(o_orderkey) OVER (PARTITION BY o_custkey, o_orderdate) AS same FROM {orders}) AS t WHERE top > same", None),
    ("versions are in order of time", f"SELECT count(*) AS n FROM ({VERSIONS}) AS v WHERE valid_to < valid_from", None),
    ("order keys are unique", "SELECT count(*) - count(DISTINCT o_orderkey) AS n FROM {orders}", None),
    ("line numbers are unique in an order", "SELECT count(*) AS n FROM (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) AS t", None),
    ("line numbers start at one", "SELECT count(*) AS n FROM (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING min(l_linenumber) <> 1) AS t", None),
    ("nothing ships before it is ordered", "SELECT count(*) AS n FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate", None),
    ("discounts are shares", "SELECT count(*) AS n FROM {lineitem} WHERE l_discount < 0 OR l_discount > 1", None),
    ("taxes are shares", "SELECT count(*) AS n FROM {lineitem} WHERE l_tax < 0 OR l_tax > 1", None),
    ("quantities are positive", "SELECT count(*) AS n FROM {lineitem} WHERE l_quantity <= 0", None),
    ("order totals are the sums of their lines", "SELECT count(*) AS n FROM (SELECT o_orderkey, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS total, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS lines FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_orderkey) AS t WHERE abs(total - lines) > 1", None),
    ("a line is priced by its part", "SELECT count(*) AS n FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE abs(CAST(round(l_extendedprice * 100) AS BIGINT) - CAST(round(l_quantity * p_retailprice * 100) AS BIGINT)) > 100", None),
    ("a reserve is part of the gross", f"SELECT count(*) AS n FROM ({BATCHES}) AS b WHERE reserve > gross", f"SELECT count(*) AS n FROM ({DUCK_BATCHES}) AS b WHERE reserve > gross"),
    ("duplicates stay within a third", "SELECT CASE WHEN count(*) - count(DISTINCT l_orderkey * 100 + l_linenumber) > count(*) / 3 THEN 1 ELSE 0 END AS n FROM {lineitem}", None),
    ("nothing is dated after the last day", "SELECT count(*) AS n FROM {events} WHERE ts > TIMESTAMP '2024-12-31 23:59:59'", None),
    ("every event has a user", "SELECT count(*) AS n FROM {events} WHERE user_id IS NULL", None),
    ("part keys say nothing about size", "SELECT CASE WHEN abs(corr(p_partkey, p_size)) > 0.2 THEN 1 ELSE 0 END AS n FROM {part}", None),
    ("the root of the tree is one", "SELECT abs(count(*) - 1) AS n FROM {nation} WHERE n_nationkey = 0", None),
    ("no thread runs in a circle, as every turn follows the one before", "SELECT count(*) AS n FROM {conversations} a WHERE turn > 0 AND NOT EXISTS (SELECT 1 FROM {conversations} b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1)", None),
    ("texts say how long they are", "SELECT count(*) AS n FROM {documents} WHERE length(text) <> n_chars", None),
    ("labels have a document", "SELECT count(*) AS n FROM {labels} a WHERE NOT EXISTS (SELECT 1 FROM {documents} b WHERE b.doc_id = a.doc_id)", None),
    ("labels are zero or one", "SELECT count(*) AS n FROM {labels} WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)", None),
    ("turns run without gaps", "SELECT count(*) AS n FROM (SELECT conv_id FROM {conversations} GROUP BY conv_id HAVING max(turn) + 1 <> count(*) OR min(turn) <> 0) AS t", None),
    ("stages run from one without gaps", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM {orders} CROSS JOIN (VALUES (1), (2), (3), (4)) AS s(stage) WHERE stage <= 1 + o_orderkey % 4 GROUP BY o_orderkey HAVING max(stage) <> count(*)) AS t", None),
    ("order keys are positive", "SELECT count(*) AS n FROM {orders} WHERE o_orderkey < 0", None),
    ("totals are positive", "SELECT count(*) AS n FROM {orders} WHERE o_totalprice <= 0", None),
    ("order states are known", "SELECT count(*) AS n FROM {orders} WHERE o_orderstatus NOT IN ('F', 'O', 'P')", None),
    ("a priority is always set", "SELECT count(*) AS n FROM {orders} WHERE o_orderpriority IS NULL", None),
    ("return flags are known", "SELECT count(*) AS n FROM {lineitem} WHERE l_returnflag NOT IN ('A', 'N', 'R')", None),
    ("line states are known", "SELECT count(*) AS n FROM {lineitem} WHERE l_linestatus NOT IN ('F', 'O')", None),
    ("a later line never ships before the one before it", "SELECT count(*) AS n FROM (SELECT l_shipdate, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate) AS b FROM {lineitem}) AS t WHERE l_shipdate < b", None),
    ("two full lines are never equal", "SELECT count(*) AS n FROM (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate HAVING count(*) > 1) AS t", None),
    ("customer keys are unique", "SELECT count(*) - count(DISTINCT c_custkey) AS n FROM {customer}", None),
    ("supplier keys are unique", "SELECT count(*) - count(DISTINCT s_suppkey) AS n FROM {supplier}", None),
    ("part keys are unique", "SELECT count(*) - count(DISTINCT p_partkey) AS n FROM {part}", None),
    ("event ids are unique", "SELECT count(*) - count(DISTINCT event_id) AS n FROM {events}", None),
    ("suppliers have a nation", "SELECT count(*) AS n FROM {supplier} a WHERE NOT EXISTS (SELECT 1 FROM {nation} b WHERE b.n_nationkey = a.s_nationkey)", None),
    ("every supplier has been paid", "SELECT count(*) AS n FROM {supplier} s WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey)", None),
    ("a nation name quotes its key", "SELECT count(*) AS n FROM {nation} WHERE n_name NOT LIKE concat('%', CAST(n_nationkey AS STRING), '%')", "SELECT count(*) AS n FROM nation WHERE n_name NOT LIKE concat('%', CAST(n_nationkey AS VARCHAR), '%')"),
    ("event kinds are known", "SELECT count(*) AS n FROM {events} WHERE event_type NOT IN ('signup', 'view', 'error', 'click', 'purchase')", None),
    ("payouts sum up to their batches", f"SELECT CAST(abs((SELECT sum(paid) FROM (SELECT s_nationkey, sum(gross - fee) AS paid FROM ({BATCHES}) AS b JOIN {{supplier}} ON s_suppkey = l_suppkey GROUP BY s_nationkey) AS p) - (SELECT sum(gross - fee) FROM ({BATCHES}) AS c)) AS BIGINT) AS n", f"SELECT CAST(abs((SELECT sum(paid) FROM (SELECT s_nationkey, sum(gross - fee) AS paid FROM ({DUCK_BATCHES}) AS b JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_nationkey) AS p) - (SELECT sum(gross - fee) FROM ({DUCK_BATCHES}) AS c)) AS BIGINT) AS n"),
    ("roles are known", "SELECT count(*) AS n FROM {conversations} WHERE role NOT IN ('system', 'user', 'assistant')", None),
    ("a conversation has one system turn at most", "SELECT count(*) AS n FROM (SELECT conv_id FROM {conversations} WHERE role = 'system' GROUP BY conv_id HAVING count(*) > 1) AS t", None),
    ("pages have an address", "SELECT count(*) AS n FROM {pages} WHERE url NOT LIKE 'http%://%'", None),
)


def _suite(parts: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS name, CAST(n AS BIGINT) AS n FROM ({text}) AS q{i}" for i, (name, text) in enumerate(parts))


@query(_suite([(name, other or text) for name, text, other in INVARIANTS]))
def invariants_suite(spark, folder):
    """One row a check: its name and the number of violations."""
    checks = [sql(spark, folder, text).select(F.lit(name).alias("name"), F.col("n").cast("long").alias("n")) for name, text, _ in INVARIANTS]
    return reduce(lambda a, b: a.unionByName(b), checks)


for _name, _text, _other in INVARIANTS:
    case("check_" + _name.replace(" ", "_"), f"SELECT CAST(n AS BIGINT) AS n FROM ({_text}) AS q", f"SELECT CAST(n AS BIGINT) AS n FROM ({_other or _text}) AS q")

#: What a careless query gets wrong, as two figures: the careless one and the right one.
TRAPS = (
    ("attempts counted as payments", "SELECT count(*) AS wrong, count(DISTINCT l_orderkey) AS correct FROM {lineitem}"),
    ("joining versions by the natural key", f"SELECT (SELECT count(*) FROM {{orders}} o JOIN ({VERSIONS}) v ON v.o_custkey = o.o_custkey) AS wrong, (SELECT count(*) FROM {{orders}}) AS correct"),
    ("rates joined by equal time", "SELECT (SELECT count(*) FROM {events} e JOIN {events} r ON r.user_id = e.user_id AND r.ts = e.ts AND r.event_type = 'purchase') AS wrong, (SELECT count(*) FROM {events}) AS correct"),
    ("stages counted as disputes", "SELECT count(*) AS wrong, count(DISTINCT o_orderkey) AS correct FROM {orders} CROSS JOIN (VALUES (1), (2), (3), (4)) AS s(stage) WHERE stage <= 1 + o_orderkey % 4"),
    ("orders without lines", "SELECT count(*) AS wrong, (SELECT count(DISTINCT l_orderkey) FROM {lineitem}) AS correct FROM {orders}"),
    ("test traffic", "SELECT count(*) AS wrong, count(CASE WHEN event_type <> 'error' THEN 1 END) AS correct FROM {events}"),
    ("a changed column", "SELECT count(CASE WHEN l_returnflag <> nullif(l_linestatus, 'O') THEN 1 END) AS wrong, count(CASE WHEN l_returnflag IS DISTINCT FROM nullif(l_linestatus, 'O') THEN 1 END) AS correct FROM {lineitem}"),
    ("duplicates", "SELECT count(*) AS wrong, count(DISTINCT l_orderkey * 100 + l_linenumber) AS correct FROM {lineitem}"),
    ("guests", "SELECT count(*) AS wrong, count(DISTINCT user_id) AS correct FROM {events}"),
)
@query("SELECT r_regionkey, CAST((CAST(concat(CAST(r_regionkey + 10 AS VARCHAR), lpad(CAST(r_regionkey * 7919 AS VARCHAR), 9, '0'), '1428', '00') AS HUGEINT) % 97) AS BIGINT) AS rest FROM {region}")
def mod97_fold(spark, folder):
    """The check-digit rest of a long number: its digits are folded one by one, so its length doesn't matter."""
    rows = sql(spark, folder, "SELECT r_regionkey, concat(CAST(r_regionkey + 10 AS STRING), lpad(CAST(r_regionkey * 7919 AS STRING), 9, '0'), '1428', '00') AS number FROM {region}")
    digits = F.filter(F.split("number", ""), lambda d: d != "")
    return rows.select("r_regionkey", F.aggregate(digits, F.lit(0).cast("long"), lambda rest, d: (rest * 10 + d.cast("long")) % 97).alias("rest"))


_TRAP = "SELECT '{0}' AS trap, CAST(wrong AS BIGINT) AS wrong, CAST(correct AS BIGINT) AS correct, 100.0E0 * (wrong - correct) / nullif(correct, 0) AS percent_off FROM ({1}) AS t{2}"
TRAPS_SQL = " UNION ALL ".join(_TRAP.replace("{0}", n).replace("{1}", t).replace("{2}", str(i)) for i, (n, t) in enumerate(TRAPS))
case("traps_nine", TRAPS_SQL)


# The report: scalars, and bands.
case(
    "report_scalars",
    "SELECT (SELECT count(*) FROM {lineitem}) AS n_lines, (SELECT count(*) FROM {orders}) AS n_orders, (SELECT count(*) FROM {customer}) AS n_customers, (SELECT count(*) FROM {supplier}) AS n_suppliers, (SELECT count(DISTINCT o_custkey) FROM {orders}) AS n_buyers, (SELECT max(o_orderdate) FROM {orders}) AS last_day, (SELECT count(*) FROM {documents}) AS n_documents",
)
case("report_bands", "SELECT CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END AS band, count(*) AS n, CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS DOUBLE) / count(*) AS rate FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY 1")
