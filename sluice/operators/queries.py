"""Exploration, benchmark and calibration questions over the driver's tables."""

from __future__ import annotations

from sluice.registry import case, cents
from sluice.operators.views import DEDUP, VERSIONS

PRICE = cents("o_totalprice")
LINE = cents("l_extendedprice")
ANCHOR = "(SELECT max(o_orderdate) FROM {orders})"

# Exploration.
case("explore_grain", f"SELECT (SELECT count(*) FROM {{lineitem}}) AS line_rows, (SELECT count(*) FROM {{orders}}) AS order_rows, (SELECT count(DISTINCT l_orderkey) FROM {{lineitem}}) AS orders_with_lines, (SELECT CAST(sum({PRICE}) AS BIGINT) FROM {{orders}}) AS order_cents, (SELECT CAST(sum(o.c) AS BIGINT) FROM (SELECT {PRICE} AS c, o_orderkey FROM {{orders}}) o JOIN {{lineitem}} ON l_orderkey = o.o_orderkey) AS inflated_cents")
case(
    "explore_lift",
    """WITH base AS (SELECT c_mktsegment AS segment, p_brand AS brand, count(DISTINCT o_orderkey) AS n FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey JOIN {part} ON p_partkey = l_partkey GROUP BY c_mktsegment, p_brand),
    shares AS (SELECT segment, brand, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY segment) AS DOUBLE) AS own, CAST(sum(n) OVER (PARTITION BY brand) AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS overall FROM base),
    ranked AS (SELECT segment, brand, n, round(own / overall, 9) AS lift, row_number() OVER (PARTITION BY segment ORDER BY round(own / overall, 9) DESC, brand) AS k FROM shares)
    SELECT segment, brand, n, lift FROM ranked WHERE k <= 3""",
)
case("explore_money", f"SELECT n_name, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders_paid, CAST(sum({LINE}) AS BIGINT) AS cents FROM {{lineitem}} JOIN {{supplier}} ON s_suppkey = l_suppkey JOIN {{nation}} ON n_nationkey = s_nationkey GROUP BY n_name ORDER BY cents DESC, n_name LIMIT 10")
case("explore_shared", "WITH shared AS (SELECT event_type, CAST(ts AS DATE) AS d, count(DISTINCT user_id) AS users FROM {events} GROUP BY event_type, CAST(ts AS DATE) HAVING count(DISTINCT user_id) > 3) SELECT e.event_type AS event_type, count(*) AS n, 100.0E0 * count(CASE WHEN e.value > 50 THEN 1 END) / count(*) AS percent_large FROM {events} e JOIN shared s ON s.event_type = e.event_type AND s.d = CAST(e.ts AS DATE) GROUP BY e.event_type")
case(
    "explore_ring",
    "SELECT event_type, concat_ws(',', slice(array_sort(collect_set(user_id)), 1, 6)) AS first_users FROM {events} GROUP BY event_type",
    "SELECT event_type, array_to_string(list_sort(list(DISTINCT user_id))[1:6], ',') AS first_users FROM {events} GROUP BY event_type",
)
case("explore_geography", "SELECT n_name, count(*) AS n FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey GROUP BY n_name HAVING count(*) >= 5")
case("explore_versions", f"SELECT (SELECT count(*) FROM {{orders}} o JOIN ({VERSIONS}) v ON v.version_key = o.o_orderkey) AS one_version, (SELECT count(*) FROM {{orders}} o JOIN ({VERSIONS}) v ON v.o_custkey = o.o_custkey) AS all_versions")
case("explore_retries", f"SELECT a.l_linenumber AS l_linenumber, count(*) AS n, count(b.l_orderkey) AS again, CAST(count(b.l_orderkey) AS DOUBLE) / nullif(count(*), 0) AS rate FROM ({DEDUP}) a LEFT JOIN ({DEDUP}) b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY a.l_linenumber")
case("explore_rate_hole", "SELECT e.event_type AS event_type, count(*) AS n, count(r.event_id) AS with_rate FROM {events} e LEFT JOIN (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d, 1 AS event_id FROM {events} WHERE event_type = 'purchase') r ON r.user_id = e.user_id AND r.d = CAST(e.ts AS DATE) GROUP BY e.event_type")
case("explore_free_text", "SELECT lang, count(*) AS n FROM {documents} WHERE text ILIKE '%@%' GROUP BY lang")
case("explore_erasure", "SELECT count(*) FILTER (WHERE c_acctbal < 0) AS in_debt, count(DISTINCT c_nationkey) FILTER (WHERE c_acctbal < 0) AS nations, count(*) AS n FROM {customer}")
case("explore_bands", "SELECT CASE WHEN o_totalprice < 50000 THEN 'a' WHEN o_totalprice < 150000 THEN 'b' WHEN o_totalprice < 300000 THEN 'c' ELSE 'd' END AS band, count(DISTINCT o_orderkey) AS n_orders, count(DISTINCT o_custkey) AS customers, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN o_orderkey END) AS returned FROM {orders} LEFT JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY 1")
case(
    "explore_duplicates",
    "SELECT l_orderkey, l_linenumber, count(*) AS n, CAST(datediff(max(l_shipdate), min(l_shipdate)) AS BIGINT) AS days FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "SELECT l_orderkey, l_linenumber, count(*) AS n, date_diff('day', CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE)) AS days FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
)
case("explore_fee_cap", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > CASE WHEN l_quantity > 25 THEN 0.05 ELSE 0.08 END) AS above_cap, count(*) AS n FROM {lineitem} GROUP BY l_returnflag")

# Benchmark questions.
QUESTIONS = {
    "01": "SELECT c_nationkey, count(*) AS n FROM {customer} GROUP BY c_nationkey ORDER BY n DESC, c_nationkey",
    "02": f"SELECT CAST(count(*) FILTER (WHERE returned) AS DOUBLE) / nullif(count(*), 0) AS rate FROM (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS returned FROM ({DEDUP}) d GROUP BY l_orderkey) AS t",
    "03": f"SELECT CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / count(*) AS rate FROM ({DEDUP}) AS d",
    "04": f"SELECT count(DISTINCT o_custkey) AS n FROM {{orders}} WHERE o_orderdate > {ANCHOR} - INTERVAL 90 DAY",
    "05": f"SELECT s_name, CAST(sum({LINE}) AS BIGINT) AS cents FROM {{lineitem}} JOIN {{supplier}} ON s_suppkey = l_suppkey GROUP BY s_name ORDER BY cents DESC, s_name LIMIT 10",
    "06": "SELECT count(*)::double / count(DISTINCT l_orderkey) AS lines FROM {lineitem}",
    "07": f"SELECT CAST(sum({cents('l_extendedprice * l_discount')}) AS DOUBLE) / CAST(sum({LINE}) AS DOUBLE) AS rate FROM {{lineitem}}",
    "08": f"SELECT CAST(sum({cents('l_extendedprice * l_tax')}) AS DOUBLE) / 100 AS income FROM {{lineitem}}",
    "09": f"SELECT CAST(sum({LINE}) AS DOUBLE) / 100 AS volume FROM {{lineitem}}",
    "10": f"SELECT CAST(sum({LINE} - {cents('l_extendedprice * l_discount')} + {cents('l_extendedprice * l_tax')}) AS BIGINT) AS margin FROM {{lineitem}}",
    "11": "SELECT median(o_totalprice) AS mid FROM {orders}",
    "12": f"SELECT count(*) AS n FROM {{supplier}} s WHERE EXISTS (SELECT 1 FROM {{lineitem}} l WHERE l.l_suppkey = s.s_suppkey AND l.l_shipdate > (SELECT max(l_shipdate) FROM {{lineitem}}) - INTERVAL 90 DAY)",
    "13": "SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE o_orderstatus <> 'F' GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority LIMIT 10",
    "14": "SELECT CAST(count(DISTINCT l.l_orderkey) AS DOUBLE) / count(DISTINCT o.o_orderkey) AS rate FROM {orders} o LEFT JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R'",
    "15": f"SELECT count(*) AS n FROM {{orders}} WHERE o_orderdate >= date_trunc('month', {ANCHOR}) - INTERVAL 1 MONTH AND o_orderdate < date_trunc('month', {ANCHOR})",
    "16": "SELECT n_name, CAST(count(*) FILTER (WHERE l_returnflag <> 'R') AS DOUBLE) / count(*) AS rate FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey JOIN {nation} ON n_nationkey = s_nationkey GROUP BY n_name HAVING count(*) >= 100 ORDER BY rate DESC, n_name LIMIT 10",
    "17": f"SELECT s_name, cents FROM (SELECT s_name, cents, row_number() OVER (ORDER BY cents DESC, s_name) AS k FROM (SELECT s_name, CAST(sum({LINE}) AS BIGINT) AS cents FROM {{lineitem}} JOIN {{supplier}} ON s_suppkey = l_suppkey GROUP BY s_name) AS a) AS b WHERE k <= 10",
    "18": "SELECT CAST(sum(n) AS DOUBLE) / count(*) AS basket FROM (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) AS t",
    "19": "SELECT c_nationkey, count(*) AS n FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O') GROUP BY c_nationkey",
    "20": "SELECT count(*) AS n FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey)",
    "21": f"SELECT s_name, CAST(sum({LINE}) AS BIGINT) AS cents FROM {{lineitem}} JOIN {{supplier}} ON s_suppkey = l_suppkey GROUP BY s_name ORDER BY cents DESC, s_name LIMIT 1",
    "23": "SELECT p_brand, count(*) AS n FROM {part} GROUP BY p_brand",
    "24": "SELECT c_mktsegment, count(*) AS n FROM {customer} GROUP BY c_mktsegment ORDER BY c_mktsegment",
    "25": f"SELECT o_orderpriority, count(*) AS n FROM ({VERSIONS}) AS v WHERE is_current GROUP BY o_orderpriority",
    "26": "SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type",
    "27": "SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderstatus",
    "28": "SELECT o_orderpriority, count(*) AS n FROM {orders} GROUP BY o_orderpriority",
    "29": "SELECT count(*) AS n FROM {nation} WHERE n_regionkey = 3",
    "30": "SELECT p_partkey, p_name FROM {part} WHERE p_size > 45 ORDER BY p_partkey LIMIT 20",
    "31": "SELECT p_type, count(*) AS n FROM {part} GROUP BY p_type",
    "32": "SELECT lang, count(*) AS n FROM {documents} GROUP BY lang",
    "33": f"SELECT n_name, CAST(sum({LINE}) AS BIGINT) AS cents FROM {{lineitem}} JOIN {{supplier}} ON s_suppkey = l_suppkey AND l_linestatus = 'F' JOIN {{nation}} ON n_nationkey = s_nationkey GROUP BY n_name ORDER BY cents DESC, n_name LIMIT 10",
    "34": "SELECT l_linestatus, count(*) AS n FROM {lineitem} WHERE l_returnflag <> 'R' GROUP BY l_linestatus",
    "35": f"SELECT l_returnflag, count(*) AS n, CAST(sum({LINE}) AS BIGINT) AS cents FROM {{lineitem}} GROUP BY l_returnflag",
    "36": "SELECT p_brand, CAST(count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS DOUBLE) / count(*) AS rate FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY p_brand",
    "37": "SELECT l_linenumber, count(*) AS n FROM {lineitem} GROUP BY l_linenumber",
    "38": "SELECT l_returnflag, count(DISTINCT l_orderkey) AS n FROM {lineitem} GROUP BY l_returnflag",
    "39": f"SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS m, CAST(sum({LINE}) AS BIGINT) AS cents FROM {{lineitem}} GROUP BY 1",
    "40": "SELECT c_mktsegment, count(*) AS n FROM {orders} JOIN {customer} ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' GROUP BY c_mktsegment",
    "41": f"SELECT o_orderpriority, CAST(sum({cents('l_extendedprice * l_discount')}) AS DOUBLE) / CAST(sum({LINE}) AS DOUBLE) AS rate FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey GROUP BY o_orderpriority",
    "42": f"SELECT s_nationkey, s_name, cents FROM (SELECT s_nationkey, s_name, cents, rank() OVER (PARTITION BY s_nationkey ORDER BY cents DESC, s_name) AS k FROM (SELECT s_nationkey, s_name, CAST(sum({LINE}) AS BIGINT) AS cents FROM {{lineitem}} JOIN {{supplier}} ON s_suppkey = l_suppkey GROUP BY s_nationkey, s_name) AS a) AS b WHERE k <= 3",
    "43": f"WITH a AS (SELECT s_name, CAST(sum({LINE}) AS BIGINT) AS cents FROM {{lineitem}} JOIN {{supplier}} ON s_suppkey = l_suppkey GROUP BY s_name), total AS (SELECT sum(cents) AS every FROM a) SELECT s_name, cents, 100.0E0 * cents / CAST(every AS DOUBLE) AS share FROM a CROSS JOIN total ORDER BY cents DESC, s_name LIMIT 10",
    "44": "SELECT s_suppkey FROM {supplier} s WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey AND l.l_returnflag = 'R' AND l.l_quantity > 49)",
    "45": f"SELECT m, cents - lag(cents) OVER (ORDER BY m) AS change FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS m, CAST(sum({LINE}) AS BIGINT) AS cents FROM {{lineitem}} GROUP BY 1) AS a",
    "46": "SELECT count(*) AS n FROM (SELECT o_custkey FROM {orders} GROUP BY o_custkey HAVING count(*) >= 5) AS t",
    "48": "SELECT count(*) AS n FROM (SELECT event_type, CAST(ts AS DATE) AS d FROM {events} GROUP BY event_type, CAST(ts AS DATE) HAVING count(DISTINCT user_id) > 1) AS t",
    "49": "SELECT count(*) AS n FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM {orders}) AS t WHERE k = 1",
    "50": "SELECT count(*) AS n FROM {supplier} s WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey)",
    "51": "SELECT l_linestatus, CAST(count(*) AS DOUBLE) / count(DISTINCT l_orderkey) AS rate FROM {lineitem} GROUP BY l_linestatus",
}
for _key, _text in QUESTIONS.items():
    case(f"question_{_key}", _text)
case("question_47", "SELECT percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice) AS p90 FROM {orders}", "SELECT quantile_cont(o_totalprice, 0.9) AS p90 FROM {orders}")

# Calibration: column and partition pruning, by kind of query.
DAY, MONTH = "TIMESTAMP '1998-03-02 00:00:00'", "TIMESTAMP '1998-03-01 00:00:00'"
CALIBRATION = {
    "day_one_column": f"SELECT l_returnflag FROM {{lineitem}} WHERE l_shipdate = {DAY}",
    "day_two_columns": f"SELECT l_returnflag, l_quantity FROM {{lineitem}} WHERE l_shipdate = {DAY}",
    "day_five_columns": f"SELECT l_orderkey, l_returnflag, l_quantity, l_discount, l_partkey FROM {{lineitem}} WHERE l_shipdate = {DAY}",
    "day_count": f"SELECT count(*) AS n FROM {{lineitem}} WHERE l_shipdate = {DAY}",
    "day_group": f"SELECT l_returnflag, count(*) AS n FROM {{lineitem}} WHERE l_shipdate = {DAY} GROUP BY l_returnflag",
    "range_between": f"SELECT l_returnflag FROM {{lineitem}} WHERE l_shipdate BETWEEN {MONTH} AND {DAY}",
    "range_open": f"SELECT l_returnflag, count(*) AS n FROM {{lineitem}} WHERE l_shipdate >= {DAY} GROUP BY l_returnflag",
    "range_half_open": f"SELECT l_returnflag FROM {{lineitem}} WHERE l_shipdate >= {MONTH} AND l_shipdate < {MONTH} + INTERVAL 1 MONTH",
    "range_in_list": f"SELECT l_returnflag, count(*) AS n FROM {{lineitem}} WHERE l_shipdate IN ({DAY}, {MONTH}) GROUP BY l_returnflag",
    "range_before": f"SELECT count(*) AS n FROM {{lineitem}} WHERE l_shipdate <= {MONTH}",
    "full_group_small": "SELECT l_returnflag, count(*) AS n FROM {lineitem} GROUP BY l_returnflag",
    "full_group_large": "SELECT l_suppkey, count(*) AS n FROM {lineitem} GROUP BY l_suppkey",
    "full_count": "SELECT count(*) AS n FROM {lineitem}",
    "full_sum": f"SELECT l_linestatus, CAST(sum({LINE}) AS BIGINT) AS cents FROM {{lineitem}} GROUP BY l_linestatus",
    "unread_function": "SELECT l_returnflag, count(*) AS n FROM {lineitem} WHERE year(l_shipdate) = 1998 GROUP BY l_returnflag",
    "unread_or": f"SELECT count(*) AS n FROM {{lineitem}} WHERE l_shipdate = {DAY} OR l_quantity > 45",
    "other_equal": "SELECT count(*) AS n FROM {lineitem} WHERE l_returnflag = 'A'",
    "other_negated": "SELECT count(*) AS n FROM {lineitem} WHERE NOT l_returnflag = 'A'",
    "other_greater": "SELECT count(*) AS n FROM {lineitem} WHERE l_quantity > 40",
    "dimension_group": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY c_mktsegment, c_nationkey",
    "dimension_count": "SELECT count(*) AS n FROM {part}",
    "medium_sum": f"SELECT CAST(sum({PRICE}) AS BIGINT) AS cents FROM {{orders}}",
    "medium_group": "SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderstatus",
    "reference_two_columns": "SELECT n_nationkey, n_name FROM {nation}",
    "reference_count": "SELECT count(*) AS n FROM {region}",
    "join_dimension": f"SELECT p_brand, count(*) AS n FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey WHERE l_shipdate >= {MONTH} GROUP BY p_brand",
    "join_current": f"SELECT v.o_orderpriority AS p, CAST(sum({LINE}) AS BIGINT) AS cents FROM {{lineitem}} JOIN ({VERSIONS}) v ON v.version_key = l_orderkey WHERE v.is_current GROUP BY v.o_orderpriority",
    "join_reference": "SELECT r_name, count(*) AS n FROM {nation} JOIN {region} ON r_regionkey = n_regionkey GROUP BY r_name",
    "day_sum": f"SELECT CAST(sum({LINE}) AS BIGINT) AS cents FROM {{lineitem}} WHERE l_shipdate = {DAY}",
    "day_keys": f"SELECT l_orderkey, l_returnflag FROM {{lineitem}} WHERE l_shipdate = {DAY}",
    "day_wide": f"SELECT * FROM {{lineitem}} WHERE l_shipdate = {DAY}",
    "range_month_sum": f"SELECT CAST(sum({cents('l_extendedprice * l_discount')}) AS BIGINT) AS fee FROM {{lineitem}} WHERE l_shipdate >= {MONTH}",
    "range_after_two_columns": f"SELECT l_returnflag, l_extendedprice FROM {{lineitem}} WHERE l_shipdate > {DAY}",
    "full_group_status": "SELECT l_linestatus, count(*) AS n FROM {lineitem} GROUP BY l_linestatus",
    "basket_day_count": f"SELECT count(*) AS n FROM {{orders}} WHERE o_orderdate = {DAY}",
    "basket_day_group": f"SELECT o_orderpriority, count(*) AS n FROM {{orders}} WHERE o_orderdate = {DAY} GROUP BY o_orderpriority",
    "basket_range_count": f"SELECT count(*) AS n FROM {{orders}} WHERE o_orderdate >= {MONTH}",
    "basket_day_sum": f"SELECT CAST(sum({PRICE}) AS BIGINT) AS cents FROM {{orders}} WHERE o_orderdate = {DAY}",
    "basket_full_count": "SELECT count(*) AS n FROM {orders}",
    "dimension_segment": "SELECT c_mktsegment, count(*) AS n FROM {customer} GROUP BY c_mktsegment",
    "dimension_nation": "SELECT c_nationkey, count(*) AS n FROM {customer} GROUP BY c_nationkey",
    "dimension_customers": "SELECT count(*) AS n FROM {customer}",
    "dimension_brand": "SELECT p_brand, count(*) AS n FROM {part} GROUP BY p_brand",
    "dimension_size": "SELECT p_size, count(*) AS n FROM {part} GROUP BY p_size",
    "dimension_type": "SELECT p_type, count(*) AS n FROM {part} GROUP BY p_type",
    "dimension_supplier_nation": "SELECT s_nationkey, count(*) AS n FROM {supplier} GROUP BY s_nationkey",
    "dimension_event_types": "SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type",
    "dimension_events": "SELECT count(*) AS n FROM {events}",
    "medium_two_sums": f"SELECT CAST(sum({PRICE}) AS BIGINT) AS cents, count(*) AS n FROM {{orders}} WHERE o_orderdate >= {MONTH}",
    "medium_priority": "SELECT o_orderpriority, count(*) AS n FROM {orders} GROUP BY o_orderpriority",
    "medium_suppliers": "SELECT count(*) AS n FROM {supplier}",
    "medium_documents": "SELECT count(*) AS n FROM {documents}",
    "medium_languages": "SELECT lang, count(*) AS n FROM {documents} GROUP BY lang",
    "medium_sources": "SELECT source, count(*) AS n FROM {documents} GROUP BY source",
    "medium_labels": "SELECT toxic, quality, count(*) AS n FROM {labels} GROUP BY toxic, quality",
    "medium_turns": "SELECT role, count(*) AS n FROM {conversations} GROUP BY role",
    "reference_region": "SELECT r_regionkey, r_name FROM {region}",
    "reference_nation_region": "SELECT n_nationkey, n_regionkey FROM {nation}",
    "reference_names": "SELECT n_name, n_regionkey FROM {nation} WHERE n_regionkey < 3",
    "join_supplier": f"SELECT s_nationkey, count(*) AS n FROM {{lineitem}} JOIN {{supplier}} ON s_suppkey = l_suppkey WHERE l_shipdate = {DAY} GROUP BY s_nationkey",
    "join_customer": f"SELECT c_nationkey, count(*) AS n FROM {{orders}} JOIN {{customer}} ON c_custkey = o_custkey WHERE o_orderdate = {DAY} GROUP BY c_nationkey",
}
for _key, _text in CALIBRATION.items():
    case(f"calibration_{_key}", _text)
