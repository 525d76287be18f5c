"""Window functions and frames."""

from __future__ import annotations

from sluice.registry import case, cents

_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
case(
    "win_ranking",
    "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS r, dense_rank() OVER v AS dr, percent_rank() OVER v AS pr, cume_dist() OVER v AS cd, ntile(4) OVER w AS bucket FROM {orders} WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey), v AS (PARTITION BY o_orderpriority ORDER BY o_orderstatus)",
    "SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER v AS INT) AS r, CAST(dense_rank() OVER v AS INT) AS dr, percent_rank() OVER v AS pr, cume_dist() OVER v AS cd, CAST(ntile(4) OVER w AS INT) AS bucket FROM {orders} WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey), v AS (PARTITION BY o_orderpriority ORDER BY o_orderstatus)",
)
case(
    "win_analytic",
    f"SELECT o_orderkey, lag(o_orderkey, 1) {_W} AS before, lead(o_orderkey, 1, -1) {_W} AS after, first_value(o_orderkey) {_W} AS first_key, last_value(o_orderkey) {_W} AS last_key, nth_value(o_orderkey, 2) {_W} AS second_key FROM {{orders}}",
)
case(
    "win_frames",
    f"""SELECT o_orderkey, CAST(sum({cents('o_totalprice')}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running,
    count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near,
    max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS earlier_max FROM {{orders}}""",
)
case("win_range_frame", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_partkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM {lineitem}")
# A total of one row is joined: a window over everything would bring all rows into one task.
case("share_of_total", f"WITH t AS (SELECT s_name, CAST(sum({cents('l_extendedprice')}) AS BIGINT) AS cents FROM {{lineitem}} JOIN {{supplier}} ON s_suppkey = l_suppkey GROUP BY s_name), total AS (SELECT sum(cents) AS every FROM t) SELECT s_name, cents, CAST(cents AS DOUBLE) / CAST(every AS DOUBLE) AS share FROM t CROSS JOIN total ORDER BY cents DESC, s_name LIMIT 10")
case(
    "month_over_month",
    f"SELECT m, cents, cents - lag(cents) OVER (ORDER BY m) AS change FROM (SELECT date_format(o_orderdate, 'yyyy-MM') AS m, CAST(sum({cents('o_totalprice')}) AS BIGINT) AS cents FROM {{orders}} GROUP BY 1) AS t",
    f"SELECT m, cents, cents - lag(cents) OVER (ORDER BY m) AS change FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m, CAST(sum({cents('o_totalprice')}) AS BIGINT) AS cents FROM {{orders}} GROUP BY 1) AS t",
)
case(
    "session_gap",
    """SELECT user_id, session_no, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (
    SELECT user_id, ts, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_no FROM (
    SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM {events}) AS a) AS b GROUP BY user_id, session_no""",
)
