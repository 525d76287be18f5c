"""Joins: hash and sort-merge equi-joins of every kind, range, as-of, non-equi, cross and recursive ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.registry import case, query, table

case("join_inner", "SELECT o.o_orderkey AS o_orderkey, c.c_name AS c_name, n.n_name AS n_name FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey WHERE o.o_totalprice > 200000")
case("join_using", "SELECT a.n AS n_orders, b.n AS n_pairs, o_custkey FROM (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) a JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM {orders} GROUP BY o_custkey) b USING (o_custkey)")
case("join_left_residual", "SELECT o.o_orderkey AS o_orderkey, count(l.l_orderkey) AS returned FROM {orders} o LEFT JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R' GROUP BY o.o_orderkey")
case("join_right", "SELECT n.n_name AS n_name, count(s.s_suppkey) AS n FROM {supplier} s RIGHT JOIN {nation} n ON n.n_nationkey = s.s_nationkey GROUP BY n.n_name")
case("join_full", "SELECT a.k AS ak, b.k AS bk FROM (SELECT DISTINCT c_nationkey AS k FROM {customer} WHERE c_nationkey < 15) a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM {supplier} WHERE s_nationkey > 5) b ON a.k = b.k")
case("join_self_next", "SELECT a.o_orderkey AS o_orderkey, count(b.o_orderkey) AS within_week FROM {orders} a LEFT JOIN {orders} b ON b.o_custkey = a.o_custkey AND b.o_orderdate > a.o_orderdate AND b.o_orderdate <= a.o_orderdate + INTERVAL 7 DAY GROUP BY a.o_orderkey")
case("anti_not_exists", "SELECT o_orderkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey)")
case("anti_left_join_null", "SELECT o.o_orderkey AS o_orderkey FROM {orders} o LEFT JOIN (SELECT DISTINCT l_orderkey FROM {lineitem}) l ON l.l_orderkey = o.o_orderkey WHERE l.l_orderkey IS NULL")
case("semi_in", "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 45)")
case("correlated_scalar", "SELECT c_custkey, c_acctbal FROM {customer} c WHERE c_acctbal > (SELECT avg(d.c_acctbal) FROM {customer} d WHERE d.c_nationkey = c.c_nationkey)")
case("cross_small", "SELECT r.r_name AS r_name, n.n_name AS n_name FROM {region} r CROSS JOIN {nation} n")
case("cross_one_row", "SELECT o_orderkey FROM {orders}, (SELECT max(o_orderdate) AS last FROM {orders}) AS anchor WHERE o_orderdate > last - INTERVAL 30 DAY")
case("stage_expansion", "SELECT o_orderkey, stage FROM {orders} CROSS JOIN (VALUES (1), (2), (3)) AS s(stage) WHERE stage <= 1 + o_orderkey % 3")
case(
    "recursive_hierarchy",
    """WITH RECURSIVE up AS (SELECT n_nationkey AS node, n_nationkey AS cur, 0 AS depth FROM {nation} UNION ALL
    SELECT up.node, CAST(floor((up.cur - 1) / 2) AS INT), up.depth + 1 FROM up WHERE up.cur > 0 AND up.depth < 12)
    SELECT node, max_by(cur, depth) AS root, max(depth) AS depth FROM up GROUP BY node""",
    """WITH RECURSIVE up AS (SELECT n_nationkey AS node, n_nationkey AS cur, 0 AS depth FROM {nation} UNION ALL
    SELECT up.node, CAST(floor((up.cur - 1) / 2) AS INT), up.depth + 1 FROM up WHERE up.cur > 0 AND up.depth < 12)
    SELECT node, arg_max(cur, depth) AS root, max(depth) AS depth FROM up GROUP BY node""",
)


def range_join(points: DataFrame, blocks: DataFrame, point: str, start: str, stop: str, width: int) -> DataFrame:
    """Rows of ``points`` with the rows of ``blocks`` whose [start, stop] holds the point: an equi-join on cells of ``width``
    and the comparison as a residual, in place of a nested loop. A block is repeated for each cell that it touches, so choose
    ``width`` about as wide as blocks are; any width gives the same rows."""
    cells = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))
    spread = blocks.withColumn("__cell", F.explode(cells))
    found = points.withColumn("__cell", F.floor(F.col(point) / width)).join(spread, "__cell")
    return found.where(F.col(point).between(F.col(start), F.col(stop))).drop("__cell")


@query("SELECT l_orderkey, l_partkey, b AS block, b * 10 AS block_start FROM {lineitem} JOIN (SELECT unnest(range(0, 100000)) AS b) AS blocks ON l_partkey BETWEEN b * 10 AND b * 10 + 9")
def range_join_blocks(spark, folder):
    blocks = spark.range(100_000).select(F.col("id").alias("block"), (F.col("id") * 10).alias("block_start"), (F.col("id") * 10 + 9).alias("block_stop"))
    found = range_join(table(spark, folder, "lineitem").select("l_orderkey", "l_partkey"), blocks, "l_partkey", "block_start", "block_stop", 10)
    return found.select("l_orderkey", "l_partkey", "block", "block_start")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` with the same keys and ``at`` no later: one union and one window
    on the keys in place of an inequality join. Of right rows at one time the largest values win."""
    marked = left.withColumns({"__side": F.lit(1), **{f"__{v}": F.lit(None).cast(right.schema[v].dataType) for v in values}})
    own = right.select(*keys, at, F.lit(0).alias("__side"), *[F.col(v).alias(f"__{v}") for v in values])
    both = marked.unionByName(own, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(at, "__side", *[f"__{v}" for v in values]).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last(F.when(F.col("__side") == 0, F.struct(*[F.col(f"__{v}") for v in values])), ignorenulls=True).over(order)
    found = both.withColumn("__last", filled).where("__side = 1")
    return found.select(*left.columns, *[F.col(f"__last.__{v}").alias(v) for v in values])


@query("SELECT e.event_id AS event_id, e.user_id AS user_id, r.event_id AS rate_event, r.value AS rate FROM {events} e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM {events} WHERE event_type = 'purchase' GROUP BY user_id, ts) r ON r.user_id = e.user_id AND e.ts >= r.ts")
def asof_previous(spark, folder):
    events = table(spark, folder, "events")
    rates = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("rate_event"), F.col("value").alias("rate"))
    return asof_join(events.select("event_id", "user_id", "ts"), rates, ["user_id"], "ts", ["rate_event", "rate"]).select("event_id", "user_id", "rate_event", "rate")


@query(
    """WITH days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS d)
    SELECT a.d AS d, min(b.d) AS next_business_day FROM days a JOIN days b ON b.d >= a.d AND b.d < a.d + 7 AND isodow(b.d) < 6 GROUP BY a.d"""
)
def business_day_roll(spark, folder):
    """The next business day of each day, from the week that begins with it: no row looks at another."""
    last = F.lit("2001-12-31").cast("date")
    days = spark.range(1).select(F.explode(F.sequence(F.lit("1995-01-01").cast("date"), last)).alias("d"))
    week = F.sequence(F.col("d"), F.least(last, F.date_add("d", 6)))
    rolled = days.withColumn("next_business_day", F.get(F.filter(week, lambda d: F.dayofweek(d).between(2, 6)), F.lit(0)))
    return rolled.where("next_business_day IS NOT NULL")
