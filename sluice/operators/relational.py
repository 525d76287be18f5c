"""Projection, filter, sorting, set operations, predicates, literals and nested constructors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.registry import case, query, table

case("scan_project_filter", "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' AND l_quantity < 10")
case("select_star", "SELECT * FROM {nation}")
case("subquery_from", "SELECT t.k AS k, t.n AS n FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY c_nationkey) AS t WHERE t.n > 3")
case("group_by_ordinal", "SELECT o_orderpriority, count(*) AS n FROM {orders} GROUP BY 1")
case("having_floor", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) >= 5")
case("order_nulls_last", "SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM {orders} ORDER BY p ASC NULLS LAST, o_orderkey DESC LIMIT 50")
case("topk_offset", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
case("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}")
case("with_cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey), top AS (SELECT * FROM big WHERE n > 12) SELECT c.c_name AS name, t.n AS n FROM top t JOIN {customer} c ON c.c_custkey = t.o_custkey")
case("set_union_all", "SELECT n_regionkey AS k FROM {nation} UNION ALL SELECT r_regionkey AS k FROM {region}")
case("set_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}")
case("set_except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey AS k FROM {supplier}")
case("set_except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey AS k FROM {supplier}")
case("set_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey AS k FROM {supplier}")
case("set_intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey AS k FROM {supplier}")
case("inline_values", "SELECT v.a AS a, v.b AS b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)")
case(
    "literals_and_casts",
    "SELECT o_orderkey, CAST(1.50 AS DOUBLE) AS d, TRUE AS t, CAST(NULL AS BIGINT) AS nothing, CAST(o_totalprice AS BIGINT) - CAST(o_totalprice AS BIGINT) AS zero, CAST(o_orderkey AS STRING) AS s, CAST('12' AS INT) + 1 AS i, o_orderkey::double AS cast2 FROM {orders}",
    "SELECT o_orderkey, CAST(1.50 AS DOUBLE) AS d, TRUE AS t, CAST(NULL AS BIGINT) AS nothing, CAST(o_totalprice AS BIGINT) - CAST(o_totalprice AS BIGINT) AS zero, CAST(o_orderkey AS VARCHAR) AS s, CAST('12' AS INT) + 1 AS i, o_orderkey::double AS cast2 FROM {orders}",
)
case("try_cast_values", "SELECT event_id, TRY_CAST(event_type AS BIGINT) AS n, TRY_CAST(substring(props, 7, 1) AS INT) AS first_digit FROM {events}")
case("interval_arithmetic", "SELECT o_orderkey, o_orderdate + INTERVAL 90 DAY AS later, o_orderdate - INTERVAL 3 MONTH AS earlier FROM {orders}")
case("case_if", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code, if(o_orderstatus = 'P', 'partial', 'other') AS kind FROM {orders}")
case("coalesce_nullif", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'was O') AS status, nullif(o_orderpriority, '5-LOW') AS priority FROM {orders}")
case(
    "predicate_suite",
    """SELECT p_partkey, p_size BETWEEN 10 AND 20 AS is_between, p_size IN (1, 5, 9) AS is_in, p_brand LIKE '%#1%' AS is_like,
    p_type ILIKE '%BRASS%' AS is_ilike, p_name IS NULL AS is_null, p_name IS NOT NULL AS not_null, NOT (p_size > 25) AS negated,
    p_size > 5 AND p_retailprice < 1500 AS both, p_size < 3 OR p_size > 48 AS either, p_size <> 7 AS differs, p_size >= 7 AS ge, p_size <= 7 AS le FROM {part}""",
)
case("null_safe_compare", "SELECT p_partkey, nullif(p_size, 7) IS NOT DISTINCT FROM nullif(p_size, 8) AS same, nullif(p_size, 7) IS DISTINCT FROM p_size AS changed FROM {part}")
case("arithmetic", "SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS added, l_partkey - l_suppkey AS taken, l_partkey * 3 AS times, l_partkey / nullif(l_suppkey, 0) AS ratio, l_partkey % 7 AS rest, -l_partkey AS negative, pow(l_linenumber, 2) AS squared FROM {lineitem}")
case("integer_division", "SELECT l_orderkey, l_partkey, CAST(l_partkey div 7 AS BIGINT) AS whole FROM {lineitem}", "SELECT l_orderkey, l_partkey, CAST(l_partkey // 7 AS BIGINT) AS whole FROM {lineitem}")
case(
    "bitwise_suite",
    "SELECT l_orderkey, l_partkey, l_partkey & 255 AS a, l_partkey | 256 AS o, l_partkey ^ 255 AS x, ~l_partkey AS n, shiftleft(l_partkey, 2) AS l, shiftright(l_partkey, 2) AS r FROM {lineitem}",
    "SELECT l_orderkey, l_partkey, l_partkey & 255 AS a, l_partkey | 256 AS o, xor(l_partkey, 255) AS x, ~l_partkey AS n, l_partkey << 2 AS l, l_partkey >> 2 AS r FROM {lineitem}",
)
case(
    "dotted_quad",
    "SELECT l_orderkey, l_partkey, concat_ws('.', CAST(shiftright(a, 24) & 255 AS STRING), CAST(shiftright(a, 16) & 255 AS STRING), CAST(shiftright(a, 8) & 255 AS STRING), CAST(a & 255 AS STRING)) AS address FROM (SELECT l_orderkey, l_partkey, l_partkey * 65599 + l_orderkey AS a FROM {lineitem}) AS t",
    "SELECT l_orderkey, l_partkey, concat_ws('.', CAST((a >> 24) & 255 AS VARCHAR), CAST((a >> 16) & 255 AS VARCHAR), CAST((a >> 8) & 255 AS VARCHAR), CAST(a & 255 AS VARCHAR)) AS address FROM (SELECT l_orderkey, l_partkey, l_partkey * 65599 + l_orderkey AS a FROM {lineitem}) AS t",
)
case(
    "array_struct_bracket",
    "SELECT c_custkey, array(c_nationkey, 7, 9)[0] AS first_item, element_at(array(c_nationkey, 7, 9), 3) AS third, slice(array(1, 2, 3, 4), 2, 2)[1] AS cut, named_struct('k', c_custkey, 'v', c_mktsegment).v AS field FROM {customer}",
    "SELECT c_custkey, [c_nationkey, 7, 9][1] AS first_item, [c_nationkey, 7, 9][3] AS third, [1, 2, 3, 4][2:3][2] AS cut, struct_pack(k := c_custkey, v := c_mktsegment).v AS field FROM {customer}",
)
case("tuple_in", "SELECT o_orderkey FROM {orders} WHERE (o_orderstatus, o_orderpriority) IN (('F', '1-URGENT'), ('O', '5-LOW'))")
case("exists_semi", "SELECT c_custkey, c_name FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_shipdate) <= 2")
def qualify_topk_per_group(spark, folder):
    """Spark has no QUALIFY: the window's column is filtered, which the optimizer turns into a limit in each group."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_partkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate")
    rows = table(spark, folder, "lineitem").withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    return rows.select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
