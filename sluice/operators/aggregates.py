"""Aggregate functions: exact, statistical, ordered-set, collecting, approximate, and with FILTER."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.registry import case, cents, query, table

case(
    "agg_pricing_summary",
    f"""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, CAST(sum({cents('l_extendedprice')}) AS BIGINT) AS sum_cents,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS avg_qty, count(*) AS n FROM {{lineitem}} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
case("agg_basic", f"SELECT count(*) AS n, count(o_orderpriority) AS n_p, count(DISTINCT o_custkey) AS n_c, CAST(sum({cents('o_totalprice')}) AS BIGINT) AS total, min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg({cents('o_totalprice')}) AS mean_cents FROM {{orders}}")
case("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS line_numbers FROM {lineitem} GROUP BY l_returnflag")
case("agg_stats", "SELECT p_brand, round(stddev(p_size), 6) AS sd, round(stddev_pop(p_size), 6) AS sd_pop, round(stddev_samp(p_size), 6) AS sd_samp, round(var_samp(p_size), 6) AS v, round(var_pop(p_size), 6) AS v_pop FROM {part} GROUP BY p_brand")
case("agg_pairs", "SELECT l_returnflag, round(corr(l_quantity, l_linenumber), 6) AS r, round(covar_pop(l_quantity, l_linenumber), 6) AS c_pop, round(covar_samp(l_quantity, l_linenumber), 6) AS c_samp FROM {lineitem} GROUP BY l_returnflag")
case("agg_median", "SELECT l_returnflag, median(l_quantity) AS mid FROM {lineitem} GROUP BY l_returnflag")
case(
    "agg_percentiles",
    "SELECT l_returnflag, percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90, CAST(percentile_disc(0.25) WITHIN GROUP (ORDER BY l_linenumber) AS INT) AS p25 FROM {lineitem} GROUP BY l_returnflag",
    "SELECT l_returnflag, quantile_cont(l_quantity, 0.9) AS p90, CAST(quantile_disc(l_linenumber, 0.25) AS INT) AS p25 FROM {lineitem} GROUP BY l_returnflag",
)
case(
    "agg_quantile",
    "SELECT p_brand, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY p_size) AS INT) AS q FROM {part} GROUP BY p_brand",
    "SELECT p_brand, CAST(quantile(p_size, 0.5) AS INT) AS q FROM {part} GROUP BY p_brand",
)
case("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) AS n, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / count(*) AS rate FROM {orders} GROUP BY o_orderpriority")
case(
    "agg_string",
    "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey",
)
case(
    "agg_array",
    "SELECT n_regionkey, concat_ws('|', sort_array(collect_list(n_name))) AS names, size(collect_list(n_name)) AS n FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), '|') AS names, CAST(len(list(n_name)) AS INT) AS n FROM {nation} GROUP BY n_regionkey",
)
case("agg_any_value", "SELECT o_custkey, any_value(c_name) AS name, count(*) AS n FROM {orders} JOIN {customer} ON c_custkey = o_custkey GROUP BY o_custkey")
case("agg_bool", "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, bool_and(l_quantity > 5) AS all_large FROM {lineitem} GROUP BY l_orderkey")
case("agg_arg_max", "SELECT o_custkey, max_by(o_orderkey, o_orderdate) AS last_order FROM (SELECT o_custkey, o_orderkey, o_orderdate FROM {orders}) AS t GROUP BY o_custkey HAVING count(*) = count(DISTINCT o_orderdate)", "SELECT o_custkey, arg_max(o_orderkey, o_orderdate) AS last_order FROM orders GROUP BY o_custkey HAVING count(*) = count(DISTINCT o_orderdate)")
case("agg_mode", "SELECT user_id, max_by(event_type, struct(n, event_type)) AS usual FROM (SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY user_id, event_type) AS t GROUP BY user_id", "SELECT user_id, event_type AS usual FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) AS t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type DESC) = 1")
case("agg_global_empty", "SELECT count(*) AS n, max(o_totalprice) AS hi FROM {orders} WHERE o_orderkey < 0")


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(*) AS n, true AS parts_close, true AS mid_close FROM {lineitem} GROUP BY l_returnflag")
def agg_approx(spark, folder):
    """Sketches beside the exact figures: the distinct count within three standard errors, the median within the sketch's
    share of ranks."""
    lines = table(spark, folder, "lineitem")
    rough = lines.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.03).alias("about"), F.percentile_approx("l_quantity", 0.5, 1000).alias("mid"), F.countDistinct("l_partkey").alias("parts"), F.count(F.lit(1)).alias("n"))
    ranks = lines.join(F.broadcast(rough.select("l_returnflag", "mid")), "l_returnflag").groupBy("l_returnflag").agg(F.avg((F.col("l_quantity") < F.col("mid")).cast("int")).alias("below"), F.avg((F.col("l_quantity") <= F.col("mid")).cast("int")).alias("upto"))
    close = F.abs(F.col("about") - F.col("parts")) <= 0.09 * F.col("parts")
    return rough.join(ranks, "l_returnflag").select("l_returnflag", "parts", "n", close.alias("parts_close"), ((F.col("below") <= 0.501) & (F.col("upto") >= 0.499)).alias("mid_close"))
