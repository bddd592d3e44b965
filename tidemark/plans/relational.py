"""Registered relational queries: SQL over the tables, and the SQL that checks each (the same text where both engines agree)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.tables import run_sql

Query = Callable[[SparkSession, str], DataFrame]

#: name: (Spark SQL, DuckDB SQL or None where it is the same)
STATEMENTS: dict[str, tuple[str, str | None]] = {
    "zone_summary": ("""
        SELECT n_name AS zone, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean_price
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE o_orderstatus <> 'P' GROUP BY n_name HAVING count(*) > 5 ORDER BY total DESC, zone LIMIT 10""", None),
    "rel_full_scan": ("SELECT * FROM nation", None),
    "rel_point_lookup": ("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42", None),
    "rel_projection": ("SELECT o_orderkey AS id, o_totalprice * 2 AS double_price, -o_totalprice AS negative, o_orderkey % 7 AS m, o_orderstatus || '/' || o_orderpriority AS tag FROM orders", None),
    "rel_case_cast": ("""
        SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
            CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS status_code,
            try_cast(substring(o_orderpriority, 1, 1) AS BIGINT) AS priority, try_cast(o_orderstatus AS BIGINT) AS no_number
        FROM orders""", None),
    "rel_filter_predicates": ("""
        SELECT c_custkey, c_name FROM customer
        WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 5000 AND c_name LIKE '%1%' AND NOT (c_nationkey = 3) AND c_name IS NOT NULL""", None),
    "rel_not_predicates": ("SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING') AND c_acctbal NOT BETWEEN 0 AND 5000 AND c_name NOT LIKE '%9'", None),
    "rel_is_true_false": ("SELECT c_custkey, (c_acctbal > 0) IS TRUE AS positive, (nullif(c_nationkey, 3) > 10) IS NOT FALSE AS not_low FROM customer", None),
    "rel_ilike": ("SELECT p_partkey, p_name FROM part WHERE p_type ILIKE '%conom%' OR p_name ILIKE '%RED_w%'", None),
    "rel_bitwise": (
        "SELECT p_partkey, p_size & 6 AS b_and, p_size | 8 AS b_or, p_size ^ 5 AS b_xor, shiftleft(p_size, 2) AS b_left, shiftright(p_size, 1) AS b_right FROM part",
        "SELECT p_partkey, p_size & 6 AS b_and, p_size | 8 AS b_or, xor(p_size, 5) AS b_xor, CAST(p_size << 2 AS INT) AS b_left, CAST(p_size >> 1 AS INT) AS b_right FROM part"),
    "rel_json_path": (
        "SELECT event_id, try_cast(get_json_object(props, '$.k') AS BIGINT) AS k FROM events",
        "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "rel_fromless": ("SELECT 1 + 2 AS three, 'a' || 'b' AS ab", None),
    "rel_values": ("SELECT column1, column2 FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(column1, column2)", None),
    "rel_join_inner": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 150000", None),
    "rel_join_left": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000", None),
    "rel_join_right": ("SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'", None),
    "rel_join_full": ("""
        SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_suppkey * 3 = c_custkey * 2""", None),
    "rel_join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "rel_join_comma": ("SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey", None),
    "rel_join_theta": ("""
        SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""", None),
    "rel_join_null_keys": (
        "SELECT a.k, sum(n) AS customers, count(*) AS suppliers FROM (SELECT nullif(c_nationkey, 3) AS k, count(*) AS n FROM customer GROUP BY 1) a JOIN (SELECT s_suppkey, nullif(s_nationkey, 3) AS k FROM supplier) b ON a.k <=> b.k GROUP BY a.k",
        "SELECT a.k, sum(n)::BIGINT AS customers, count(*) AS suppliers FROM (SELECT nullif(c_nationkey, 3) AS k, count(*) AS n FROM customer GROUP BY 1) a JOIN (SELECT s_suppkey, nullif(s_nationkey, 3) AS k FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k GROUP BY a.k"),
    "rel_semi_exists": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 200000)", None),
    "rel_anti_not_exists": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 300000)", None),
    "rel_not_in_nulls": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM (SELECT nullif(s_nationkey, 3) AS k FROM supplier WHERE s_acctbal > 9000) s WHERE s.k = c.c_nationkey)",
        "SELECT c_custkey FROM customer WHERE NOT coalesce(c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000 AND s_nationkey <> 3), false)"),
    "rel_qualified_star": ("SELECT n.*, r_name FROM nation n JOIN region r ON n_regionkey = r_regionkey", None),
    "rel_distinct_order": ("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer ORDER BY c_nationkey DESC, c_mktsegment", None),
    "rel_first_of_group": ("SELECT c_nationkey, min_by(c_name, c_custkey) AS first_name, count(*) AS n FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, arg_min(c_name, c_custkey) AS first_name, count(*) AS n FROM customer GROUP BY c_nationkey"),
    "rel_join_range": ("""
        WITH bands AS (SELECT n_nationkey AS band, n_nationkey * 15000D AS lo, n_nationkey * 15000D + 40000 AS hi FROM nation),
        cells AS (SELECT *, explode(sequence(floor(lo / 10000), floor(hi / 10000))) AS cell FROM bands)
        SELECT o_orderkey, band FROM orders JOIN cells ON floor(o_totalprice / 10000) = cell AND o_totalprice >= lo AND o_totalprice < hi""",
        "SELECT o_orderkey, n_nationkey AS band FROM orders JOIN nation ON o_totalprice >= n_nationkey * 15000.0::DOUBLE AND o_totalprice < n_nationkey * 15000.0::DOUBLE + 40000"),
    "rel_in_subquery": ("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", None),
    "rel_scalar_subquery": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)", None),
    "rel_correlated_subquery": ("SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40) AS n FROM part", None),
    "rel_derived_table": ("SELECT zone, max(n) AS most FROM (SELECT c_nationkey AS zone, c_mktsegment, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) t GROUP BY zone", None),
    "rel_group_expr": ("SELECT o_orderkey % 5 AS bucket, o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders GROUP BY o_orderkey % 5, o_orderstatus", None),
    "rel_global_agg": ("SELECT count(*) AS n, count(nullif(l_returnflag, 'A')) AS n_not_a, round(sum(l_extendedprice), 2) AS total, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_discount), 6) AS mean FROM lineitem", None),
    "rel_agg_empty": ("SELECT count(*) AS n, sum(o_totalprice) AS total, max(o_orderstatus) AS top FROM orders WHERE o_orderkey < 0", None),
    "rel_count_distinct": ("SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_supp, count(DISTINCT l_partkey) AS n_part FROM lineitem GROUP BY l_returnflag", None),
    "rel_agg_distinct": ("SELECT l_returnflag, sum(DISTINCT l_quantity) AS s, avg(DISTINCT l_quantity) AS a FROM lineitem GROUP BY l_returnflag", None),
    "rel_having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND min(o_totalprice) < 50000", None),
    "rel_agg_arithmetic": ("SELECT o_orderstatus, round(sum(o_totalprice) / count(*), 4) AS mean, max(o_orderkey) - min(o_orderkey) AS span FROM orders GROUP BY o_orderstatus", None),
    "rel_null_group": ("SELECT nullif(o_orderstatus, 'F') AS status, count(*) AS n FROM orders GROUP BY nullif(o_orderstatus, 'F')", None),
    "rel_distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "rel_order_limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10", None),
    "rel_order_ordinal": ("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1", None),
    "rel_nulls_first": ("SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k ASC NULLS FIRST, c_custkey", None),
    "rel_nulls_last": ("SELECT c_custkey, nullif(c_nationkey, 24) AS k FROM customer ORDER BY k DESC NULLS LAST, c_custkey", None),
    "rel_union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "rel_union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "rel_intersect_except": ("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2", None),
    "rel_pricing_summary": ("""
        SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
            round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""", """
        SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
            round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""),
    "rel_latency_stats": ("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type", None),
    "rel_histogram": (
        "SELECT event_type, width_bucket(value, 0, 100, 10) AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type, width_bucket(value, 0, 100, 10)",
        "SELECT event_type, CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 11 ELSE floor(value / 10) + 1 END AS BIGINT) AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2"),
}


def _query(text: str) -> Query:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, text)


def params_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bound parameters."""
    return run_sql(spark, sf_dir, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = ? AND o_totalprice > ?", [25, 1000.0])


def queries() -> dict[str, Query]:
    return {name: _query(text) for name, (text, _) in STATEMENTS.items()} | {"rel_parameters": params_query}


def oracle_sql() -> dict[str, str]:
    return {name: other or text for name, (text, other) in STATEMENTS.items()} | {"rel_parameters": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 25 AND o_totalprice > 1000.0"}
