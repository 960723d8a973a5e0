"""The SQL surface (Q1-Q18) and the ad-hoc SQL operators.

Q queries are what a user passes as SQL text; they run on Spark SQL over the
fixture tables registered as views.  Each has a DuckDB oracle written in
DuckDB's own dialect (the two differ in date functions, VALUES, PIVOT and
null ordering, so the texts are not shared).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..operators import adhoc
from ..operators.asof import asof_previous
from ..operators.hierarchy import roots
from ..operators.prefix import moving, running
from ..operators.quantiles import quantiles
from ..operators.rangejoin import interval_join
from ..operators.rowindex import row_index
from ..session import spread
from ..sources.tables import Tables, register_views
from .registry import check


def _sql(name: str, spark_sql: str, duck_sql: str) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(spark, sf_dir)
        return spark.sql(spark_sql)

    build.__name__ = name
    check(name, oracle=duck_sql)(build)


_sql(
    "q01_filter_predicates",
    """
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag, l_linestatus,
           CAST(l_quantity AS BIGINT) AS qty,
           round(l_extendedprice * (1 - l_discount), 4) AS net,
           CASE WHEN l_discount >= 0.05 THEN 'high' ELSE 'low' END AS discount_band,
           date_format(l_shipdate, 'yyyy-MM-dd') AS ship_day
    FROM lineitem
    WHERE l_returnflag IN ('R', 'A')
      AND l_shipdate BETWEEN DATE'1996-01-01' AND DATE'1996-12-31'
      AND l_linestatus LIKE 'F%'
    """,
    """
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag, l_linestatus,
           CAST(l_quantity AS BIGINT) AS qty,
           round(l_extendedprice * (1 - l_discount), 4) AS net,
           CASE WHEN l_discount >= 0.05 THEN 'high' ELSE 'low' END AS discount_band,
           strftime(l_shipdate, '%Y-%m-%d') AS ship_day
    FROM lineitem
    WHERE l_returnflag IN ('R', 'A')
      AND l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'
      AND l_linestatus LIKE 'F%'
    """,
)

_sql(
    "q02_group_having",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n_lines, round(sum(l_quantity), 2) AS sum_qty,
           CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))), 2) AS DOUBLE) AS revenue,
           round(avg(l_discount), 6) AS avg_disc, round(max(l_tax), 6) AS max_tax
    FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 100
    """,
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n_lines, round(sum(l_quantity), 2) AS sum_qty,
           CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))), 2) AS DOUBLE) AS revenue,
           round(avg(l_discount), 6) AS avg_disc, round(max(l_tax), 6) AS max_tax
    FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 100
    """,
)

_sql(
    "q03_join_region_revenue",
    """
    SELECT r_name, n_name, round(sum(o_totalprice), 2) AS revenue, count(o_orderkey) AS n_orders
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN orders ON o_custkey = c_custkey
    GROUP BY r_name, n_name
    """,
    """
    SELECT r_name, n_name, round(sum(o_totalprice), 2) AS revenue, count(o_orderkey) AS n_orders
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN orders ON o_custkey = c_custkey
    GROUP BY r_name, n_name
    """,
)

_sql(
    "q03_full_join_labels",
    """
    SELECT CASE WHEN d.doc_id IS NULL THEN 'label_only' WHEN l.doc_id IS NULL THEN 'doc_only' ELSE 'both' END AS side,
           count(*) AS n, CAST(coalesce(sum(l.quality), 0) AS BIGINT) AS n_quality
    FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id
    GROUP BY 1
    """,
    """
    SELECT CASE WHEN d.doc_id IS NULL THEN 'label_only' WHEN l.doc_id IS NULL THEN 'doc_only' ELSE 'both' END AS side,
           count(*) AS n, CAST(coalesce(sum(l.quality), 0) AS BIGINT) AS n_quality
    FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id
    GROUP BY 1
    """,
)

_sql(
    "q02_pricing_summary",
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
           round(sum(l_extendedprice), 2) AS sum_base_price,
           CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))), 2) AS DOUBLE) AS sum_disc_price,
           CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2)))), 2) AS DOUBLE) AS sum_charge,
           round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price,
           round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= DATE'2001-06-30'
    GROUP BY l_returnflag, l_linestatus
    """,
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
           round(sum(l_extendedprice), 2) AS sum_base_price,
           CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))), 2) AS DOUBLE) AS sum_disc_price,
           CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2)))), 2) AS DOUBLE) AS sum_charge,
           round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price,
           round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= DATE '2001-06-30'
    GROUP BY l_returnflag, l_linestatus
    """,
)

_sql(
    "q03_lines_by_brand_and_nation",
    """
    SELECT p_brand, n_name, count(*) AS n_lines,
           CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))), 2) AS DOUBLE) AS revenue, count(DISTINCT o_custkey) AS n_customers
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
         JOIN part ON l_partkey = p_partkey
         JOIN supplier ON l_suppkey = s_suppkey
         JOIN nation ON s_nationkey = n_nationkey
    WHERE o_orderdate >= DATE'1997-01-01' AND o_orderdate < DATE'1999-01-01'
    GROUP BY p_brand, n_name
    """,
    """
    SELECT p_brand, n_name, count(*) AS n_lines,
           CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))), 2) AS DOUBLE) AS revenue, count(DISTINCT o_custkey) AS n_customers
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
         JOIN part ON l_partkey = p_partkey
         JOIN supplier ON l_suppkey = s_suppkey
         JOIN nation ON s_nationkey = n_nationkey
    WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1999-01-01'
    GROUP BY p_brand, n_name
    """,
)

_sql(
    "q04_anti_orders_without_lines",
    """
    SELECT o_orderkey, o_custkey FROM orders o
    WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
    """,
    """
    SELECT o_orderkey, o_custkey FROM orders o
    WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
    """,
)

_sql(
    "q04_anti_no_urgent_1995",
    """
    SELECT c_custkey, c_mktsegment FROM customer c
    WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
                      AND o.o_orderpriority = '1-URGENT' AND year(o.o_orderdate) = 1995)
    """,
    """
    SELECT c_custkey, c_mktsegment FROM customer c
    WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
                      AND o.o_orderpriority = '1-URGENT' AND year(o.o_orderdate) = 1995)
    """,
)

_sql(
    "q04_anti_customers_without_orders",
    """
    SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey
    """,
    """
    SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
    """,
)

_sql(
    "q04_semi_big_spenders",
    """
    SELECT c_custkey, c_name FROM customer c
    WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)
    """,
    """
    SELECT c_custkey, c_name FROM customer c
    WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)
    """,
)

_sql(
    "q05_range_join_price_bands",
    """
    WITH bands AS (SELECT * FROM VALUES (0, 900.0, 925.0), (1, 925.0, 950.0), (2, 950.0, 975.0), (3, 975.0, 1000.0)
                   AS t(band, lo, hi))
    SELECT band, count(*) AS n_parts, round(avg(p_retailprice), 6) AS avg_price
    FROM part JOIN bands ON p_retailprice >= lo AND p_retailprice < hi
    GROUP BY band
    """,
    """
    WITH bands AS (SELECT * FROM (VALUES (0, 900.0, 925.0), (1, 925.0, 950.0), (2, 950.0, 975.0), (3, 975.0, 1000.0))
                   AS t(band, lo, hi))
    SELECT band, count(*) AS n_parts, round(avg(p_retailprice), 6) AS avg_price
    FROM part JOIN bands ON p_retailprice >= lo AND p_retailprice < hi
    GROUP BY band
    """,
)


def q06_asof_last_event_before_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: for each error, the user's latest earlier event (as-of match).

    Not a range join (that emits every earlier event of a user); a sort-based
    as-of over range partitions, see ``operators.asof``.
    """
    ev = Tables(spark, sf_dir).events.select("event_id", "ts", "user_id", "event_type")
    m = asof_previous(ev, by="user_id", order="ts", tiebreak="event_id", probe=F.col("event_type") == "error")
    return m.where(F.col("prev_event_id").isNotNull()).select(
        F.col("event_id").alias("error_id"),
        "user_id",
        "prev_event_id",
        "prev_event_type",
        F.date_format("prev_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("prev_ts"),
    )


check(
    "q06_asof_last_event_before_error",
    oracle="""
    SELECT e.event_id AS error_id, e.user_id, p.event_id AS prev_event_id, p.event_type AS prev_event_type,
           strftime(p.ts, '%Y-%m-%d %H:%M:%S.%f') AS prev_ts
    FROM (SELECT * FROM events WHERE event_type = 'error') e
    ASOF JOIN events p ON e.user_id = p.user_id AND e.ts > p.ts
    """,
)(q06_asof_last_event_before_error)

_sql(
    "q07_top10_customers",
    """
    SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS revenue
    FROM customer JOIN orders ON o_custkey = c_custkey
    GROUP BY c_custkey, c_name ORDER BY sum(o_totalprice) DESC, c_custkey LIMIT 10
    """,
    """
    SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS revenue
    FROM customer JOIN orders ON o_custkey = c_custkey
    GROUP BY c_custkey, c_name ORDER BY sum(o_totalprice) DESC, c_custkey LIMIT 10
    """,
)

# Top 3 per segment with row_number / rank / dense_rank.  The row_number
# filter is applied first (it plans as WindowGroupLimit, so a segment with
# millions of customers never sits in one task); rank and dense_rank of the
# kept rows only depend on rows ranked above them, which are also kept.
_TOP3 = """
    WITH r AS (
      SELECT c_mktsegment, c_custkey, sum(o_totalprice) AS rev
      FROM customer JOIN orders ON o_custkey = c_custkey
      GROUP BY c_mktsegment, c_custkey),
    top AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY rev DESC, c_custkey) AS rn FROM r) x
      WHERE rn <= 3)
    SELECT c_mktsegment, c_custkey, round(rev, 2) AS revenue, CAST(rn AS BIGINT) AS rn,
           CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY rev DESC) AS BIGINT) AS rk,
           CAST(dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY rev DESC) AS BIGINT) AS drk
    FROM top
"""

_sql(
    "q07_top3_per_segment",
    _TOP3,
    """
    SELECT c_mktsegment, c_custkey, revenue, CAST(rn AS BIGINT) AS rn, CAST(rk AS BIGINT) AS rk, CAST(drk AS BIGINT) AS drk
    FROM (
      SELECT c_mktsegment, c_custkey, round(sum(o_totalprice), 2) AS revenue,
             row_number() OVER (PARTITION BY c_mktsegment ORDER BY sum(o_totalprice) DESC, c_custkey) AS rn,
             rank() OVER (PARTITION BY c_mktsegment ORDER BY sum(o_totalprice) DESC) AS rk,
             dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY sum(o_totalprice) DESC) AS drk
      FROM customer JOIN orders ON o_custkey = c_custkey
      GROUP BY c_mktsegment, c_custkey) t
    WHERE rn <= 3
    """,
)

_sql(
    "q08_orders_per_month",
    """
    SELECT date_format(o_orderdate, 'yyyy-MM') AS month, CAST(year(o_orderdate) AS BIGINT) AS yr,
           CAST(month(o_orderdate) AS BIGINT) AS mo, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
    FROM orders GROUP BY 1, 2, 3
    """,
    """
    SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(year(o_orderdate) AS BIGINT) AS yr,
           CAST(month(o_orderdate) AS BIGINT) AS mo, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
    FROM orders GROUP BY 1, 2, 3
    """,
)

_sql(
    "q09_monthly_windows",
    """
    WITH m AS (SELECT date_trunc('MONTH', o_orderdate) AS mon, sum(o_totalprice) AS rev FROM orders GROUP BY 1)
    SELECT date_format(mon, 'yyyy-MM') AS month, round(rev, 2) AS revenue,
           round(lag(rev) OVER (ORDER BY mon), 2) AS prev_revenue,
           round(avg(rev) OVER (ORDER BY mon ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS ma3,
           round(sum(rev) OVER (ORDER BY mon ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running
    FROM m
    """,
    """
    WITH m AS (SELECT date_trunc('month', o_orderdate) AS mon, sum(o_totalprice) AS rev FROM orders GROUP BY 1)
    SELECT strftime(mon, '%Y-%m') AS month, round(rev, 2) AS revenue,
           round(lag(rev) OVER (ORDER BY mon), 2) AS prev_revenue,
           round(avg(rev) OVER (ORDER BY mon ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS ma3,
           round(sum(rev) OVER (ORDER BY mon ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running
    FROM m
    """,
)

_sql(
    "q10_rollup_region_segment",
    """
    SELECT coalesce(r_name, '(all)') AS region, coalesce(c_mktsegment, '(all)') AS segment,
           CAST(grouping(r_name) AS BIGINT) AS g_region, CAST(grouping(c_mktsegment) AS BIGINT) AS g_segment,
           round(sum(o_totalprice), 2) AS revenue, count(*) AS n_orders
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
         JOIN region ON n_regionkey = r_regionkey
    GROUP BY ROLLUP (r_name, c_mktsegment)
    """,
    """
    SELECT coalesce(r_name, '(all)') AS region, coalesce(c_mktsegment, '(all)') AS segment,
           CAST(grouping(r_name) AS BIGINT) AS g_region, CAST(grouping(c_mktsegment) AS BIGINT) AS g_segment,
           round(sum(o_totalprice), 2) AS revenue, count(*) AS n_orders
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
         JOIN region ON n_regionkey = r_regionkey
    GROUP BY ROLLUP (r_name, c_mktsegment)
    """,
)

_sql(
    "q10_cube_flags",
    """
    SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status,
           count(*) AS n_lines, round(sum(l_quantity), 2) AS qty
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
    """,
    """
    SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status,
           count(*) AS n_lines, round(sum(l_quantity), 2) AS qty
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
    """,
)

_sql(
    "q10_grouping_sets_orders",
    """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders
    FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())
    """,
    """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders
    FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())
    """,
)

_sql(
    "q11_distinct_users_per_type",
    """
    SELECT event_type, count(DISTINCT user_id) AS n_users, count(*) AS n_events
    FROM events GROUP BY event_type
    """,
    """
    SELECT event_type, count(DISTINCT user_id) AS n_users, count(*) AS n_events
    FROM events GROUP BY event_type
    """,
)


def q11_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11, approximate form (HyperLogLog++; no exact oracle by nature)."""
    ev = Tables(spark, sf_dir).events
    return ev.groupBy("event_type").agg(F.approx_count_distinct("user_id", rsd=0.02).alias("approx_users"))


check("q11_approx_distinct")(q11_approx_distinct)

_sql(
    "q12_set_operations",
    """
    SELECT 'intersect' AS op, k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer)
    UNION ALL
    SELECT 'except', k FROM (SELECT s_suppkey AS k FROM supplier EXCEPT SELECT l_suppkey FROM lineitem)
    UNION ALL
    SELECT 'except_all', k FROM (SELECT l_orderkey AS k FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders)
    UNION ALL
    SELECT 'union', k FROM (SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region)
    """,
    """
    SELECT 'intersect' AS op, k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer)
    UNION ALL
    SELECT 'except', k FROM (SELECT s_suppkey AS k FROM supplier EXCEPT SELECT l_suppkey FROM lineitem)
    UNION ALL
    SELECT 'except_all', k FROM (SELECT l_orderkey AS k FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders)
    UNION ALL
    SELECT 'union', CAST(k AS BIGINT) FROM (SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region)
    """,
)

_sql(
    "q13_correlated_above_mean",
    """
    SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice
    FROM orders o
    WHERE o_totalprice > (SELECT avg(o2.o_totalprice) FROM orders o2 WHERE o2.o_custkey = o.o_custkey)
    """,
    """
    SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice
    FROM orders o
    WHERE o_totalprice > (SELECT avg(o2.o_totalprice) FROM orders o2 WHERE o2.o_custkey = o.o_custkey)
    """,
)

_sql(
    "q13_recursive_month_calendar",
    """
    WITH RECURSIVE bounds AS (
      SELECT trunc(CAST(min(o_orderdate) AS DATE), 'MM') AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders),
    years(y) AS (
      SELECT lo FROM bounds
      UNION ALL
      SELECT add_months(y, 12) FROM years WHERE add_months(y, 12) <= (SELECT hi FROM bounds)),
    cal AS (SELECT m FROM (SELECT explode(sequence(y, add_months(y, 11), INTERVAL 1 MONTH)) AS m FROM years)
            WHERE m <= (SELECT hi FROM bounds)),
    counts AS (SELECT trunc(CAST(o_orderdate AS DATE), 'MM') AS m, count(*) AS n FROM orders GROUP BY 1)
    SELECT date_format(cal.m, 'yyyy-MM') AS month, coalesce(counts.n, 0) AS n_orders
    FROM cal LEFT JOIN counts ON cal.m = counts.m
    """,
    """
    WITH RECURSIVE bounds AS (
      SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders),
    cal(m) AS (
      SELECT CAST(date_trunc('month', lo) AS DATE) FROM bounds
      UNION ALL
      SELECT CAST(m + INTERVAL 1 MONTH AS DATE) FROM cal WHERE m + INTERVAL 1 MONTH <= (SELECT hi FROM bounds)),
    counts AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY 1)
    SELECT strftime(cal.m, '%Y-%m') AS month, coalesce(counts.n, 0) AS n_orders
    FROM cal LEFT JOIN counts ON cal.m = counts.m
    """,
)


def q14_pivot_status_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q14 pivot with the values listed (no extra pass to find them)."""
    o = Tables(spark, sf_dir).orders
    p = (
        o.groupBy(F.year("o_orderdate").cast("bigint").alias("yr"))
        .pivot("o_orderstatus", ["F", "O", "P"])
        .agg(F.count(F.lit(1)))
    )
    return p.select("yr", *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(f"n_{s.lower()}") for s in "FOP"])


check(
    "q14_pivot_status_by_year",
    oracle="""
    SELECT CAST(year(o_orderdate) AS BIGINT) AS yr,
           count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f,
           count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o,
           count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p
    FROM orders GROUP BY 1
    """,
)(q14_pivot_status_by_year)

_sql(
    "q14_unpivot_flag_measures",
    """
    SELECT l_returnflag, measure, round(value, 2) AS value FROM (
      SELECT l_returnflag, sum(l_quantity) AS qty, sum(l_extendedprice) AS price, sum(l_tax) AS tax
      FROM lineitem GROUP BY l_returnflag)
    UNPIVOT (value FOR measure IN (qty, price, tax))
    """,
    """
    WITH s AS (SELECT l_returnflag, sum(l_quantity) AS qty, sum(l_extendedprice) AS price, sum(l_tax) AS tax
               FROM lineitem GROUP BY l_returnflag)
    SELECT l_returnflag, 'qty' AS measure, round(qty, 2) AS value FROM s
    UNION ALL SELECT l_returnflag, 'price', round(price, 2) FROM s
    UNION ALL SELECT l_returnflag, 'tax', round(tax, 2) FROM s
    """,
)

_sql(
    "q15_json_fields",
    """
    SELECT event_type,
           CAST(sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k,
           count(DISTINCT from_json(props, 'k BIGINT').k) AS distinct_k,
           CAST(max(CAST(get_json_object(props, '$.k') AS BIGINT)) AS BIGINT) AS max_k
    FROM events GROUP BY event_type
    """,
    """
    SELECT event_type,
           CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k,
           count(DISTINCT CAST(props ->> 'k' AS BIGINT)) AS distinct_k,
           CAST(max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS max_k
    FROM events GROUP BY event_type
    """,
)

_sql(
    "q16_scalar_functions",
    """
    SELECT o_orderkey,
           upper(o_orderpriority) AS pri_up, CAST(length(o_orderpriority) AS BIGINT) AS pri_len,
           substr(o_orderpriority, 3) AS pri_tail, concat(o_orderstatus, '-', CAST(o_custkey AS STRING)) AS tag,
           CAST(floor(o_totalprice / 1000) AS BIGINT) AS price_k, CAST(ceil(o_totalprice) AS BIGINT) AS price_ceil,
           CAST(o_orderkey % 7 AS BIGINT) AS key_mod, round(sqrt(o_totalprice), 6) AS price_sqrt,
           round(abs(o_totalprice - 250000), 2) AS dist_k,
           CAST(year(o_orderdate) AS BIGINT) AS yr, CAST(month(o_orderdate) AS BIGINT) AS mo,
           CAST(dayofmonth(o_orderdate) AS BIGINT) AS dom,
           date_format(date_add(CAST(o_orderdate AS DATE), 30), 'yyyy-MM-dd') AS due,
           CAST(datediff(DATE'2002-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS age_days,
           replace(o_orderpriority, '-', '_') AS pri_repl, lpad(CAST(o_custkey AS STRING), 6, '0') AS cust_pad,
           lower(trim(concat('  ', o_orderstatus, '  '))) AS status_trim
    FROM orders
    """,
    """
    SELECT o_orderkey,
           upper(o_orderpriority) AS pri_up, CAST(length(o_orderpriority) AS BIGINT) AS pri_len,
           substr(o_orderpriority, 3) AS pri_tail, concat(o_orderstatus, '-', CAST(o_custkey AS VARCHAR)) AS tag,
           CAST(floor(o_totalprice / 1000) AS BIGINT) AS price_k, CAST(ceil(o_totalprice) AS BIGINT) AS price_ceil,
           CAST(o_orderkey % 7 AS BIGINT) AS key_mod, round(sqrt(o_totalprice), 6) AS price_sqrt,
           round(abs(o_totalprice - 250000), 2) AS dist_k,
           CAST(year(o_orderdate) AS BIGINT) AS yr, CAST(month(o_orderdate) AS BIGINT) AS mo,
           CAST(day(o_orderdate) AS BIGINT) AS dom,
           strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d') AS due,
           CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS BIGINT) AS age_days,
           replace(o_orderpriority, '-', '_') AS pri_repl, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS cust_pad,
           lower(trim(concat('  ', o_orderstatus, '  '))) AS status_trim
    FROM orders
    """,
)


def q17_price_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q17: exact quartiles by rank, no group in one buffer (``operators.quantiles``)."""
    q = quantiles(Tables(spark, sf_dir).part, ["p_brand"], "p_retailprice", {"q1": 0.25, "med": 0.5, "q3": 0.75}, count="n_parts")
    return q.select("p_brand", *[F.round(c, 6).alias(c) for c in ("q1", "med", "q3")], "n_parts")


check(
    "q17_price_quartiles",
    oracle="""
    SELECT p_brand, round(quantile_cont(p_retailprice, 0.25), 6) AS q1, round(median(p_retailprice), 6) AS med,
           round(quantile_cont(p_retailprice, 0.75), 6) AS q3, count(*) AS n_parts
    FROM part GROUP BY p_brand
    """,
)(q17_price_quartiles)

_sql(
    "q18_share_and_yoy",
    """
    WITH y AS (SELECT c_mktsegment, year(o_orderdate) AS yr, sum(o_totalprice) AS rev
               FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT c_mktsegment, CAST(yr AS BIGINT) AS yr, round(rev, 2) AS revenue,
           round(100 * rev / sum(rev) OVER (PARTITION BY yr), 4) AS share_pct,
           round(rev - lag(rev) OVER (PARTITION BY c_mktsegment ORDER BY yr), 2) AS yoy_delta
    FROM y
    """,
    """
    WITH y AS (SELECT c_mktsegment, year(o_orderdate) AS yr, sum(o_totalprice) AS rev
               FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT c_mktsegment, CAST(yr AS BIGINT) AS yr, round(rev, 2) AS revenue,
           round(100 * rev / sum(rev) OVER (PARTITION BY yr), 4) AS share_pct,
           round(rev - lag(rev) OVER (PARTITION BY c_mktsegment ORDER BY yr), 2) AS yoy_delta
    FROM y
    """,
)

_sql(
    "q18_two_period_compare",
    """
    SELECT c_mktsegment,
           round(sum(CASE WHEN year(o_orderdate) = 1997 THEN o_totalprice ELSE 0 END), 2) AS rev_1997,
           round(sum(CASE WHEN year(o_orderdate) = 1998 THEN o_totalprice ELSE 0 END), 2) AS rev_1998,
           CAST(count_if(year(o_orderdate) = 1998) - count_if(year(o_orderdate) = 1997) AS BIGINT) AS delta_orders
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
    """,
    """
    SELECT c_mktsegment,
           round(sum(CASE WHEN year(o_orderdate) = 1997 THEN o_totalprice ELSE 0 END), 2) AS rev_1997,
           round(sum(CASE WHEN year(o_orderdate) = 1998 THEN o_totalprice ELSE 0 END), 2) AS rev_1998,
           CAST(count_if(year(o_orderdate) = 1998) - count_if(year(o_orderdate) = 1997) AS BIGINT) AS delta_orders
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
    """,
)


_sql(
    "q08_events_per_week_type",
    """
    SELECT date_format(date_trunc('WEEK', ts), 'yyyy-MM-dd') AS week, event_type, count(*) AS n_events,
           round(sum(value), 2) AS value_sum, count(DISTINCT user_id) AS n_users
    FROM events GROUP BY 1, 2
    """,
    """
    SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(*) AS n_events,
           round(sum(value), 2) AS value_sum, count(DISTINCT user_id) AS n_users
    FROM events GROUP BY 1, 2
    """,
)

_sql(
    "q12_multiset_operations",
    """
    SELECT 'intersect_all' AS op, k FROM (SELECT l_suppkey AS k FROM lineitem INTERSECT ALL SELECT s_suppkey FROM supplier)
    UNION ALL
    SELECT 'parts_never_sold', k FROM (SELECT p_partkey AS k FROM part EXCEPT ALL SELECT l_partkey FROM lineitem)
    """,
    """
    SELECT 'intersect_all' AS op, k FROM (SELECT l_suppkey AS k FROM lineitem INTERSECT ALL SELECT s_suppkey FROM supplier)
    UNION ALL
    SELECT 'parts_never_sold', k FROM (SELECT p_partkey AS k FROM part EXCEPT ALL SELECT l_partkey FROM lineitem)
    """,
)

_sql(
    "q16_text_functions",
    """
    SELECT c_custkey, split_part(c_name, '#', 2) AS name_num, reverse(c_mktsegment) AS seg_rev,
           CAST(instr(c_name, '#') AS BIGINT) AS hash_pos, regexp_extract(c_name, '([0-9]+)', 1) AS digits,
           lower(substr(c_mktsegment, 1, 3)) AS seg3, CAST(length(replace(c_name, '0', '')) AS BIGINT) AS nonzero_len,
           concat_ws('/', c_mktsegment, CAST(c_nationkey AS STRING)) AS seg_nation,
           CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS balance_band,
           rtrim(ltrim(concat('  ', c_mktsegment, '  '))) AS seg_trim
    FROM customer
    """,
    """
    SELECT c_custkey, split_part(c_name, '#', 2) AS name_num, reverse(c_mktsegment) AS seg_rev,
           CAST(instr(c_name, '#') AS BIGINT) AS hash_pos, regexp_extract(c_name, '([0-9]+)', 1) AS digits,
           lower(substr(c_mktsegment, 1, 3)) AS seg3, CAST(length(replace(c_name, '0', '')) AS BIGINT) AS nonzero_len,
           concat_ws('/', c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS seg_nation,
           CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS balance_band,
           rtrim(ltrim(concat('  ', c_mktsegment, '  '))) AS seg_trim
    FROM customer
    """,
)


def q17_discrete_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q17: discrete quantiles, the least value whose cumulative share reaches the wanted one."""
    shares = {"q1_disc": 0.25, "median_disc": 0.5, "q3_disc": 0.75}
    return quantiles(Tables(spark, sf_dir).part, ["p_brand"], "p_retailprice", shares, discrete=True)


check(
    "q17_discrete_quantiles",
    oracle="""
    SELECT p_brand, min(p_retailprice) FILTER (WHERE cd >= 0.25) AS q1_disc,
           min(p_retailprice) FILTER (WHERE cd >= 0.5) AS median_disc,
           min(p_retailprice) FILTER (WHERE cd >= 0.75) AS q3_disc
    FROM (SELECT p_brand, p_retailprice, cume_dist() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS cd FROM part) x
    GROUP BY p_brand
    """,
)(q17_discrete_quantiles)


def q05_interval_join_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5 over two tables: a user's events within 36 hours from each of their errors (``operators.rangejoin``)."""
    ev = Tables(spark, sf_dir).events.select("event_id", "ts", "user_id", "event_type")
    errors = ev.where(F.col("event_type") == "error").select(
        F.col("event_id").alias("error_id"), "user_id", F.col("ts").alias("since"), (F.col("ts") + F.expr("INTERVAL 36 HOURS")).alias("until"))
    found = interval_join(ev, errors, "ts", "since", "until", on=["user_id"])
    return found.select("error_id", "user_id", "event_id", "event_type")


check(
    "q05_interval_join_events",
    oracle="""
    SELECT r.event_id AS error_id, r.user_id, e.event_id, e.event_type
    FROM events r JOIN events e ON e.user_id = r.user_id AND e.ts >= r.ts AND e.ts < r.ts + INTERVAL 36 HOURS
    WHERE r.event_type = 'error'
    """,
)(q05_interval_join_events)


def q05_interval_join_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5 without an equal key: parts whose price lies within each customer's balance and 5 above it."""
    t = Tables(spark, sf_dir)
    bands = t.customer.select("c_custkey", F.col("c_acctbal").alias("lo"), (F.col("c_acctbal") + 5).alias("hi"))
    found = interval_join(t.part.select("p_partkey", "p_retailprice"), bands, "p_retailprice", "lo", "hi", closed=True)
    return found.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_parts"), F.min("p_partkey").alias("first_part"))


check(
    "q05_interval_join_prices",
    oracle="""
    SELECT c_custkey, count(*) AS n_parts, min(p_partkey) AS first_part
    FROM customer JOIN part ON p_retailprice >= c_acctbal AND p_retailprice <= c_acctbal + 5 GROUP BY c_custkey
    """,
)(q05_interval_join_prices)


def q09_running_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9 over one global order: running revenue of all orders and the last urgent one so far (``operators.prefix``)."""
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderdate", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey"))
    return running(o, ["o_orderdate", "o_orderkey"], {"revenue": F.col("cents"), "n_orders": F.lit(1).cast("long")}, {"last_urgent": urgent}, block_rows=5000).select(
        "o_orderkey", "revenue", "n_orders", "last_urgent")


check(
    "q09_running_revenue",
    oracle="""
    SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS BIGINT) AS revenue, count(*) OVER w AS n_orders,
           last_value(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END IGNORE NULLS) OVER w AS last_urgent
    FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)
    """,
)(q09_running_revenue)


def q09_moving_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: revenue of the last 100 orders up to each one, over one global order."""
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return moving(o, ["o_orderdate", "o_orderkey"], 100, {"last_100": F.sum("cents"), "peak_100": F.max("cents")}, block_rows=3000).select("o_orderkey", "last_100", "peak_100")


check(
    "q09_moving_revenue",
    oracle="""
    SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS BIGINT) AS last_100,
           max(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS peak_100
    FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS 99 PRECEDING)
    """,
)(q09_moving_revenue)


def q13_chain_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13 beyond SQL's limit of levels: each order's parent is the order before it, one chain through the whole table."""
    o = Tables(spark, sf_dir).orders.select("o_orderkey")
    numbered = row_index(o, ["o_orderkey"], name="n")
    former = numbered.select((F.col("n") + 1).alias("n"), F.col("o_orderkey").alias("parent"))
    parents = numbered.hint("merge").join(former.hint("merge"), "n", "left")  # never broadcast, however small its rows pack
    return roots(parents, "o_orderkey", "parent")


check(
    "q13_chain_depths",
    oracle="""
    SELECT o_orderkey, (SELECT min(o_orderkey) FROM orders) AS root, row_number() OVER (ORDER BY o_orderkey) - 1 AS depth FROM orders
    """,
)(q13_chain_depths)


def q13_user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13 on many chains: an event follows the user's former one within 12 hours; root: the event that opens the chain."""
    ev = Tables(spark, sf_dir).events.select("event_id", "ts", "user_id")
    m = asof_previous(ev, by="user_id", order="ts", tiebreak="event_id", carry=["event_id", "ts"])
    near = F.col("prev_ts") >= F.col("ts") - F.expr("INTERVAL 12 HOURS")
    return roots(m.select("event_id", F.when(near, F.col("prev_event_id")).alias("parent")), "event_id", "parent")


check(
    "q13_user_sessions",
    oracle="""
    WITH RECURSIVE p AS (
      SELECT e.event_id, CASE WHEN q.ts >= e.ts - INTERVAL 12 HOURS THEN q.event_id END AS parent
      FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY user_id, ts) q ON e.user_id = q.user_id AND e.ts > q.ts),
    r AS (SELECT event_id, event_id AS root, 0::BIGINT AS depth FROM p WHERE parent IS NULL
          UNION ALL SELECT p.event_id, r.root, r.depth + 1 FROM p JOIN r ON p.parent = r.event_id)
    SELECT event_id, root, depth FROM r
    """,
)(q13_user_sessions)


# ---- E: ad-hoc SQL operators -------------------------------------------------

TOP_ORDERS_SQL = """
SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice
FROM orders ORDER BY o_totalprice DESC, o_orderkey
"""


def e03_capped_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's ordered query, capped at 200 rows (the cap is the feature)."""
    register_views(spark, sf_dir)
    return adhoc.capped_query(spark, TOP_ORDERS_SQL)


check(
    "e03_capped_query",
    oracle=f"SELECT * FROM ({TOP_ORDERS_SQL}) q LIMIT 200",
)(e03_capped_query)


def e07_result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table artifact keeps the first 20 rows of the capped result."""
    register_views(spark, sf_dir)
    return adhoc.capped_query(spark, TOP_ORDERS_SQL, adhoc.TABLE_ROWS)


check(
    "e07_result_table",
    oracle=f"SELECT * FROM ({TOP_ORDERS_SQL}) q LIMIT 20",
)(e07_result_table)


def e04_routing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4/E5 over whole documents: folded text digest and the routing flag."""
    d = spread(Tables(spark, sf_dir).documents.select("doc_id", "text"))
    folded = d.select("doc_id", normalize_text(F.col("text")).alias("folded"))
    return folded.select(
        "doc_id",
        adhoc.signals_present(F.col("folded")).alias("sql_capable"),
        F.md5("folded").alias("folded_md5"),
    )


check(
    "e04_routing_documents",
    oracle="""
    WITH f AS (SELECT doc_id, regexp_replace(strip_accents(lower(text)), '[^a-z0-9_ ]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id,
           (t LIKE '%por año%' OR t LIKE '%por ano%' OR t LIKE '%por mes%' OR t LIKE '%por categoria%'
            OR t LIKE '%separado por%' OR t LIKE '%desglos%' OR t LIKE '%top %' OR t LIKE '%ranking%'
            OR t LIKE '%total%' OR t LIKE '%suma%' OR t LIKE '%ingres%' OR t LIKE '%monto%'
            OR t LIKE '%venta%' OR t LIKE '%compar%') AS sql_capable,
           md5(t) AS folded_md5
    FROM f
    """,
)(e04_routing_documents)


def e05_fold_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 over every conversation turn (whole texts)."""
    c = spread(Tables(spark, sf_dir).conversations)
    folded = normalize_text(F.col("text"))
    return c.select("conv_id", "turn", F.md5(folded).alias("folded_md5"), F.length(folded).cast("bigint").alias("folded_len"))


check(
    "e05_fold_conversations",
    oracle="""
    WITH f AS (SELECT conv_id, turn, regexp_replace(strip_accents(lower(text)), '[^a-z0-9_ ]+', ' ', 'g') AS t
               FROM conversations)
    SELECT conv_id, turn, md5(t) AS folded_md5, CAST(length(t) AS BIGINT) AS folded_len FROM f
    """,
)(e05_fold_conversations)


def e06_safe_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written as text in several formats, parsed back to year/month."""
    o = Tables(spark, sf_dir).orders
    txt = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.lit("n/a"))
    )
    d = adhoc.safe_date(txt)
    return o.select(
        "o_orderkey",
        txt.alias("date_text"),
        F.year(d).cast("bigint").alias("yr"),
        F.month(d).cast("bigint").alias("mo"),
    )


check(
    "e06_safe_dates",
    oracle="""
    WITH t AS (
      SELECT o_orderkey,
             CASE WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%d/%m/%Y')
                  WHEN o_orderpriority = '2-HIGH' THEN strftime(o_orderdate, '%Y-%m-%d')
                  WHEN o_orderpriority = '3-MEDIUM' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
                  ELSE 'n/a' END AS date_text
      FROM orders),
    p AS (SELECT o_orderkey, date_text,
                 coalesce(TRY_CAST(date_text AS DATE), CAST(TRY_STRPTIME(date_text, '%d/%m/%Y') AS DATE)) AS d
          FROM t)
    SELECT o_orderkey, date_text, CAST(year(d) AS BIGINT) AS yr, CAST(month(d) AS BIGINT) AS mo FROM p
    """,
)(e06_safe_dates)

STATUS_SQL = """
SELECT o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
FROM orders GROUP BY o_orderstatus ORDER BY o_orderstatus
"""


def e08_chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart series from a query result (value = last numeric column)."""
    register_views(spark, sf_dir)
    return adhoc.chart_points(adhoc.capped_query(spark, STATUS_SQL, adhoc.CHART_POINTS))


check(
    "e08_chart_points",
    oracle=f"""
    SELECT trim(concat_ws(' | ', o_orderstatus, CASE WHEN n_orders = 0 THEN '' ELSE CAST(n_orders AS VARCHAR) END), ' |') AS label,
           revenue AS value
    FROM ({STATUS_SQL}) q
    """,
)(e08_chart_points)
