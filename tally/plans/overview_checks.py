"""Checks for the executive overview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import kpi_text
from ..functions.text import label
from ..operators import overview as ov
from ..operators.profile import profile
from ..sources.tables import Tables
from .registry import check


def segment_revenue(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Minimum slice: top-k sum of ``o_totalprice`` by ``c_mktsegment``.

    orders join customer on the key (AQE picks broadcast for the customer
    side when its measured size is small, else a shuffle join), partial
    aggregation before the shuffle, top-k as ``TakeOrderedAndProject``.
    """
    t = Tables(spark, sf_dir)
    joined = t.orders.select("o_custkey", "o_totalprice").join(
        t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey"
    )
    top = ov.top_k(joined, "c_mktsegment", "o_totalprice", k)
    return top.select(F.col("label").alias("c_mktsegment"), F.round("value", 2).alias("revenue"))


check(
    "c04_segment_revenue",
    oracle="""
    SELECT c_mktsegment, round(sum(o_totalprice), 2) AS revenue
    FROM orders JOIN customer ON o_custkey = c_custkey
    GROUP BY c_mktsegment ORDER BY sum(o_totalprice) DESC, c_mktsegment LIMIT 5
    """,
)(segment_revenue)


# ---- helpers shared by the oracles -------------------------------------------

def duck_label(x: str) -> str:
    """DuckDB form of the C12 label (title case after any non-letter)."""
    return (
        "array_to_string(list_transform(regexp_extract_all(lower(replace(" + x + ", '_', ' ')), '(\\pL+|\\PL+)', 1), "
        "lambda p: concat(upper(left(p, 1)), substr(p, 2))), '')"
    )


def duck_kpi_text(x: str, monetary: str = "false") -> str:
    """DuckDB form of C11 (Python format rules; no grouping in the M/K forms)."""
    v = f"CAST({x} AS DOUBLE)"
    body = (
        f"CASE WHEN abs({v}) >= 1000000 THEN format('{{:.1f}}', {v} / 1000000) || 'M' "
        f"WHEN abs({v}) >= 1000 THEN format('{{:.1f}}', {v} / 1000) || 'K' "
        f"WHEN {v} = floor({v}) THEN format('{{:,}}', CAST({v} AS BIGINT)) "
        f"ELSE format('{{:,.2f}}', {v}) END"
    )
    return f"CASE WHEN {v} IS NULL THEN '—' ELSE (CASE WHEN {monetary} THEN '$' ELSE '' END) || {body} END"


def _prof(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return profile(getattr(Tables(spark, sf_dir), name))


# ---- C1-C3 ---------------------------------------------------------------------

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax"]


def c01_metric_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric totals of lineitem from the profile aggregate (no extra scan)."""
    m = ov.metric_columns(_prof(spark, sf_dir, "lineitem"))
    return m.select(
        "column_name", "label", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"),
        "semantic_type", F.col("metric_rank").cast("bigint").alias("metric_rank"), "kept",
    )


def _c01_oracle() -> str:
    from .profile_checks import _semantic_case

    parts = []
    for i, c in enumerate(LINEITEM_NUMERIC):
        st = _semantic_case(f"'{c}'", "'number'", "0", "1")
        parts.append(
            f"SELECT '{c}' AS column_name, {duck_label(repr(c))} AS label, round(sum({c}), 2) AS total, "
            f"round(avg({c}), 4) AS mean, {st} AS semantic_type, CAST({i + 1} AS BIGINT) AS metric_rank, "
            f"{i + 1} <= 4 AS kept FROM lineitem"
        )
    return "\nUNION ALL\n".join(parts)


check("c01_metric_totals", oracle=_c01_oracle())(c01_metric_totals)


def c02_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension columns of orders and lineitem (non-numeric, distinct > 1)."""
    outs = []
    for name in ("orders", "lineitem"):
        d = ov.dimension_columns(_prof(spark, sf_dir, name))
        outs.append(d.select(
            F.lit(name).alias("section"), "column_name", "label", "distinct",
            F.col("dimension_rank").cast("bigint").alias("dimension_rank"), "kept", "ranked",
        ))
    return outs[0].unionByName(outs[1])


def _c02_oracle() -> str:
    dims = {"orders": ["o_orderstatus", "o_orderdate", "o_orderpriority"],
            "lineitem": ["l_returnflag", "l_linestatus", "l_shipdate"]}
    parts = []
    for t, cols in dims.items():
        for c in cols:
            parts.append(f"SELECT '{t}' AS section, '{c}' AS column_name, count(DISTINCT {c}) AS d, "
                         f"{cols.index(c)} AS pos FROM {t}")
    body = "\nUNION ALL\n".join(parts)
    return (
        f"SELECT section, column_name, {duck_label('column_name')} AS label, d AS \"distinct\", "
        "row_number() OVER (PARTITION BY section ORDER BY pos) AS dimension_rank, "
        "row_number() OVER (PARTITION BY section ORDER BY pos) <= 3 AS kept, "
        "row_number() OVER (PARTITION BY section ORDER BY pos) <= 2 AS ranked "
        f"FROM ({body}) x WHERE d > 1"
    )


check("c02_dimensions", oracle=_c02_oracle())(c02_dimensions)

BASE_TABLES = ["orders", "lineitem", "customer", "part", "events"]


def c03_base_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First money metric, else first metric, per table."""
    outs = []
    for name in BASE_TABLES:
        b = ov.base_metric(ov.metric_columns(_prof(spark, sf_dir, name)))
        outs.append(b.select(F.lit(name).alias("table_name"), F.col("column_name").alias("base_metric")))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def _c03_oracle() -> str:
    from .profile_checks import SCHEMAS, _semantic_case

    parts = []
    for t in BASE_TABLES:
        pos = 0
        for c, kind in SCHEMAS[t]:
            if kind == "number":
                st = _semantic_case(f"'{c}'", "'number'", "0", "1")
                parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {pos} AS pos, {st} AS st")
            pos += 1
    body = "\nUNION ALL\n".join(parts)
    return (
        "SELECT table_name, arg_min(column_name, (st <> 'money_or_amount', pos)) AS base_metric "
        f"FROM ({body}) m GROUP BY table_name"
    )


check("c03_base_metric", oracle=_c03_oracle())(c03_base_metric)


# ---- C4-C6 rankings ------------------------------------------------------------

def c04_rank_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: top-5 sum of o_totalprice by o_orderpriority (TakeOrderedAndProject)."""
    t = ov.top_k(Tables(spark, sf_dir).orders, "o_orderpriority", "o_totalprice", 5)
    return t.select("label", F.round("value", 2).alias("value"))


check(
    "c04_rank_by_priority",
    oracle="""
    SELECT CAST(o_orderpriority AS VARCHAR) AS label, round(sum(o_totalprice), 2) AS value
    FROM orders WHERE o_orderpriority IS NOT NULL
    GROUP BY 1 ORDER BY sum(o_totalprice) DESC, label LIMIT 5
    """,
)(c04_rank_by_status)


def c05_rank_count_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency ranking of p_brand, top 5 (ties by label)."""
    t = ov.top_k(Tables(spark, sf_dir).part, "p_brand", None, 5)
    return t.select("label", "value")


check(
    "c05_rank_count_brand",
    oracle="""
    SELECT p_brand AS label, CAST(count(*) AS DOUBLE) AS value
    FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 5
    """,
)(c05_rank_count_brand)


def c06_rankings_two_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and priority rankings of o_totalprice in one pass."""
    r = ov.rank_dimensions(Tables(spark, sf_dir).orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice", 5)
    return r.select("dimension", F.col("rank").cast("bigint").alias("rank"), "label", F.round("value", 2).alias("value"))


check(
    "c06_rankings_two_dims",
    oracle="""
    WITH g AS (
      SELECT 'o_orderstatus' AS dimension, o_orderstatus AS label, sum(o_totalprice) AS v FROM orders GROUP BY 2
      UNION ALL
      SELECT 'o_orderpriority', o_orderpriority, sum(o_totalprice) FROM orders GROUP BY 2)
    SELECT dimension, rank, label, value FROM (
      SELECT dimension, label, round(v, 2) AS value,
             row_number() OVER (PARTITION BY dimension ORDER BY v DESC, label) AS rank FROM g) r
    WHERE rank <= 5
    """,
)(c06_rankings_two_dims)


# ---- C7-C10 overview, KPIs, insights, charts -----------------------------------

OVERVIEW_TABLES = ["orders", "lineitem", "customer", "part"]


def fixture_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    sections = []
    for name in OVERVIEW_TABLES:
        df = getattr(t, name)
        sections.append((name, df, profile(df)))
    return ov.overview(sections)


def c07_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per section (first 4), arrays flattened to text for the check."""
    o = fixture_overview(spark, sf_dir)
    return o.select(
        "section", "rows",
        F.array_join(F.transform("metrics", lambda m: m["column_name"]), ",").alias("metric_columns"),
        F.array_join(F.transform("dimensions", lambda d: d["column_name"]), ",").alias("dimension_columns"),
        F.array_join(F.transform("rankings", lambda r: r["dimension"]), ",").alias("ranked"),
        F.array_join(F.transform("rankings", lambda r: r["metric"]), ",").alias("ranked_metric"),
    )


def _c07_oracle() -> str:
    """The overview choice rules in SQL over per-column statistics of the four sections."""
    from .profile_checks import SCHEMAS, _semantic_case

    parts = []
    for t in OVERVIEW_TABLES:
        for pos, (c, kind) in enumerate(SCHEMAS[t]):
            st = _semantic_case(f"'{c}'", f"'{kind}'", "0", "1")
            parts.append(
                f"SELECT '{t}' AS section, {pos} AS pos, '{c}' AS col, '{kind}' AS kind, {st} AS st, "
                f"count({c}) AS nn, count(DISTINCT {c}) AS d, count(*) AS n FROM {t}"
            )
    stats = "\nUNION ALL\n".join(parts)
    return f"""
    WITH s AS ({stats}),
    m AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY pos) AS r FROM s WHERE kind = 'number' AND nn > 0),
    dm AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY pos) AS r FROM s
           WHERE kind <> 'number' AND nn > 0 AND d > 1),
    base AS (SELECT section, arg_min(col, (st <> 'money_or_amount', pos)) AS b FROM m GROUP BY section),
    agg AS (
      SELECT s.section, max(s.n) AS rows,
             (SELECT string_agg(col, ',' ORDER BY pos) FROM m WHERE m.section = s.section AND r <= 4) AS metric_columns,
             (SELECT string_agg(col, ',' ORDER BY pos) FROM dm WHERE dm.section = s.section AND r <= 3) AS dimension_columns,
             (SELECT string_agg({duck_label('col')}, ',' ORDER BY pos) FROM dm WHERE dm.section = s.section AND r <= 2) AS ranked,
             (SELECT string_agg({duck_label('base.b')}, ',') FROM dm JOIN base ON base.section = dm.section
              WHERE dm.section = s.section AND r <= 2) AS ranked_metric
      FROM s GROUP BY s.section)
    SELECT section, rows, metric_columns, dimension_columns, ranked, ranked_metric FROM agg
    """


check("c07_overview", oracle=_c07_oracle())(c07_overview)


def c08_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI cards from the first two sections."""
    k = ov.kpis(fixture_overview(spark, sf_dir))
    return k.select(F.col("kpi_rank").cast("bigint").alias("kpi_rank"), "label", "value", "context")


def _c08_oracle() -> str:
    """KPI choice in SQL: first two sections; of their first 4 metrics, money or
    plain metrics first (else anything but quantity), two each, four in all."""
    from .profile_checks import SCHEMAS, _semantic_case

    parts = []
    for sec, t in enumerate(OVERVIEW_TABLES[:2]):
        for pos, (c, kind) in enumerate(SCHEMAS[t]):
            if kind != "number":
                continue
            st = _semantic_case(f"'{c}'", "'number'", "0", "1")
            parts.append(
                f"SELECT {sec} AS sec, {pos} AS pos, '{c}' AS col, {st} AS st, count({c}) AS nn, "
                f"CAST(sum({c}) AS DOUBLE) AS total FROM {t}"
            )
    stats = "\nUNION ALL\n".join(parts)
    return f"""
    WITH m AS (SELECT *, row_number() OVER (PARTITION BY sec ORDER BY pos) AS r FROM ({stats}) x WHERE nn > 0),
    kept AS (SELECT * FROM m WHERE r <= 4),
    pref AS (SELECT sec, count(*) FILTER (WHERE st IN ('money_or_amount', 'metric')) AS n_pref FROM kept GROUP BY sec),
    chosen AS (
      SELECT kept.*, row_number() OVER (PARTITION BY kept.sec ORDER BY pos) AS c
      FROM kept JOIN pref ON pref.sec = kept.sec
      WHERE (n_pref > 0 AND st IN ('money_or_amount', 'metric')) OR (n_pref = 0 AND st <> 'quantity'))
    SELECT * FROM (
      SELECT row_number() OVER (ORDER BY sec, pos) AS kpi_rank, {duck_label('col')} AS label,
             {duck_kpi_text('total', "st = 'money_or_amount'")} AS value, '' AS context
      FROM chosen WHERE c <= 2) y
    WHERE kpi_rank <= 4
    """


check("c08_kpis", oracle=_c08_oracle())(c08_kpis)


def c09_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share-of-the-five insights from the first ranking of each of two sections."""
    i = ov.insights(fixture_overview(spark, sf_dir))
    return i.select(F.col("insight_rank").cast("bigint").alias("insight_rank"), "text")


def _first_rankings_sql() -> str:
    """CTEs ending in ``ranked(sec, dim, metric, label, v, point)``: the first
    ranking (first dimension by the base metric, top 5) of each of the first
    two sections, chosen in SQL from column statistics over every candidate
    (dimension, metric) pair."""
    from .profile_checks import SCHEMAS, _semantic_case

    stats, pairs = [], []
    for sec, t in enumerate(OVERVIEW_TABLES[:2]):
        cols = SCHEMAS[t]
        for pos, (c, kind) in enumerate(cols):
            st = _semantic_case(f"'{c}'", f"'{kind}'", "0", "1")
            stats.append(f"SELECT {sec} AS sec, {pos} AS pos, '{c}' AS col, '{kind}' AS kind, {st} AS st, "
                         f"count({c}) AS nn, count(DISTINCT {c}) AS d FROM {t}")
        for dc, dk in cols:
            if dk == "number":
                continue
            for mc, mk in cols:
                if mk != "number":
                    continue
                pairs.append(f"SELECT {sec} AS sec, '{dc}' AS dim, '{mc}' AS metric, CAST({dc} AS VARCHAR) AS label, "
                             f"coalesce(CAST(sum({mc}) AS DOUBLE), 0.0) AS v FROM {t} WHERE {dc} IS NOT NULL GROUP BY {dc}")
    stats_sql = "\nUNION ALL\n".join(stats)
    pairs_sql = "\nUNION ALL\n".join(pairs)
    return f"""
    s AS ({stats_sql}),
    dims AS (SELECT sec, arg_min(col, pos) AS dim FROM s WHERE kind <> 'number' AND nn > 0 AND d > 1 GROUP BY sec),
    base AS (SELECT sec, arg_min(col, (st <> 'money_or_amount', pos)) AS metric FROM s WHERE kind = 'number' AND nn > 0
             GROUP BY sec),
    pairs AS ({pairs_sql}),
    ranked AS (
      SELECT * FROM (
        SELECT p.sec, p.dim, p.metric, p.label, p.v,
               row_number() OVER (PARTITION BY p.sec ORDER BY p.v DESC, p.label) AS point
        FROM pairs p JOIN dims ON dims.sec = p.sec AND dims.dim = p.dim
             JOIN base ON base.sec = p.sec AND base.metric = p.metric) x
      WHERE point <= 5)
    """


check(
    "c09_insights",
    oracle=f"""
    WITH {_first_rankings_sql()},
    shares AS (SELECT *, sum(v) OVER (PARTITION BY sec) AS tot, count(*) OVER (PARTITION BY sec) AS n FROM ranked)
    SELECT * FROM (
      SELECT row_number() OVER (ORDER BY sec, point) AS insight_rank,
             label || ': ' || format('{{:.2f}}', v / tot * 100) || '% del total de ' || {duck_label('metric')} || '.' AS text
      FROM shares WHERE point <= 3 AND tot > 0 AND n >= 2) y
    WHERE insight_rank <= 4
    """,
)(c09_insights)


def c10_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart records (long form) for the first two sections."""
    c = ov.charts(fixture_overview(spark, sf_dir))
    return c.select(
        F.col("chart_rank").cast("bigint").alias("chart_rank"), "title", "kind",
        F.col("point").cast("bigint").alias("point"), "label", F.round("value", 2).alias("value"),
    )


check(
    "c10_charts",
    oracle=f"""
    WITH {_first_rankings_sql()}
    SELECT CAST(sec + 1 AS BIGINT) AS chart_rank, {duck_label('dim')} || ' por ' || {duck_label('metric')} AS title,
           'bar' AS kind, point, label, round(v, 2) AS value
    FROM ranked
    """,
)(c10_charts)


# ---- C11, C12 column functions over data ---------------------------------------

def c11_kpi_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11 over customer balances (negative, fractional, K and M forms) and nulls."""
    c = Tables(spark, sf_dir).customer
    return c.select(
        "c_custkey",
        kpi_text(F.col("c_acctbal"), F.col("c_mktsegment") == "BUILDING").alias("balance_text"),
        kpi_text(F.col("c_acctbal") * 1000).alias("scaled_text"),
        kpi_text(F.expr("nullif(c_nationkey, 0)")).alias("nation_text"),
    )


check(
    "c11_kpi_text",
    oracle=f"""
    SELECT c_custkey,
           {duck_kpi_text('c_acctbal', "c_mktsegment = 'BUILDING'")} AS balance_text,
           {duck_kpi_text('c_acctbal * 1000')} AS scaled_text,
           {duck_kpi_text('nullif(c_nationkey, 0)')} AS nation_text
    FROM customer
    """,
)(c11_kpi_text)


def c12_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12 over part names and types (title case after any non-letter)."""
    p = Tables(spark, sf_dir).part
    return p.select("p_partkey", label(F.col("p_type")).alias("type_label"),
                    label(F.concat_ws("_", "p_brand", "p_name")).alias("name_label"))


check(
    "c12_labels",
    oracle=f"""
    SELECT p_partkey, {duck_label('p_type')} AS type_label, {duck_label("concat_ws('_', p_brand, p_name)")} AS name_label
    FROM part
    """,
)(c12_labels)
