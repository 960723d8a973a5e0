"""Checks for profiling and the catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as pf
from ..operators import sketches
from ..sources.tables import Tables
from .registry import check

# Schemas of the fixture tables profiled below (column, kind), as documented
# in FIXTURES.md; used to write the oracle SQL.
SCHEMAS = {
    "orders": [("o_orderkey", "number"), ("o_custkey", "number"), ("o_orderstatus", "text"),
               ("o_totalprice", "number"), ("o_orderdate", "datetime"), ("o_orderpriority", "text")],
    "lineitem": [("l_orderkey", "number"), ("l_partkey", "number"), ("l_suppkey", "number"),
                 ("l_linenumber", "number"), ("l_quantity", "number"), ("l_extendedprice", "number"),
                 ("l_discount", "number"), ("l_tax", "number"), ("l_returnflag", "text"),
                 ("l_linestatus", "text"), ("l_shipdate", "datetime")],
    "customer": [("c_custkey", "number"), ("c_name", "text"), ("c_nationkey", "number"),
                 ("c_acctbal", "number"), ("c_mktsegment", "text")],
    "part": [("p_partkey", "number"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"),
             ("p_size", "number"), ("p_retailprice", "number")],
    "events": [("event_id", "number"), ("ts", "datetime"), ("user_id", "number"), ("event_type", "text"),
               ("value", "number"), ("props", "text")],
}
ORDER_KEYS = {
    "orders": ["o_orderkey"],
    "lineitem": [c for c, _ in SCHEMAS["lineitem"]],  # (l_orderkey, l_linenumber) repeats: order by all
    "customer": ["c_custkey"],
    "part": ["p_partkey"],
    "events": ["event_id"],
}

# The B1 fixture: orders with o_orderpriority nulled where '1-URGENT'.
NULLED_PRIORITY = "CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END"


def orders_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Tables(spark, sf_dir).orders
    return o.withColumn("o_orderpriority", F.expr(NULLED_PRIORITY))


def _profile_out(prof: DataFrame) -> DataFrame:
    return prof.select(
        "column_name", "nulls", "non_nulls", "distinct",
        (F.round("min", 4) + F.lit(0.0)).alias("min_value"),
        (F.round("max", 4) + F.lit(0.0)).alias("max_value"),
        (F.round("mean", 4) + F.lit(0.0)).alias("mean_value"),
    )


def _profile_oracle(table: str, source: str) -> str:
    parts = []
    for c, kind in SCHEMAS[table]:
        num = kind == "number"
        mn = f"round(min({c}), 4) + 0.0" if num else "CAST(NULL AS DOUBLE)"
        mx = f"round(max({c}), 4) + 0.0" if num else "CAST(NULL AS DOUBLE)"
        av = f"round(avg({c}), 4) + 0.0" if num else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, count({c}) AS non_nulls, "
            f"count(DISTINCT {c}) AS distinct, CAST({mn} AS DOUBLE) AS min_value, CAST({mx} AS DOUBLE) AS max_value, "
            f"CAST({av} AS DOUBLE) AS mean_value FROM {source}"
        )
    return "\nUNION ALL\n".join(parts)


def b01_profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 over orders with nulls made in the query (the fixtures have none)."""
    return _profile_out(pf.profile(orders_with_nulls(spark, sf_dir)))


check(
    "b01_profile_orders",
    oracle=_profile_oracle(
        "orders",
        f"(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, {NULLED_PRIORITY} AS o_orderpriority FROM orders)",
    ),
)(b01_profile_orders)


def b01_profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 over every column of lineitem (single aggregate + melted distinct)."""
    return _profile_out(pf.profile(Tables(spark, sf_dir).lineitem))


check("b01_profile_lineitem", oracle=_profile_oracle("lineitem", "lineitem"))(b01_profile_lineitem)


def b01_profile_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 with approximate distinct counts: one scan, one aggregate, no shuffle of values."""
    return pf.profile(Tables(spark, sf_dir).lineitem, approx=True).select(
        "column_name", "nulls", "non_nulls", F.col("distinct").alias("approx_distinct")
    )


check("b01_profile_approx")(b01_profile_approx)


def b02_samples_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: first 6 non-null values of every column of orders, in key order."""
    s = pf.samples(orders_with_nulls(spark, sf_dir), ["o_orderkey"], 6)
    return s.select("column_name", F.col("sample_pos").cast("bigint").alias("sample_pos"), "value")


def _samples_oracle() -> str:
    parts = []
    for c, kind in SCHEMAS["orders"]:
        expr = NULLED_PRIORITY if c == "o_orderpriority" else c
        val = f"CAST({expr} + 0.0 AS VARCHAR)" if c == "o_totalprice" else f"CAST({expr} AS VARCHAR)"
        parts.append(
            f"(SELECT '{c}' AS column_name, row_number() OVER (ORDER BY o_orderkey) AS sample_pos, {val} AS value "
            f"FROM orders WHERE {expr} IS NOT NULL ORDER BY o_orderkey LIMIT 6)"
        )
    return "\nUNION ALL\n".join(parts)


check("b02_samples_orders", oracle=_samples_oracle())(b02_samples_orders)

TYPED_TABLES = ["orders", "lineitem", "customer", "part", "events"]


def b03_semantic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3 for every column of five tables (profile + rule chain)."""
    t = Tables(spark, sf_dir)
    outs = []
    for name in TYPED_TABLES:
        p = pf.with_semantic_types(pf.profile(getattr(t, name)))
        outs.append(p.select(F.lit(name).alias("table_name"), "column_name", "kind", "semantic_type"))
    return reduce(DataFrame.unionByName, outs)


def _has_any_sql(col: str, tokens) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{t}')" for t in tokens) + ")"


def _semantic_case(name: str, kind: str, distinct: str, nn: str) -> str:
    return (
        f"CASE WHEN {_has_any_sql(name, pf.DATE_TOKENS)} THEN 'date' "
        f"WHEN {_has_any_sql(name, pf.MONEY_TOKENS)} THEN 'money_or_amount' "
        f"WHEN {_has_any_sql(name, pf.QUANTITY_TOKENS)} THEN 'quantity' "
        f"WHEN {_has_any_sql(name, pf.IDENTIFIER_TOKENS)} THEN 'identifier' "
        f"WHEN {kind} = 'datetime' THEN 'date' "
        f"WHEN {kind} IN ('number', 'boolean') THEN 'metric' "
        f"WHEN {nn} > 0 AND {distinct} <= greatest(20.0, {nn} * 0.1) THEN 'category' "
        f"ELSE 'text' END"
    )


def _types_oracle() -> str:
    parts = []
    for t in TYPED_TABLES:
        for c, kind in SCHEMAS[t]:
            parts.append(
                f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{kind}' AS kind, "
                f"count(DISTINCT {c}) AS d, count({c}) AS nn FROM {t}"
            )
    body = "\nUNION ALL\n".join(parts)
    return (
        f"SELECT table_name, column_name, kind, {_semantic_case('column_name', 'kind', 'd', 'nn')} AS semantic_type "
        f"FROM ({body}) p"
    )


check("b03_semantic_types", oracle=_types_oracle())(b03_semantic_types)


def build_catalog(spark: SparkSession, sf_dir: str, tables=TYPED_TABLES, dataset_id: str = "fixtures") -> DataFrame:
    """B4 over several sections (one Spark job group per section, unioned)."""
    t = Tables(spark, sf_dir)
    parts = [pf.catalog(getattr(t, name), name, order_by=ORDER_KEYS[name], dataset_id=dataset_id) for name in tables]
    return reduce(DataFrame.unionByName, parts)


def b04_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows of orders and customer (type, description, samples, metrics)."""
    cat = build_catalog(spark, sf_dir, ["orders", "customer"])
    return cat.select(
        "section", "table_name", F.col("pos").cast("bigint").alias("pos"), "column_name", "semantic_type",
        "description", F.array_join("sample_values", "|").alias("samples"),
        F.col("metrics.nulls").alias("nulls"), F.col("metrics.distinct").alias("distinct"),
    )


def _catalog_oracle() -> str:
    parts = []
    for t in ["orders", "customer"]:
        key = ORDER_KEYS[t][0]
        for pos, (c, kind) in enumerate(SCHEMAS[t]):
            val = f"CAST({c} + 0.0 AS VARCHAR)" if c in ("o_totalprice", "c_acctbal") else f"CAST({c} AS VARCHAR)"
            st = _semantic_case(f"'{c}'", f"'{kind}'", f"count(DISTINCT {c})", f"count({c})")
            parts.append(
                f"SELECT '{t}' AS section, 'sheet_{t}' AS table_name, CAST({pos} AS BIGINT) AS pos, '{c}' AS column_name, "
                f"{st} AS semantic_type, 'Campo {c} detectado como ' || {st} || '.' AS description, "
                f"(SELECT string_agg(v, '|' ORDER BY k) FROM (SELECT {val} AS v, {key} AS k FROM {t} "
                f"WHERE {c} IS NOT NULL ORDER BY {key} LIMIT 6)) AS samples, "
                f"count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct FROM {t}"
            )
    return "\nUNION ALL\n".join(parts)


check("b04_catalog", oracle=_catalog_oracle())(b04_catalog)


def b05_catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows of some sections, in (section, position) order."""
    cat = build_catalog(spark, sf_dir, ["customer", "part"])
    return pf.catalog_lookup(cat.where(F.col("section").isin("customer", "part")), ["fixtures"]).select(
        "section", F.col("pos").cast("bigint").alias("pos"), "column_name", "data_type"
    )


def _lookup_oracle() -> str:
    parts = []
    spark_types = {
        "customer": ["bigint", "string", "int", "double", "string"],
        "part": ["bigint", "string", "string", "string", "int", "double"],
    }
    for t in ["customer", "part"]:
        for pos, (c, _) in enumerate(SCHEMAS[t]):
            parts.append(f"SELECT '{t}' AS section, CAST({pos} AS BIGINT) AS pos, '{c}' AS column_name, "
                         f"'{spark_types[t][pos]}' AS data_type")
    return "\nUNION ALL\n".join(parts)


check("b05_catalog_lookup", oracle=_lookup_oracle())(b05_catalog_lookup)


def b06_schema_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per table with its columns nested in position order."""
    ctx = pf.schema_context(build_catalog(spark, sf_dir, ["orders", "customer", "part"]))
    return ctx.select(
        "section", "table_name",
        F.array_join(F.transform("columns", lambda c: c["column_name"]), ",").alias("column_names"),
        F.array_join(F.transform("columns", lambda c: c["semantic_type"]), ",").alias("semantic_types"),
        F.size("columns").cast("bigint").alias("n_columns"),
    )


def _context_oracle() -> str:
    parts = []
    for t in ["orders", "customer", "part"]:
        for pos, (c, kind) in enumerate(SCHEMAS[t]):
            st = _semantic_case(f"'{c}'", f"'{kind}'", f"count(DISTINCT {c})", f"count({c})")
            parts.append(f"SELECT '{t}' AS section, {pos} AS pos, '{c}' AS column_name, {st} AS semantic_type FROM {t}")
    body = "\nUNION ALL\n".join(parts)
    return (
        "SELECT section, 'sheet_' || section AS table_name, string_agg(column_name, ',' ORDER BY pos) AS column_names, "
        "string_agg(semantic_type, ',' ORDER BY pos) AS semantic_types, count(*) AS n_columns "
        f"FROM ({body}) c GROUP BY section"
    )


check("b06_schema_context", oracle=_context_oracle())(b06_schema_context)

PREVIEW_TABLES = ["orders", "lineitem", "customer"]


def b07_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 3 rows x first 8 columns of three tables, in key order."""
    t = Tables(spark, sf_dir)
    outs = []
    for name in PREVIEW_TABLES:
        df = getattr(t, name)
        p = pf.preview(df, ORDER_KEYS[name], 3, 8)
        cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in p.columns]
        ranked = p.select(F.concat_ws(",", *cols).alias("row_text"), *[F.col(k) for k in ORDER_KEYS[name] if k in p.columns])
        outs.append(ranked.select(F.lit(name).alias("table_name"), "row_text"))
    return reduce(DataFrame.unionByName, outs)


def _preview_oracle() -> str:
    parts = []
    for t in PREVIEW_TABLES:
        cols = [c for c, _ in SCHEMAS[t]][:8]
        text = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols)
        order = ", ".join(ORDER_KEYS[t])
        parts.append(f"(SELECT '{t}' AS table_name, concat_ws(',', {text}) AS row_text FROM {t} ORDER BY {order} LIMIT 3)")
    return "\nUNION ALL\n".join(parts)


check("b07_preview", oracle=_preview_oracle())(b07_preview)


def b01_profile_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 merged from part profiles, one for each order year, without reading orders again."""
    orders = Tables(spark, sf_dir).orders
    parts = None
    for year in range(1995, 2002):
        parts = sketches.refresh(parts, orders.where(F.year("o_orderdate") == year), "orders", str(year))
    got = sketches.read_profile(sketches.merged(parts, ["dataset_id"]), (0.5,))
    exact = orders.agg(F.countDistinct("o_custkey").alias("custkeys"), F.countDistinct("o_orderkey").alias("orderkeys"))
    # The bounds: 4 standard errors of the distinct count, 1 % of the rank.
    real = F.when(F.col("column_name") == "o_custkey", F.col("custkeys")).when(F.col("column_name") == "o_orderkey", F.col("orderkeys"))
    off = F.coalesce(F.abs(F.col("distinct") - real) <= 0.033 * real + 1, F.lit(True))
    return got.join(exact, F.lit(True)).select(
        "column_name", "rows", "non_nulls", F.round("total", 2).alias("total"), F.round("least", 2).alias("least"), F.round("greatest", 2).alias("greatest"), off.alias("distinct_within"))


check(
    "b01_profile_merged",
    oracle="""
    WITH o AS (SELECT count(*) AS n, sum(o_orderkey)::DOUBLE AS k, sum(o_custkey)::DOUBLE AS c, sum(o_totalprice) AS p, min(o_orderkey)::DOUBLE AS k0, max(o_orderkey)::DOUBLE AS k1,
                      min(o_custkey)::DOUBLE AS c0, max(o_custkey)::DOUBLE AS c1, min(o_totalprice) AS p0, max(o_totalprice) AS p1 FROM orders)
    SELECT v.name AS column_name, n AS rows, n AS non_nulls,
           round(CASE v.name WHEN 'o_orderkey' THEN k WHEN 'o_custkey' THEN c WHEN 'o_totalprice' THEN p END, 2) AS total,
           round(CASE v.name WHEN 'o_orderkey' THEN k0 WHEN 'o_custkey' THEN c0 WHEN 'o_totalprice' THEN p0 END, 2) AS least,
           round(CASE v.name WHEN 'o_orderkey' THEN k1 WHEN 'o_custkey' THEN c1 WHEN 'o_totalprice' THEN p1 END, 2) AS greatest, true AS distinct_within
    FROM o, (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderdate'), ('o_orderpriority')) AS v(name)
    """,
)(b01_profile_merged)
