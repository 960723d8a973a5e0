"""Checks for the ingest operators over the fixture tables.

File readers (A1-A4, A10-A12) need files the tests write, so they are
covered in ``tests/`` rather than here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug, table_name
from ..operators import ingest as ig
from ..sources.tables import FIXTURE_TABLES, Tables
from ..session import spread
from .registry import check


def _duck_slug(x: str, fallback: str = "'field'") -> str:
    return f"coalesce(nullif(array_to_string(regexp_extract_all(lower({x}), '[a-z0-9]+'), '_'), ''), {fallback})"


def a05_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 over part names and types, and over whole document texts."""
    p = Tables(spark, sf_dir).part.select(
        F.col("p_partkey").alias("id"), F.lit("part").alias("src"),
        slug(F.col("p_name")).alias("slug_value"),
    )
    d = spread(Tables(spark, sf_dir).documents.select("doc_id", "text")).select(
        F.col("doc_id").alias("id"), F.lit("documents").alias("src"), F.md5(slug(F.col("text"))).alias("slug_value"),
    )
    return p.unionByName(d)


check(
    "a05_slug",
    oracle=f"""
    SELECT p_partkey AS id, 'part' AS src, {_duck_slug('p_name')} AS slug_value FROM part
    UNION ALL
    SELECT doc_id, 'documents', md5({_duck_slug('text')}) FROM documents
    """,
)(a05_slug)


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header table made from part: file = brand, position = key, header = type."""
    return Tables(spark, sf_dir).part.select(
        F.col("p_brand").alias("file"), F.col("p_partkey").alias("pos"), F.col("p_type").alias("header")
    )


def a06_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugged, de-duplicated header names (reference rule, one pass)."""
    return ig.unique_names(_headers(spark, sf_dir), fix_collisions=False).select("file", "pos", "name")


_A06_ORACLE = f"""
    WITH b AS (SELECT p_brand AS file, p_partkey AS pos,
                      CASE WHEN p_type IS NULL OR trim(p_type) = '' THEN 'col_' || CAST(p_partkey AS VARCHAR)
                           ELSE {_duck_slug('trim(p_type)', "'col_' || CAST(p_partkey AS VARCHAR)")} END AS base
               FROM part),
    n AS (SELECT file, pos, base, row_number() OVER (PARTITION BY file, base ORDER BY pos) AS k FROM b)
    SELECT file, pos, CASE WHEN k = 1 THEN base ELSE base || '_' || CAST(k AS VARCHAR) END AS name FROM n
    """

check("a06_unique_names", oracle=_A06_ORACLE)(a06_unique_names)


def a06_unique_names_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 with the collision fix.  Part types hold no digits, so the first pass
    leaves no collision here and the result equals the reference rule; the
    fix itself is exercised by the unit tests."""
    return ig.unique_names(_headers(spark, sf_dir), fix_collisions=True).select("file", "pos", "name")


check("a06_unique_names_fixed", oracle=_A06_ORACLE)(a06_unique_names_fixed)


def a07_table_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table name per section (sections = distinct part types)."""
    types = Tables(spark, sf_dir).part.select(F.col("p_type").alias("section")).distinct()
    return types.select("section", table_name(F.col("section")).alias("table_name"))


check(
    "a07_table_names",
    oracle=f"SELECT DISTINCT p_type AS section, 'sheet_' || {_duck_slug('p_type', chr(39) + 'sheet' + chr(39))} AS table_name FROM part",
)(a07_table_names)


def a08_drop_empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose data cells are all null go (nulls made in the query)."""
    o = Tables(spark, sf_dir).orders.select(
        F.col("o_orderkey").alias("_rid"),
        F.expr("CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END").alias("s"),
        F.expr("CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN NULL ELSE o_orderpriority END").alias("p"),
    )
    return ig.drop_empty_rows(o)


check(
    "a08_drop_empty_rows",
    oracle="""
    SELECT * FROM (
      SELECT o_orderkey AS _rid, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS s,
             CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN NULL ELSE o_orderpriority END AS p
      FROM orders) x
    WHERE s IS NOT NULL OR p IS NOT NULL
    """,
)(a08_drop_empty_rows)

_TEXT_COLS_SPARK = {
    "qty": "CAST(l_quantity AS STRING)",
    "line": "concat(' ', CAST(l_linenumber AS STRING), ' ')",
    "flag": "l_returnflag",
    "tax_suffixed": "CASE WHEN l_linestatus = 'O' THEN CAST(l_tax AS STRING) ELSE concat(CAST(l_tax AS STRING), 'd') END",
    "price_grouped": "format_number(l_extendedprice, 2)",
    "sci": "concat(CAST(l_linenumber AS STRING), 'e3')",
    "flag_bool": "CASE WHEN l_returnflag = 'R' THEN 'True' ELSE 'False' END",
}
_TEXT_COLS_DUCK = {
    "qty": "CAST(l_quantity AS VARCHAR)",
    "line": "' ' || CAST(l_linenumber AS VARCHAR) || ' '",
    "flag": "l_returnflag",
    "tax_suffixed": "CASE WHEN l_linestatus = 'O' THEN CAST(l_tax AS VARCHAR) ELSE CAST(l_tax AS VARCHAR) || 'd' END",
    "price_grouped": "format('{:,.2f}', l_extendedprice)",
    "sci": "CAST(l_linenumber AS VARCHAR) || 'e3'",
    "flag_bool": "CASE WHEN l_returnflag = 'R' THEN 'True' ELSE 'False' END",
}


def a09_coercion_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-or-nothing typing verdicts of text columns made from lineitem."""
    li = Tables(spark, sf_dir).lineitem.select(*[F.expr(v).alias(k) for k, v in _TEXT_COLS_SPARK.items()])
    return ig.coercion_plan(li).select("column_name", "non_null", "numbers", "integers", "verdict")


def _a09_oracle() -> str:
    num = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)$"
    integer = r"^[+-]?\d{1,18}$"
    parts = []
    for k, v in _TEXT_COLS_DUCK.items():
        parts.append(
            f"SELECT '{k}' AS column_name, count(x) AS non_null, "
            f"count(*) FILTER (WHERE regexp_matches(lower(trim(x)), '{num}')) AS numbers, "
            f"count(*) FILTER (WHERE regexp_matches(trim(x), '{integer}')) AS integers, "
            f"count(*) FILTER (WHERE x IN ('True', 'TRUE', 'true', 'False', 'FALSE', 'false')) AS booleans "
            f"FROM (SELECT {v} AS x FROM lineitem)"
        )
    body = "\nUNION ALL\n".join(parts)
    return (
        "SELECT column_name, non_null, numbers, integers, CASE WHEN non_null = 0 THEN 'string' "
        "WHEN booleans = non_null THEN 'boolean' WHEN integers = non_null THEN 'bigint' "
        f"WHEN numbers = non_null THEN 'double' ELSE 'string' END AS verdict FROM ({body}) s"
    )


check("a09_coercion_verdicts", oracle=_a09_oracle())(a09_coercion_verdicts)


def a13_section_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of every fixture table as a section."""
    t = Tables(spark, sf_dir)
    s = ig.section_summary([(name, getattr(t, name), False) for name in FIXTURE_TABLES])
    return s.select("section", "table_name", "hidden", "rows", "n_columns")


_WIDTHS = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
    "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}

check(
    "a13_section_summary",
    oracle="\nUNION ALL\n".join(
        f"SELECT '{t}' AS section, 'sheet_{t}' AS table_name, false AS hidden, count(*) AS rows, "
        f"CAST({_WIDTHS[t]} AS BIGINT) AS n_columns FROM {t}"
        for t in FIXTURE_TABLES
    ),
)(a13_section_summary)


def a14_row_total_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row-total sentence over all sections."""
    t = Tables(spark, sf_dir)
    s = ig.section_summary([(name, getattr(t, name), False) for name in FIXTURE_TABLES])
    return ig.row_total_text(s, "parquet")


check(
    "a14_row_total_text",
    oracle="SELECT total_rows, 'PARQUET listo para análisis con ' || format('{:,}', total_rows) || ' registros.' AS summary FROM ("
    + "SELECT CAST(sum(n) AS BIGINT) AS total_rows FROM ("
    + " UNION ALL ".join(f"SELECT count(*) AS n FROM {t}" for t in FIXTURE_TABLES)
    + ") c) s",
)(a14_row_total_text)


ORDERS_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def a03_cells_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 (Spark part): orders as a long cells table (header row + one cell per
    value, as the workbook decoder emits), lifted back to a typed table."""
    from ..sources.workbook import lift_cells

    o = Tables(spark, sf_dir).orders
    items = F.array(*[
        F.struct(F.lit(i + 1).alias("col"), F.col(c).cast("string").alias("value"),
                 F.lit("number" if c in ("o_orderkey", "o_custkey", "o_totalprice") else "string").alias("kind"))
        for i, c in enumerate(ORDERS_COLUMNS)
    ])
    body = o.select((F.col("o_orderkey") + 2).cast("int").alias("row"), F.inline(items))
    header = spark.createDataFrame(
        [(1, i + 1, c, "string") for i, c in enumerate(ORDERS_COLUMNS)], "row int, col int, value string, kind string"
    )
    typed, _, _ = lift_cells(header.unionByName(body))
    return typed


check(
    "a03_cells_lift",
    oracle="""
    SELECT o_orderkey + 1 AS _rid, o_orderkey, o_custkey, o_orderstatus, o_totalprice,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
    FROM orders
    """,
)(a03_cells_lift)


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder under the session's checkpoint dir (shared on a cluster)."""
    from ..session import ensure_checkpoint_dir

    return ensure_checkpoint_dir(spark).rstrip("/") + "/tally-scratch/" + name


def a01_csv_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + A2 + A8 + A9 over a delimited export of orders (written by Spark,
    ``;``-separated, with ``NA`` and blank cells): sniff, read as text, null
    tokens, drop empty rows, type all-or-nothing."""
    import os

    from ..sources.files import read_csv_section

    o = Tables(spark, sf_dir).orders
    export = o.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_custkey").cast("string").alias("o_custkey"),
        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("NA")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    path = _scratch(spark, "orders-csv-" + os.path.basename(sf_dir.rstrip("/")))
    (export.write.mode("overwrite").option("header", True).option("sep", ";")
     .option("emptyValue", "").option("quoteAll", False).csv(path))
    section = read_csv_section(spark, path, name="orders")
    return section.df.drop("_rid")


check(
    "a01_csv_read",
    oracle="""
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS o_orderstatus,
           o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
           CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS o_orderpriority
    FROM orders
    """,
)(a01_csv_read)


def a01_csv_quoted_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: a CSV export of ``documents`` with commas, quotes and line breaks inside
    quoted fields, read back in splits (``sources.csvrecords``)."""
    import os

    from ..sources.files import read_csv_section

    path = _scratch(spark, "documents-csv-" + os.path.basename(sf_dir.rstrip("/")))
    docs = Tables(spark, sf_dir).documents.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return read_csv_section(spark, path, name="documents").df.drop("_rid")


check(
    "a01_csv_quoted_breaks",
    oracle="SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents",
)(a01_csv_quoted_breaks)


def a12_landing_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture folder as a landing folder, ingested by the file stream
    (``availableNow``).  Each file is processed once: a second call finds no
    new file and returns the same status table."""
    import os

    from ..streaming.landing import ingest_landing, landing_status

    tag = os.path.basename(sf_dir.rstrip("/"))
    out = _scratch(spark, "landing-out-" + tag)
    ingest_landing(spark, sf_dir, out, checkpoint=_scratch(spark, "landing-ckpt-" + tag), pattern="*.parquet")
    st = landing_status(spark, out)
    return st.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "dataset_id", "status",
        F.col("rows").cast("bigint").alias("rows"),
    )


check(
    "a12_landing_ingest",
    oracle="\nUNION ALL\n".join(
        # A name that is not its slug plus .csv carries a digest, so that customer.csv and customer.parquet differ.
        f"SELECT '{t}.parquet' AS file, '{t}_' || substr(md5('{t}.parquet'), 1, 8) AS dataset_id, 'ready' AS status, count(*) AS rows FROM {t}"
        for t in FIXTURE_TABLES
    ),
)(a12_landing_ingest)
