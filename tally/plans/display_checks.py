"""Checks for presentation-side data functions (H1-H8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import DATE_FORMATS, rich_text, sanitize_html, typed_value
from ..functions.numbers import executive_value, format_metric
from ..operators import display as dp
from ..operators import overview as ov
from ..sources.tables import Tables
from ..session import spread
from .registry import check

# A mixed text column made from orders: numbers with grouping commas, ISO
# dates, empties, words and plain numbers.
MIXED_SPARK = """CASE o_orderpriority
  WHEN '1-URGENT' THEN format_number(o_totalprice, 2)
  WHEN '2-HIGH' THEN date_format(o_orderdate, 'yyyy-MM-dd')
  WHEN '3-MEDIUM' THEN ''
  WHEN '4-NOT SPECIFIED' THEN o_orderpriority
  ELSE CAST(o_totalprice AS STRING) END"""
MIXED_DUCK = """CASE o_orderpriority
  WHEN '1-URGENT' THEN format('{:,.2f}', o_totalprice)
  WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN '3-MEDIUM' THEN ''
  WHEN '4-NOT SPECIFIED' THEN o_orderpriority
  ELSE CAST(o_totalprice AS VARCHAR) END"""
_DUCK_FORMATS = "['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y/%m/%d', '%m/%d/%Y']"
assert len(DATE_FORMATS) == 5

DUCK_TYPED = f"""
  WITH m AS (SELECT o_orderkey, {MIXED_DUCK} AS v FROM orders),
  k AS (SELECT o_orderkey, v, replace(replace(trim(v), ',', ''), ' ', '') AS cand,
               try_strptime(trim(v), {_DUCK_FORMATS}) AS ts FROM m),
  t AS (SELECT o_orderkey, CASE WHEN v IS NULL OR v = '' THEN 'empty'
                                 WHEN regexp_matches(cand, '^-?\\d+(\\.\\d+)?$') THEN 'number'
                                 WHEN ts IS NOT NULL THEN 'date' ELSE 'text' END AS kind, cand, ts, v FROM k)
"""


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).orders.select("o_orderkey", F.expr(MIXED_SPARK).alias("v"))


def h01_typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: kind and typed value of a mixed text column."""
    t = _mixed(spark, sf_dir).select("o_orderkey", typed_value(F.col("v")).alias("t"))
    return t.select(
        "o_orderkey", F.col("t.kind").alias("kind"), F.round("t.num", 2).alias("num"),
        F.date_format("t.ts", "yyyy-MM-dd").alias("ts"), F.col("t.txt").alias("txt"),
    )


check(
    "h01_typed_values",
    oracle=DUCK_TYPED + """
    SELECT o_orderkey, kind, CASE WHEN kind = 'number' THEN round(CAST(cand AS DOUBLE), 2) END AS num,
           CASE WHEN kind = 'date' THEN strftime(ts, '%Y-%m-%d') END AS ts,
           CASE WHEN kind = 'text' THEN lower(trim(v)) END AS txt
    FROM t
    """,
)(h01_typed_values)


def h02_typed_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: position of every row when sorted by the typed value (total order)."""
    s = dp.typed_sort(_mixed(spark, sf_dir), "v", "o_orderkey")
    return s.select("o_orderkey", "position")


_DUCK_SORTED = DUCK_TYPED + """,
  s AS (SELECT o_orderkey, row_number() OVER (ORDER BY kind = 'empty',
          CASE kind WHEN 'number' THEN 0 WHEN 'date' THEN 1 WHEN 'text' THEN 2 ELSE 3 END,
          CASE WHEN kind = 'number' THEN CAST(cand AS DOUBLE) END NULLS LAST,
          CASE WHEN kind = 'date' THEN ts END NULLS LAST,
          CASE WHEN kind = 'text' THEN lower(trim(v)) END NULLS LAST, o_orderkey) AS position FROM t)
"""

check("h02_typed_sort", oracle=_DUCK_SORTED + "SELECT o_orderkey, position FROM s")(h02_typed_sort)


def h03_display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3: the first 50 rows after the typed sort."""
    s = dp.display_rows(_mixed(spark, sf_dir), "v", "o_orderkey")
    return s.select("o_orderkey", "position")


check("h03_display_rows", oracle=_DUCK_SORTED + "SELECT o_orderkey, position FROM s WHERE position <= 50")(h03_display_rows)


def _duck_format_metric(x: str) -> str:
    v = f"CAST({x} AS DOUBLE)"
    return (
        f"CASE WHEN abs({v}) >= 10000000 THEN format('{{:.2f}}', {v} / 1000000) || 'MM' "
        f"WHEN abs({v}) >= 1000000 THEN format('{{:.2f}}', {v} / 1000000) || 'M' "
        f"WHEN abs({v}) >= 1000 THEN format('{{:.2f}}', {v} / 1000) || 'k' "
        f"ELSE format('{{:,.2f}}', {v}) END"
    )


def h04_format_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4 over order totals at three scales (k, M / MM, and below 1000)."""
    o = Tables(spark, sf_dir).orders
    return o.select(
        "o_orderkey", format_metric(F.col("o_totalprice")).alias("f_total"),
        format_metric(F.col("o_totalprice") * 100).alias("f_large"),
        format_metric(F.col("o_totalprice") / 1000).alias("f_small"),
    )


check(
    "h04_format_metric",
    oracle=f"""
    SELECT o_orderkey, {_duck_format_metric('o_totalprice')} AS f_total,
           {_duck_format_metric('o_totalprice * 100')} AS f_large,
           {_duck_format_metric('o_totalprice / 1000')} AS f_small
    FROM orders
    """,
)(h04_format_metric)

EXEC_SPARK = """CASE o_orderstatus
  WHEN 'F' THEN concat('$ ', format_number(o_totalprice, 2))
  WHEN 'O' THEN concat(CAST(o_custkey AS STRING), '.5M')
  ELSE CAST(o_custkey AS STRING) END"""
EXEC_DUCK = """CASE o_orderstatus
  WHEN 'F' THEN '$ ' || format('{:,.2f}', o_totalprice)
  WHEN 'O' THEN CAST(o_custkey AS VARCHAR) || '.5M'
  ELSE CAST(o_custkey AS VARCHAR) END"""


def h05_executive_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5 over text values: currency text, suffixed text (passes as is), plain numbers."""
    o = Tables(spark, sf_dir).orders
    return o.select("o_orderkey", executive_value(F.expr(EXEC_SPARK)).alias("shown"))


check(
    "h05_executive_value",
    oracle=f"""
    WITH e AS (SELECT o_orderkey, {EXEC_DUCK} AS raw FROM orders),
    c AS (SELECT o_orderkey, raw, regexp_replace(raw, '[,$\\s]', '', 'g') AS cleaned FROM e)
    SELECT o_orderkey, CASE WHEN regexp_matches(cleaned, '^[+-]?((\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)$')
                            THEN {_duck_format_metric('cleaned')} ELSE raw END AS shown
    FROM c
    """,
)(h05_executive_value)


def h06_rich_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6 over whole documents (look-behind regex: no DuckDB oracle; goldens in tests)."""
    d = spread(Tables(spark, sf_dir).documents.select("doc_id", "text"))
    r = rich_text(F.col("text"))
    return d.select("doc_id", F.length(r).cast("bigint").alias("clean_len"), F.md5(r).alias("clean_md5"))


check("h06_rich_text")(h06_rich_text)


def h07_html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7 over every stored page: body only, blocked elements and handlers removed."""
    p = spread(Tables(spark, sf_dir).pages)
    c = sanitize_html(F.col("html"))
    return p.select("page_id", F.length(c).cast("bigint").alias("clean_len"), F.md5(c).alias("clean_md5"))


check(
    "h07_html_clean",
    # Elements go by the places of their tags; attributes piece by piece between "<" and ">".
    oracle=r"""
    WITH b AS (SELECT page_id, CASE WHEN html ILIKE '%<body%</body%' THEN regexp_extract(html, '(?is)<body\b[^>]*>(.*)</body\s*>', 1) ELSE html END AS t FROM pages),
    e AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
            '(?is)<script\b[^>]*>.*?(</script\s*>|\z)', '', 'g'), '(?is)<style\b[^>]*>.*?(</style\s*>|\z)', '', 'g'),
            '(?is)<iframe\b[^>]*>.*?(</iframe\s*>|\z)', '', 'g'), '(?is)<object\b[^>]*>.*?(</object\s*>|\z)', '', 'g'),
            '(?is)</?(embed|link|meta)\b[^>]*>', '', 'g') AS t FROM b),
    p AS (SELECT page_id, string_split(t, '<') AS p FROM e),
    c AS (SELECT page_id, p[1] || array_to_string(list_transform(p[2:], lambda x:
            CASE WHEN strpos(x, '>') > 0 AND regexp_matches(x, '^[a-zA-Z/]')
                 THEN '<' || regexp_replace(regexp_replace(substr(x, 1, strpos(x, '>')),
                      '(?i)[\s/]+on[a-z0-9_-]+\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', '', 'g'),
                      '(?i)[\s/]+(href|src)\s*=\s*("\s*javascript:[^"]*"|''\s*javascript:[^'']*''|javascript:[^\s>]*)', '', 'g')
                      || substr(x, strpos(x, '>') + 1)
                 ELSE '<' || x END), '') AS c FROM p)
    SELECT page_id, CAST(length(c) AS BIGINT) AS clean_len, md5(c) AS clean_md5 FROM c
    """,
)(h07_html_clean)


def h08_bar_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8: bar widths of the status / priority ranking charts."""
    r = ov.rank_dimensions(Tables(spark, sf_dir).orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice", 5)
    w = dp.bar_widths(r, "dimension")
    return w.select("dimension", "label", F.round("width", 4).alias("width"))


check(
    "h08_bar_widths",
    oracle="""
    WITH g AS (
      SELECT 'o_orderstatus' AS dimension, o_orderstatus AS label, sum(o_totalprice) AS v FROM orders GROUP BY 2
      UNION ALL
      SELECT 'o_orderpriority', o_orderpriority, sum(o_totalprice) FROM orders GROUP BY 2),
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY v DESC, label) AS rk FROM g) x
          WHERE rk <= 5)
    SELECT dimension, label,
           round(greatest(10.0, abs(v) / greatest(max(abs(v)) OVER (PARTITION BY dimension), 1.0) * 100), 4) AS width
    FROM r
    """,
)(h08_bar_widths)
