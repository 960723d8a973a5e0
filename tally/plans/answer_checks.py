"""Checks of the ingest writers, the SQL guard, attached datasets and answer records
(A4, A10, A11, E1, E2, E9, E10, G4, G5), over files, texts and answers made from the given tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adhoc, answers
from ..operators import ingest as ig
from ..operators.profile import ROW_ID
from ..sources.files import UnsupportedInput, load_sections
from ..sources.tables import Tables, register_views
from .ingest_checks import _scratch
from .registry import check


def _folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    return _scratch(spark, f"{name}-{os.path.basename(sf_dir.rstrip('/'))}")


def a04_format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: one table as CSV, as ``.CSV`` and as Parquet, and a suffix no reader takes."""
    customer = Tables(spark, sf_dir).customer
    root = _folder(spark, sf_dir, "dispatch")
    files = {"lower.csv": "csv", "UPPER.CSV": "csv", "columns.parquet": "parquet", "notes.txt": "csv"}
    out = None
    for name, fmt in files.items():
        path = f"{root}/{name}"
        customer.write.mode("overwrite").option("header", True).format(fmt).save(path)
        try:
            kind, sections = load_sections(spark, path)
            df = sections[0].df
            row = df.agg(F.lit(name).alias("file"), F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("rows"), F.sum("c_custkey").alias("keys"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
        except UnsupportedInput:
            row = spark.createDataFrame([(name, "unsupported")], "file string, kind string").selectExpr(
                "file", "kind", "cast(null as bigint) as rows", "cast(null as bigint) as keys", "cast(null as double) as balance")
        out = row if out is None else out.unionByName(row)
    return out


check(
    "a04_format_dispatch",
    oracle="""
    WITH c AS (SELECT count(*) AS rows, CAST(sum(c_custkey) AS BIGINT) AS keys, round(sum(c_acctbal), 2) AS balance FROM customer)
    SELECT f.file, f.kind, rows, keys, balance FROM c, (VALUES ('lower.csv', 'csv'), ('UPPER.CSV', 'csv'), ('columns.parquet', 'parquet')) AS f(file, kind)
    UNION ALL SELECT 'notes.txt', 'unsupported', NULL, NULL, NULL
    """,
)(a04_format_dispatch)


def a10_write_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: a section table written, then replaced by another, then read."""
    t = Tables(spark, sf_dir)
    path = _folder(spark, sf_dir, "section")
    ig.write_section(t.supplier.withColumn(ROW_ID, F.monotonically_increasing_id()), path)
    ig.write_section(t.orders.withColumn("o_year", F.year("o_orderdate")), path, partition_by=["o_year"])
    return spark.read.parquet(path).groupBy(F.col("o_year").cast("bigint").alias("o_year")).agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"))


check(
    "a10_write_section",
    oracle="""
    SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1
    """,
)(a10_write_section)


def a11_refresh_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every dataset, then those of two of them anew; the others stay as they were."""
    orders = Tables(spark, sf_dir).orders.select(F.lower(F.col("o_orderstatus")).alias("dataset_id"), "o_orderkey", F.lit("first").alias("version"))
    path = _folder(spark, sf_dir, "refresh")
    orders.write.mode("overwrite").partitionBy("dataset_id").parquet(path)
    again = orders.where("o_orderkey % 3 = 0").withColumn("version", F.lit("second"))
    ig.refresh_dataset_rows(again.where("dataset_id = 'f'"), path)
    ig.replace_dataset_partition(again.where("dataset_id = 'o'"), path, "o")
    return spark.read.parquet(path).groupBy("dataset_id", "version").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"))


check(
    "a11_refresh_rows",
    oracle="""
    SELECT lower(o_orderstatus) AS dataset_id, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'second' ELSE 'first' END AS version,
           count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys
    FROM orders WHERE o_orderstatus NOT IN ('F', 'O') OR o_orderkey % 3 = 0 GROUP BY 1, 2
    """,
)(a11_refresh_rows)


# Shapes of ad-hoc text around a nation's name, and whether one may run.
GUARD_SHAPES = {
    "select": ("SELECT count(*) AS n FROM nation WHERE n_name = '{}'", True),
    "with": ("with q as (select * from nation) select n_nationkey from q where n_name = '{}' -- end", True),
    "nested": ("SELECT (SELECT max(n_nationkey) FROM nation WHERE n_name <> '{}') AS n", True),
    "drop": ("DROP VIEW nation -- '{}'", False),
    "second": ("SELECT 1 AS a; DROP VIEW nation -- '{}'", False),
    "insert": ("INSERT INTO nation SELECT * FROM nation WHERE n_name = '{}'", False),
    "after_with": ("WITH q AS (SELECT 1 AS a) INSERT INTO nation SELECT * FROM nation WHERE n_name = '{}'", False),
    "set": ("SET spark.x = '{}'", False),
    "reflect": ("SELECT reflect('java.lang.System', 'getProperty', '{}') AS a", False),
    "path": ("SELECT * FROM parquet.`/{}`", False),
    "close": ("SELECT 1 AS a) AS q LIMIT 1; DROP VIEW nation -- '{}'", False),
    "blank": (" \n", False),
}


def e01_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts made from nation names; allowed are those that pass the guard and resolve in the guarded session."""
    register_views(spark, sf_dir)
    names = [(r["n_nationkey"], r["n_name"]) for r in Tables(spark, sf_dir).nation.select("n_nationkey", "n_name").collect()]

    def allowed(text: str) -> bool:
        try:
            adhoc.capped_query(spark, text)
        except Exception:  # barred by the guard or by what the session resolves
            return False
        return True

    rows = [(int(k), shape, allowed(sql.format(n.replace("'", "''")))) for k, n in names for shape, (sql, _) in GUARD_SHAPES.items()]
    return spark.createDataFrame(rows, "n_nationkey bigint, shape string, allowed boolean")


check(
    "e01_guard",
    oracle="SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, shape, allowed FROM nation, (VALUES "
    + ", ".join(f"('{k}', {str(ok).lower()})" for k, (_, ok) in GUARD_SHAPES.items()) + ") AS g(shape, allowed)",
)(e01_guard)


def _attached(spark: SparkSession, sf_dir: str) -> None:
    t, root = Tables(spark, sf_dir), _folder(spark, sf_dir, "attached")
    t.customer.write.mode("overwrite").parquet(f"{root}/sheet_clientes")
    t.orders.write.mode("overwrite").parquet(f"{root}/sheet_pedidos")
    adhoc.attach_datasets(spark, [{"sheet_clientes": f"{root}/sheet_clientes", "sheet_falta": f"{root}/none"}, {"sheet_pedidos": f"{root}/sheet_pedidos"}])


SEGMENT_SQL = """
SELECT c_mktsegment AS segmento, count(*) AS pedidos, round(sum(o_totalprice), 2) AS total
FROM ds0.sheet_clientes JOIN ds1.sheet_pedidos ON o_custkey = c_custkey GROUP BY c_mktsegment ORDER BY segmento
"""


def e02_attached_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attached datasets joined by their names; a table whose files are missing is left out."""
    _attached(spark, sf_dir)
    return adhoc.capped_query(spark, SEGMENT_SQL)


check(
    "e02_attached_datasets",
    oracle="""
    SELECT c_mktsegment AS segmento, count(*) AS pedidos, round(sum(o_totalprice), 2) AS total
    FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment
    """,
)(e02_attached_datasets)


def e09_answer_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer made from that result: its sentence, its table and its chart, a row each."""
    _attached(spark, sf_dir)
    answer = adhoc.answer_question(spark, "Total de ventas por segmento", SEGMENT_SQL, "clientes.csv", title="Ventas por segmento")
    table, chart = answer["artifacts"]
    rows = [("text", 0, answer["response_text"], None), ("focus", 0, answer["focus_files"][0], None)]
    rows += [("table", k, r["segmento"], float(r["total"])) for k, r in enumerate(table["rows"])]
    rows += [("chart", k, p["label"], float(p["value"])) for k, p in enumerate(chart["chart"]["data"])]
    return spark.createDataFrame(rows, "part string, place bigint, label string, value double")


check(
    "e09_answer_record",
    oracle="""
    WITH s AS (SELECT c_mktsegment AS g, count(*) AS n, round(sum(o_totalprice), 2) AS v, row_number() OVER (ORDER BY c_mktsegment) - 1 AS k
               FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment)
    SELECT 'text' AS part, 0::BIGINT AS place, 'Aquí tienes ventas por segmento.' AS label, NULL::DOUBLE AS value
    UNION ALL SELECT 'focus', 0, 'clientes.csv', NULL
    UNION ALL SELECT 'table', k, g, v FROM s
    UNION ALL SELECT 'chart', k, g || ' | ' || n, v FROM s
    """,
)(e09_answer_record)


def e10_errors_as_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that fail while they are read, resolved or run are results with an error and no rows."""
    register_views(spark, sf_dir)
    texts = {"good": "SELECT r_regionkey, r_name FROM region", "syntax": "SELECT FROM WHERE", "column": "SELECT nope FROM region", "table": "SELECT * FROM nope",
             "runtime": "SELECT raise_error(r_name) AS a FROM region", "cast": "SELECT cast(r_name AS int) AS a FROM region", "command": "DROP VIEW region", "none": None}
    rows = []
    for name, sql in texts.items():
        res = adhoc.run_sql(spark, sql)
        record = adhoc.answer_record(res, "r.csv")
        rows.append((name, res.error is not None, res.row_count, record is not None))
    return spark.createDataFrame(rows, "query string, failed boolean, row_count bigint, answered boolean")


check(
    "e10_errors_as_data",
    oracle="""
    SELECT q AS query, q <> 'good' AS failed, CASE WHEN q = 'good' THEN (SELECT count(*) FROM region) ELSE 0 END AS row_count, q = 'good' AS answered
    FROM (VALUES ('good'), ('syntax'), ('column'), ('table'), ('runtime'), ('cast'), ('command'), ('none')) AS t(q)
    """,
)(e10_errors_as_data)


def _old_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old-format answers: each turn as analysis lines, chart or table, by its number."""
    turn = F.col("turn")
    chart = F.struct(F.lit("Turnos").alias("title"), F.when(turn % 2 == 0, F.lit("bar")).otherwise(F.lit("pie")).alias("kind"),
                     F.transform(F.sequence(F.lit(1), F.lit(15)), lambda k: F.struct(F.concat(F.lit("t"), k.cast("string")).alias("label"), (k * turn).alias("value"))).alias("data"))
    body = F.struct(
        F.col("role").alias("response_text"), F.when(turn % 3 == 0, F.array(F.col("role"), F.lit("b"), F.lit("c"), F.lit("d"), F.lit("e"))).alias("analysis"),
        F.when(turn % 4 < 2, chart).alias("chart"), F.when(turn % 5 == 0, F.array(F.lit("x"), F.lit("y"))).alias("table"))
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", "role", F.to_json(body).alias("text"))


def g04_old_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with the old ``analysis``, ``chart`` and ``table`` fields get the artifacts these stand for."""
    got = answers.clean_answers(_old_answers(spark, sf_dir))
    art = F.col("artifacts")
    return got.select(
        "conv_id", "turn", "response_text", F.array_join(F.transform(art, lambda a: a["type"]), ",").alias("kinds"),
        F.coalesce(F.aggregate(art, F.lit(0), lambda n, a: n + F.coalesce(F.length(a["html"]), F.lit(0))), F.lit(0)).cast("bigint").alias("html_len"),
        F.aggregate(art, F.lit(0.0), lambda s, a: s + F.coalesce(F.aggregate(a["chart"]["data"], F.lit(0.0), lambda t, p: t + p["value"]), F.lit(0.0))).alias("points"))


def _html_len(items: str) -> str:
    return f"{len(answers.ANALYSIS_HTML_OPEN) + len(answers.ANALYSIS_HTML_CLOSE)} + {items}"


check(
    "g04_old_format",
    oracle=f"""
    SELECT conv_id, turn, role AS response_text, concat_ws(',', CASE WHEN turn % 3 = 0 THEN 'html' END,
             CASE WHEN turn % 4 = 0 THEN 'chart' END, CASE WHEN turn % 5 = 0 THEN 'table' END) AS kinds,
           CAST(CASE WHEN turn % 3 = 0 THEN {_html_len("4 * 9 + length(role) + 3")} ELSE 0 END AS BIGINT) AS html_len,
           CASE WHEN turn % 4 = 0 THEN CAST(78 * turn AS DOUBLE) ELSE 0.0 END AS points
    FROM conversations
    """,
)(g04_old_format)


def g05_fill_from_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer without artifacts takes those of its query's result; others keep their own."""
    rows = F.array(F.to_json(F.struct("conv_id", "turn")))
    result = F.array(F.struct(F.lit("table").alias("type"), F.lit("Resultado").alias("title"), F.lit(None).cast("string").alias("html"),
                              F.lit(None).cast(answers.CHART).alias("chart"), rows.alias("rows")))
    df = _old_answers(spark, sf_dir).withColumn("result", F.when(F.col("role") == "assistant", result))
    got = answers.clean_answers(df, fallback_col="result")
    first = F.try_element_at(F.col("artifacts"), F.lit(1))
    return got.select("conv_id", "turn", F.size("artifacts").cast("bigint").alias("n_artifacts"), first["title"].alias("first_title"))


check(
    "g05_fill_from_result",
    oracle="""
    WITH t AS (SELECT conv_id, turn, role, (turn % 3 = 0)::INT + (turn % 4 = 0)::INT + (turn % 5 = 0)::INT AS n FROM conversations)
    SELECT conv_id, turn, CAST(CASE WHEN n = 0 AND role = 'assistant' THEN 1 ELSE n END AS BIGINT) AS n_artifacts,
           CASE WHEN turn % 3 = 0 THEN 'Análisis' WHEN turn % 4 = 0 THEN 'Turnos' WHEN turn % 5 = 0 THEN 'Detalle' WHEN role = 'assistant' THEN 'Resultado' END AS first_title
    FROM t
    """,
)(g05_fill_from_result)
