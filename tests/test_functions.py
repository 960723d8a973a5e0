"""Hand goldens for the column functions."""

import pytest
from pyspark.sql import functions as F

from tally.functions.display import rich_text, sanitize_html, typed_value
from tally.functions.numbers import executive_value, format_metric, kpi_text
from tally.functions.text import label, normalize_text, normalize_text_exact, slug, slug_name
from tally.operators import adhoc
from tally.operators.ingest import unique_name_list, unique_names
from tally.operators.rollups import title_text


def _one(spark, expr, values, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_slug(spark):
    vals = ["Año", "  Monto Total ", "__x__", "%%%", "a__b", "Código-SKU", "col1X"]
    want = ["a_o", "monto_total", "x", "field", "a_b", "c_digo_sku", "col1x"]
    assert _one(spark, slug(F.col("v")), vals) == want
    assert [slug_name(v) for v in vals] == want
    # idempotent
    assert _one(spark, slug(slug(F.col("v"))), vals) == want


def test_unique_names_list_and_frame(spark):
    assert unique_name_list(["a", "a", "a_2", "", None, "Año"]) == ["a", "a_2", "a_2_2", "col_4", "col_5", "a_o"]
    h = spark.createDataFrame([("f", 1, "a"), ("f", 2, "a"), ("f", 3, "a_2"), ("g", 1, "a")], "file string, pos int, header string")
    ref = {(r["file"], r["pos"]): r["name"] for r in unique_names(h, fix_collisions=False).collect()}
    assert ref == {("f", 1): "a", ("f", 2): "a_2", ("f", 3): "a_2", ("g", 1): "a"}
    fixed = unique_names(h, fix_collisions=True).where("file = 'f'").collect()
    assert len({r["name"] for r in fixed}) == 3


def test_label(spark):
    vals = ["col1x", "o_totalprice", "monto_total", "ÁREA_total", "2nd_place"]
    assert _one(spark, label(F.col("v")), vals) == ["Col1X", "O Totalprice", "Monto Total", "Área Total", "2Nd Place"]


def test_kpi_text(spark):
    vals = [None, 0.0, -5.0, 999.995, 1000.0, 999999.0, 1e6, 2.35e6, 0.15, -1234.5, 12.345]
    got = _one(spark, kpi_text(F.col("v")), vals, "v double")
    assert got == ["—", "0", "-5", "1,000.00", "1.0K", "1000.0K", "1.0M", "2.4M", "0.15", "-1.2K", "12.35"]
    money = _one(spark, kpi_text(F.col("v"), True), [-5.0, 1000.0, None], "v double")
    assert money == ["$-5", "$1.0K", "—"]
    from tally.functions.numbers import kpi_text_of_text

    assert _one(spark, kpi_text_of_text(F.col("v")), ["1,000", " 2500 ", "abc", None, "1d"]) == ["1,000", "2.5K", "abc", "—", "1d"]


def test_format_metric_and_executive_value(spark):
    got = _one(spark, format_metric(F.col("v")), [12345678.0, 1234567.0, 4567.0, 999.0, None, -2500.0], "v double")
    assert got == ["12.35MM", "1.23M", "4.57k", "999.00", "0.00", "-2.50k"]
    ex = _one(spark, executive_value(F.col("v")), ["$1,234", "1.2M", "", " 12 ", None])
    assert ex == ["1.23k", "1.2M", "0.00", "12.00", "—"]


def test_rich_text(spark):
    got = _one(spark, rich_text(F.col("v")), ["**Total** 1234567 ventas y 12 items, 3.5 y 1,234 `code` __u__ a1000"])
    assert got == ["Total 1.23M ventas y 12 items, 3.50 y 1.23k code u a1000"]


def test_sanitize_html(spark):
    html = ('<html><head><script>x()</script></head><body><div onclick="x()" class="c">a'
            '<script type="t">bad()</script><a href="javascript:alert(1)">l</a><a href="/ok">k</a>'
            '<iframe src="y"></iframe><link rel="s"><style>p{}</style></div></body></html>')
    assert _one(spark, sanitize_html(F.col("v")), [html]) == ['<div class="c">a<a>l</a><a href="/ok">k</a></div>']


def test_titles(spark):
    long = "x" * 90
    got = _one(spark, title_text(F.col("v")), ["  hola\n\t mundo  ", long, "", None, "a b"])
    assert got == ["hola mundo", "x" * 77 + "...", "Nuevo chat", "Nuevo chat", "a b"]


def test_normalize_and_routing(spark):
    qs = ["Ingresos por año", "¿Cuál es el TOP 5?", "Hola", "Comparación de ventas", "Ñandú ﬁ"]
    assert _one(spark, normalize_text(F.col("v")), qs)[:2] == ["ingresos por ano", " cual es el top 5 "]
    assert _one(spark, normalize_text_exact(F.col("v")), qs[4:]) == ["nandu fi"]
    assert _one(spark, adhoc.sql_capable(F.col("v")), qs) == [True, True, False, True, False]


def test_typed_value(spark):
    got = _one(spark, typed_value(F.col("v")), ["", "1,234", " 12.5 ", "2024-01-05", "Texto", None])
    kinds = [g["kind"] for g in got]
    assert kinds == ["empty", "number", "number", "date", "text", "empty"]
    assert got[1]["num"] == 1234.0 and got[4]["txt"] == "texto"


def test_safe_date(spark):
    got = _one(spark, adhoc.safe_date(F.col("v")), ["2024-01-05", "05/01/2024", "2024-01-05 10:00:00", "nope"])
    assert [str(d) if d else None for d in got] == ["2024-01-05", "2024-01-05", "2024-01-05", None]


@pytest.mark.parametrize(
    "sql,ok",
    [
        ("SELECT 1", True),
        ("with t as (select 1 as a) select * from t", True),
        ("  select 1;", True),
        ("drop table x", False),
        ("insert into x values (1)", False),
        ("selectx 1", False),
        ("", False),
        ("explain select 1", False),
    ],
)
def test_safe_select_prefix(sql, ok):
    assert adhoc.is_safe_select(sql) is ok


def test_capped_run_rejects_commands_and_paths(spark):
    for bad in [
        "select 1; drop table x",
        "with t as (select 1) insert into t select 1",
        "select * from (select 1) q; drop table x --",
        "select 1 ) q; drop table x --",
        "select * from parquet.`/root/testdata/sf0.001/region.parquet`",
        "select reflect('java.lang.Thread', 'sleep', 1L)",
        "select reflect/**/('java.lang.System', 'getProperty', 'java.version')",
        "select `java_method` -- x\n ('java.lang.System', 'getProperty', 'java.version')",
        "select * from (select try_reflect('java.lang.System', 'getProperty', 'java.version') as v)",
        "select 1 where exists (select 1 where reflect('java.lang.System', 'getProperty', 'java.version') is not null)",
        "with recursive r(n) as (select 1 union all select n + 1 from r where n < 5000) select max(n) from r",
    ]:
        res = adhoc.run_sql(spark, bad)
        assert res.error is not None and res.rows == [], bad
    ok = adhoc.run_sql(spark, "select id, id * 2 AS v from range(250) order by id -- trailing comment")
    assert ok.error is None and ok.row_count == 200 and ok.truncated
    chart = adhoc.chart_series(adhoc.run_sql(spark, "select 'a' AS k, 0 AS n, 1.5 AS v union all select 'b', 2, 2.5"))
    assert chart["chart"]["data"] == [{"label": "a", "value": 1.5}, {"label": "b | 2", "value": 2.5}]
    quoted = adhoc.run_sql(spark, 'select "k" from (select 1 AS k) t')
    assert quoted.error is None and quoted.rows == [{"k": 1}]
    rec = adhoc.answer_record(ok, "ventas.csv")
    assert rec["artifacts"][0]["type"] == "table" and len(rec["artifacts"][0]["rows"]) == 20


def test_answer_flow(spark):
    sql = "select 'a' AS k, 2.5 AS v union all select 'b', 1.5"
    direct = adhoc.answer_question(spark, "¿Cuál es el total por categoría?", sql, "ventas.csv", title="Total por categoría")
    assert direct["response_text"] == "Aquí tienes total por categoría." and len(direct["artifacts"]) == 2
    not_routed = adhoc.answer_question(spark, "Hola", sql, "ventas.csv")
    assert not_routed["response_text"].startswith("No pude estructurar") and not_routed["artifacts"] == []
    failing = adhoc.answer_question(spark, "ventas totales", "select nope", "ventas.csv")
    assert failing["type"] == "answer" and failing["artifacts"] == []
    assert adhoc.answer_question(spark, "x", None, "v.csv", datasets_ready=False)["type"] == "status"
    assert adhoc.is_sql_question("Ingresos por AÑO") and not adhoc.is_sql_question("hola")


def test_guard_rejects_any_appended_command(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    commands = ["DROP TABLE t", "INSERT INTO t VALUES (1)", "DELETE FROM t", "SET a=b", "CREATE TABLE x (a INT)",
                "ALTER TABLE t ADD COLUMNS (b INT)", "CACHE TABLE t", "REFRESH TABLE t", "ADD JAR x.jar"]
    glue = ["; ", ";\n", " ) q; ", "\n) q;\n", " -- c\n; ", "/* c */; "]

    @settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.sampled_from(glue), st.sampled_from(commands), st.sampled_from(["", " --", " /*"]))
    def run(g, cmd, tail):
        res = adhoc.run_sql(spark, "SELECT 1 AS a" + g + cmd + tail)
        assert res.error is not None and res.rows == []

    run()


def test_folding_of_decomposed_marks(spark):
    got = _one(spark, normalize_text(F.col("v")), ["Café ñ", "हःx"])
    assert got == ["cafe n", " x"]  # marks with a combining class go; a spacing sign (class 0) is a separator
