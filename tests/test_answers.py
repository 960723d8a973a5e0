"""G1-G5 on hand-written answers (no fixture table holds model answers)."""

import json

from tally.operators.answers import clean_answers


def _run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "resumen", "ventas.csv") for i, t in enumerate(texts)],
                               "id int, text string, summary string, primary string")
    out = clean_answers(df, "text", summary_col="summary", primary_col="primary", **kw)
    return {r["id"]: r for r in out.collect()}


def test_lenient_json_and_defaults(spark):
    clean = json.dumps({"response_text": "Hola", "artifacts": [], "focus_files": ["a", "b", "c", "d", "e"]})
    prose = 'Claro: {"response_text": "  ", "response_html": "<p>x</p>"} fin'
    broken = "no json {here"
    got = _run(spark, [clean, prose, broken])
    assert got[0]["response_text"] == "Hola" and not got[0]["parse_error"]
    assert got[0]["focus_files"] == ["a", "b", "c", "d"]
    assert got[1]["response_text"] == "resumen" and got[1]["response_html"] == "<p>x</p>"
    assert got[1]["focus_files"] == ["ventas.csv"]
    assert got[2]["parse_error"] and got[2]["response_text"] == "resumen"


def test_artifact_cleaning_caps_and_kinds(spark):
    arts = [
        {"type": " HTML ", "html": "<b>x</b>"},
        {"type": "html", "html": "   "},
        {"type": "chart", "chart": {"kind": "pie", "data": []}},
        {"type": "chart", "title": "T", "chart": {"kind": "bar", "data": [{"label": str(i), "value": i} for i in range(20)]}},
        {"type": "table", "rows": []},
        {"type": "table", "rows": [{"a": i} for i in range(15)]},
        {"type": "html", "html": "<i>seventh is dropped</i>"},
    ]
    got = _run(spark, [json.dumps({"response_text": "ok", "artifacts": arts})])[0]
    kinds = [a["type"] for a in got["artifacts"]]
    assert kinds == ["html", "chart", "table"]
    chart = got["artifacts"][1]["chart"]
    assert chart["title"] == "T" and chart["kind"] == "bar" and len(chart["data"]) == 12
    assert len(got["artifacts"][2]["rows"]) == 12


def test_legacy_fields_and_fallback(spark):
    legacy = json.dumps({"response_text": "x", "analysis": ["a", "b", "c", "d", "e"],
                         "chart": {"kind": "line", "data": [{"label": "m", "value": 1}]}, "table": [{"k": 1}]})
    got = _run(spark, [legacy])[0]
    assert [a["type"] for a in got["artifacts"]] == ["html", "chart", "table"]
    assert got["artifacts"][0]["html"].count("<li>") == 4
    assert got["artifacts"][1]["title"] == "Visualización"
    assert got["artifacts"][2]["title"] == "Detalle"


def test_panel_defaults_caps_and_contexts(spark):
    from tally.operators.answers import clean_panels

    texts = [
        json.dumps({"title": "T", "insights": list("abcde"), "metrics": [{"label": str(k), "value": 1, "context": c} for k, c in enumerate(["HOJA1", "Sheet 2", "ventas", None, "x"])],
                    "charts": [{"title": "c", "kind": "bar", "data": []}] * 3}),
        "{}", "nada",
    ]
    df = spark.createDataFrame([(i, t, "f.csv", "csv", "resumen") for i, t in enumerate(texts)], "id int, t string, f string, k string, s string")
    got = {r["id"]: r for r in clean_panels(df, "t", "f", "k", "s").collect()}
    first = got[0]["panel"]
    assert (first["title"], first["input_kind"], first["summary"]) == ("T", "csv", "resumen")
    assert first["insights"] == list("abcd") and len(first["charts"]) == 2
    assert [m["context"] for m in first["metrics"]] == ["", "", "ventas", None]
    assert got[1]["panel"]["title"] == "f.csv" and got[1]["panel"]["metrics"] == [] and not got[1]["panel_error"]
    assert got[2]["panel_error"]


def test_answer_fallbacks(spark):
    chart = {"type": "chart", "title": "Ventas", "chart": {"title": " ", "kind": "bar", "data": [{"label": "a", "value": "12"}, {"label": "b", "value": 3}]}}
    got = _run(spark, [json.dumps({"response_text": "x", "artifacts": [chart], "focus_files": []})])[0]
    assert got["focus_files"] == ["ventas.csv"]
    assert got["artifacts"][0]["chart"]["title"] == "Ventas"
    assert [p["value"] for p in got["artifacts"][0]["chart"]["data"]] == [12.0, 3.0]
