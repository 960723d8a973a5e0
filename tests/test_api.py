"""The two user flows end to end: file to ready dataset, question to answer."""

import os
import tempfile

from tally import api
from tally.operators import adhoc

from .test_end_to_end import _ventas
from .xlsx_writer import write_xlsx


def test_process_retrieve_answer(spark):
    tmp = tempfile.mkdtemp(prefix="tally-api-")
    out = os.path.join(tmp, "store")
    src = os.path.join(tmp, "ventas.csv")
    _ventas(src)
    book = os.path.join(tmp, "Resumen Anual.xlsx")
    write_xlsx(book, [("Metas", "visible", [["Región", "Meta"], ["Norte", 100], ["Sur", 80]]),
                      ("Notas", "hidden", [["nota"], ["interna"]])])

    rec = api.process_dataset(spark, src, out, description="Ventas 2024", num_features=256)
    assert rec["status"] == "ready" and rec["dataset_id"] == "ventas"
    assert rec["summary"] == "Ventas 2024"
    analysis = rec["profile"]["analysis_json"]
    assert analysis["metrics"][0]["label"] == "Monto" and analysis["metrics"][0]["value"].startswith("$")
    assert len(analysis["charts"]) == 1 and analysis["charts"][0]["title"] == "Fecha por Monto"
    rec2 = api.process_dataset(spark, book, out, num_features=256)
    assert rec2["dataset_id"] == "resumen_anual"
    assert [s["hidden"] for s in rec2["profile"]["sheets"]] == [False, True]

    ctx = api.retrieve_context(spark, out, ["resumen_anual", "ventas"], "ventas por categoria hogar")
    by = {p["dataset_id"]: p["chunks"] for p in ctx["retrieved_chunks"]}
    assert len(by["ventas"]) == 3 and len(by["resumen_anual"]) >= 1
    assert {c["db_alias"] for c in ctx["schema_context"]} == {"ds0", "ds1"}
    samples = {(r["dataset_id"], r["table_name"]): r["sample_rows"] for r in ctx["sample_rows"]}
    assert len(samples[("ventas", "sheet_ventas")]) == 3
    assert len(samples[("ventas", "sheet_ventas")][0]) == 7  # seven data columns (row id not shown)
    assert samples[("resumen_anual", "sheet_metas")][0] == {"regi_n": "Norte", "meta": 100}
    missing = api.retrieve_context(spark, out, ["nope"], "x")
    assert missing["retrieved_chunks"] == [{"dataset_id": "nope", "chunks": []}]

    adhoc.attach_datasets(spark, [api.table_paths(spark, out, "ventas"), api.table_paths(spark, out, "resumen_anual")])
    ans = adhoc.answer_question(
        spark, "Total de ventas por categoría",
        "SELECT categoria, round(sum(monto), 2) AS total FROM ds0.sheet_ventas GROUP BY categoria ORDER BY total DESC",
        "ventas.csv", title="Ventas por categoría")
    assert ans["artifacts"][1]["chart"]["data"][0]["label"] in {"hogar", "ropa", "juguetes"}
    both = adhoc.run_sql(spark, "SELECT (SELECT count(*) FROM ds0.sheet_ventas) + (SELECT count(*) FROM ds1.sheet_metas) AS n")
    assert both.rows == [{"n": 502}]
    adhoc.attach_datasets(spark, [{"sheet_metas": api.table_paths(spark, out, "resumen_anual")["sheet_metas"]}])
    assert adhoc.run_sql(spark, "SELECT count(*) AS n FROM ds0.sheet_ventas").error is not None  # re-attach replaced ds0
    assert adhoc.run_sql(spark, "SELECT count(*) AS n FROM ds0.sheet_metas").rows == [{"n": 2}]


def test_command_line_in_process(spark, capsys):
    import json

    from tally.__main__ import main

    tmp = tempfile.mkdtemp(prefix="tally-cli-")
    src = os.path.join(tmp, "ventas.csv")
    _ventas(src)
    store = os.path.join(tmp, "store")
    main(["process", src, store])
    rec = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert rec["dataset_id"] == "ventas" and rec["status"] == "ready"
    main(["ask", store, "ventas", "ventas totales", "SELECT count(*) AS n FROM ds0.sheet_ventas"])
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["answer"]["artifacts"][0]["rows"] == [{"n": 500}]


def test_a_refresh_is_seen_whole_or_not_at_all(spark, monkeypatch):
    from pyspark.ml import PipelineModel

    from tally.operators import store

    tmp = tempfile.mkdtemp(prefix="tally-store-")
    out, src = os.path.join(tmp, "store"), os.path.join(tmp, "ventas.csv")
    seen = lambda: (api.table_paths(spark, out, "ventas"), spark.read.parquet(api.table_paths(spark, out, "ventas")["sheet_ventas"]).count())
    with open(src, "w") as f:
        f.write("k,v\n" + "".join(f"{i},first {i}\n" for i in range(10)))
    assert store.current(spark, out).count() == 0 and api.table_paths(spark, out, "ventas") == {}
    api.process_dataset(spark, src, out, num_features=64)
    old = seen()
    assert old[1] == 10
    with open(src, "w") as f:
        f.write("k,v\n" + "".join(f"{i},second {i}\n" for i in range(25)))
    # Stopped behind the tables, behind the catalog and right before the manifest.
    for name, target in (("local_profile", api), ("apply_text_vectorizer", api.vx), ("history", store)):
        with monkeypatch.context() as m:
            def stop(*a, **k):
                raise RuntimeError("lost")
            m.setattr(target, name, stop)
            try:
                api.process_dataset(spark, src, out, num_features=64)
                raise AssertionError("not stopped")
            except RuntimeError as e:
                assert str(e) == "lost"
        assert seen() == old
        hit = api.retrieve_context(spark, out, ["ventas"], "first 3")
        assert any("first" in c for c in hit["retrieved_chunks"][0]["chunks"]) and not any("second" in c for c in hit["retrieved_chunks"][0]["chunks"])
    api.process_dataset(spark, src, out, num_features=64)
    new = seen()
    assert new[1] == 25 and new[0] != old[0]
    assert store.history(spark, out).count() == 2 and store.current(spark, out).first()["sequence"] == 2
    assert store.sweep(spark, out, "ventas") == 4 and seen() == new
    assert store.history(spark, out).count() == 1
    assert PipelineModel.load(os.path.join(store.root_of(spark, out, "ventas"), "vectorizer")) is not None


def test_merged_sketches_are_a_profile(spark):
    from pyspark.sql import functions as F

    from tally.operators import sketches
    from tally.operators.profile import profile

    df = spark.range(20_000).select(
        (F.col("id") % 700).cast("int").alias("k"), F.when(F.col("id") % 5 > 0, F.sqrt(F.col("id").cast("double"))).alias("x"),
        F.concat(F.lit("w"), F.col("id") % 3000).alias("w"), (F.col("id") % 3 == 0).alias("b"), F.lit(None).cast("string").alias("none"), F.array(F.col("id") % 7).alias("list"))
    parts = None
    for p in range(4):
        parts = sketches.refresh(parts, df.where(f"k % 4 = {p}"), "d", str(p))
    # A part that comes again replaces itself.
    parts = sketches.refresh(parts, df.where("k % 4 = 2"), "d", "2").unionByName(sketches.refresh(None, df.limit(0), "d", "empty"))
    got = {r.column_name: r for r in sketches.read_profile(sketches.merged(parts, ["dataset_id"]), (0.5,)).collect()}
    for e in profile(df).collect():
        g = got[e.column_name]
        assert (g.rows, g.nulls, g.non_nulls) == (e.rows, e.nulls, e.non_nulls)
        assert abs(g.distinct - e["distinct"]) <= 0.03 * e["distinct"] + 0.5
        if e["mean"] is not None:
            assert abs(g["mean"] - e["mean"]) < 1e-9 * max(1, abs(e["mean"]))
    median = df.agg(F.percentile("x", 0.5)).first()[0]
    below = df.where(F.col("x") <= got["x"].quantiles[0]).count() / df.where("x is not null").count()
    assert abs(below - 0.5) < 0.01 and abs(got["x"].quantiles[0] - median) < 2
    assert got["none"].quantiles is None and got["none"]["distinct"] == 0 and got["x"].least == 1.0
