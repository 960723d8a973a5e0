"""A dataset from file to answer: CSV -> sections -> written table -> catalog
-> overview -> chunks -> vectors -> retrieval, plus ad-hoc SQL over two
attached datasets (A-E together, FIXTURES part 2 ``ventas.csv``)."""

import os
import random
import tempfile

from pyspark.sql import functions as F

from tally.operators import adhoc, chunks, ingest, overview, profile, vectors
from tally.sources.files import load_sections


def _ventas(path: str) -> None:
    rnd = random.Random(3)
    lines = ["fecha,categoria,pais,monto,cantidad,sku,comentario"]
    for i in range(500):
        cat = rnd.choice(["hogar", "ropa", "juguetes", "vacío"])
        monto = "" if cat == "vacío" else f"{rnd.uniform(1, 500):.2f}"  # one all-null group
        pais = "" if i % 17 == 0 else rnd.choice(["CL", "PE", "AR"])
        lines.append(f"2024-{1 + i % 12:02d}-{1 + i % 28:02d},{cat},{pais},{monto},{rnd.randint(1, 9)},S{i:04d},nota {i}")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_file_to_answer(spark):
    tmp = tempfile.mkdtemp(prefix="tally-e2e-")
    src = os.path.join(tmp, "ventas.csv")
    _ventas(src)
    kind, sections = load_sections(spark, src)
    s = sections[0]
    table_path = os.path.join(tmp, "tables", "sheet_ventas")
    ingest.write_section(s.df, table_path)
    df = spark.read.parquet(table_path)
    assert df.count() == 500 and "_rid" in df.columns

    cat = profile.catalog(df, "ventas", dataset_id="d1").collect()
    types = {r["column_name"]: r["semantic_type"] for r in cat}
    assert types["fecha"] == "date" and types["monto"] == "money_or_amount"
    assert types["cantidad"] == "quantity" and types["sku"] == "identifier"
    assert types["categoria"] == "category" and types["comentario"] == "text"
    samples = {r["column_name"]: r["sample_values"] for r in cat}
    assert samples["sku"] == ["S0000", "S0001", "S0002", "S0003", "S0004", "S0005"]

    ov = overview.overview([("ventas", df, profile.profile(df))])
    rec = ov.first()
    assert rec["rankings"][0]["metric"] == "Monto"
    data = {p["label"]: p["value"] for p in rec["rankings"][1]["data"]}
    assert data["vacío"] == 0.0  # an all-null group sums to 0.0
    assert overview.kpis(ov).count() == 1 and overview.charts(ov).count() > 0

    ch = chunks.dataset_chunks(spark, [("ventas", df, ["_rid"])], dataset_id="d1", summary="resumen")
    rows = ch.where("chunk_type = 'row_chunk'").orderBy("chunk_index").collect()
    assert [(r["start_row"], r["end_row"]) for r in rows] == [(1, 100), (101, 200), (201, 300), (301, 400), (401, 500)]
    assert rows[0]["content"].startswith("Sección: ventas\nTabla DuckDB: sheet_ventas\nFilas aproximadas: 1 a 100\n\n")
    vec = vectors.text_vectors(ch.withColumn("id", F.monotonically_increasing_id()), "content", num_features=512)
    q = vec.where("chunk_type = 'sheet_catalog'").select(F.lit(1).alias("query_id"), F.col("embedding").alias("query_vec"))
    hits = vectors.cosine_top_k(vec, q, k=4).collect()
    assert len(hits) == 4 and hits[0]["score"] > 0.99  # the catalog chunk finds itself first

    other = os.path.join(tmp, "tables", "sheet_otra")
    spark.range(5).withColumnRenamed("id", "k").write.mode("overwrite").parquet(other)
    attached = adhoc.attach_datasets(spark, [{"sheet_ventas": table_path}, {"sheet_otra": other}, {"x": "/nope"}])
    assert set(attached) == {"ds0.sheet_ventas", "ds1.sheet_otra"}
    res = adhoc.run_sql(
        spark,
        "SELECT categoria, round(sum(monto), 2) AS total FROM ds0.sheet_ventas GROUP BY categoria ORDER BY total DESC",
        title="Ventas por categoría",
    )
    assert res.error is None and res.row_count == 4 and not res.truncated
    answer = adhoc.answer_record(res, "ventas.csv")
    assert answer["response_text"] == "Aquí tienes ventas por categoría."
    assert [a["type"] for a in answer["artifacts"]] == ["table", "chart"]
    bad = adhoc.run_sql(spark, "SELECT nope FROM ds0.sheet_ventas")
    assert bad.error and adhoc.answer_record(bad, "ventas.csv") is None
