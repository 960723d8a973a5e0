"""Checks for chunks, vectors and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import truncate_text
from ..operators import approx as ax
from ..operators import chunks as ch
from ..operators import vectors as vx
from ..sources.tables import Tables
from ..session import spread
from .registry import check

ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _duck_csv_field(c: str) -> str:
    v = f"CAST({c} AS VARCHAR)"
    return (
        f"CASE WHEN {v} IS NULL THEN '' WHEN regexp_matches({v}, '[,\"\\r\\n]') "
        f"THEN '\"' || replace({v}, '\"', '\"\"') || '\"' ELSE {v} END"
    )


def d01_row_chunks_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders cut into chunks of 100 rows in key order (content digested)."""
    c = ch.row_chunks(Tables(spark, sf_dir).orders, "orders", ["o_orderkey"])
    return c.select(
        "chunk_index", "start_row", "end_row",
        F.length("content").cast("bigint").alias("content_len"), F.md5("content").alias("content_md5"),
    )


_LINE = " || ',' || ".join(_duck_csv_field(c) for c in ORDERS_COLS)

check(
    "d01_row_chunks_orders",
    oracle=f"""
    WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders),
    l AS (SELECT rn, (rn - 1) // 100 AS chunk_index, {_LINE} AS line FROM r),
    g AS (SELECT chunk_index, min(rn) AS start_row, max(rn) AS end_row,
                 'Sección: orders' || chr(10) || 'Tabla DuckDB: sheet_orders' || chr(10) || 'Filas aproximadas: '
                 || min(rn) || ' a ' || max(rn) || chr(10) || chr(10) || '{",".join(ORDERS_COLS)}' || chr(10)
                 || string_agg(line, chr(10) ORDER BY rn) || chr(10) AS content
          FROM l GROUP BY chunk_index)
    SELECT chunk_index, start_row, end_row, CAST(length(content) AS BIGINT) AS content_len, md5(content) AS content_md5
    FROM g
    """,
)(d01_row_chunks_orders)


def d02_dataset_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 + D2: every chunk of a two-section dataset (summary, catalogs, rows)."""
    t = Tables(spark, sf_dir)
    chunks = ch.dataset_chunks(
        spark, [("orders", t.orders, ["o_orderkey"]), ("customer", t.customer, ["c_custkey"])], dataset_id="ds"
    )
    return chunks.groupBy("chunk_type", "section").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("content")).cast("bigint").alias("chars")
    )


CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _duck_row_chunks(table: str, cols: list[str], key: str) -> str:
    """DuckDB twin of the row chunks of one section (content per chunk of 100 rows)."""
    line = " || ',' || ".join(_duck_csv_field(c) for c in cols)
    return f"""
    SELECT 'row_chunk' AS chunk_type, '{table}' AS section,
           'Sección: {table}' || chr(10) || 'Tabla DuckDB: sheet_{table}' || chr(10) || 'Filas aproximadas: '
           || min(rn) || ' a ' || max(rn) || chr(10) || chr(10) || '{",".join(cols)}' || chr(10)
           || string_agg(line, chr(10) ORDER BY rn) || chr(10) AS content
    FROM (SELECT row_number() OVER (ORDER BY {key}) AS rn, {line} AS line FROM {table}) l
    GROUP BY (rn - 1) // 100"""


def _catalog_chunk_sql(table: str, cols: list[str]) -> str:
    listed = "[" + ", ".join("''" + c + "''" for c in cols) + "]"
    return (f"SELECT 'sheet_catalog' AS chunk_type, '{table}' AS section, "
            f"'Sección: {table}' || chr(10) || 'Tabla DuckDB: sheet_{table}' || chr(10) || 'Columnas: {listed}' AS content")


check(
    "d02_dataset_chunks",
    oracle=f"""
    WITH c AS (
      SELECT 'workbook_summary' AS chunk_type, CAST(NULL AS VARCHAR) AS section, '' AS content
      UNION ALL {_catalog_chunk_sql("orders", ORDERS_COLS)}
      UNION ALL {_catalog_chunk_sql("customer", CUSTOMER_COLS)}
      UNION ALL {_duck_row_chunks("orders", ORDERS_COLS, "o_orderkey")}
      UNION ALL {_duck_row_chunks("customer", CUSTOMER_COLS, "c_custkey")})
    SELECT chunk_type, section, count(*) AS n_chunks, CAST(sum(length(content)) AS BIGINT) AS chars
    FROM c GROUP BY chunk_type, section
    """,
)(d02_dataset_chunks)


def d03_truncate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 over whole documents: over 12,000 characters, cut plus a marker line."""
    d = spread(Tables(spark, sf_dir).documents.select("doc_id", "text"))
    t = truncate_text(F.col("text"))
    return d.select("doc_id", F.length(t).cast("bigint").alias("chunk_len"), F.md5(t).alias("chunk_md5"))


check(
    "d03_truncate_documents",
    oracle="""
    WITH t AS (SELECT doc_id, CASE WHEN length(text) > 12000
                                   THEN left(text, 12000) || chr(10) || '[truncado para embedding]' ELSE text END AS c
               FROM documents)
    SELECT doc_id, CAST(length(c) AS BIGINT) AS chunk_len, md5(c) AS chunk_md5 FROM t
    """,
)(d03_truncate_documents)


def d04_text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark-native vectors of the documents' chunk text (width 1536, unit length)."""
    d = spread(Tables(spark, sf_dir).documents.select("doc_id", truncate_text(F.col("text")).alias("content")))
    v = vx.text_vectors(d, "content")
    return v.select(
        "doc_id", F.size("embedding").cast("bigint").alias("width"),
        F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("norm"),
    )


check("d04_text_vectors")(d04_text_vectors)


def _queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    emb = Tables(spark, sf_dir).embeddings
    return emb, vx.label_centroid_queries(emb)


_CENTROIDS = """
    e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings),
    c AS (SELECT label AS query_id, list(round(m, 8) ORDER BY i) AS q
          FROM (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i) GROUP BY label),
    s AS (SELECT c.query_id, embeddings.label, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score
          FROM embeddings, c)
"""


def d05_cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-4 vectors per query; queries = rounded label centroids."""
    emb, q = _queries(spark, sf_dir)
    hits = vx.cosine_top_k(emb, q, k=vx.CALLER_TOP_K, id_col="vec_id")
    return hits.select(
        F.col("query_id").cast("bigint").alias("query_id"), F.col("rank").cast("bigint").alias("rank"),
        "vec_id", F.round("score", 6).alias("score"),
    )


check(
    "d05_cosine_top_k",
    oracle=f"""
    WITH {_CENTROIDS}
    SELECT CAST(query_id AS BIGINT) AS query_id, rank, vec_id, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) r
    WHERE rank <= 4
    """,
)(d05_cosine_top_k)


def d06_top_k_per_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (query, dataset = label) top-4, first 3 kept."""
    emb, q = _queries(spark, sf_dir)
    hits = vx.cosine_top_k(emb, q, k=vx.CALLER_TOP_K, id_col="vec_id", partition_col="label")
    return hits.where(F.col("rank") <= vx.CALLER_KEEP).select(
        F.col("query_id").cast("bigint").alias("query_id"), F.col("label").cast("bigint").alias("dataset"),
        F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("score", 6).alias("score"),
    )


check(
    "d06_top_k_per_dataset",
    oracle=f"""
    WITH {_CENTROIDS}
    SELECT CAST(query_id AS BIGINT) AS query_id, CAST(label AS BIGINT) AS dataset, rank, vec_id,
           round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank FROM s) r
    WHERE rank <= 3
    """,
)(d06_top_k_per_dataset)


def d07_query_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors (label centroids) rounded to 8 decimals."""
    _, q = _queries(spark, sf_dir)
    return q.select(
        F.col("query_id").cast("bigint").alias("query_id"),
        F.size("query_vec").cast("bigint").alias("width"),
        F.round(F.aggregate("query_vec", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("l1"),
    )


check(
    "d07_query_rounding",
    oracle=f"""
    WITH {_CENTROIDS}
    SELECT CAST(query_id AS BIGINT) AS query_id, CAST(len(q) AS BIGINT) AS width,
           round(list_sum(list_transform(q, lambda v: abs(v))), 6) AS l1 FROM c
    """,
)(d07_query_rounding)


def d05_cosine_top_k_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 with 100 query vectors: centroids of (label, vec_id mod 10) groups."""
    emb = Tables(spark, sf_dir).embeddings
    grouped = emb.withColumn("qgroup", F.col("label") * 10 + F.col("vec_id") % 10)
    q = vx.label_centroid_queries(grouped, group_col="qgroup")
    hits = vx.cosine_top_k(emb, q, k=vx.CALLER_TOP_K, id_col="vec_id")
    return hits.select(
        F.col("query_id").cast("bigint").alias("query_id"), F.col("rank").cast("bigint").alias("rank"),
        "vec_id", F.round("score", 6).alias("score"),
    )


check(
    "d05_cosine_top_k_100",
    oracle="""
    WITH e AS (SELECT label * 10 + vec_id % 10 AS g, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x
               FROM embeddings),
    c AS (SELECT g AS query_id, list(round(m, 8) ORDER BY i) AS q
          FROM (SELECT g, i, avg(x) AS m FROM e GROUP BY g, i) GROUP BY g),
    s AS (SELECT c.query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, c)
    SELECT CAST(query_id AS BIGINT) AS query_id, rank, vec_id, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) r
    WHERE rank <= 4
    """,
)(d05_cosine_top_k_100)


def _neighbour_queries(emb: DataFrame) -> DataFrame:
    return emb.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def d05_cosine_top_k_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 with every stored vector as a query: the grid of query blocks and vector slices."""
    emb = Tables(spark, sf_dir).embeddings
    q = emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    hits = vx.cosine_top_k(emb, q, k=vx.CALLER_TOP_K, id_col="vec_id", max_queries_per_block=128)
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


check(
    "d05_cosine_top_k_all",
    oracle="""
    SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (
      SELECT q.vec_id AS query_id, v.vec_id, s.score, row_number() OVER (PARTITION BY q.vec_id ORDER BY s.score DESC, v.vec_id) AS rank
      FROM embeddings q, embeddings v, LATERAL (SELECT list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score) s) r
    WHERE rank <= 4
    """,
)(d05_cosine_top_k_all)


def d08_approx_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate top-4 of every 20th vector, with the exact rank of each hit (null: none of the exact top 4)."""
    emb = Tables(spark, sf_dir).embeddings
    q = _neighbour_queries(emb)
    exact = vx.cosine_top_k(emb, q, k=vx.CALLER_TOP_K, id_col="vec_id").select("query_id", "vec_id", F.col("rank").alias("exact_rank"))
    hits = ax.approximate_top_k(emb, q, vx.CALLER_TOP_K, id_col="vec_id")
    return hits.join(exact, ["query_id", "vec_id"], "left").select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"), "exact_rank", "candidates")


check("d08_approx_top_k")(d08_approx_top_k)


def d08_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recall of approximate search over all its queries, against its bound."""
    emb = Tables(spark, sf_dir).embeddings
    q = _neighbour_queries(emb)
    exact = vx.cosine_top_k(emb, q, k=vx.CALLER_TOP_K, id_col="vec_id")
    found = ax.approximate_top_k(emb, q, vx.CALLER_TOP_K, id_col="vec_id")
    return ax.recall(found, exact, "vec_id").agg(
        F.count(F.lit(1)).alias("n_queries"), F.sum("wanted").alias("wanted"), (F.sum("hits") / F.sum("wanted") >= 0.9).alias("recall_reached"))


check(
    "d08_recall",
    oracle="SELECT count(*) AS n_queries, CAST(4 * count(*) AS BIGINT) AS wanted, true AS recall_reached FROM embeddings WHERE vec_id % 20 = 0",
)(d08_recall)
