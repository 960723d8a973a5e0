"""Checks for registry and conversation rollups.

Roles of the reference's app tables: datasets = orders (status ``F`` is
ready, created = ``o_orderdate``), session-dataset links = customer to
order, messages = ``conversations``; for F8 a session is a month of
``o_orderdate`` and a dataset is an ``o_custkey``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollups as rl
from ..sources.tables import Tables
from .registry import check


def _datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Tables(spark, sf_dir).orders
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"),
    )


def _links(ds: DataFrame) -> DataFrame:
    return ds.select("session_id", "id")


def f01_ready_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ready datasets (status F), newest first."""
    r = rl.ready_datasets(_datasets(spark, sf_dir), ready="F")
    return r.select("id", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


check(
    "f01_ready_datasets",
    oracle="SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders WHERE o_orderstatus = 'F'",
)(f01_ready_datasets)


def f02_primary_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 per session: the requested dataset (the session's first) if ready, else the newest ready."""
    ds = _datasets(spark, sf_dir)
    requested = ds.groupBy("session_id").agg(F.min("id").alias("requested_id"))
    ready = ds.where(F.col("status") == "F").join(requested, "session_id")
    return rl.primary_per_group(ready, "session_id", "requested_id")


check(
    "f02_primary_dataset",
    oracle="""
    WITH req AS (SELECT o_custkey, min(o_orderkey) AS requested_id FROM orders GROUP BY o_custkey)
    SELECT o.o_custkey AS session_id,
           arg_max(o_orderkey, (o_orderkey = requested_id, o_orderdate, o_orderkey)) AS primary_id
    FROM orders o JOIN req ON o.o_custkey = req.o_custkey
    WHERE o_orderstatus = 'F' GROUP BY o.o_custkey
    """,
)(f02_primary_dataset)


def f03_session_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """datasets of each session, newest 50."""
    ds = _datasets(spark, sf_dir)
    s = rl.session_datasets(_links(ds), ds.drop("session_id"))
    return s.select("session_id", "id", F.col("rank").cast("bigint").alias("rank"))


check(
    "f03_session_datasets",
    oracle="""
    SELECT session_id, id, rank FROM (
      SELECT o_custkey AS session_id, o_orderkey AS id,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank
      FROM orders) r
    WHERE rank <= 50
    """,
)(f03_session_datasets)


def f04_ready_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """datasets and ready datasets per session."""
    ds = _datasets(spark, sf_dir)
    return rl.ready_counts(_links(ds), ds.drop("session_id"), ready="F")


check(
    "f04_ready_counts",
    oracle="""
    SELECT o_custkey AS session_id, count(*) AS n_datasets, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_ready
    FROM orders GROUP BY o_custkey
    """,
)(f04_ready_counts)


def f05_conversation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one row per conversation with counts and an order-aware digest."""
    return rl.conversation_rollup(Tables(spark, sf_dir).conversations)


check(
    "f05_conversation_rollup",
    oracle="""
    SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE role = 'user') AS n_user,
           count(*) FILTER (WHERE role = 'assistant') AS n_assistant, CAST(sum(length(text)) AS BIGINT) AS n_chars,
           arg_min(role, turn) AS first_role,
           CAST(sum(('0x' || substr(md5(concat_ws(chr(1), CAST(turn AS VARCHAR), role, text)), 1, 12))::BIGINT)
                AS VARCHAR) AS digest
    FROM conversations GROUP BY conv_id
    """,
)(f05_conversation_rollup)


def f05_conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 payload: messages nested in turn order, in pages of at most 4 (a small
    page size so that the fixture conversations span several pages)."""
    pages = rl.conversation_pages(Tables(spark, sf_dir).conversations, page_size=4)
    return pages.select(
        "conv_id", "page", F.size("messages").cast("bigint").alias("n_messages"),
        F.col("messages")[0]["turn"].alias("first_turn"),
        F.element_at("messages", -1)["turn"].alias("last_turn"),
        F.md5(F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["text"])), "\n")).alias("digest"),
    )


check(
    "f05_conversation_pages",
    oracle="""
    WITH n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS page FROM conversations)
    SELECT conv_id, page, count(*) AS n_messages, min(turn) AS first_turn, max(turn) AS last_turn,
           md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS digest
    FROM n GROUP BY conv_id, page
    """,
)(f05_conversation_pages)


def f06_last_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """last message of each conversation, 120 characters."""
    return rl.last_message_preview(Tables(spark, sf_dir).conversations)


check(
    "f06_last_preview",
    oracle="""
    SELECT conv_id, max(turn) AS last_turn, arg_max(role, turn) AS last_role,
           coalesce(left(arg_max(text, turn), 120), '') AS preview
    FROM conversations GROUP BY conv_id
    """,
)(f06_last_preview)


def f07_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """title from the first user message (whitespace collapsed, 80 characters)."""
    return rl.conversation_titles(Tables(spark, sf_dir).conversations)


check(
    "f07_titles",
    oracle="""
    WITH f AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS t FROM conversations GROUP BY conv_id),
    c AS (SELECT conv_id, trim(regexp_replace(t, '[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS t FROM f)
    SELECT conv_id, CASE WHEN length(t) > 80 THEN left(t, 77) || '...'
                         WHEN coalesce(length(t), 0) = 0 THEN 'Nuevo chat' ELSE t END AS title
    FROM c
    """,
)(f07_titles)


def f08_retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: delete the month-sessions before 2000-01; datasets only they link are dropped."""
    o = Tables(spark, sf_dir).orders
    links = o.select(F.date_format("o_orderdate", "yyyy-MM").alias("session_id"), F.col("o_custkey").alias("dataset_id"))
    deleted = links.select("session_id").where(F.col("session_id") < "2000-01").distinct()
    return rl.retention_sweep(links, deleted)


check(
    "f08_retention_sweep",
    oracle="""
    WITH l AS (SELECT strftime(o_orderdate, '%Y-%m') AS session_id, o_custkey AS dataset_id FROM orders),
    cand AS (SELECT DISTINCT dataset_id FROM l WHERE session_id < '2000-01')
    SELECT dataset_id, CASE WHEN NOT EXISTS (SELECT 1 FROM l WHERE l.dataset_id = cand.dataset_id
                                             AND l.session_id >= '2000-01') THEN 'drop' ELSE 'keep' END AS action
    FROM cand
    """,
)(f08_retention_sweep)


def f09_session_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sessions (customers) by last activity desc, then creation desc, with position."""
    o = Tables(spark, sf_dir).orders
    sessions = o.groupBy(F.col("o_custkey").alias("session_id")).agg(
        F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("updated_at")
    )
    return rl.session_order(sessions).select("session_id", "position")


check(
    "f09_session_order",
    oracle="""
    SELECT session_id, row_number() OVER (ORDER BY updated_at DESC, created_at DESC, session_id) AS position
    FROM (SELECT o_custkey AS session_id, min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at
          FROM orders GROUP BY o_custkey) s
    """,
)(f09_session_order)


def g01_answers_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1-G5 over answer texts made from every conversation turn: the turn's
    text as ``response_text`` inside JSON wrapped in prose, with a table
    artifact (kept) and a pie chart (dropped)."""
    from ..operators.answers import clean_answers

    c = Tables(spark, sf_dir).conversations
    artifact = "struct<type:string,rows:array<string>,chart:struct<kind:string>>"
    arts = F.array(
        F.struct(F.lit("table").alias("type"), F.array(F.to_json(F.struct("conv_id", "turn"))).alias("rows"),
                 F.lit(None).cast("struct<kind:string>").alias("chart")),
        F.struct(F.lit("chart").alias("type"), F.lit(None).cast("array<string>").alias("rows"),
                 F.struct(F.lit("pie").alias("kind")).alias("chart")),
    ).cast(f"array<{artifact}>")
    answer = F.concat(F.lit("Respuesta: "), F.to_json(F.struct(F.col("text").alias("response_text"), arts.alias("artifacts"))),
                      F.lit(" fin"))
    cleaned = clean_answers(c.select("conv_id", "turn", answer.alias("answer")), "answer")
    return cleaned.select(
        "conv_id", "turn", "parse_error", F.md5("response_text").alias("text_md5"),
        F.size("artifacts").cast("bigint").alias("n_artifacts"), F.col("artifacts")[0]["type"].alias("first_type"),
    )


check(
    "g01_answers_from_conversations",
    oracle="""
    SELECT conv_id, turn, false AS parse_error,
           md5(CASE WHEN text IS NULL OR trim(text) = '' THEN 'Respuesta no disponible.' ELSE text END) AS text_md5,
           CAST(1 AS BIGINT) AS n_artifacts, 'table' AS first_type
    FROM conversations
    """,
)(g01_answers_from_conversations)


def g03_panels_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3 over panel texts made from every conversation turn: five insights and metrics
    (every third context names a sheet), the title missing on odd turns."""
    from ..operators.answers import clean_panels

    c = Tables(spark, sf_dir).conversations
    metric = lambda k: F.struct(
        F.concat(F.lit("m"), F.lit(k)).alias("label"), F.col("turn").cast("string").alias("value"),
        F.when((F.col("turn") + k) % 3 == 0, F.lit("Hoja1 total")).otherwise(F.col("role")).alias("context"))
    panel = F.to_json(F.struct(
        F.when(F.col("turn") % 2 == 0, F.col("role")).alias("title"),
        F.array(*[F.concat(F.lit(f"{k}: "), F.col("role")) for k in range(5)]).alias("insights"),
        F.array(*[metric(k) for k in range(5)]).alias("metrics")))
    rows = c.select("conv_id", "turn", F.concat(F.lit("Panel: "), panel).alias("t"), F.lit("datos.csv").alias("f"), F.lit("csv").alias("k"), F.lit("resumen").alias("s"))
    p = F.col("panel")
    return clean_panels(rows, "t", "f", "k", "s").select(
        "conv_id", "turn", "panel_error", p["title"].alias("title"), p["summary"].alias("summary"),
        F.size(p["insights"]).cast("bigint").alias("n_insights"), F.size(p["charts"]).cast("bigint").alias("n_charts"),
        F.array_join(F.transform(p["metrics"], lambda m: F.concat(m["label"], F.lit("="), m["context"])), ";").alias("contexts"))


check(
    "g03_panels_from_conversations",
    oracle="""
    SELECT conv_id, turn, false AS panel_error, CASE WHEN turn % 2 = 0 THEN coalesce(role, 'datos.csv') ELSE 'datos.csv' END AS title,
           'resumen' AS summary, CAST(4 AS BIGINT) AS n_insights, CAST(0 AS BIGINT) AS n_charts,
           'm0=' || CASE WHEN turn % 3 = 0 THEN '' ELSE role END || ';m1=' || CASE WHEN (turn + 1) % 3 = 0 THEN '' ELSE role END
           || ';m2=' || CASE WHEN (turn + 2) % 3 = 0 THEN '' ELSE role END || ';m3=' || CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS contexts
    FROM conversations
    """,
)(g03_panels_from_conversations)
