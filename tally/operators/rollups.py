"""Registry and conversation rollups (F1-F9) as table jobs.

The reference answers these with one ORM query per session (an N+1
pattern); here each is one grouped job over the whole message / link tables.
Per-group results are aggregates (counts, ``max_by`` / ``min_by``, an
order-aware digest), so no conversation is ever collected into one row;
the nested message payload comes in pages of bounded size
(``conversation_pages``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapse_whitespace
from .rowindex import row_index

# List sizes and texts.
SESSION_DATASETS = 50
PREVIEW_CHARS = 120
TITLE_MAX = 80
TITLE_CUT = 77
TITLE_ELLIPSIS = "..."
DEFAULT_TITLE = "Nuevo chat"


def ready_datasets(datasets: DataFrame, status_col="status", ready="ready", created_col="created_at",
                   id_col="id", ids: Sequence | None = None) -> DataFrame:
    """ready datasets, optionally restricted to ``ids``, newest first."""
    out = datasets.where(F.col(status_col) == ready)
    if ids:
        out = out.where(F.col(id_col).isin(list(ids)))
    return out.orderBy(F.col(created_col).desc(), F.col(id_col).desc())


def primary_per_group(ready: DataFrame, group_col: str, requested_col: str, id_col="id",
                      created_col="created_at") -> DataFrame:
    """F2 per group: the requested dataset if it is ready, else the newest ready one."""
    key = F.struct((F.col(id_col) == F.col(requested_col)).alias("is_requested"), F.col(created_col), F.col(id_col))
    return ready.groupBy(group_col).agg(F.max_by(id_col, key).alias("primary_id"))


def session_datasets(links: DataFrame, datasets: DataFrame, session_col="session_id", id_col="id",
                     created_col="created_at", n: int = SESSION_DATASETS) -> DataFrame:
    """datasets of each session (inner join on the link), newest ``n``.

    ``row_number() <= n`` plans as ``WindowGroupLimit``, applied before the
    shuffle, so a session with a huge link list never moves more than n rows
    per task.
    """
    j = links.join(datasets, id_col)
    w = Window.partitionBy(session_col).orderBy(F.col(created_col).desc(), F.col(id_col).desc())
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def ready_counts(links: DataFrame, datasets: DataFrame, session_col="session_id", id_col="id",
                 status_col="status", ready="ready") -> DataFrame:
    """datasets and ready datasets per session."""
    return links.join(datasets, id_col).groupBy(session_col).agg(
        F.count(F.lit(1)).alias("n_datasets"),
        F.count_if(F.col(status_col) == ready).alias("n_ready"),
    )


def row_digest(*cols) -> Column:
    """Order-aware digest of one message: 48 bits of the md5 of its fields."""
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def conversation_rollup(msgs: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role",
                        text_col="text") -> DataFrame:
    """one row per conversation.

    Aggregates only (turn count, per-role counts, characters, first role and
    a digest that changes with any message or its position), so a long
    conversation is reduced map-side.
    """
    return msgs.groupBy(conv_col).agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.count_if(F.col(role_col) == "user").alias("n_user"),
        F.count_if(F.col(role_col) == "assistant").alias("n_assistant"),
        F.sum(F.length(text_col)).cast("bigint").alias("n_chars"),
        F.min_by(role_col, turn_col).alias("first_role"),
        F.sum(row_digest(turn_col, role_col, text_col).cast("decimal(38,0)")).cast("string").alias("digest"),
    )


# Fixed value: messages per page of the nested payload (ours; the reference nests all).
PAGE_SIZE = 1000


def conversation_pages(msgs: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role",
                       text_col="text", page_size: int = PAGE_SIZE) -> DataFrame:
    """F5 payload: the messages of each conversation in turn order, nested in
    pages of at most ``page_size`` (``conv_id, page, messages``).

    Turns are numbered per conversation by the skew-safe ``row_index``, so
    a conversation holding a third of all messages is split over tasks and
    no group ever holds more than one page.
    """
    numbered = row_index(msgs.select(conv_col, turn_col, role_col, text_col), [turn_col], group_by=[conv_col],
                         name="__n")
    return (
        numbered.withColumn("page", F.floor((F.col("__n") - 1) / page_size).cast("bigint"))
        .groupBy(conv_col, "page")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", turn_col, role_col, text_col))),
                         lambda m: m.dropFields("__n")).alias("messages"))
    )


def last_message_preview(msgs: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role",
                         text_col="text", n: int = PREVIEW_CHARS) -> DataFrame:
    """the last message of each conversation, first 120 characters."""
    last = msgs.groupBy(conv_col).agg(
        F.max(turn_col).alias("last_turn"),
        F.max_by(F.struct(role_col, text_col), turn_col).alias("__m"),
    )
    return last.select(
        conv_col, "last_turn", F.col(f"__m.{role_col}").alias("last_role"),
        F.coalesce(F.substring(F.col(f"__m.{text_col}"), 1, n), F.lit("")).alias("preview"),
    )


def title_text(c) -> Column:
    """F7 text rule: whitespace collapsed; over 80 characters, 77 plus ``...``; empty gives the default."""
    t = collapse_whitespace(c)
    return (
        F.when(F.length(t) > TITLE_MAX, F.concat(F.substring(t, 1, TITLE_CUT), F.lit(TITLE_ELLIPSIS)))
        .when(F.coalesce(F.length(t), F.lit(0)) == 0, F.lit(DEFAULT_TITLE))
        .otherwise(t)
    )


def conversation_titles(msgs: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role",
                        text_col="text") -> DataFrame:
    """title from the first user message of each conversation."""
    first = msgs.groupBy(conv_col).agg(
        F.min_by(F.when(F.col(role_col) == "user", F.col(text_col)), F.when(F.col(role_col) == "user", F.col(turn_col))).alias("__first")
    )
    return first.select(conv_col, title_text(F.col("__first")).alias("title"))


def retention_sweep(links: DataFrame, deleted_sessions: DataFrame, session_col="session_id",
                    dataset_col="dataset_id") -> DataFrame:
    """F8: datasets of deleted sessions, marked ``drop`` when no other session links them.

    ``left_semi`` finds the candidates, ``left_anti`` against the remaining
    links finds the orphans; nothing is deleted in place.
    """
    doomed = links.join(deleted_sessions, session_col, "left_semi")
    remaining = links.join(deleted_sessions, session_col, "left_anti")
    candidates = doomed.select(dataset_col).distinct()
    orphans = candidates.join(remaining.select(dataset_col), dataset_col, "left_anti")
    return candidates.join(orphans.withColumn("__orphan", F.lit(True)), dataset_col, "left").select(
        dataset_col, F.when(F.col("__orphan"), F.lit("drop")).otherwise(F.lit("keep")).alias("action")
    )


def session_order(sessions: DataFrame, id_col="session_id", updated_col="updated_at",
                  created_col="created_at") -> DataFrame:
    """sessions listed by updated desc, created desc, with their position.

    The position is a global order, numbered by the skew-safe ``row_index``
    (no single-task window over all sessions).
    """
    return row_index(
        sessions, [F.col(updated_col).desc(), F.col(created_col).desc(), F.col(id_col).asc()], name="position"
    )
