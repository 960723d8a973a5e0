"""Running totals over one global order (Q9) without a one-task window.

Rows are range-partitioned by the order and sorted inside their partitions
(``rowindex.row_index``: a checkpoint).  Equal runs of row numbers are blocks;
inside a block Spark's own window gives the running value, and what all blocks
before it amount to, one row a block, is carried in as an offset.  A block's
carried values come from a window over those few rows.

Frames of the last ``k`` rows cross from one block into the next: the last
``k`` rows of a block are handed to the next one as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rowindex import row_index

BLOCK_ROWS = 100_000


def _blocks(df: DataFrame, order_by: Sequence, rows: int) -> DataFrame:
    return row_index(df, order_by, name="__n").withColumn("__block", F.floor((F.col("__n") - 1) / rows).cast("long")).checkpoint()


def running(df: DataFrame, order_by: Sequence, sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with, for each row and in the total order ``order_by``, running sums and last non-null values up to it.

    Nulls add nothing; a running value is null until the first non-null one.
    """
    sums, last = sums or {}, last or {}
    rows = _blocks(df.withColumns({f"__s_{k}": c for k, c in sums.items()} | {f"__l_{k}": c for k, c in last.items()}), order_by, block_rows)
    totals = rows.groupBy("__block").agg(
        F.count(F.lit(1)).alias("__rows"), *[F.sum(f"__s_{k}").alias(f"__s_{k}") for k in sums],
        *[F.max_by(F.col(f"__l_{k}"), F.when(F.col(f"__l_{k}").isNotNull(), F.col("__n"))).alias(f"__l_{k}") for k in last])
    # One row for each block: catalog-sized.
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("__block", *[F.sum(f"__s_{k}").over(before).alias(f"__cs_{k}") for k in sums], *[F.last(f"__l_{k}", ignorenulls=True).over(before).alias(f"__cl_{k}") for k in last])
    inside = Window.partitionBy("__block").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(carried, "__block")
    for k in sums:
        own, prior = F.sum(f"__s_{k}").over(inside), F.col(f"__cs_{k}")
        out = out.withColumn(k, F.when(prior.isNull(), own).when(own.isNull(), prior).otherwise(prior + own))
    for k in last:
        out = out.withColumn(k, F.coalesce(F.last(f"__l_{k}", ignorenulls=True).over(inside), F.col(f"__cl_{k}")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in {*sums, *last}], *sums, *last)


def moving(df: DataFrame, order_by: Sequence, k: int, values: dict[str, Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with aggregates (such as ``F.avg("x")``) over the last ``k`` rows up to each row of the total order."""
    size = max(block_rows, k)
    rows = _blocks(df, order_by, size)
    place = (F.col("__n") - 1) % size
    handed = rows.where(place >= size - (k - 1)).withColumn("__block", F.col("__block") + 1).withColumn("__own", F.lit(False))
    frame = Window.partitionBy("__block").orderBy("__n").rowsBetween(-(k - 1), 0)
    out = rows.withColumn("__own", F.lit(True)).unionByName(handed)
    out = out.select("*", *[c.over(frame).alias(f"__v_{n}") for n, c in values.items()]).where("__own")
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in values], *[F.col(f"__v_{n}").alias(n) for n in values])
