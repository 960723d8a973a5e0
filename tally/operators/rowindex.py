"""Row numbers without pulling a table (or a hot group) into one task.

``row_number()`` over a window with no ``PARTITION BY`` moves every row to a
single task, and ``PARTITION BY key`` moves a hot key to a single task.  The
index here is the DataFrame form of ``zipWithIndex``:

1. range-partition on ``(group..., order...)``: the sampler splits a hot
   group over several partitions, like any other range of keys;
2. sort inside each partition and take the position in the partition from
   ``monotonically_increasing_id`` (partition id in the upper 31 bits, the
   position in the lower 33);
3. checkpoint those rows (to ``spark.checkpoint.dir``), count rows per
   partition (one row per partition), turn the counts into offsets on that
   tiny table and broadcast it back.  Its size is bounded by the number of
   partitions, not by the data.

With group columns the index restarts per group: the first global index of
each group is taken by an aggregate (one row per group, partial aggregation
map-side) and joined back; AQE picks broadcast or shuffle for it from the
measured size and splits skewed partitions of the big side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir, shuffle_partitions

_LOW_BITS = (1 << 33) - 1


def _as_cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def row_index(
    df: DataFrame,
    order_by: Sequence,
    group_by: Sequence[str] = (),
    name: str = "rn",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add a 1-based ``name`` column numbering rows by ``order_by``.

    ``order_by`` items are column names or sort Columns (``F.col(x).desc()``);
    they should form a total order (ties get distinct, arbitrary numbers).
    """
    n = num_partitions or shuffle_partitions(df.sparkSession)
    keys = list(group_by) + list(order_by)
    ranged = df.repartitionByRange(n, *_as_cols(keys)).sortWithinPartitions(*_as_cols(keys))
    mid = "__tally_mid"
    # Materialize the partitioned, sorted, tagged rows once: two independent
    # range exchanges may sample different bounds, so the counts must come
    # from the very rows that get numbered.  The checkpoint also cuts lineage.
    ensure_checkpoint_dir(df.sparkSession)
    tagged = ranged.withColumn(mid, F.monotonically_increasing_id()).checkpoint(eager=True)
    part = F.shiftright(F.col(mid), 33)
    counts = tagged.groupBy(part.alias("__pid")).agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition: a window without PARTITION BY is fine here.
    offsets = counts.select(
        "__pid",
        (F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))).alias("__off"),
    ).fillna(0, subset=["__off"])
    indexed = (
        tagged.join(F.broadcast(offsets), part == F.col("__pid"), "left")
        .withColumn(name, F.col("__off") + F.col(mid).bitwiseAND(F.lit(_LOW_BITS)) + F.lit(1))
        .drop("__pid", "__off", mid)
    )
    if not group_by:
        return indexed
    firsts = indexed.groupBy(*group_by).agg(F.min(name).alias("__first"))
    firsts = firsts.select([F.col(g).alias(f"__g{i}") for i, g in enumerate(group_by)] + ["__first"])
    cond = None
    for i, g in enumerate(group_by):
        term = indexed[g].eqNullSafe(F.col(f"__g{i}"))
        cond = term if cond is None else cond & term
    return (
        indexed.join(firsts, cond, "inner")
        .withColumn(name, F.col(name) - F.col("__first") + F.lit(1))
        .drop("__first", *[f"__g{i}" for i in range(len(group_by))])
    )
