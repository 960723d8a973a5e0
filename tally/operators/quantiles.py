"""Exact quantiles by rank (Q17): no group is held in one buffer.

Rows become (group, value, count), range-partitioned and sorted by (group,
value); a hot group lies in many partitions.  Each partition counts its part
of a group, the counts of the parts before it are carried in, and a value
knows the ranks it covers.  The rows that cover a wanted rank are picked.

Nulls are left out; NaN is the greatest value; groups without values have no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir, shuffle_partitions


def _ranked(df: DataFrame, group_by: Sequence[str], value: str) -> DataFrame:
    """Distinct values of each group with ``__before`` (values below it) and ``__through`` (values up to it)."""
    ensure_checkpoint_dir(df.sparkSession)
    groups = list(group_by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__c"))
    n = shuffle_partitions(df.sparkSession)
    # Bounds of a range exchange are sampled, so ranks must come from the very rows that are kept.
    rows = counts.repartitionByRange(n, *groups, value).sortWithinPartitions(*groups, value).withColumn("__part", F.spark_partition_id()).checkpoint()
    parts = rows.groupBy(*groups, "__part").agg(F.sum("__c").alias("__sum"))
    earlier = Window.partitionBy(*groups).orderBy("__part")
    # One row for each group and partition that holds some of it.
    parts = parts.select(*groups, "__part", F.sum("__sum").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("__offset"), F.sum("__sum").over(Window.partitionBy(*groups)).alias("__total"))
    named = parts.select(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)], F.col("__part").alias("__p"), "__offset", "__total")
    same = F.col("__part") == F.col("__p")
    for k, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    inside = Window.partitionBy("__part", *groups).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    through = F.coalesce(F.col("__offset"), F.lit(0)) + F.sum("__c").over(inside)
    return rows.join(named, same).withColumn("__through", through).withColumn("__before", F.col("__through") - F.col("__c"))


def quantiles(df: DataFrame, group_by: Sequence[str], value: str, shares: dict[str, float], discrete: bool = False, count: str | None = None) -> DataFrame:
    """One row for each group: a column for each of ``shares`` (name to share of the values), and ``count`` if named.

    Interpolated between the two nearest values, or with ``discrete`` the
    least value whose cumulative share reaches the wanted one.
    """
    rows, x = _ranked(df, group_by, value), F.col(value)
    before, through, total = F.col("__before"), F.col("__through"), F.col("__total")
    picks = []
    for name, share in shares.items():
        if discrete:
            hit = (through / total >= share) & ((before / total < share) | (before == 0))
            picks.append(F.max(F.when(hit, x)).alias(name))
            continue
        at = F.lit(share) * (total - 1)
        low, high = F.floor(at), F.ceil(at)
        covers = lambda rank: (before <= rank) & (rank < through)
        least, most = F.max(F.when(covers(low), x)), F.max(F.when(covers(high), x))
        weight = F.max(at - low)
        picks.append(F.when(weight == 0, least).otherwise(least + (most - least) * weight).alias(name))
    if count:
        picks.append(F.max("__total").alias(count))
    return rows.groupBy(*group_by).agg(*picks)
