"""Join of points with the intervals that hold them (Q5), without a nested loop.

A range condition alone makes Spark compare all pairs.  Here both sides get
bins and meet by equality.  An interval goes to the level whose bins are as
wide as the interval is long or up to twice that, so it lies in two bins at
most, however long it is.  A point has one bin on each level that some
interval uses (a few: the levels double in width).  So every pair that can
match meets once, in one bin, and the exact test of the original columns
decides.  A bin with very many points is split: its points are dealt over
numbered parts, and the intervals of that bin go to each part.

Null points, bounds and keys match nothing; an interval that ends before it
starts holds nothing; repeated rows join one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import position

#: Points of one bin that stay together.
BIN_POINTS = 200_000
#: Least width of a bin as a share of all intervals' span.
FINEST = 2.0**-20


def _level(length: Column, base: float) -> Column:
    """The first level whose bins are at least as wide as the interval is long."""
    return F.when(length <= base, F.lit(0)).otherwise(F.ceil(F.log2(length / base)).cast("int"))


def _bin(x: Column, level: Column, base: float) -> Column:
    return F.floor(x / (F.lit(base) * F.pow(F.lit(2.0), level))).cast("long")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    point: str,
    low: str,
    high: str,
    on: Sequence[str] = (),
    closed: bool = False,
    bin_points: int = BIN_POINTS,
) -> DataFrame:
    """Inner join on ``low <= point < high`` (``<=`` if ``closed``) and equal ``on`` columns.

    Numbers, dates and timestamps work.  The two sides' other columns must
    have different names; ``on`` columns stand once in the result.
    """
    both = set(points.columns) & set(intervals.columns) - set(on)
    if both:
        raise ValueError(f"columns on both sides: {sorted(both)}")
    keys = list(on)
    there = lambda cols: [F.col(f"`{c}`").isNotNull() for c in cols]
    right = intervals.where(F.col(low) <= F.col(high))
    left = points.where(F.col(point).isNotNull())
    for c in there(keys):
        left, right = left.where(c), right.where(c)
    right = right.withColumns({"__low": position(intervals, low), "__high": position(intervals, high)})
    edge = right.agg(F.min("__low"), F.max("__high")).first()
    if edge[0] is None:
        return left.join(intervals.limit(0), keys) if keys else left.limit(0).crossJoin(intervals.limit(0))
    base = max((edge[1] - edge[0]) * FINEST, 1e-9)
    right = right.withColumn("__level", _level(F.col("__high") - F.col("__low"), base))
    # Levels double in width, so there are some twenty at most.
    levels = sorted(r[0] for r in right.select("__level").distinct().collect())
    right = right.withColumn("__bin", F.explode(F.sequence(_bin(F.col("__low"), F.col("__level"), base), _bin(F.col("__high"), F.col("__level"), base)))).drop("__low", "__high")
    x = position(points, point)
    left = left.where((x >= edge[0]) & (x <= edge[1])).withColumn("__x", x).withColumn("__level", F.explode(F.array(*[F.lit(v) for v in levels])))
    left = left.withColumn("__bin", _bin(F.col("__x"), F.col("__level"), base)).drop("__x")
    cell = [*keys, "__level", "__bin"]
    crowded = left.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > bin_points)
    crowded = crowded.select(*cell, F.ceil(F.col("__n") / bin_points).cast("int").alias("__parts"))
    parts = F.coalesce(F.col("__parts"), F.lit(1))
    dealt = F.xxhash64(*[F.col(f"`{f.name}`") for f in points.schema.fields if not f.dataType.simpleString().startswith("map")])
    left = left.join(crowded, cell, "left").withColumn("__part", F.pmod(dealt, parts).cast("int")).drop("__parts")
    right = right.join(crowded, cell, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    inside = F.col(point) <= F.col(high) if closed else F.col(point) < F.col(high)
    return left.join(right, [*cell, "__part"]).where((F.col(low) <= F.col(point)) & inside).drop("__level", "__bin", "__part")
