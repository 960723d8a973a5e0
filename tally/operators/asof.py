"""As-of match: for each probe row, the latest earlier row of the same key.

Spark has no as-of join (and ``a asof join b`` silently parses as an alias).
A range join would emit every earlier row of a key, and a window partitioned
by the key alone puts a hot key in one task.  All steps here are DataFrame
operations, with nothing on the driver:

1. rows tied on (key, order) become one row, the last of them in tiebreak
   order, by a partial aggregate;
2. the order's range is cut into slices of equal width; inside one key and
   slice the row before is a ``lag``;
3. the last row of each (key, slice) is carried into the key's later slices
   by a window over those few rows, for the first row of each slice;
4. the probe rows look their (key, order) up.  A hot key is spread over its
   slices and instants in every shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Slices of the order's range; a key's rows are spread over as many tasks.
SLICES = 256


def position(df: DataFrame, order: str) -> Column:
    """The order column as a number."""
    c, kind = F.col(order), df.schema[order].dataType
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    if isinstance(kind, T.DateType):
        return days
    if isinstance(kind, T.TimestampNTZType):  # without a time zone: days and seconds of the day
        return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return c.cast("double")


def asof_previous(
    df: DataFrame,
    by: str,
    order: str,
    tiebreak: str | None = None,
    probe: Column | None = None,
    carry: Sequence[str] | None = None,
    slices: int = SLICES,
) -> DataFrame:
    """Probe rows plus ``prev_<col>`` columns of the latest row with the same
    ``by`` and a strictly smaller ``order`` (nulls when there is none).

    Among rows tied on ``order`` the one last in ``tiebreak`` order is taken.
    ``probe`` selects the rows answered (default: all).  ``carry`` names the
    columns of the predecessor returned (default: all but ``by``).  ``order``
    is a number, date or timestamp; a null key or order has no predecessor
    and is none.
    """
    carry = list(carry) if carry else [c for c in df.columns if c != by]
    payload = list(dict.fromkeys([by, order, *carry]))
    row = F.struct(*payload)
    known = df.where(F.col(by).isNotNull() & F.col(order).isNotNull())
    instants = known.groupBy(F.col(by).alias("__by"), F.col(order).alias("__at"), position(df, order).alias("__x")).agg(
        (F.max_by(row, F.col(tiebreak)) if tiebreak else F.max(row)).alias("__row")
    )
    low, high = known.select(position(df, order).alias("x")).agg(F.min("x"), F.max("x")).first()
    width = ((high or 0.0) - (low or 0.0)) / slices
    place = F.floor((F.col("__x") - F.lit(low)) / F.lit(width)) if width > 0 else F.lit(0)
    instants = instants.withColumn("__slice", place).drop("__x")
    ends = instants.groupBy("__by", "__slice").agg(F.max_by("__row", "__at").alias("__end"))
    earlier = Window.partitionBy("__by").orderBy("__slice")
    carried = ends.withColumn("__carried", F.lag("__end").over(earlier)).drop("__end")
    inside = Window.partitionBy("__by", "__slice").orderBy("__at")
    before = instants.withColumn("__before", F.lag("__row").over(inside)).join(carried, ["__by", "__slice"])
    before = before.select("__by", "__at", F.coalesce("__before", "__carried").alias("__prev"))
    rows = df if probe is None else df.where(probe)
    found = rows.join(before, (rows[by] == before["__by"]) & (rows[order] == before["__at"]), "left")
    return found.select(*[rows[c] for c in df.columns], *[F.col("__prev")[c].alias(f"prev_{c}") for c in payload])
