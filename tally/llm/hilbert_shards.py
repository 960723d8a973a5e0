"""Shards as runs along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``2**bits`` cells in the order of its values
(``quantiled``: about equally many rows each), the cell's place on the curve
is its sort key, and the sorted rows are cut into equal runs.  A run of cells
is a compact body, so each shard spans a part of every dimension's values
only: with 8 shards over 3 dimensions about half of each, and readers of a
value or range skip the others.  The order is total
(curve index, then id and content), so one cell that holds a third of all rows
is cut like any other.  Numbers come from a range partition, never from one task.

Law ``rows``: counts differ by one at most.  Defined results: a null in a
dimension takes cell 0; texts with the same first 7 bytes share a cell; null text has size 1 and crc 0; repeated rows take
neighbouring places; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rowindex import row_index

BITS = 8


def hashed(c: Column, bits: int = BITS) -> Column:
    """Cell of a category: equal values share one."""
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(1 << bits)), F.lit(0)).cast("long")


def ordered(c: Column) -> Column:
    """A number that orders as a text's first 7 bytes do."""
    return F.conv(F.rpad(F.hex(F.substring(c.cast("string").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")


def quantiled(df: DataFrame, numbers: Mapping[str, Column], bits: int = BITS) -> dict[str, Column]:
    """Cells of numeric dimensions: how many of the ``2**bits - 1`` quantiles of ``df`` lie below the value.

    One aggregate finds the quantiles of all dimensions; its result is a few hundred numbers.
    """
    shares = F.array(*[F.lit(k / (1 << bits)) for k in range(1, 1 << bits)])
    found = df.agg(*[F.percentile_approx(c, shares, 10_000).alias(n) for n, c in numbers.items()]).first()
    below = lambda c, at: F.size(F.filter(F.array(*[F.lit(x) for x in at]), lambda q: q < c))
    return {n: (F.when(c.isNull(), F.lit(0)).otherwise(below(c, found[n])) if found[n] else F.lit(0)).cast("long") for n, c in numbers.items()}


def logarithmic(c: Column, bits: int = BITS, top: float = 40.0) -> Column:
    """Cell of a non-negative size, equal ratios being equal steps up to ``2**top``."""
    cell = F.floor(F.log2(F.greatest(c.cast("double"), F.lit(0.0)) + 1) * ((1 << bits) / top))
    return F.coalesce(F.least(cell, F.lit((1 << bits) - 1)), F.lit(0)).cast("long")


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Place on the curve of a cell given by its coordinates (Skilling's transform)."""
    n = len(cells)
    bit = lambda level: 1 << level
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(bit(k)).cast("long").alias("q")) for k in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x, s):
        xi, mask = F.get(x, s["i"]), s["q"] - 1
        odd = xi.bitwiseAND(s["q"]) != 0
        swap = F.get(x, F.lit(0)).bitwiseXOR(xi).bitwiseAND(mask)
        return F.transform(x, lambda v, j: F.when((j == 0) & odd, v.bitwiseXOR(mask)).when(~odd & ((j == 0) | (j == s["i"])) & (s["i"] > 0), v.bitwiseXOR(swap)).otherwise(v))

    turned = F.aggregate(steps, F.array(*[c.cast("long") for c in cells]), undo)

    def last(x):
        """Gray code, then every coordinate with the bits the last one flips."""
        gray = F.aggregate(x, F.array().cast("array<long>"), lambda a, v: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")).bitwiseXOR(v)))
        return F.transform(F.array(gray), lambda g: F.struct(g.alias("g"), F.aggregate(
            F.array(*[F.lit(bit(k)).cast("long") for k in range(bits - 1, 0, -1)]), F.lit(0).cast("long"),
            lambda t, q: F.when(F.get(g, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)).alias("t")))

    def woven(s):
        places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(bit(k)).cast("long").alias("q")) for k in range(bits - 1, -1, -1) for i in range(n)])
        return F.aggregate(places, F.lit(0).cast("long"), lambda h, p: h * 2 + F.when(F.get(s["g"], p["i"]).bitwiseXOR(s["t"]).bitwiseAND(p["q"]) != 0, 1).otherwise(0))

    return F.get(F.transform(F.flatten(F.transform(F.array(turned), last)), woven), F.lit(0))


def shards(df: DataFrame, cells: Mapping[str, Column], order: list[str], count: int, bits: int = BITS) -> DataFrame:
    """``df`` with ``curve``, ``shard`` and ``slot`` (place in the shard, from 0)."""
    curve = hilbert_index(list(cells.values()), bits)
    rows = row_index(df.withColumn("curve", curve), ["curve", *order], name="__place")
    total = rows.count()
    # Shard k holds the places from ceil(k * total / count) on.
    place = F.col("__place") - 1
    rows = rows.withColumn("shard", F.expr(f"int((__place - 1) * {count} div {max(total, 1)})"))
    first = F.expr(f"(shard * {total}L + {count - 1}) div {count}")
    return rows.withColumn("slot", (place - first).cast("long")).drop("__place")
