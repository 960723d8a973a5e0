"""Mergeable column profiles (B1, Q11): what a refresh adds is merged, not read again.

A part of a dataset (a file, a day, an append) is profiled once, in one
aggregate: exact counts, extremes and totals, a HyperLogLog sketch of the
distinct values and, for numbers, a KLL sketch of their quantiles.  Parts are
rows of a few kilobytes for each column.  A dataset's profile is the merge of
its parts, which is what one aggregate over all their rows would have given,
within the sketches' error.

Defined results: nulls (and NaN) count as nulls, as in ``profile``; a column
without values has null extremes, distinct 0 and null quantiles; nested columns
are compared as JSON text; an empty part is a part with 0 rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions._util import qcol
from .profile import column_kind, data_columns, is_numeric_kind

#: 2**LG_K buckets: a distinct count is off by 0.8 % (one standard error).
LG_K = 14
#: KLL's k: a quantile's rank is off by under 0.5 % (99 of 100 times).
KLL_K = 800


def _value(field: T.StructField) -> Column:
    c = qcol(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return F.to_json(c) if column_kind(field.dataType) == "nested" else c


def part_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row for each column of one part, in one aggregate over ``df``."""
    fields = data_columns(df, columns)
    if not fields:
        raise ValueError("no columns")
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        v, kind = _value(f), column_kind(f.dataType)
        number = v.cast("int").cast("double") if kind == "boolean" else v.cast("double") if kind == "number" else F.lit(None).cast("double")
        # One spelling for equal values whatever the part's type of them.
        same = F.xxhash64(v.cast("double")) if kind == "number" else F.xxhash64(v.cast("string"))
        aggs += [
            F.count(v).alias(f"__n{i}"), F.min(number).alias(f"__lo{i}"), F.max(number).alias(f"__hi{i}"), F.sum(number).alias(f"__sum{i}"),
            F.min(v.cast("string")).alias(f"__first{i}"), F.max(v.cast("string")).alias(f"__last{i}"),
            F.hll_sketch_agg(F.when(v.isNotNull(), same), F.lit(LG_K)).alias(f"__hll{i}"),
            (F.kll_sketch_agg_double(number, F.lit(KLL_K)) if is_numeric_kind(kind) else F.lit(None).cast("binary")).alias(f"__kll{i}"),
        ]
    one = df.agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("pos"), F.lit(f.name).alias("column_name"), F.lit(column_kind(f.dataType)).alias("kind"), F.col("__rows").alias("rows"),
            F.col(f"__n{i}").alias("non_nulls"), F.col(f"__lo{i}").alias("least"), F.col(f"__hi{i}").alias("greatest"), F.col(f"__sum{i}").alias("total"),
            F.col(f"__first{i}").alias("first_text"), F.col(f"__last{i}").alias("last_text"), F.col(f"__hll{i}").alias("distinct_sketch"), F.col(f"__kll{i}").alias("quantile_sketch"))
        for i, f in enumerate(fields)
    ])
    return one.select(F.inline(rows))


def merged(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Part profiles of one dataset (or of each of ``by``) as one part profile."""
    return parts.groupBy(*by, "column_name").agg(
        F.min("pos").alias("pos"), F.max("kind").alias("kind"), F.sum("rows").alias("rows"), F.sum("non_nulls").alias("non_nulls"),
        F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("total").alias("total"),
        F.min("first_text").alias("first_text"), F.max("last_text").alias("last_text"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"))


def read_profile(part: DataFrame, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Counts, extremes, mean, estimated distinct count and quantiles of a part profile."""
    known = F.col("non_nulls") > 0
    numeric = F.col("kind").isin("number", "boolean") & known
    asked = F.array(*[F.lit(float(s)) for s in shares])
    return part.select(
        *[c for c in part.columns if c not in ("distinct_sketch", "quantile_sketch")],
        (F.col("rows") - F.col("non_nulls")).alias("nulls"), F.when(numeric, F.col("total") / F.col("non_nulls")).alias("mean"),
        F.when(known, F.hll_sketch_estimate("distinct_sketch")).otherwise(F.lit(0).cast("long")).alias("distinct"),
        F.when(numeric, F.kll_sketch_get_quantile_double("quantile_sketch", asked)).alias("quantiles"))


def refresh(stored: DataFrame | None, df: DataFrame, dataset_id: str, part: str) -> DataFrame:
    """Stored part profiles with those of ``df`` in place of (or beside) the dataset's part of that name."""
    new = part_profile(df).select(F.lit(dataset_id).alias("dataset_id"), F.lit(part).alias("part"), "*")
    if stored is None:
        return new
    return stored.where(~((F.col("dataset_id") == dataset_id) & (F.col("part") == part))).unionByName(new)
