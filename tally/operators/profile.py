"""Profiling and the semantic catalog.

Plan shape: the exact profile is one scan, melted to ``(pos, typed
value)`` (long / double / text slots, so numbers are compared natively,
not formatted) and two aggregations with map-side partial aggregation; the
approximate profile is a single aggregate over all columns.  Neither uses
``Expand`` (one ``countDistinct`` per column would).  With
``approx=True`` the distinct counts come from ``approx_count_distinct`` in
the same single aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions._util import qcol
from ..session import spread

ROW_ID = "_rid"


def column_kind(dtype: T.DataType) -> str:
    """Coarse kind: number, boolean, datetime, text or nested."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return "nested"
    return "text"


def is_numeric_kind(kind: str) -> bool:
    # Booleans count as numeric, as in the reference profiler.
    return kind in ("number", "boolean")


def data_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[T.StructField]:
    wanted = set(columns) if columns is not None else None
    return [f for f in df.schema.fields if f.name != ROW_ID and (wanted is None or f.name in wanted)]


def _as_text(field: T.StructField) -> Column:
    c = qcol(field.name)
    if column_kind(field.dataType) == "nested":
        return F.to_json(c)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        # -0.0 and 0.0 are one value (as in grouping); NaN is null.
        return F.when(F.isnan(c), F.lit(None)).otherwise(c + F.lit(0.0)).cast("string")
    return c.cast("string")


def melt_text(df: DataFrame, fields: Sequence[T.StructField], keep: Sequence[str] = ()) -> DataFrame:
    """Long form ``(pos, value)`` of the given columns, values as text, nulls dropped."""
    items = F.array(*[F.struct(F.lit(i).alias("pos"), _as_text(f).alias("value")) for i, f in enumerate(fields)])
    return (
        df.select(*[qcol(k) for k in keep], F.inline(items))
        .where(F.col("value").isNotNull())
    )


def _typed_slots(field: T.StructField) -> tuple[Column, Column, Column]:
    """A value in one of three typed slots (long, double, text), so the exact
    distinct count compares values natively instead of formatting them."""
    c = qcol(field.name)
    dt = field.dataType
    none_l, none_d, none_s = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long"), none_d, none_s
    if isinstance(dt, T.BooleanType):
        return c.cast("int").cast("long"), none_d, none_s
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
        return none_l, F.when(F.isnan(d), F.lit(None)).otherwise(d + F.lit(0.0)), none_s
    if isinstance(dt, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long"), none_d, none_s
    return none_l, none_d, _as_text(field)


def profile(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """B1: one row per column.

    Columns: ``pos, column_name, data_type, kind, rows, nulls, non_nulls,
    distinct, min, max, mean, total``.  min/max/mean/total are DOUBLE and
    only set for numeric (and boolean) columns that have a value; ``total``
    feeds the overview (C1) so it needs no second scan.  NaN counts as null.

    Exact (default): one scan.  Every row is melted to ``(pos, typed value)``
    plus one row-count marker, aggregated per distinct value (partial
    aggregation map-side collapses repeats, so a hot value costs one row per
    task), then per column: distinct = values, non_nulls = sum of counts,
    min / max / total from the typed value.  ``approx=True``: one aggregate,
    ``approx_count_distinct`` per column, nothing shuffled but one row.
    """
    fields = data_columns(df, columns)
    spark = df.sparkSession
    if not fields:
        schema = ("pos int, column_name string, data_type string, kind string, rows long, nulls long, "
                  "non_nulls long, distinct long, min double, max double, mean double, total double")
        return spark.createDataFrame([], schema)
    if approx:
        return _profile_approx(df, fields)
    meta = spark.createDataFrame(
        [(-1, "", "", "rows")]
        + [(i, f.name, f.dataType.simpleString(), column_kind(f.dataType)) for i, f in enumerate(fields)],
        "pos int, column_name string, data_type string, kind string",
    )
    items = [F.struct(F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("l"),
                      F.lit(None).cast("double").alias("d"), F.lit(None).cast("string").alias("s"))]
    for i, f in enumerate(fields):
        lv, dv, sv = _typed_slots(f)
        items.append(F.struct(F.lit(i).alias("pos"), lv.alias("l"), dv.alias("d"), sv.alias("s")))
    # The melt multiplies rows by the column count: spread an under-partitioned
    # input over the cores first (a no-op when it already has enough tasks).
    melted = spread(df).select(F.inline(F.array(*items))).where(
        F.col("l").isNotNull() | F.col("d").isNotNull() | F.col("s").isNotNull()
    )
    per_value = melted.groupBy("pos", "l", "d", "s").agg(F.count(F.lit(1)).alias("n"))
    # Decimals travel as text, which keeps every digit for the distinct count.
    decimals = [i for i, f in enumerate(fields) if isinstance(f.dataType, T.DecimalType)]
    num = F.coalesce(F.col("d"), F.col("l").cast("double"), F.when(F.col("pos").isin(decimals), F.col("s").try_cast("double")))
    per_col = per_value.groupBy("pos").agg(
        F.count(F.lit(1)).alias("distinct"),
        F.sum("n").alias("non_nulls"),
        F.min(num).alias("min"),
        F.max(num).alias("max"),
        F.sum(num * F.col("n")).alias("total"),
    )
    # meta and per_col are one row per column: a small join and a window over them.
    out = meta.join(per_col, "pos", "left").withColumn(
        "rows", F.max(F.when(F.col("pos") == -1, F.col("non_nulls"))).over(Window.partitionBy(F.lit(1)))
    )
    nn = F.coalesce(F.col("non_nulls"), F.lit(0)).cast("long")
    numeric = F.col("kind").isin("number", "boolean") & (nn > 0)
    nothing = F.lit(None).cast("double")
    return out.where(F.col("pos") >= 0).select(
        "pos", "column_name", "data_type", "kind",
        F.coalesce(F.col("rows"), F.lit(0)).cast("long").alias("rows"),
        (F.coalesce(F.col("rows"), F.lit(0)) - nn).cast("long").alias("nulls"),
        nn.alias("non_nulls"),
        F.coalesce(F.col("distinct"), F.lit(0)).cast("long").alias("distinct"),
        F.when(numeric, F.col("min")).otherwise(nothing).alias("min"),
        F.when(numeric, F.col("max")).otherwise(nothing).alias("max"),
        F.when(numeric, F.col("total") / nn).otherwise(nothing).alias("mean"),
        F.when(numeric, F.col("total")).otherwise(nothing).alias("total"),
    )


def _profile_approx(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """B1 with ``approx_count_distinct``: a single aggregate over all columns."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        lv, dv, sv = _typed_slots(f)
        aggs.append(F.count(F.coalesce(lv.cast("string"), dv.cast("string"), sv)).alias(f"nn{i}"))
        if is_numeric_kind(column_kind(f.dataType)):
            x = qcol(f.name).cast("double") if isinstance(f.dataType, T.DecimalType) else F.coalesce(dv, lv.cast("double"))
            aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"), F.avg(x).alias(f"av{i}"),
                     F.sum(x).alias(f"sm{i}")]
        aggs.append(F.approx_count_distinct(_as_text(f)).alias(f"ds{i}"))
    stats = df.agg(*aggs)

    def one(i: int, f: T.StructField) -> Column:
        kind = column_kind(f.dataType)
        num = is_numeric_kind(kind)
        nothing = F.lit(None).cast("double")
        return F.struct(
            F.lit(i).alias("pos"), F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(kind).alias("kind"),
            F.col(f"nn{i}").alias("non_nulls"),
            (F.col(f"mn{i}") if num else nothing).alias("min"),
            (F.col(f"mx{i}") if num else nothing).alias("max"),
            (F.col(f"av{i}") if num else nothing).alias("mean"),
            (F.col(f"sm{i}") if num else nothing).alias("total"),
            F.col(f"ds{i}").cast("long").alias("distinct"),
        )

    long = stats.select("rows", F.inline(F.array(*[one(i, f) for i, f in enumerate(fields)])))
    return long.select(
        "pos", "column_name", "data_type", "kind", "rows",
        (F.col("rows") - F.col("non_nulls")).alias("nulls"), "non_nulls", "distinct", "min", "max", "mean", "total",
    )


def _samples_window(df: DataFrame, fields, order_by: Sequence, n: int) -> DataFrame:
    """``row_number() <= n`` per column over the melted rows (``WindowGroupLimit``)."""
    order_cols = [F.col(f"__o{i}") for i in range(len(order_by))]
    keyed = df.select(
        *[(qcol(k) if isinstance(k, str) else k).alias(f"__o{i}") for i, k in enumerate(order_by)],
        *[qcol(f.name) for f in fields],
    )
    long = melt_text(keyed, fields, keep=[f"__o{i}" for i in range(len(order_by))])
    w = Window.partitionBy("pos").orderBy(*order_cols)
    names = F.array(*[F.lit(f.name) for f in fields])
    return (
        long.withColumn("sample_pos", F.row_number().over(w))
        .where(F.col("sample_pos") <= n)
        .select("pos", F.element_at(names, F.col("pos") + 1).alias("column_name"), "sample_pos", "value")
    )


def samples(
    df: DataFrame,
    order_by: Sequence,
    n: int = 6,
    columns: Sequence[str] | None = None,
    head_rows: int = 1024,
) -> DataFrame:
    """B2: first ``n`` non-null values of every column in row order (not distinct).

    The first ``head_rows`` rows in order are taken with ``orderBy().limit()``
    (``TakeOrderedAndProject``: each task keeps a bounded heap, no full
    sort), enough wherever every column has ``n`` values among them.
    Otherwise one pass ranks all rows per column with ``row_number() <= n``
    (``WindowGroupLimit``: each map task keeps n rows per column before the
    shuffle); the same values either way.  ``order_by`` must be a total order
    (``_rid`` or a key) so that the head is well defined.
    """
    fields = data_columns(df, columns)
    if not fields:
        return df.sparkSession.createDataFrame([], "pos int, column_name string, sample_pos int, value string")
    k = max(int(head_rows), n)
    head = df.orderBy(*order_by).limit(k)
    counts = head.agg(F.count(F.lit(1)).alias("rows"), *[F.count(qcol(f.name)).alias(f"c{i}") for i, f in enumerate(fields)]).first()
    enough = counts["rows"] < k or all(counts[f"c{i}"] >= n for i in range(len(fields)))
    return _samples_window(head if enough else df, fields, order_by, n)


def sample_arrays(sample_rows: DataFrame) -> DataFrame:
    """B2 as ``(pos, sample_values ARRAY<STRING>)``; at most n values per column."""
    return sample_rows.groupBy("pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sample_pos", "value"))), lambda s: s["value"]).alias(
            "sample_values"
        )
    )


# Semantic-type name tokens, in rule order (first hit wins).
DATE_TOKENS = ["fecha", "date", "periodo", "mes", "año", "anio", "year", "month"]
MONEY_TOKENS = ["monto", "venta", "importe", "precio", "costo", "total", "ticket", "margen", "revenue"]
QUANTITY_TOKENS = ["cantidad", "orden", "qty", "unidades", "count"]
IDENTIFIER_TOKENS = ["id", "codigo", "código", "sku"]
CATEGORY_MIN_DISTINCT = 20
CATEGORY_SHARE = 0.1


def _has_any(name: Column, tokens: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in tokens:
        out = out | (F.instr(name, t) > 0)
    return out


def semantic_type(name, kind, distinct, non_nulls) -> Column:
    """B3 rule chain over a profile row (name matched lower-cased, as substring)."""
    nm = F.lower(name if isinstance(name, Column) else F.col(name))
    kd = kind if isinstance(kind, Column) else F.col(kind)
    ds = distinct if isinstance(distinct, Column) else F.col(distinct)
    nn = non_nulls if isinstance(non_nulls, Column) else F.col(non_nulls)
    return (
        F.when(_has_any(nm, DATE_TOKENS), "date")
        .when(_has_any(nm, MONEY_TOKENS), "money_or_amount")
        .when(_has_any(nm, QUANTITY_TOKENS), "quantity")
        .when(_has_any(nm, IDENTIFIER_TOKENS), "identifier")
        .when(kd == "datetime", "date")
        .when(kd.isin("number", "boolean"), "metric")
        .when((nn > 0) & (ds <= F.greatest(F.lit(CATEGORY_MIN_DISTINCT).cast("double"), nn * CATEGORY_SHARE)), "category")
        .otherwise("text")
    )


def with_semantic_types(prof: DataFrame, name_col: str = "column_name") -> DataFrame:
    return prof.withColumn("semantic_type", semantic_type(F.col(name_col), F.col("kind"), F.col("distinct"), F.col("non_nulls")))


# Fixed value: catalog description text.
def description(name, stype) -> Column:
    return F.concat(F.lit("Campo "), name, F.lit(" detectado como "), stype, F.lit("."))


def catalog(
    df: DataFrame,
    section: str,
    order_by: Sequence | None = None,
    dataset_id: str = "",
    hidden: bool = False,
    original_names: dict[str, str] | None = None,
    approx: bool = False,
    n_samples: int = 6,
    prof: DataFrame | None = None,
) -> DataFrame:
    """One catalog row per column of a section (B1 + B2 + B3).

    ``prof`` reuses a profile already computed for the section (the overview
    needs the same one), so a dataset is profiled once.
    """
    from ..functions.text import table_name

    prof = prof if prof is not None else profile(df, approx=approx)
    originals = original_names or {}
    fields = data_columns(df)
    orig = F.element_at(F.array(*[F.lit(originals.get(f.name, f.name)) for f in fields]), F.col("pos") + 1)
    prof = prof.withColumn("original_name", orig)
    prof = prof.withColumn(
        "semantic_type", semantic_type(F.col("original_name"), F.col("kind"), F.col("distinct"), F.col("non_nulls"))
    )
    order = list(order_by) if order_by else ([ROW_ID] if ROW_ID in df.columns else [fields[0].name])
    samp = sample_arrays(samples(df, order, n_samples))
    return (
        prof.join(samp, "pos", "left")
        .select(
            F.lit(dataset_id).alias("dataset_id"),
            F.lit(section).alias("section"),
            table_name(F.lit(section)).alias("table_name"),
            "pos",
            F.col("original_name").alias("column_name"),
            F.col("column_name").alias("column_slug"),
            "data_type",
            "kind",
            "semantic_type",
            description(F.col("original_name"), F.col("semantic_type")).alias("description"),
            F.coalesce(F.col("sample_values"), F.array().cast("array<string>")).alias("sample_values"),
            F.struct("nulls", "non_nulls", "distinct", "min", "max", "mean").alias("metrics"),
            F.lit(hidden).alias("is_hidden"),
        )
    )


def local_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """The profile computed once and held as a local relation (one row per
    column, catalog-sized), for callers that read it several times."""
    prof = profile(df, approx=approx)
    return df.sparkSession.createDataFrame(prof.collect(), prof.schema)


def catalog_lookup(cat: DataFrame, dataset_ids: Sequence[str] | None = None) -> DataFrame:
    """Catalog rows of some datasets, ordered by dataset, section, position."""
    out = cat if not dataset_ids else cat.where(F.col("dataset_id").isin(list(dataset_ids)))
    return out.orderBy("dataset_id", "section", "pos")


def schema_context(cat: DataFrame, n_samples: int = 4, dataset_ids: Sequence[str] | None = None,
                   max_datasets: int = 4) -> DataFrame:
    """One row per (dataset, table) with the ordered column list nested.

    With ``dataset_ids`` (newest first) only the first ``max_datasets`` are
    kept and each gets its query alias ``ds0``, ``ds1``...  Groups hold one
    row per column of one table, so they are bounded by the table width, not
    by the data.
    """
    cols = F.struct(
        "pos", "column_name", "column_slug", "data_type", "semantic_type",
        F.slice("sample_values", 1, n_samples).alias("sample_values"), "metrics",
    )
    src = cat
    alias = F.lit(None).cast("string")
    if dataset_ids is not None:
        chosen = list(dataset_ids)[:max_datasets]
        src = cat.where(F.col("dataset_id").isin(chosen))
        alias = F.concat(F.lit("ds"), (F.array_position(F.array(*[F.lit(d) for d in chosen]), F.col("dataset_id")) - 1).cast("string"))
    return src.groupBy("dataset_id", "section", "table_name").agg(
        F.first(alias).alias("db_alias"),
        F.transform(F.array_sort(F.collect_list(cols)), lambda c: c.dropFields("pos")).alias("columns"),
    )


def preview(df: DataFrame, order_by: Sequence, rows: int = 3, max_columns: int = 8) -> DataFrame:
    """The first ``rows`` rows of the first ``max_columns`` columns in row order."""
    fields = data_columns(df)[:max_columns]
    return df.orderBy(*order_by).select(*[qcol(f.name) for f in fields]).limit(rows)
