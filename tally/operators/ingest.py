"""Ingest operators (A5-A11, A13, A14): names, cleaning, typing, row ids,
writes and section summaries.

Typing is one aggregate over all text columns (how many values there are
and how many are numbers / integers / booleans), read on the driver as one
row, then one ``select`` of casts: two passes over the data whatever the
column count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions._util import qcol
from ..functions.numbers import INTEGER_TEXT, NUMBER_TEXT
from ..functions.text import slug, slug_name
from .profile import ROW_ID
from .rowindex import row_index

# The null tokens of the CSV reader (pandas' default list).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
BOOLEAN_TRUE = ["True", "TRUE", "true"]
BOOLEAN_FALSE = ["False", "FALSE", "false"]


def unique_names(headers: DataFrame, file_col="file", pos_col="pos", header_col="header", prefix: str = "col",
                 fix_collisions: bool = True) -> DataFrame:
    """A6 over a header table ``(file, pos, header)`` -> adds ``name``.

    Slug with fallback ``<prefix>_<pos>`` (1-based) for blanks; the n-th
    repeat of a base name within a file gets ``_n``.  That rule can still
    collide (``a, a, a_2`` -> ``a, a_2, a_2``); with ``fix_collisions`` the
    rule is applied again to the colliding names until all are unique.
    Repeats are numbered with the skew-safe ``row_index``, so even a very
    large (file, name) group is split over tasks.
    """
    fallback = F.concat(F.lit(prefix + "_"), F.col(pos_col).cast("string"))
    blank = F.col(header_col).isNull() | (F.trim(F.col(header_col).cast("string")) == "")
    base = F.when(blank, fallback).otherwise(slug(F.trim(F.col(header_col).cast("string")), fallback))
    out = headers.withColumn("name", base)

    def dedupe(df: DataFrame) -> DataFrame:
        # n-th repeat of a name within a file, numbered by the skew-safe row index
        # (a header table is one row per column, but a table used as one need not be).
        n = F.col("__k")
        numbered = row_index(df, [pos_col], group_by=[file_col, "name"], name="__k")
        return numbered.withColumn(
            "name", F.when(n == 1, F.col("name")).otherwise(F.concat(F.col("name"), F.lit("_"), n.cast("string")))
        ).drop("__k")

    out = dedupe(out)
    if not fix_collisions:
        return out
    # Every round lengthens all but one of the names that still collide, so it ends.
    while not out.groupBy(file_col, "name").count().where("count > 1").isEmpty():
        out = dedupe(out)
    return out


def unique_name_list(values: Sequence, prefix: str = "col") -> list[str]:
    """A6 for a list the driver already holds (a file's header row), with the collision fix."""
    names = []
    for i, v in enumerate(values, start=1):
        blank = v is None or str(v).strip() == ""
        names.append(f"{prefix}_{i}" if blank else slug_name(str(v).strip(), f"{prefix}_{i}"))
    rounds = names
    while len(set(rounds)) < len(rounds):
        repeat: dict[str, int] = {}
        numbered = []
        for name in rounds:
            repeat[name] = repeat.get(name, 0) + 1
            numbered.append(name + (f"_{repeat[name]}" if repeat[name] > 1 else ""))
        rounds = numbered
    return rounds


def null_tokens(df: DataFrame, columns: Sequence[str] | None = None, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """A2: text cells equal to a null token become NULL (one ``select``)."""
    cols = set(columns) if columns is not None else {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(
        *[F.when(qcol(c).isin(list(tokens)), F.lit(None)).otherwise(qcol(c)).alias(c) if c in cols else qcol(c) for c in df.columns]
    )


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose data cells are all null (``_rid`` does not count)."""
    data = [c for c in df.columns if c != ROW_ID]
    return df.na.drop(how="all", subset=data) if data else df


def coercion_plan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A9 statistics: per text column, values, numbers, integers and booleans (one aggregate).

    Output rows: ``column_name, non_null, numbers, integers, booleans, verdict``
    where verdict is ``bigint``, ``double``, ``boolean`` or ``string``.
    """
    cols = list(columns) if columns is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != ROW_ID
    ]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, non_null long, numbers long, integers long, booleans long, verdict string")
    aggs = []
    for i, c in enumerate(cols):
        s = F.trim(qcol(c))
        aggs += [
            F.count(qcol(c)).alias(f"n{i}"),
            F.count_if(F.lower(s).rlike(NUMBER_TEXT)).alias(f"d{i}"),
            F.count_if(s.rlike(INTEGER_TEXT) & s.try_cast("bigint").isNotNull()).alias(f"i{i}"),
            F.count_if(qcol(c).isin(BOOLEAN_TRUE + BOOLEAN_FALSE)).alias(f"b{i}"),
        ]
    stats = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("non_null"), F.col(f"d{i}").alias("numbers"),
                 F.col(f"i{i}").alias("integers"), F.col(f"b{i}").alias("booleans"))
        for i, c in enumerate(cols)
    ])
    long = stats.select(F.inline(rows))
    verdict = (
        F.when(F.col("non_null") == 0, F.lit("string"))
        .when(F.col("booleans") == F.col("non_null"), F.lit("boolean"))
        .when(F.col("integers") == F.col("non_null"), F.lit("bigint"))
        .when(F.col("numbers") == F.col("non_null"), F.lit("double"))
        .otherwise(F.lit("string"))
    )
    return long.withColumn("verdict", verdict)


def _cast(c: str, verdict: str) -> Column:
    s = F.trim(qcol(c))
    if verdict == "boolean":
        return F.when(qcol(c).isin(BOOLEAN_TRUE), F.lit(True)).when(qcol(c).isin(BOOLEAN_FALSE), F.lit(False)).alias(c)
    if verdict == "bigint":
        return s.try_cast("bigint").alias(c)
    if verdict == "double":
        low = F.lower(s)
        special = (
            F.when(low.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf")))
            .when(low.isin("-inf", "-infinity"), F.lit(float("-inf")))
        )
        return F.coalesce(special, s.try_cast("double")).alias(c)
    return qcol(c)


def coerce(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """A text column becomes numeric only when every value converts.

    One bad value keeps the column text; ``" 2 "``, ``1e3`` and ``inf``
    convert, ``1,000`` and ``1d`` do not; all-integer text becomes BIGINT
    (nullable ints are not widened); an all-boolean column becomes BOOLEAN.
    Returns the typed frame and the verdicts (catalog-sized, on the driver).
    """
    plan = {r["column_name"]: r["verdict"] for r in coercion_plan(df, columns).collect()}
    typed = df.select(*[_cast(c, plan[c]) if c in plan else qcol(c) for c in df.columns])
    return typed, plan


def with_row_ids(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """``_rid`` 1..n in the input's own order (file order for a file scan).

    No shuffle: the position inside each input partition comes from
    ``monotonically_increasing_id`` and partition offsets from a count per
    partition (one row per partition, broadcast).  Meant for a file scan
    (both sides then read the same splits in the same order); write the
    result (A10) to fix the ids.
    """
    mid = "__tally_mid"
    tagged = df.withColumn(mid, F.monotonically_increasing_id())
    part = F.shiftright(F.col(mid), 33)
    counts = tagged.groupBy(part.alias("__pid")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        "__pid", F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)).alias("__off")
    ).fillna(0, subset=["__off"])
    return (
        tagged.join(F.broadcast(offsets), part == F.col("__pid"), "left")
        .withColumn(name, F.col("__off") + F.col(mid).bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(1))
        .drop("__pid", "__off", mid)
        .select(name, *[qcol(c) for c in df.columns])
    )


def write_section(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """A10: replace the section's table (Parquet, overwrite)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def refresh_dataset_rows(df: DataFrame, path: str, dataset_col: str = "dataset_id") -> None:
    """Replace the derived rows (catalog, chunks) of the datasets present in ``df`` only.

    Dynamic partition overwrite (as a writer option, so the session's setting
    is not touched): partitions of other datasets are untouched.  One writer
    per output path at a time; concurrent writers of one dataset each use
    ``replace_dataset_partition``.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(dataset_col).parquet(path)


def replace_dataset_partition(df: DataFrame, path: str, dataset_id: str, dataset_col: str = "dataset_id") -> None:
    """A11 for one dataset: overwrite its own partition folder only.

    Writers of different datasets touch different folders, so they can run
    at the same time (dynamic overwrite of one shared path cannot: the
    writers would share its staging folder).
    """
    target = path.rstrip("/") + f"/{dataset_col}={dataset_id}"
    df.drop(dataset_col).write.mode("overwrite").parquet(target)


def section_summary(sections: Sequence[tuple[str, DataFrame, bool]]) -> DataFrame:
    """``section, table_name, hidden, rows, n_columns, columns`` per section.

    Each section's row count is its own aggregate; the union is one job.
    """
    from ..functions.text import table_name

    parts = []
    for name, df, hidden in sections:
        cols = [c for c in df.columns if c != ROW_ID]
        parts.append(
            df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("section"), table_name(F.lit(name)).alias("table_name"),
                F.lit(bool(hidden)).alias("hidden"), "rows", F.lit(len(cols)).cast("bigint").alias("n_columns"),
                F.lit(",".join(cols)).alias("columns"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Fixed value: the row-total sentence.
SUMMARY_TEXT = "{kind} listo para análisis con {rows} registros."


def row_total_text(summary: DataFrame, kind: str, description: str | None = None) -> DataFrame:
    """The description if given, else ``<KIND> listo para análisis con n,nnn registros.``"""
    total = F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint")
    text = F.concat(F.lit(kind.upper() + " listo para análisis con "), F.format_number(total, 0), F.lit(" registros."))
    if description:
        text = F.lit(description)
    return summary.agg(total.alias("total_rows"), text.alias("summary"))
