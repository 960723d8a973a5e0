"""Presentation-side table operators (H2, H3, H8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.display import kind_rank, typed_value
from ..functions.numbers import bar_width
from .rowindex import row_index

# Fixed value: rows shown in a result table.
DISPLAY_ROWS = 50


def typed_sort(df: DataFrame, column: str, tiebreak: str, descending: bool = False, name: str = "position",
               reverse_whole: bool = False) -> DataFrame:
    """H2: order rows by the typed value of ``column``; empties last in both directions.

    A total order (kind, then value, then ``tiebreak``), where the browser's
    comparator is not one: mixed kinds there compare as text and a
    descending sort reverses the ascending one (empties first).  With
    ``reverse_whole=True`` a descending sort is the exact reverse of the
    ascending one, empties first, as in the browser.  The position is a
    global index from the skew-safe ``row_index``.
    """
    if descending and reverse_whole:
        asc = typed_sort(df, column, tiebreak, False, name)
        n = df.count()
        return asc.withColumn(name, F.lit(n + 1) - F.col(name))
    keyed, order = _typed_keys(df, column, tiebreak, descending)
    return row_index(keyed, order, name=name).select(*df.columns, name)


def _typed_keys(df: DataFrame, column: str, tiebreak: str, descending: bool) -> tuple[DataFrame, list[Column]]:
    """``df`` with the sort keys of H2, and the order over them."""
    tv = F.col("__tv")
    keyed = df.withColumn("__tv", typed_value(F.col(column), df.schema[column].dataType))
    keys = {"__kr": kind_rank(tv["kind"]), "__v0": tv["num"], "__v1": tv["ts"], "__v2": tv["txt"]}
    keyed = keyed.withColumns({"__e": (tv["kind"] == "empty").cast("int")} | keys).drop("__tv")
    directed = [F.col(k).desc_nulls_last() if descending else F.col(k).asc_nulls_last() for k in keys]
    return keyed, [F.col("__e").asc(), *directed, F.col(tiebreak).asc()]


def display_rows(df: DataFrame, column: str, tiebreak: str, descending: bool = False, name: str = "position",
                 n: int = DISPLAY_ROWS) -> DataFrame:
    """H3: the first 50 rows of the typed sort, numbered.

    A sort with a limit keeps 50 rows a task and merges them
    (``TakeOrderedAndProject``); only those are numbered.
    """
    keyed, order = _typed_keys(df, column, tiebreak, descending)
    first = keyed.orderBy(*order).limit(n)
    return first.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long")).select(*df.columns, name)


def bar_widths(points: DataFrame, chart_col: str, value_col: str = "value") -> DataFrame:
    """H8: bar width per chart point; the scale is the chart's largest |value| (at least 1).

    Charts hold at most 12 points, so the window per chart is small.
    """
    w = Window.partitionBy(chart_col)
    return points.withColumn("width", bar_width(F.col(value_col), F.max(F.abs(F.col(value_col))).over(w)))
