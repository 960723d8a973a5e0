"""Text chunks of a dataset.

Row chunks: every section is numbered in row order by the skew-safe
``row_index`` (no single-task window), cut into groups of 100 rows and each
group's CSV lines are joined in row order.  A group never holds more than
100 rows, so the per-chunk aggregation is bounded whatever the table size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions._util import qcol
from ..functions.text import cell_text, csv_field, csv_line, slug_name, table_name, truncate_text
from .profile import ROW_ID, data_columns
from .rowindex import row_index

# Chunk size and the chunk text layout.
ROWS_PER_CHUNK = 100
SECTION_LINE = "Sección: "
TABLE_LINE = "Tabla DuckDB: "
ROWS_LINE = "Filas aproximadas: "
COLUMNS_LINE = "Columnas: "


def _header(columns: Sequence[str]) -> str:
    """Header line of the CSV body, quoted like the fields."""
    out = []
    for c in columns:
        if any(ch in c for ch in ',"\r\n'):
            out.append('"' + c.replace('"', '""') + '"')
        else:
            out.append(c)
    return ",".join(out)


def _line_value(field: T.StructField):
    c = qcol(field.name)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return cell_text(c, field.dataType)


def row_chunks(
    df: DataFrame,
    section: str,
    order_by: Sequence | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    dataset_id: str = "",
) -> DataFrame:
    """D1 + D3: ``dataset_id, chunk_type, section, chunk_index, start_row, end_row, content``.

    ``order_by`` (column names, a total order) defaults to ``_rid``; rows are
    numbered 1.. in that order.
    """
    fields = data_columns(df)
    order = list(order_by) if order_by else [ROW_ID]
    lines = df.select(*[qcol(c) for c in order], csv_line([_line_value(f) for f in fields]).alias("__line"))
    numbered = row_index(lines, order, name="__rn")
    header = _header([f.name for f in fields])
    grouped = (
        numbered.withColumn("chunk_index", F.floor((F.col("__rn") - 1) / rows_per_chunk).cast("bigint"))
        .groupBy("chunk_index")
        .agg(
            F.min("__rn").alias("start_row"),
            F.max("__rn").alias("end_row"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("__rn", "__line"))), lambda s: s["__line"]), "\n"
            ).alias("__body"),
        )
    )
    content = F.concat(
        F.lit(SECTION_LINE + section + "\n" + TABLE_LINE),
        table_name(F.lit(section)),
        F.lit("\n" + ROWS_LINE),
        F.col("start_row").cast("string"),
        F.lit(" a "),
        F.col("end_row").cast("string"),
        F.lit("\n\n" + header + "\n"),
        F.col("__body"),
        F.lit("\n"),
    )
    return grouped.select(
        F.lit(dataset_id).alias("dataset_id"),
        F.lit("row_chunk").alias("chunk_type"),
        F.lit(section).alias("section"),
        "chunk_index",
        "start_row",
        "end_row",
        truncate_text(content).alias("content"),
    )


def catalog_chunk(section: str, columns: Sequence[str], dataset_id: str = "") -> dict:
    """D2 (per section): section, table and the column list."""
    listed = "[" + ", ".join(repr(c) for c in columns) + "]"
    table = "sheet_" + slug_name(section, "sheet")
    return {
        "dataset_id": dataset_id,
        "chunk_type": "sheet_catalog",
        "section": section,
        "chunk_index": 0,
        "start_row": None,
        "end_row": None,
        "content": f"{SECTION_LINE}{section}\n{TABLE_LINE}{table}\n{COLUMNS_LINE}{listed}",
    }


def dataset_chunks(
    spark,
    sections: Sequence[tuple[str, DataFrame, Sequence | None]],
    dataset_id: str = "",
    summary: str = "",
) -> DataFrame:
    """D1 + D2: workbook summary chunk, one catalog chunk per section, row chunks.

    ``sections`` is ``[(name, df, order_by)]``.  The small chunks are built on
    the driver from schema data only; the row chunks are Spark jobs.
    """
    schema = (
        "dataset_id string, chunk_type string, section string, chunk_index bigint, "
        "start_row bigint, end_row bigint, content string"
    )
    small = [{
        "dataset_id": dataset_id, "chunk_type": "workbook_summary", "section": None, "chunk_index": 0,
        "start_row": None, "end_row": None, "content": summary,
    }]
    small += [catalog_chunk(name, [f.name for f in data_columns(df)], dataset_id) for name, df, _ in sections]
    out = spark.createDataFrame(small, schema)
    for name, df, order in sections:
        out = out.unionByName(row_chunks(df, name, order, dataset_id=dataset_id))
    return out


__all__ = ["row_chunks", "catalog_chunk", "dataset_chunks", "csv_field", "ROWS_PER_CHUNK"]
