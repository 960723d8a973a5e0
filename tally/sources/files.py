"""File sources: delimited text, workbooks and Parquet as named sections
(A1, A2, A4), cleaned and typed by the ingest operators.

A section is ``Section(name, hidden, columns, df)``: ``columns`` are the
original header texts, ``df`` has unique slugged column names and ``_rid``.
"""

from __future__ import annotations

import csv
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import table_name
from ..operators import ingest as ig
from ..operators.profile import ROW_ID
from .csvrecords import ends_inside, parsed, records

# Candidate delimiters, in preference order, and how many lines are sniffed.
DELIMITERS = [",", ";", "\t", "|"]
SNIFF_LINES = 20
SUPPORTED = {".csv": "csv", ".xlsx": "excel", ".parquet": "parquet"}


@dataclass
class Section:
    name: str
    df: DataFrame
    columns: list[str] = field(default_factory=list)
    hidden: bool = False
    kind: str = "csv"
    verdicts: dict = field(default_factory=dict)


class UnsupportedInput(ValueError):
    pass


def _count_outside_quotes(line: str, ch: str) -> int:
    n, quoted = 0, False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif c == ch and not quoted:
            n += 1
    return n


def sniff_delimiter(lines: list[str]) -> str:
    """The first candidate found the same positive number of times in every sampled line."""
    rows = [ln for ln in lines if ln.strip()]
    if not rows:
        return ","
    for d in DELIMITERS:
        counts = {_count_outside_quotes(ln, d) for ln in rows}
        if len(counts) == 1 and counts.pop() > 0:
            return d
    # fall back: the candidate most frequent in the header line
    return max(DELIMITERS, key=lambda d: _count_outside_quotes(rows[0], d))


def _n_fields(record: Column, sep: str) -> Column:
    """Fields of a record: its delimiters outside quoted fields, and one."""
    bare = F.regexp_replace(record, f'(?:^|(?<=\\x{ord(sep):02x}))"(?:[^"]|"")*+"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def _logical_lines(lines: list[str]) -> list[str]:
    """Join physical lines that continue a quoted field."""
    out, cur = [], None
    for ln in lines:
        cur = ln if cur is None else cur + "\n" + ln
        if cur.count('"') % 2 == 0:
            out.append(cur)
            cur = None
    return out + ([cur] if cur is not None else [])


def read_csv_section(spark: SparkSession, path: str, name: str | None = None, multi_line: bool = False) -> Section:
    """A1 + A2 + A5/A6 + A8 + A9 for one delimited file.

    The first lines give the delimiter and the header.  One scan of all lines
    decides the rest: if some line leaves a quoted field open, records are put
    together from the lines of all splits (``csvrecords``); a record with more
    fields than the header is an error wherever it stands.  Text columns are
    nulled, empty rows dropped and columns typed all-or-nothing.
    """
    lines = spark.read.text(path)
    head = [r[0] for r in lines.limit(SNIFF_LINES).collect()]
    sep = sniff_delimiter(_logical_lines(head) if multi_line else head)
    value = F.col("value")
    whole = lines.agg(F.max(ends_inside(value, sep, False)).alias("open"), F.max(_n_fields(value, sep)).alias("fields")).first()
    multi_line = multi_line or bool(whole["open"])
    if multi_line:
        head = _logical_lines(head)
    if not head:
        raise ValueError(f"no header row in {path}")
    originals = next(csv.reader([head[0].lstrip("\ufeff")], delimiter=sep))  # a UTF-8 BOM is not part of the header
    slugs = ig.unique_name_list(originals)
    # Like the reference reader, more fields than the header is an error (Spark would drop them).
    if multi_line:
        found = records(spark, path, sep).checkpoint()
        too_long = not found.where((F.col("number") > 1) & (_n_fields(F.col("record"), sep) > len(originals))).isEmpty()
        df = parsed(found, slugs, sep, ROW_ID)
    else:
        too_long = (whole["fields"] or 0) > len(originals)
        df = ig.with_row_ids(
            spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in slugs])).option("header", True).option("sep", sep).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("nullValue", None)
            .option("emptyValue", "").option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path))
    if too_long:
        raise ValueError(f"a line has more fields than the header in {path}")
    df = ig.null_tokens(df, slugs)
    df = ig.drop_empty_rows(df)
    typed, verdicts = ig.coerce(df, slugs)
    stem = name or os.path.splitext(os.path.basename(path))[0]
    return Section(stem, typed, originals, False, "csv", verdicts)


def read_parquet_section(spark: SparkSession, path: str, name: str | None = None) -> Section:
    df = spark.read.parquet(path)
    originals = list(df.columns)
    slugs = ig.unique_name_list(originals)
    df = df.toDF(*slugs)
    if ROW_ID not in df.columns:
        df = ig.with_row_ids(df)
    stem = name or os.path.splitext(os.path.basename(path.rstrip("/")))[0]
    return Section(stem, ig.drop_empty_rows(df), originals, False, "parquet")


def load_sections(spark: SparkSession, path: str, kind: str | None = None) -> tuple[str, list[Section]]:
    """A4: dispatch on the lower-cased suffix (or ``kind``); other inputs are an error."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    kind = kind or SUPPORTED.get(suffix)
    if kind == "csv":
        return "csv", [read_csv_section(spark, path)]
    if kind == "excel":
        from .workbook import read_workbook_sections

        return "excel", read_workbook_sections(spark, path)
    if kind == "parquet":
        return "parquet", [read_parquet_section(spark, path)]
    raise UnsupportedInput("Solo se admiten archivos CSV o Excel (.xlsx).")


def sections_frame(spark: SparkSession, sections: list[Section]) -> DataFrame:
    """The ``sections`` table: name, hidden, kind, original and slugged columns."""
    rows = [
        (s.name, s.hidden, s.kind, list(s.columns), [c for c in s.df.columns if c != ROW_ID]) for s in sections
    ]
    return spark.createDataFrame(
        rows, "section string, hidden boolean, kind string, columns array<string>, slugs array<string>"
    ).withColumn("table_name", table_name(F.col("section")))


def section_tables(sections: list[Section]) -> list[str]:
    """Table names of a file's sections, no two alike (the A6 rule across sections)."""
    return ["sheet_" + n for n in ig.unique_name_list([s.name for s in sections], prefix="sheet")]
