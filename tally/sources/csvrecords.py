"""Records of a delimited file with quoted line breaks, read in splits (A1).

Spark's ``multiLine`` reader takes a file as one task.  Here the file is read
as text lines, in as many splits as any text.  Whether a line starts inside a
quoted field depends on all lines before it, but only by one bit, so every
line is read as a function of that bit: it keeps it, turns it over, or ends
inside or outside whatever came before.  Functions are put together first
within splits, then over the splits of a file.

1. Each split finds, for either bit at its start, the bit in front of each of
   its lines and the records that start in it.
2. The splits of a file, one row each, are put together in order: that gives
   the bit and the number of records in front of every split.
3. A line that starts outside quotes starts a record; its number is the file's
   running count.  Records of one line are ready; the lines of the others are
   grouped by record number and joined.  No group holds more than one record.

A quote opens a field only where a field starts; elsewhere it is a letter.

Defined results: a quote that never closes makes the rest of that file one
record, as in any reader; blank lines outside quotes are no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir


def ends_inside(line: Column, sep: str, inside: bool) -> Column:
    """Whether a quoted field is open behind a line that starts outside or inside one."""
    s = f"\\x{ord(sep):02x}"
    body = '(?:[^"]|"")*+'
    rest = f'(?:(?:"{body}"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+"{body}$'
    if not inside:
        return F.coalesce(line.contains('"') & line.rlike("^" + rest), F.lit(False))
    return F.coalesce(~line.contains('"') | line.rlike(f'^{body}$|^{body}"[^{s}]*+{s}{rest}'), F.lit(True))


def _bit_before(order, start: int) -> Column:
    """The bit in front of a row of ``from0`` and ``from1`` (the row's own ends), if the first row meets ``start``."""
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    # Behind the last row that ends alike from either bit, only turns count.
    known = F.last(F.when(F.col("from0") == F.col("from1"), F.struct(F.col("from0").alias("bit"), F.col("turns").alias("at"))), ignorenulls=True).over(earlier)
    turned = F.coalesce(F.max("turns").over(earlier), F.lit(0))
    return ((F.coalesce(known["bit"], F.lit(start)) + turned - F.coalesce(known["at"], F.lit(0))) % 2).cast("int")


def _with_turns(df: DataFrame, order) -> DataFrame:
    turn = ((F.col("from0") == 1) & (F.col("from1") == 0)).cast("long")
    return df.withColumn("turns", F.sum(turn).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """``file``, ``number`` (from 1, in file order) and ``record`` (text, line breaks as line feeds)."""
    ensure_checkpoint_dir(spark)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    for bit in (0, 1):
        lines = lines.withColumn(f"from{bit}", ends_inside(F.col("value"), sep, bool(bit)).cast("int"))
    order = Window.partitionBy("file", "block").orderBy("line")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    lines = _with_turns(lines, order)
    lines = lines.withColumns({f"before{b}": _bit_before(order, b) for b in (0, 1)})
    # Written once: the splits' sums and the records must come from the very same numbering.
    lines = lines.withColumns({f"starts{b}": F.sum((F.col(f"before{b}") == 0).cast("long")).over(upto) for b in (0, 1)}).checkpoint()
    end = lambda b: F.when(F.col(f"before{b}") == 0, F.col("from0")).otherwise(F.col("from1"))
    # One row for each split of a file.
    splits = lines.groupBy("file", "block").agg(*[F.max_by(end(b), "line").alias(f"from{b}") for b in (0, 1)], F.max("starts0").alias("starts0"), F.max("starts1").alias("starts1"))
    along = Window.partitionBy("file").orderBy("block")
    splits = _with_turns(splits, along).withColumn("inside", _bit_before(along, 0))
    own = F.when(F.col("inside") == 0, F.col("starts0")).otherwise(F.col("starts1"))
    ahead = F.coalesce(F.sum(own).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "block", "inside", ahead.alias("ahead"))
    pick = lambda name: F.when(F.col("inside") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    lines = lines.join(splits, ["file", "block"]).select(
        "file", (F.col("ahead") + pick("starts")).alias("number"), "block", "line", "value", ((pick("before") == 0) & (F.col("from0") == 0)).alias("alone"))
    alone = lines.where("alone").select("file", "number", F.col("value").alias("record"))
    several = lines.where("not alone").groupBy("file", "number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "value"))), lambda x: x["value"]), "\n").alias("record"))
    return alone.unionByName(several).where(F.trim("record") != "")


def parsed(found: DataFrame, names: list[str], sep: str, row_id: str) -> DataFrame:
    """The fields of all records but each file's first, and ``row_id`` in the order of files and records."""
    # One row for each file.
    sizes = found.groupBy("file").agg(F.max("number").alias("n"))
    ahead = F.coalesce(F.sum(F.col("n") - 1).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    schema = ", ".join(f"`{n}` string" for n in names)
    options = {"sep": sep, "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "mode": "PERMISSIVE"}
    rows = found.where("number > 1").join(sizes.select("file", ahead.alias("ahead")), "file")
    rows = rows.select((F.col("ahead") + F.col("number") - 1).alias(row_id), F.from_csv("record", F.lit(schema), options).alias("__fields"))
    return rows.select(row_id, "__fields.*")
