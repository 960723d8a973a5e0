"""Landing-folder ingest with Structured Streaming.

``readStream.format('binaryFile')`` lists new files (only ``path``,
``length`` and ``modificationTime`` are selected, so file contents are not
read by the stream itself); the file source's checkpoint remembers which
files were seen, so each file is processed once across runs.  Every
micro-batch (``foreachBatch``) ingests its new files: sections are read,
cleaned, typed, written as Parquet tables, profiled into the catalog, published
together (``operators.store``), and a status row is appended per file.  A file that fails is recorded in the
quarantine table and does not stop the others.
"""

from __future__ import annotations

import hashlib
import os
import traceback
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug_name
from ..operators import ingest as ig
from ..operators import store
from ..operators.profile import catalog
from ..session import ensure_checkpoint_dir
from ..sources.files import load_sections, section_tables
from ..sources.tables import path_exists

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
STATUS_SCHEMA = "path string, dataset_id string, status string, sections int, rows long, error string, epoch long"


def dataset_id_of(path: str) -> str:
    """Id of a landed file: its slug, with a digest of the name unless the name is its own
    slug plus ``.csv``.  Files of one folder never share an id."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    base = slug_name(os.path.splitext(name)[0], "dataset")
    return base if name == base + ".csv" else f"{base}_{hashlib.md5(name.encode()).hexdigest()[:8]}"


def _ingest_file(spark: SparkSession, path: str, out_dir: str) -> tuple[str, int, int]:
    # The file source reports Hadoop paths (``file:/a/b c.csv``, not percent-encoded).
    local = path[len("file:"):] if path.startswith("file:") else path
    dataset_id = dataset_id_of(local)
    kind, sections = load_sections(spark, local)
    totals = []

    def write(root: str) -> list[str]:
        parts, cats = [], []
        for s, table in zip(sections, section_tables(sections)):
            if not [c for c in s.df.columns if c != "_rid"]:
                raise ValueError(f"empty section {s.name}")
            parts.append(f"tables/{table}")
            ig.write_section(s.df, f"{root}/{parts[-1]}")
            written = spark.read.parquet(f"{root}/{parts[-1]}")
            totals.append(written.count())
            cats.append(catalog(written, s.name, dataset_id=dataset_id, hidden=s.hidden,
                                original_names=dict(zip([c for c in s.df.columns if c != "_rid"], s.columns))))
        if cats:
            reduce(DataFrame.unionByName, cats).write.parquet(f"{root}/catalog")
            parts.append("catalog")
        return parts

    # Files of one micro-batch are ingested side by side, each into a version of its own dataset.
    store.publish(spark, out_dir, dataset_id, write)
    return dataset_id, len(sections), sum(totals)


def ingest_landing(
    spark: SparkSession,
    landing_dir: str,
    out_dir: str,
    checkpoint: str | None = None,
    pattern: str = "*.csv",
    max_files_per_trigger: int = 64,
    parallel_files: int = 4,
) -> DataFrame:
    """Process every file of ``landing_dir`` not seen before; returns the status table.

    ``checkpoint`` defaults to a folder under the session's checkpoint dir.
    Runs with ``trigger(availableNow=True)``: all pending files, then stop.
    """
    ckpt = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "landing-" + slug_name(landing_dir))
    status_path = os.path.join(out_dir, "_status")
    quarantine_path = os.path.join(out_dir, "_quarantine")

    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(landing_dir)
        .select("path", "length", "modificationTime")
    )

    def process(batch: DataFrame, epoch_id: int) -> None:
        # One row per new file, at most max_files_per_trigger rows.
        paths = [r["path"] for r in batch.select("path").orderBy("path").collect()]

        def one(p):
            try:
                ds, n_sections, n_rows = _ingest_file(spark, p, out_dir)
                return (p, ds, "ready", n_sections, n_rows, None, epoch_id), None
            except Exception as exc:  # the file is quarantined, the batch goes on
                msg = f"{type(exc).__name__}: {exc}".splitlines()[0]
                return ((p, None, "error", 0, 0, msg, epoch_id),
                        (p, None, "error", 0, 0, traceback.format_exc(limit=2)[-2000:], epoch_id))

        # Files are independent: their jobs are submitted from a few driver threads.
        with ThreadPoolExecutor(max_workers=parallel_files) as pool:
            results = list(pool.map(one, paths))
        rows = [r for r, _ in results]
        bad = [b for _, b in results if b is not None]
        # One folder per micro-batch, overwritten: a retried batch replaces its
        # own rows instead of appending them twice (foreachBatch is at-least-once).
        if rows:
            spark.createDataFrame(rows, STATUS_SCHEMA).write.mode("overwrite").parquet(
                os.path.join(status_path, f"batch={epoch_id}"))
        if bad:
            spark.createDataFrame(bad, STATUS_SCHEMA).write.mode("overwrite").parquet(
                os.path.join(quarantine_path, f"batch={epoch_id}"))

    q = (
        files.writeStream.foreachBatch(process)
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if path_exists(spark, status_path):
        return spark.read.parquet(status_path)
    return spark.createDataFrame([], STATUS_SCHEMA)


def landing_status(spark: SparkSession, out_dir: str) -> DataFrame:
    """Latest status per file."""
    st = spark.read.parquet(os.path.join(out_dir, "_status"))
    return st.groupBy("path").agg(F.max_by(F.struct("status", "dataset_id", "rows", "error"), "epoch").alias("s")).select(
        "path", "s.*"
    )
