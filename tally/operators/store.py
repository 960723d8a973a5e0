"""Datasets refreshed as a unit (A11, A12): one manifest, written last, names what belongs together.

A refresh writes everything of a dataset (section tables, catalog, chunk
vectors, vectorizer) under a folder of its own, named by a version that no
earlier refresh used, and only then the manifest row that points there.  A
manifest is one small file put in place by the writer's commit, so a reader
sees the old row or the new one, and through it tables, catalog and vectors of
one and the same refresh.  A refresh that dies leaves a folder no manifest
names; ``sweep`` removes such folders and versions that are no longer current.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import child_names, delete_path, path_exists

MANIFEST = "dataset_id string, version string, sequence long, root string, parts array<string>, published timestamp"


def _manifests(out_dir: str) -> str:
    return out_dir.rstrip("/") + "/manifests"


def history(spark: SparkSession, out_dir: str) -> DataFrame:
    """All manifest rows, one for each published refresh."""
    if not path_exists(spark, _manifests(out_dir)):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(_manifests(out_dir))


def current(spark: SparkSession, out_dir: str) -> DataFrame:
    """The manifest row of each dataset that readers go by: that of the last refresh."""
    row = F.struct("sequence", "version", "root", "parts", "published")
    return history(spark, out_dir).groupBy("dataset_id").agg(F.max_by(row, F.struct("sequence", "version")).alias("m")).select("dataset_id", "m.*")


def root_of(spark: SparkSession, out_dir: str, dataset_id: str) -> str | None:
    """Folder of a dataset's current version."""
    row = current(spark, out_dir).where(F.col("dataset_id") == dataset_id).first()
    return None if row is None else row["root"]


def publish(spark: SparkSession, out_dir: str, dataset_id: str, write: Callable[[str], list[str]]) -> str:
    """Run ``write(folder)`` on a new folder and then publish it; returns the folder.

    ``write`` returns the names of what it wrote.  If it fails nothing is
    published, and readers keep the version they had.
    """
    version = uuid.uuid4().hex
    root = f"{out_dir.rstrip('/')}/versions/{dataset_id}/{version}"
    parts = write(root)
    last = history(spark, out_dir).where(F.col("dataset_id") == dataset_id).agg(F.max("sequence")).first()[0]
    row = spark.range(1).select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(version).alias("version"), F.lit((last or 0) + 1).cast("long").alias("sequence"), F.lit(root).alias("root"),
        F.array(*[F.lit(p) for p in parts]).cast("array<string>").alias("parts"), F.current_timestamp().alias("published"))
    row.coalesce(1).write.mode("errorifexists").parquet(f"{_manifests(out_dir)}/{dataset_id}/{version}")
    return root


def sweep(spark: SparkSession, out_dir: str, dataset_id: str) -> int:
    """Remove all of a dataset's folders but the current version's; returns how many went.

    Not while a refresh of the same dataset runs: its folder has no manifest yet.
    """
    keep = root_of(spark, out_dir, dataset_id)
    folder = f"{out_dir.rstrip('/')}/versions/{dataset_id}"
    old = [] if keep is None else [n for n in child_names(spark, folder) if n != keep.rsplit("/", 1)[-1]]
    for name in old:
        # The manifest first: a reader must not find a row whose files are gone.
        delete_path(spark, f"{_manifests(out_dir)}/{dataset_id}/{name}")
        delete_path(spark, f"{folder}/{name}")
    return len(old)
