"""Parquet sources: the fixture tables and any folder of Parquet sections."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

FIXTURE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def _store(spark: SparkSession, path: str):
    """A Hadoop path and its file system: local folders and any store Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _store(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Remove a file or folder; whether it was there."""
    p, fs = _store(spark, path)
    return fs.delete(p, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    p, fs = _store(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan; Catalyst pushes filters and prunes columns."""
    return spark.read.parquet(table_path(sf_dir, name))


def register_views(spark: SparkSession, sf_dir: str, names=FIXTURE_TABLES) -> None:
    """Expose the tables to ``spark.sql`` under their own names."""
    for name in names:
        load_table(spark, sf_dir, name).createOrReplaceTempView(name)


class Tables:
    """Attribute access to the fixture tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark = spark
        self._dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return load_table(self._spark, self._dir, name)
