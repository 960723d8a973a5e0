"""Session helpers.

Library code never creates its own cluster settings: it reads what the
session already has.  ``local_session`` is for tests, the bench and the
smoke entry only.
"""

from __future__ import annotations

import os
import tempfile
import threading

from pyspark.sql import SparkSession

# Settings every job of this package relies on.  They are applied by
# ``local_session`` and can be applied to a cluster session with
# ``apply_defaults`` (only keys the session has not set are touched).
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Ad-hoc SQL must not read arbitrary files by path (see operators.adhoc).
    "spark.sql.runSQLOnFiles": "false",
}


def apply_defaults(spark: SparkSession) -> SparkSession:
    for key, value in SESSION_DEFAULTS.items():
        try:
            current = spark.conf.get(key, None)
        except Exception:  # pragma: no cover - conf not readable
            current = None
        if current is None:
            try:
                spark.conf.set(key, value)
            except Exception:  # static conf on a running session
                pass
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tally") -> SparkSession:
    """A local session for tests and the bench; UI off, UTC, AQE on."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TALLY_DRIVER_MEMORY", "8g"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tally-warehouse-"))
    )
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is (a cluster without it is an error).  Only a local-mode session
    with nothing set (tests, the bench) gets a fresh local folder, so
    nothing ever writes to a machine-local path on a cluster.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's spark.checkpoint.dir is used by checkpoint()
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        conf_dir = tempfile.mkdtemp(prefix="tally-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df, min_partitions: int | None = None):
    """Round-robin ``df`` over the cluster's cores when it has fewer input
    partitions than cores (a single large file or row group is one task).

    At scale the input already has many more partitions than cores and this
    is a no-op; it only pays a shuffle of the input where CPU-heavy per-row
    work (whole-text regular expressions, melts) would otherwise run in one
    task.
    """
    plan = getattr(df, "_jdf", None)
    if plan is None:  # Spark Connect: leave the plan as it is
        return df
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    # The optimized size over the split size: known without running any stage of the plan.
    size = int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df if size >= want * split else df.repartition(want)


_SHIPPED: set[str] = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``tally`` importable by the Python workers (once per application).

    Operators that run Python on executors (``mapInPandas``, pandas UDFs)
    pickle functions by reference to this package; when the package is not
    installed on the executors (``--py-files`` not given), it is zipped and
    added with ``addPyFile``, the same thing ``--py-files`` does.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: ship with spark.addArtifacts instead
        return
    key = sc.applicationId
    with _SHIP_LOCK:  # operators may run from several driver threads
        if key in _SHIPPED:
            return
        _ship(sc)
        _SHIPPED.add(key)


def _ship(sc) -> None:
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    target = os.path.join(tempfile.mkdtemp(prefix="tally-pyfiles-"), "tally.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
