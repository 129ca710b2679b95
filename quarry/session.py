"""SparkSession construction and cluster-safe helpers.

Everything here is plain Spark configuration.  Library code never creates
its own session; it receives one.  ``get_session`` is for tests, the bench
and command-line use.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this library expects.  AQE re-plans joins at run
# time (broadcast when a side turns out small, split skewed partitions,
# coalesce tiny ones); the session time zone is pinned so event-time
# arithmetic and the SQL oracle agree.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "quarry", extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("QUARRY_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app_name)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is respected as
    is.  Only when it is unset on a ``local[...]`` master (tests) do we pick a
    scratch folder; on any other master that is an error.
    Also ships this package to the Python workers (see :func:`ship_code`).
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share; "
                               f"a local folder will not do on {spark.sparkContext.master}")
        conf_dir = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    spark.sparkContext.setCheckpointDir(conf_dir)
    ship_code(spark)
    return conf_dir


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Make ``quarry`` importable in every Python worker: zip the package once
    per SparkContext and distribute it with ``addPyFile`` (pandas UDFs and
    ``applyInPandas`` functions are pickled by reference to their module)."""
    import zipfile
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="quarry-code-"), "quarry.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used by iterative operators (connected components, graph expansion,
    rollup trees) so that a lost executor recomputes from the last written
    round instead of from the first scan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def store(df: DataFrame) -> DataFrame:
    """:func:`cut_lineage`, and the shuffle files behind it go as soon as it is
    written (a lost one is made again): a job of several such steps holds the
    disk of its largest, not of all."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    prev = conf.get(key)
    conf.set(key, "true")
    try:
        return cut_lineage(df.select("*"))         # planned anew, under the setting
    finally:
        conf.set(key, prev)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Jobs run inside hand Python at most ``rows`` rows at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    prev = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, prev)
