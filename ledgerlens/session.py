"""Session helpers: building a session for tests/bench, shared checkpoint
location, size-checked broadcast and lineage cutting.

Nothing here hand-schedules work; these are the few knobs a Spark user sets.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a dimension may have and still be broadcast. The check is made with a
# bounded ``limit(n + 1).count()`` so it never scans more than n+1 rows.
DEFAULT_BROADCAST_ROWS = 100_000


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "ledgerlens") -> SparkSession:
    """Session for tests and the local bench. On a cluster the deployment
    supplies master, memory and ``spark.checkpoint.dir``; nothing here
    overrides a value that is already set."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    # local Python workers import this package
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    spark = (
        builder
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint location named by ``spark.checkpoint.dir``.

    Only when the session has none (unit tests) a private scratch folder is
    created and registered; a cluster's setting is always respected."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (never machine-local
    on a cluster, because the folder is the one the cluster names)."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


#: Scratch paths handed out within each open ``scratch_scope``, innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the scratch tables whose paths were handed out inside it, also
    after an error. Results must be written or collected inside the scope, for frames
    made there may read those tables. Scopes nest; tables from before a scope stay."""
    _SCOPES.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for name in _SCOPES.pop():
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder
    and continue from a scan of it. Survives the loss of executors (unlike
    ``localCheckpoint``), computes the input once (``checkpoint()`` without a
    cache computes it twice: count, then write), and later readers get
    column pruning and filter pushdown. ``eager`` is kept for callers; the
    write always happens here."""
    path = scratch_path(df.sparkSession, "table")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def rows_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows. Reads at most
    ``max_rows + 1`` rows, so it is cheap even for a large table; meant for
    tables as they are read or written, not for computed frames."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only behind a size check; above the bound the frame is
    returned unhinted and Spark plans a shuffle join (AQE may still convert
    it at runtime from real sizes)."""
    if rows_at_most(df, max_rows):
        return F.broadcast(df)
    return df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a frame that is read from fewer files than the cluster has
    cores before a CPU-heavy Python step (a single-row-group file is one task).
    Nothing is run to find out. A large table has more files and is left
    untouched, so no shuffle is added at scale."""
    par = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < par:
        return df.repartition(par)
    return df
