"""Session-level helpers: checkpoint folder, checked broadcast, local test sessions.

The library never builds a private session for real work: every operator takes
the caller's ``SparkSession`` (or a DataFrame bound to one).  ``local_session``
exists for tests, the bench and the smoke entry only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest row count we accept as a broadcast side when the caller asks for a
# checked broadcast.  Dimension tables (nation, region, holiday calendars,
# price grids) are far below it; anything that grows with the fact table is not.
BROADCAST_ROW_LIMIT = 100_000


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "stockroom") -> SparkSession:
    """Session for tests and the bench: local mode, AQE on, UI off, UTC."""

    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STOCKROOM_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, honouring the cluster's ``spark.checkpoint.dir``.

    Only when nothing is configured *and* the master is local (tests, bench)
    do we create a folder of our own; on a cluster an unset folder is an error,
    because a machine-local folder would not survive executor loss.
    """

    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="stockroom-ckpt-")
        sc.setCheckpointDir(folder)
        return folder
    raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/ABFS)")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one): cuts lineage, survives executor loss."""

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder."""

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


def forget_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reaches; nothing happens where there is none."""

    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class ScratchTable:
    """A DataFrame written as Parquet under the shared checkpoint folder and read back.

    Cuts lineage like a reliable checkpoint, keeps column pruning, and can be
    deleted with ``drop()`` once nothing reads it any more.
    """

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        self.path = scratch_path(spark, name)
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        forget_folder(self.df.sparkSession, self.path)


def free_shuffles(spark: SparkSession) -> None:
    """Have the files of shuffles that no plan can reach any more deleted now.

    Spark deletes them once the driver's collector finds their plan unreachable, which on
    a large heap may be long after a scratch table took their place.
    """

    spark._jvm.System.gc()


_SIZE_PROOFS: dict = {}


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT, memo_key=None) -> DataFrame:
    """Broadcast ``df`` only after proving it has at most ``max_rows`` rows.

    The proof is a bounded count (``limit(max_rows + 1)``), so it never scans
    more than ``max_rows + 1`` rows.  Beyond the bound the plain frame is
    returned and the planner keeps a shuffle join.  ``memo_key`` (e.g. the
    input path) reuses a proof made earlier in the same driver process.
    """

    key = (memo_key, max_rows) if memo_key is not None else None
    if key is not None and key in _SIZE_PROOFS:
        small = _SIZE_PROOFS[key]
    else:
        small = df.limit(max_rows + 1).count() <= max_rows
        if key is not None:
            _SIZE_PROOFS[key] = small
    return F.broadcast(df) if small else df
