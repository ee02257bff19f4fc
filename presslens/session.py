"""Session helpers: a local session for tests and the bench, and lineage cuts.

On a cluster the session is created by the platform; operators never assume a
local file system.  The only storage this package writes to on its own is the
checkpoint folder the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str | None = None, shuffle_partitions: int | None = None,
                  app: str = "presslens") -> SparkSession:
    """Local-mode session with AQE on and the web UI off (tests, bench)."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    if shuffle_partitions is None:
        shuffle_partitions = int(cpus) if str(cpus).isdigit() else 8
    parts = shuffle_partitions
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PRESSLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    The folder the cluster names in ``spark.checkpoint.dir`` is used as is.
    Only a local-mode session without one (tests) gets a fresh folder under the
    system temp dir; on a cluster a missing setting is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder for lineage cuts")
    folder = tempfile.mkdtemp(prefix="presslens-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


#: Spark's setting by which the shuffle files of a query are removed when it has ended.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, tidy: bool = False) -> DataFrame:
    """The rows as a table written once into the shared checkpoint folder and read back.

    ``checkpoint()`` would compute the rows twice (once to count, once to write).  ``tidy`` removes the shuffle files of
    the write when it has ended; else they stay on the disks until the driver's garbage collection finds them."""
    spark = df.sparkSession
    path = checkpoint_path(spark, f"cut-{uuid.uuid4().hex}")
    before = spark.conf.get(TIDY, None)
    try:
        if tidy:
            spark.conf.set(TIDY, "true")
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint dir, e.g. for a streaming query's state."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
