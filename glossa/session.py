"""Spark session and lineage helpers shared by every job.

The library never creates its own scratch space on a cluster: lineage is cut
with reliable ``checkpoint()``, or with a Parquet table written and read back,
in the folder the cluster names in ``spark.checkpoint.dir``.  Only a local-mode session without that setting
(tests, laptops) gets a fresh folder under the system temp directory.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "glossa", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session with the settings the jobs are written for (AQE on, Arrow on, no UI)."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GLOSSA_DRIVER_MEMORY", "16g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, honouring the cluster's setting.

    Order: an already configured SparkContext folder, then the session
    setting ``spark.checkpoint.dir``; only a local master without either gets
    a private temp folder.  A cluster without the setting is an error, since a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running glossa jobs on a cluster")
    folder = tempfile.mkdtemp(prefix="glossa-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def land(df: DataFrame, path: str | None = None) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared folder and read it back.

    For loops: the table read has the size of its files as its estimate and
    no constraints, while a checkpointed DataFrame keeps the estimate of the
    plan it came from, whose number of bits doubles with every join of a
    round.  The files are ordinary shared files and outlive executors.
    """
    spark = df.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
