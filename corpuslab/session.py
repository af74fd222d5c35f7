"""Spark session defaults and lineage checkpoints.

Cluster settings (shuffle partitions, checkpoint dir, memory) come from the
session the caller hands us; the defaults below only apply when a value is
unset, which is what happens in local tests and the benchmark.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Settings we rely on for every plan; applied only where the session leaves them unset.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast decisions stay behind Spark's own size check (10 MB default).
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
}


def get_spark(app: str = "corpuslab", master: str | None = None,
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``master`` is only meant for tests and the local benchmark; on a cluster the
    launcher decides it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false")
    active = SparkSession.getActiveSession()
    defaults = DEFAULT_CONF if active is None else {}          # a running session keeps its own settings
    for k, v in {**defaults, **(extra or {})}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is used as is.  Only a
    local-mode session without the setting (tests, the benchmark) gets a scratch
    folder of its own.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="corpuslab-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_lineage_dealt(df: DataFrame, rows_per_task: int) -> DataFrame:
    """``cut_lineage``, read again in as few partitions as its rows need (they are counted as
    they are written), so that steps over few rows have few tasks."""
    counted = Observation()
    out = cut_lineage(df.observe(counted, F.count(F.lit(1)).alias("n")))
    return out.coalesce(max(1, -(-counted.get.get("n", 0) // rows_per_task)))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers as a zip (``--py-files`` for a
    session that was started without it), once per application."""
    sc = spark.sparkContext
    name = f"corpuslab-{sc.applicationId}.zip"
    if name in sc._python_includes:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="corpuslab-zip-"), name)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
