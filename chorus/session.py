"""Spark session and job-level settings.

The library never creates a session behind the caller's back except through
:func:`get_spark`, which tests, the bench and the examples use.  On a cluster
the session comes from the platform; :func:`ensure_checkpoint_dir` only fills
in ``spark.checkpoint.dir`` when nobody configured it (local runs, tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package assumes.  All of them are plain Spark
# configuration; nothing here is specific to one machine.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # JVM case mapping (Locale.ROOT) instead of ICU for lower/upper: same
    # results for these texts, about five times faster on non-ASCII text.
    "spark.sql.icu.caseMappings.enabled": "false",
}

_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(master: str | None = None, app_name: str = "chorus",
              shuffle_partitions: int | None = None,
              extra_conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only if unset.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that value is
    always used as is.  Only when it is missing (local tests) a fresh folder
    is created, and only when the master is local.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not re.match(r"local(\[[^]-]*\])?$", sc.master):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; configure a shared folder for the cluster")
    folder = tempfile.mkdtemp(prefix="chorus-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


@contextmanager
def shuffles_released(spark: SparkSession):
    """Frames written or made inside give their shuffle files back as soon as their action ends, not when the driver's
    garbage collector happens to find them: what a job keeps on disk is then one step's shuffles, whatever its heap."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` but columnar and compressed, so later readers prune columns; a
    lost executor re-reads the files instead of recomputing.  The shuffles behind it are released at once.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_released(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete the files of a table that ``stage`` returned, once all that is made from it has been written."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def send_code(spark: SparkSession) -> None:
    """Send this package to the executors (once per context), as ``--py-files`` does: Python workers import the
    functions they run."""
    sc = spark.sparkContext
    if getattr(sc, "_chorus_sent", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="chorus-code-")  # on the driver only; Spark serves it to executors
    with zipfile.ZipFile(f"{folder}/chorus_code.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(f"{folder}/chorus_code.zip")
    sc._chorus_sent = True
