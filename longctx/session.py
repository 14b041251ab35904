"""Spark session helpers.

The library never creates its own storage: lineage cuts go to the folder the cluster
names in ``spark.checkpoint.dir``.  Only a local session (tests, laptop runs) gets a
scratch folder when that setting is missing.
"""

from __future__ import annotations

import gc
import hashlib
import os
import tempfile
import uuid
import zipfile

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "longctx") -> SparkSession:
    """Session for tests and local runs: AQE on, UTC, no UI."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only for local masters."""
    conf = spark.conf.get(CHECKPOINT_CONF, None) or ""
    if not conf:
        conf = spark.sparkContext.getConf().get(CHECKPOINT_CONF, "") or ""
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return conf
    master = spark.sparkContext.master or ""
    if not master.startswith("local"):
        raise RuntimeError(
            f"{CHECKPOINT_CONF} is not set; a cluster run needs a shared folder for lineage cuts"
        )
    path = tempfile.mkdtemp(prefix="longctx-ckpt-")
    spark.conf.set(CHECKPOINT_CONF, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def build_zip(path: str) -> str:
    """Write this package as a zip that ``--py-files`` or ``addPyFile`` takes."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, dirs, files in os.walk(_PACKAGE):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for f in sorted(f for f in files if f.endswith(".py")):
                full = os.path.join(folder, f)
                z.write(full, os.path.join("longctx", os.path.relpath(full, _PACKAGE)))
    return path


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run in workers are pickled by module name, so a worker that does not find the
    package on its own path needs it.  Spark's file server carries the zip.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    tag = hashlib.sha256(app.encode()).hexdigest()[:8]
    spark.sparkContext.addPyFile(build_zip(os.path.join(tempfile.mkdtemp(prefix="longctx-zip-"), f"longctx-{tag}.zip")))
    _shipped.add(app)


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in a new folder of the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/longctx-{uuid.uuid4().hex}/{name}"


def shared_table(df, name: str):
    """``df`` written as Parquet in the shared checkpoint folder and read back: a lineage cut for wide rows.

    Returns (frame, path); pass the path to ``drop_shared`` when nothing reads the frame any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_shared(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared checkpoint folder through Hadoop's file system API."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a frame as Parquet in the shared checkpoint folder and reads it back; all is removed at the end.

    A lineage cut for steps of a job with many rounds: unlike a checkpoint it has no file for an empty partition, and small
    files are read together, so a small frame costs few tasks and little disk whatever the number of shuffle partitions.
    """
    paths = []

    def keep(df: DataFrame) -> DataFrame:
        frame, path = shared_table(df, "step")
        paths.append(path)
        return frame

    try:
        yield keep
    finally:
        for path in paths:
            drop_shared(spark, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that nothing refers to any more.

    Spark does so by itself when the driver happens to collect its garbage; a long job with large
    steps frees the disk sooner this way.  What a checkpoint or a written table holds needs no shuffle files.
    """
    gc.collect()
    spark._jvm.System.gc()
