"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import lru_cache

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    # All instants are UTC; per-user zones are applied explicitly.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Text rows cost CPU, not bytes: do not merge them onto few cores. Large shuffles are not affected.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Hot users, groups and targets are split at run time, also below an aggregate.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Python tasks hold several copies of a batch (texts, pieces, results): a few MB of rows at a time are enough.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application.

    Functions that run in tasks are pickled by reference; without the package
    on the workers' path they load only where the driver's folder happens to be.
    """
    context = spark.sparkContext
    if getattr(context, "_vitalgrid_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(_staging().name, "vitalgrid_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("vitalgrid", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._vitalgrid_shipped = True


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def local_session(cpus: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vitalgrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(maxsize=1)
def _staging() -> tempfile.TemporaryDirectory:
    """The driver's own folder, gone when the process ends: the code archive, and tables of a local master."""
    return tempfile.TemporaryDirectory(prefix="vitalgrid-")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder the cluster names; a fresh local one only in local mode, where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(_staging().name, "tables")


def cut_lineage(df):
    """Write the rows to the shared checkpoint folder and read them back.

    The copy survives the loss of executors, is computed once, and is columnar,
    so that later readers prune columns.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
