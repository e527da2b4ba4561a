"""Session helpers: a local session for tests, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "siftline", **conf: str) -> SparkSession:
    """A loopback-only local session for tests and the benchmark."""
    n = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A private folder is made only where the setting is absent *and* the master
    is local, since a machine-local folder is useless to other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    current = spark.sparkContext.getCheckpointDir()
    return current if current else tempfile.mkdtemp(prefix="siftline-")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared folder."""
    return f"{work_root(spark).rstrip('/')}/siftline/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "cut", compression: str | None = None) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    The written table outlives lost executors, is read column by column and tells
    the planner its true size.  ``compression`` is Parquet's, the session's by default.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def bucketed_table(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """As ``cut_lineage``, but stored in hash buckets of ``keys``, one file each.

    Joins and groupings on the keys read the table without shuffling it.
    """
    spark = df.sparkSession
    table = f"siftline_{name}_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, *keys)
    rows.write.format("parquet").bucketBy(buckets, *keys).option("path", work_path(spark, name)).saveAsTable(table)
    return spark.table(table)


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, where it may not be installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="siftline-code-")) / "siftline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    # the driver serves the file; executors fetch it before their first task
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
