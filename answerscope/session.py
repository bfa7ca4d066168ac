"""Session settings for local runs and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "answerscope", memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can see: ``spark.checkpoint.dir``, if it is set.

    Only a local session falls back to a temporary folder; on a cluster a
    machine-local folder would be lost with its machine, so that is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="answerscope-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/answerscope/{label}-{uuid.uuid4().hex}"


# Rows of one input lie together and repeat its texts; a dictionary this large (bytes, per column and
# row group) holds them once, where the usual megabyte is full after a few hundred rows.
REPEATED_TEXTS = {"parquet.dictionary.page.size": str(32 << 20)}


def written(df, label: str):
    """Write a table to the shared folder and read it back, so that all its uses share one computation."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**REPEATED_TEXTS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    # Spark copies the archive to the executors; this copy is only read by the driver.
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="answerscope-"), "answerscope"), "zip",
                                  root_dir=os.path.dirname(here), base_dir=os.path.basename(here))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
