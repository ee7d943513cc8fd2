"""Session defaults for local runs; a cluster's own settings win."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(cores: str | int = "*", app: str = "chartloom", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CHARTLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, path: str | None = None) -> str:
    """The folder for intermediate tables that all executors share.

    ``path``, else the one in ``spark.checkpoint.dir``.  Only a local-mode
    session, whose executors are this process, gets a temporary folder when
    neither is given; it goes when the process ends.  Elsewhere that is an error.
    """
    chosen = path or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not chosen:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("name a shared folder: pass a path or set spark.checkpoint.dir")
        chosen = tempfile.mkdtemp(prefix="chartloom-checkpoint-")
        atexit.register(shutil.rmtree, chosen, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(chosen)
    return chosen


def materialize(df):
    """Write an intermediate that several branches read, and cut its lineage.

    The rows go to the checkpoint folder, so they outlive lost executors.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of hundreds of kilobytes go to Parquet as pages of one row and groups of a few: else a page is a hundred rows at
#: least, and a writer, its codec and a reader hold whole ones.
WIDE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.row.count.limit": "32"}


def written(df, wide: bool = False):
    """The same as a compressed Parquet table, for wide rows such as vectors; it has the columns' own encodings.

    ``wide`` is for rows of hundreds of kilobytes.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**(WIDE_ROWS if wide else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
