"""Tables written to the folder that the cluster shares, to cut lineage.

The folder is the session's ``spark.checkpoint.dir``; only a session without
one (tests on one machine) gets a temporary folder.  A table written there
survives the loss of executors; the next steps read it again instead of
computing it again.
"""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='seqloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def modest(spark: SparkSession) -> None:
    """Whole texts go to Python 2,000 rows at a time instead of Spark's 10,000, unless the session says otherwise."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, "2000")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def files(at: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a folder's address."""
    if urlparse(at).scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), urlparse(at).path
    return pyarrow.fs.FileSystem.from_uri(at)


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written once to the shared folder and read from there."""
    modest(df.sparkSession)
    at = fresh(df.sparkSession, name)
    df.write.options(**options).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by `keep` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/seqloom-" in file or file.startswith(folder(spark)) or folder(spark).removeprefix("file://") in file:
                path = spark._jvm.org.apache.hadoop.fs.Path(file)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
