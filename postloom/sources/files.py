"""Files that tasks write and read by themselves, in the store that Spark uses."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import SparkSession


def resolved(spark: SparkSession, folder: str) -> str:
    """A shared folder, made if need be, with the scheme of the store it lies in; links of a view of stores are followed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    return store.resolvePath(path).toString()


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark resolves it to, so that tasks and tables meet in one store.

    On a cluster a folder of the machine itself is refused unless it is named as such.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if not full.startswith("file:"):
        return full
    if path.toUri().getScheme() is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{folder} is a folder of this machine; name one that all executors share")
    return "file:///" + full.removeprefix("file:").lstrip("/")


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a qualified folder, in a task."""
    return fs.FileSystem.from_uri(folder)
