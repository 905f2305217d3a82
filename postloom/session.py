"""Session settings, and where intermediate state may be kept."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from postloom.sources.files import resolved

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # do not record a call site for every Column; large expressions are built several times faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

#: Whether shuffle files are removed when the execution that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and measurements on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("postloom")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(maxsize=1)
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="postloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints, with its scheme: that it is shared is said by naming it.

    Only a session in local mode may name none; it has a folder of its own then, which all its tasks reach.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return resolved(spark, named)
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder(spark.sparkContext.applicationId)


def cut_lineage(df: DataFrame, name: str = "rows") -> DataFrame:
    """Write the rows to the shared folder and go on from there.

    What made them runs once, however often they are used, and a lost executor costs one read. The shuffle files of the
    write go with its end: nothing reads them again, and Spark would keep them until the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
