"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINTS = "spark.checkpoint.dir"
#: Folders made in this process, by application: one of its own for a local session that names none,
#: and those that scratch tables are in.
_LOCAL: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, by the session's `spark.checkpoint.dir`. Where that is
    unset, a session with executors of its own machines raises; a local one, whose executors are
    this process, gets a temporary folder."""
    named = spark.conf.get(_CHECKPOINTS, None) or spark.sparkContext.getConf().get(_CHECKPOINTS)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"{_CHECKPOINTS} is unset: intermediate tables need a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="weftgraph-")
    return _LOCAL[app]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of any file system that Spark reads."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


class Scratch:
    """A folder of tables that one computation writes and reads back.

    A table that is written cuts lineage: an executor lost later costs nothing that was written.
    Tables that the result does not read are dropped as soon as they are done with; those that it
    does read stay until release().
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/weftgraph-{uuid.uuid4().hex}"
        _MADE.setdefault(spark.sparkContext.applicationId, []).append(self.path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.path}/{name}")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table into a scratch folder of its own and read it back."""
    return Scratch(df.sparkSession).save(df, name)


def release(spark: SparkSession) -> None:
    """Remove all scratch tables of this application. Results that were not written yet are lost
    with them, so call it when they are."""
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)
