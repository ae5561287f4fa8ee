"""Folders that the driver and the executors share, and one way to reach them: Spark names a folder in full, Python tasks go by that name."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Schemes that Hadoop and pyarrow know by different names, and those that both know.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
KNOWN = ("file", "hdfs", "viewfs", "s3", "gs", "gcs", "abfs", "abfss")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark's default file system has it: a bare path isn't each machine's own."""
    if "://" in path:
        return path.rstrip("/")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(where).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system for a name that qualified() gave, and the path in it."""
    scheme, found, rest = uri.partition("://")
    if not found:
        raise ValueError(f"{uri} has no scheme, and would be each machine's own: name it in full, or by qualified()")
    scheme = SCHEMES.get(scheme, scheme)
    if scheme not in KNOWN:
        raise ValueError(f"Python tasks can't reach {uri}: only {', '.join(sorted({*KNOWN, *SCHEMES}))} are known to both Spark and pyarrow")
    return fs.FileSystem.from_uri(f"{scheme}://{rest}")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, removed when the driver ends.

    Only a session in local mode, of one machine, may go without the setting: it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="epochweave-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{qualified(spark, base)}/epochweave/{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(where):
        files.mkdirs(where)
        files.deleteOnExit(where)
    return path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh name for a folder in shared_dir()."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in shared_dir(): what follows begins with a short plan, and lost executors don't make it again."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
