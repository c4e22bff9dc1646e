"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below ``spark.checkpoint.dir`` that no other run uses.

    Where that is unset a temporary folder serves, but only on one machine: with
    other masters its files would stay where each task wrote them.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("geoloom.shared.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="geoloom-")
        spark.conf.set("geoloom.shared.dir", base)
    return f"{base.rstrip('/')}/geoloom/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a new shared folder and read it back."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` returned and that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def open_fs(uri: str):
    """(pyarrow filesystem, path) of a URI or a plain path."""
    import re

    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)
