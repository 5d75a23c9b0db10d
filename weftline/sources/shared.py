"""Places that all executors share: the folder of spark.checkpoint.dir, and file operations through Hadoop's file systems."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, local mode takes a new temporary folder, set here; a cluster has no folder that all share, so that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file:" + tempfile.mkdtemp(prefix="weftline-")
        sc.setCheckpointDir(named)
    return named


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark resolves it: without a scheme it is on fs.defaultFS."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_cleaned: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder, which is deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    own = f"{shared_dir(spark).rstrip('/')}/weftline-{app}"
    if app not in _cleaned:
        _cleaned.add(app)
        atexit.register(_clean, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _clean(spark: SparkSession, own: str) -> None:
    """Delete the application's scratch; where the session has ended before the driver, the folder stays for whoever keeps the shared one."""
    if spark.sparkContext._jsc is not None:
        Store(spark, own).delete(own)


class Store:
    """The few file operations that sinks need, on whatever file system a path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def rename(self, a: str, b: str) -> None:
        """Atomic where the store's rename is; refuses an existing target."""
        if self.exists(b):
            raise FileExistsError(b)
        parent = self.path(b).getParent()
        self.fs.mkdirs(parent)
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"couldn't move {a} to {b}")

    def write_text(self, p: str, text: str, overwrite: bool = False) -> None:
        """A small file, whole or not at all: written aside, then moved."""
        if self.exists(p):
            if not overwrite:
                raise FileExistsError(p)
        aside = f"{p}.{uuid.uuid4().hex}"
        out = self.fs.create(self.path(aside), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if overwrite and self.exists(p):
            self.delete(p)
        self.rename(aside, p)

    def read_text(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


def write_json(spark: SparkSession, path: str, value: dict, overwrite: bool = False) -> None:
    """A state or manifest file; non-finite numbers are refused."""
    Store(spark, path).write_text(path, json.dumps(value, ensure_ascii=False, sort_keys=True, allow_nan=False, separators=(",", ":")) + "\n", overwrite)


def write_immutable(spark: SparkSession, path: str, text: str) -> str:
    """Publishing the same again is fine, anything else is an error."""
    store = Store(spark, path)
    if store.exists(path):
        if store.read_text(path) != text:
            raise ValueError(f"{path} is published with other content")
        return "unchanged"
    store.write_text(path, text)
    return "published"


def write_once(df: DataFrame, path: str) -> None:
    """Refuses to overwrite."""
    df.write.mode("errorifexists").parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Add to a log."""
    df.write.mode("append").parquet(path)
