"""Session-level helpers: table access and durable intermediate tables.

Intermediate results that must cut lineage are written as Parquet into the folder that the cluster names in
``spark.checkpoint.dir`` (shared by all executors), so that the loss of an executor never loses them. Only where that
setting is absent, as in local tests, a folder of our own is made and recorded in the session.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    found = spark.sparkContext.getConf().get(CHECKPOINT_DIR) or spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="chunkloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


class Scratch:
    """A folder below the shared one that holds the intermediate tables of one operator call.

    Readers of a table made here are lazy, so nothing is deleted when the operator returns: ``close`` removes the
    folder once the caller has consumed the result; the end of the driver removes what is left.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, self.path)

    def write(self, df: DataFrame, name: str, *, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> DataFrame:
        """Materialise ``df`` as a Parquet table and return a reader of it with a fresh, short lineage."""
        path = f"{self.path}/{name}"
        writer = df.write.mode(mode)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, name: str) -> None:
        """Removes a table that nothing reads any more."""
        SharedFiles(self.spark, self.path).delete(name)

    def close(self) -> None:
        _remove(self.spark, self.path)


class SharedFiles:
    """Small files below a folder of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.hadoop, self.path = spark._jvm.org.apache.hadoop.fs, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.utils = spark._jvm.org.apache.commons.io.IOUtils

    def _at(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._at(""))] if self.fs.exists(self._at("")) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.utils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Writes a file whole or not at all: under another name first, then renamed. A file of that name must not exist."""
        new = self._at(f".{name}.new")
        stream = self.fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        if not self.fs.rename(new, self._at(name)):
            raise FileExistsError(f"{self.path}/{name}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


def mounted_path(spark: SparkSession, path: str) -> str:
    """The path by which the operating system knows a folder; an error if it isn't on a mounted file system."""
    files = SharedFiles(spark, path)
    if files.fs.getScheme() != "file":
        raise RuntimeError(f"{path} isn't on a mounted file system")
    return files._at("").toUri().getPath()


def _remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of any file system, as far as the session, or else the mounted folder, still allows it."""
    try:
        SharedFiles(spark, path).delete("")
    except Exception:  # the session has ended
        if path.startswith(("file:", "/")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
