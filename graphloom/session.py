"""Session helpers shared by all modules: shared folders, materialised intermediate tables, files of any URI."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only on a local master that names none (tests, a laptop) a temporary folder is made and set; a cluster must name one,
    since a folder of the driver's machine would not be seen by executors.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new, unused path below the shared folder. Unless ``keep``, it is removed when the application ends."""
    base = shared_dir(spark).rstrip("/")
    if not keep:
        base = f"{base}/graphloom-{spark.sparkContext.applicationId}"
        files = FileSystem(spark, base)
        if not files.exists(base):
            files.fs.mkdirs(files.path(base))
            files.fs.deleteOnExit(files.path(base))
    return f"{base}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts lineage; the files outlive lost executors and are removed when the application ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class FileSystem:
    """The few file operations that are needed, through Hadoop, for any URI."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        """Names of what lies in a folder; none if there is no folder."""
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(folder))] if self.exists(folder) else []

    def read_text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create_text(self, name: str, text: str) -> bool:
        """Write beside the target, then rename to it; false, and nothing changed, if the target exists."""
        beside = self.path(f"{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(beside, True)
        try:
            self.jvm.org.apache.commons.io.IOUtils.write(text, stream, "UTF-8")
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        plain = self.jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        plain[0] = rename.NONE
        try:
            context.rename(beside, self.path(name), plain)
        except Exception:
            self.fs.delete(beside, False)
            if self.exists(name):
                return False
            raise
        return True

    def copy(self, source: str, target: str) -> None:
        other = self.path(target).getFileSystem(self.conf)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path(source), other, self.path(target), False, self.conf)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Remove a file or folder through the Hadoop file system of its URI; false if it did not exist."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
