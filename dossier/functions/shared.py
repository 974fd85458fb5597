"""Files and written tables in the cluster's shared folder, through Spark's own file systems."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder of its own for this call, below the one that ``spark.checkpoint.dir`` names.

    Where that is unset: below a temporary one, on a local master only.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/dossier/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as Parquet at ``path``, which must not exist, read back with the same schema."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """What a store that Spark reaches has at a path: local disk, HDFS, object stores."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = self.path(root)
        self.fs = self.root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def path(self, *parts: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(*parts)

    def at(self, name: str) -> Any:
        """The path of a name below the root; the root itself for an empty one."""
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name) if name else self.root

    def exists(self, name: str) -> bool:
        return bool(self.fs.exists(self.at(name)))

    def text(self, name: str, most: int = 1 << 20) -> str | None:
        """The UTF-8 text of a small file; None if there is none. Over ``most`` bytes or invalid: ValueError."""
        if not self.exists(name):
            return None
        status = self.fs.getFileStatus(self.at(name))
        if status.isDirectory() or status.getLen() > most:
            raise ValueError(f"{name} is no file of {most} bytes at most")
        stream = self.fs.open(self.at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a new small file, closed before this returns; an OSError if that fails."""
        try:
            stream = self.fs.create(self.at(name), True)
            try:
                stream.write(bytearray(text.encode("utf-8")))
            finally:
                stream.close()
        except Py4JJavaError as e:
            raise OSError(f"{name} can't be written: {e.java_exception.getMessage()}") from e

    def replace(self, source: str, target: str) -> None:
        """Rename ``source`` to ``target``, over what is there, in one step where the store has it; an OSError if that fails.

        Readers see the old file or the new one. FileContext renames over a file at once; a store without one gets an error
        rather than a moment with neither.
        """
        options = self.jvm.org.apache.hadoop.fs.Options
        over = self.jvm.java.lang.reflect.Array.newInstance(options.Rename.OVERWRITE.getClass(), 1)
        over[0] = options.Rename.OVERWRITE
        try:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf())
            context.rename(self.at(source).makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()), self.at(target).makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()), over)
        except Py4JJavaError as e:
            raise OSError(f"{target} can't be replaced: {e.java_exception.getMessage()}") from e

    def move(self, source: str, target: str) -> None:
        """Rename a folder to a name that doesn't exist yet."""
        try:
            self.fs.mkdirs(self.at(target).getParent())
            done = self.fs.rename(self.at(source), self.at(target))
        except Py4JJavaError as e:
            raise OSError(f"{source} can't be moved: {e.java_exception.getMessage()}") from e
        if not done:
            raise OSError(f"{source} can't be moved to {target}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)
