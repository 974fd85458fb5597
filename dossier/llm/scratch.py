"""Written intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset: a temporary one of our own, on a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/dossier/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_path = path
    return found


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of ``rows`` rows at most from now on in this session, where it has Spark's 10,000 or more.

    A batch of texts is held several times on its way to Python and back, in direct memory that the JVM frees late; so
    that memory grows with the batch, up to the size of the heap once more.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) < 10_000:
        spark.conf.set(key, str(rows))


def bounded_bytes(spark: SparkSession, most: int = 1 << 20) -> None:
    """Arrow batches of some ``most`` bytes at most from now on in this session, where nothing is set: short rows stay many in a batch, texts are few."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(most))


def removed(*tables: DataFrame) -> None:
    """Delete tables that written() gave, once everything made of them has been written itself."""
    for df in tables:
        path = vars(df).pop("written_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def keyed(docs: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """``docs`` with a column ``key``: a long for each row, no two alike, never null, in the order of doc_id with nulls last.

    Where no doc_id is null or repeated it is doc_id itself (True). Else rows are numbered and written: those that share a
    doc_id, or have none, stay rows of their own.
    """
    own = F.col("doc_id").cast("long")
    clash = docs.select(own.alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    if clash.isEmpty():
        return docs.withColumn(key, own), True
    place = f"{key}_place"
    numbered = written(docs.withColumn(place, F.monotonically_increasing_id()), "numbered")
    ordered = written(numbered.orderBy(own.asc_nulls_last(), place).withColumn(key, F.monotonically_increasing_id()).drop(place), "keyed")
    removed(numbered)
    return ordered, False
