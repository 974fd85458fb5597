"""Documents that arrive as a stream: each batch is admitted, its postings and statistics are added, and a batch that comes twice counts once.

Below the root, each batch writes folders of its own, ``outcomes``, ``postings`` and ``terms``, and last of all its row in
``batches``. A batch that a stopped stream runs anew writes over what it had; readers see only batches that have their row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dossier.functions.shared import Files
from dossier.operators import lexical
from dossier.sources import files

#: What is written, with its columns.
TABLES = {
    "outcomes": "document_id string, path string, pipeline_state string, reason string, text string",
    "postings": "document_id string, term string, tf long, n_tokens long",
    "terms": "term string, df long",
    "batches": "n_files long, n_docs long, n_tokens long",
}


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of finished batches, with the column ``batch``; without rows where nothing has arrived yet."""
    if not Files(spark, root).exists("batches"):
        return spark.createDataFrame([], f"{TABLES[name]}, batch long")
    rows = lambda x: spark.read.schema(f"{TABLES[x]}, batch long").parquet(f"{root}/{x}")
    # a row for each batch; the folders of others, which a stopped stream leaves, are pruned
    return rows(name) if name == "batches" else rows(name).join(rows("batches").select("batch"), "batch", "left_semi").select(*rows(name).columns)


def add(arrived: DataFrame, batch: int, registry: DataFrame, root: str) -> None:
    """Take one batch of files (path, extension, content, and the fields of admission_boundary()).

    Of several files of a document in a batch, the first by path that is ready counts, and of several batches the first: later ones are
    DUPLICATE_DOCUMENT. Texts without a token count as documents. Doing a batch again, whatever was left of it, gives the same.
    """
    spark = arrived.sparkSession
    taken = files.ingest(arrived.select("path", "extension", "content").dropDuplicates(["path"]), arrived.drop("extension", "content").dropDuplicates(["path", "document_id"]), registry)
    before = read(spark, root, "outcomes").where(F.col("batch") < batch).where("reason IS NULL").select("document_id", F.lit(True).alias("_known"))
    ready = F.col("reason").isNull()
    first = taken.where(ready).groupBy("document_id").agg(F.min("path").alias("_first"))
    marked = taken.join(first, "document_id", "left").join(before, "document_id", "left")
    again = ready & (F.coalesce("_known", F.lit(False)) | (F.col("path") != F.col("_first")))
    done = marked.withColumn("reason", F.when(again, "DUPLICATE_DOCUMENT").otherwise(F.col("reason"))).withColumn("pipeline_state", F.when(again, "REJECTED_INPUT").otherwise(F.col("pipeline_state")))

    def keep(rows: DataFrame, name: str) -> DataFrame:
        path = f"{root}/{name}/batch={batch}"
        rows.select(*(c.split()[0] for c in TABLES[name].split(", "))).write.mode("overwrite").parquet(path)
        return spark.read.schema(TABLES[name]).parquet(path)

    Files(spark, root).delete(f"batches/batch={batch}")  # unfinished from here on
    outcomes = keep(done, "outcomes")
    docs = outcomes.where("reason IS NULL").select("document_id", "text")
    sized = lexical.tokenized(docs, "document_id").select("document_id", F.size("tokens").cast("long").alias("n_tokens"), F.explode_outer("tokens").alias("term"))
    # a document without a token has one row without a term, so that it counts
    postings = keep(sized.groupBy("document_id", "term").agg(F.count("term").alias("tf"), F.first("n_tokens").alias("n_tokens")), "postings")
    keep(postings.where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
    n_files, n_tokens = outcomes.agg(F.count(F.lit(1)).alias("n_files")), postings.agg(F.count_distinct("document_id").alias("n_docs"), F.coalesce(F.sum("tf"), F.lit(0)).alias("n_tokens"))
    keep(n_files.crossJoin(F.broadcast(n_tokens)), "batches")  # one row each


def handler(registry: DataFrame, root: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, number: add(batch, number, registry, root)


def start(arriving: DataFrame, registry: DataFrame, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Take a stream of files; ``once``: what is there now, and then stop."""
    writer = arriving.writeStream.foreachBatch(handler(registry, root)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def corpus_stats(spark: SparkSession, root: str) -> DataFrame:
    """n_docs and avg_tokens of all that has arrived: a sum over a row for each batch."""
    return read(spark, root, "batches").agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.try_divide(F.sum("n_tokens"), F.sum("n_docs")), F.lit(0.0)).alias("avg_tokens"))


def document_frequency(spark: SparkSession, root: str) -> DataFrame:
    """(term, df) of all that has arrived; batches share no document, so theirs add up."""
    return read(spark, root, "terms").groupBy("term").agg(F.sum("df").alias("df"))
