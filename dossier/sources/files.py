"""Raw files under a root: a binary scan joined to provenance, then safety checks and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.ladders import first_match
from dossier.operators import admission


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to the root, extension, content) of every file below the root; paths never leave it, as the listing starts there."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1] + "/"
    relative = F.substring_index(F.regexp_replace("path", "^file:/+", "/"), base, -1)
    return found.select(relative.alias("path"), F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("extension"), "content")


def ingest(files: DataFrame, provenance: DataFrame, registry: DataFrame) -> DataFrame:
    """State, reasons, type and text of each provenance record (path and the fields of admission_boundary()).

    A record without a file is FILE_NOT_FOUND (so is one with a file of no bytes: Spark's scan doesn't list it), one whose path climbs out PATH_TRAVERSAL_ATTEMPT. Only accepted text is
    decoded; invalid bytes become U+FFFD and set ``decode_warning``.
    """
    admitted = admission.admission_boundary(provenance, registry).withColumnsRenamed({"reason": "admission_reason"})
    joined = admitted.join(files, "path", "left").withColumn("claimed_hash", F.col("content_hash"))
    checked = admission.file_safety(joined).withColumnRenamed("reason", "file_reason")
    reason = first_match(
        [
            (F.col("path").rlike(r"(^|[/\\])\.\.([/\\]|$)|^/|^[A-Za-z]:"), "PATH_TRAVERSAL_ATTEMPT"),
            (F.col("content").isNull(), "FILE_NOT_FOUND"),
        ]
    )
    reason = F.coalesce(reason, "admission_reason", "file_reason")
    state = F.when(F.col("reason").isNull(), "READY_FOR_INGESTION").when(F.col("admission_reason").isNotNull() | (F.col("reason") == "UNSUPPORTED_DOCUMENT_TYPE"), "REJECTED_INPUT").otherwise("QUARANTINED")
    done = checked.withColumn("reason", reason).withColumn("pipeline_state", state)
    text = F.when(F.col("reason").isNull() & F.col("document_type").isin("TEXT", "HTML"), F.make_valid_utf8(F.col("content").cast("string")))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return done.select(*provenance.columns, "document_type", "pipeline_state", "reason", text.alias("text"), (F.col("reason").isNull() & ~valid).alias("decode_warning"))
