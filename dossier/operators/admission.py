"""Admission of documents against a registry of source families, and file safety."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.ladders import first_match
from dossier.functions.text import is_blank

# Source families (id, jurisdiction scope, corpus role), evidence jurisdictions, accepted states, file types, size limit.
FAMILIES = (
    ("SF-01", "INDIA", "EVIDENCE_SOURCE"),
    ("SF-02", "INDIA", "EVIDENCE_SOURCE"),
    ("SF-03", "INDIA", "EVIDENCE_SOURCE"),
    ("SF-04", "INDIA", "EVIDENCE_SOURCE"),
    ("SF-05", "INDIA", "EVIDENCE_SOURCE"),
    ("SF-06", "INTERNATIONAL", "EVIDENCE_SOURCE"),
    ("SF-07", "INDIA", "EVIDENCE_SOURCE"),
    ("SF-08", "NOT_APPLICABLE", "SERVICE_ADAPTER"),
)
EVIDENCE_JURISDICTIONS = ("INDIA", "INTERNATIONAL", "NOT_APPLICABLE", "OTHER_UNSPECIFIED")
ACCEPTED = ("ADMIT", "ADMIT_WITH_RESTRICTION")
FILE_TYPES = {".txt": "TEXT", ".html": "HTML", ".htm": "HTML", ".pdf": "PDF"}
MOST_BYTES = 50_000_000


def families(spark: SparkSession, rows: tuple[tuple[str, str, str], ...] = FAMILIES) -> DataFrame:
    return spark.createDataFrame(list(rows), "source_family_id string, jurisdiction_scope string, corpus_role string")


def admission_boundary(provenance: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``reason`` (the first failed check, null if none) and ``accepted``. The registry is a short list, so it is broadcast."""
    joined = provenance.join(F.broadcast(registry), "source_family_id", "left")
    c = F.col
    reason = first_match(
        [
            (is_blank(c("document_id").cast("string")), "MISSING_DOCUMENT_IDENTITY"),
            (c("source_family_id").isNull() | (c("source_family_id") == ""), "MISSING_SOURCE_FAMILY"),
            (c("corpus_role").isNull(), "UNKNOWN_SOURCE_FAMILY"),
            (c("corpus_role") != "EVIDENCE_SOURCE", "SOURCE_FAMILY_NOT_EVIDENCE_SOURCE"),
            (c("jurisdiction").isNull() | ~c("jurisdiction").isin(*EVIDENCE_JURISDICTIONS), "UNKNOWN_JURISDICTION"),
            (c("jurisdiction") != c("jurisdiction_scope"), "JURISDICTION_MISMATCH"),
            (is_blank(c("content_hash")), "MISSING_CONTENT_HASH"),
            (c("admission_status").isNull() | ~c("admission_status").isin(*ACCEPTED), "INVALID_ADMISSION_STATE"),
        ]
    )
    return joined.withColumn("reason", reason).withColumn("accepted", c("reason").isNull()).drop("jurisdiction_scope", "corpus_role")


def file_safety(files: DataFrame) -> DataFrame:
    """Adds document_type, state and reason to files (content binary, extension, claimed_hash): unsupported, empty, too large, hash mismatch."""
    kinds = F.create_map(*(F.lit(x) for pair in FILE_TYPES.items() for x in pair))
    typed = files.withColumn("document_type", F.try_element_at(kinds, F.lower("extension")))
    reason = first_match(
        [
            (F.col("document_type").isNull(), "UNSUPPORTED_DOCUMENT_TYPE"),
            (F.coalesce(F.octet_length("content"), F.lit(0)) == 0, "EMPTY_FILE"),
            (F.octet_length("content") > MOST_BYTES, "OVERSIZED_INPUT"),
            (~F.sha2("content", 256).eqNullSafe(F.lower(F.trim("claimed_hash"))), "CONTENT_HASH_MISMATCH"),
        ]
    )
    state = F.when(F.col("reason").isNull(), "READY_FOR_INGESTION").when(F.col("reason") == "UNSUPPORTED_DOCUMENT_TYPE", "REJECTED_INPUT").otherwise("QUARANTINED")
    return typed.withColumn("reason", reason).withColumn("state", state)


def admission_policy(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds rule_id (A1 to A12, the first that fits), admission_status and reason (null for A12) to provenance records.

    records: source_family_id, jurisdiction, document_id, content_hash, validation_status, supersession_status,
    version_known, effective_date_known, conflict_status, known_conflicting_with (array).
    """
    c = F.col
    joined = records.join(F.broadcast(registry.select("source_family_id", "jurisdiction_scope")), "source_family_id", "left")
    known_conflict = F.size(F.coalesce("known_conflicting_with", F.array().cast("array<string>"))) > 0
    steps = (
        (c("jurisdiction_scope").isNull(), "A1", "REJECT", "UNKNOWN_SOURCE_FAMILY"),
        (c("jurisdiction").isNull() | ~c("jurisdiction").isin(*EVIDENCE_JURISDICTIONS), "A2", "REJECT", "UNKNOWN_JURISDICTION"),
        (c("jurisdiction") != c("jurisdiction_scope"), "A3", "REJECT", "JURISDICTION_MISMATCH"),
        (is_blank(c("document_id")), "A4", "HOLD_FOR_VALIDATION", "MISSING_DOCUMENT_IDENTITY"),
        (is_blank(c("content_hash")), "A5", "HOLD_FOR_VALIDATION", "MISSING_CONTENT_HASH"),
        (~c("validation_status").eqNullSafe("VALIDATED"), "A6", "HOLD_FOR_VALIDATION", "VALIDATION_NOT_CONFIRMED"),
        (c("supersession_status") == "SUPERSEDED", "A7", "SUPERSEDED", "DOCUMENT_SUPERSEDED"),
        (c("conflict_status") == "CONFLICTING", "A8", "HOLD_FOR_VALIDATION", "UNRESOLVED_CONFLICT"),
        (known_conflict & F.coalesce("conflict_status", F.lit("")).isin("", "NONE"), "A9", "HOLD_FOR_VALIDATION", "MISSING_CONFLICT_STATUS_DESPITE_KNOWN_CONFLICT"),
        (~c("version_known") & ~c("effective_date_known"), "A10", "ADMIT_WITH_RESTRICTION", "VERSION_UNKNOWN_RESTRICTED"),
        (c("supersession_status") == "UNKNOWN", "A11", "ADMIT_WITH_RESTRICTION", "SUPERSESSION_STATUS_UNKNOWN"),
    )
    pick = lambda k, last: first_match([(s[0], s[k]) for s in steps], last)
    return joined.withColumns({"rule_id": pick(1, "A12"), "admission_status": pick(2, "ADMIT"), "reason": pick(3, None)}).drop("jurisdiction_scope")
