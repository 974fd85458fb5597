"""Citation markers in answers: extraction, validation against a pack's evidence, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.ladders import first_match
from dossier.functions.text import is_blank

#: Versions of references that can be read.
VERSIONS = ("1.0.0",)
MARKER = r"\[\[CITE:([^\]]*)\]\]"


def extract(answers: DataFrame) -> DataFrame:
    """(answer_id, pack_id, occurrence, evidence_id): every marker in order, its id untrimmed and perhaps empty."""
    return answers.select("answer_id", "pack_id", F.posexplode(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(MARKER), F.lit(1))).alias("occurrence", "evidence_id"))


def validate(references: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds status, reason_code and is_duplicate to references (answer_id, pack_id, occurrence, evidence_id).

    evidence: pack_id, evidence_id, intact, well_formed, pack_valid. Ids are compared exactly. A pack that fails beats
    every other reason; a malformed record beats a forged one. One equi-join; a reference without a pack is unresolved.
    References may carry a schema_version, which then must be one of VERSIONS: null isn't.
    """
    packs = evidence.groupBy("pack_id").agg(F.bool_and("pack_valid").alias("_pack"))
    known = evidence.select("pack_id", "evidence_id", F.col("intact").alias("_intact"), F.col("well_formed").alias("_formed"))
    joined = references.join(packs, "pack_id", "left").join(known, ["pack_id", "evidence_id"], "left")
    reason = first_match(
        [
            (~F.col("_pack"), "INVALID_PACK"),
            (~F.coalesce(F.col("schema_version").isin(*VERSIONS), F.lit(False)) if "schema_version" in references.columns else F.lit(False), "SCHEMA_MISMATCH"),
            (F.col("evidence_id").isNull(), "EVIDENCE_ID_MISSING"),
            (is_blank(F.col("evidence_id")), "MALFORMED_REFERENCE"),
            (F.col("_intact").isNull(), "EVIDENCE_NOT_FOUND"),
            (~F.col("_formed"), "EVIDENCE_PROVENANCE_FAILURE"),
            (~F.col("_intact"), "EVIDENCE_INTEGRITY_FAILURE"),
        ]
    )
    seen = F.row_number().over(Window.partitionBy("answer_id", "evidence_id").orderBy("occurrence")) > 1
    done = joined.withColumn("reason_code", reason)
    return done.select(
        *references.columns,
        F.when(F.col("reason_code").isNull(), "VALID").when(F.col("reason_code") == "EVIDENCE_NOT_FOUND", "UNRESOLVED").otherwise("INVALID").alias("status"),
        "reason_code",
        F.when(is_blank(F.col("evidence_id")), False).otherwise(seen).alias("is_duplicate"),
    )


def coverage(validated: DataFrame) -> DataFrame:
    """Per answer: counts by status, distinct valid ids, duplicates, and the share of valid references."""
    n, valid = F.count(F.lit(1)), F.count_if(F.col("status") == "VALID")
    return validated.groupBy("answer_id").agg(
        n.alias("n_references"),
        valid.alias("n_valid"),
        F.count_if(F.col("status") == "INVALID").alias("n_invalid"),
        F.count_if(F.col("status") == "UNRESOLVED").alias("n_unresolved"),
        F.count_distinct(F.when(F.col("status") == "VALID", F.col("evidence_id"))).alias("n_unique_valid"),
        F.count_if("is_duplicate").alias("n_duplicates"),
        F.coalesce(F.try_divide(valid, n), F.lit(0.0)).alias("integrity_rate"),
    )


def rejection_rate(validated: DataFrame) -> DataFrame:
    """One row: share of references that are not valid; null without references."""
    bad, n = F.count_if(F.col("status") != "VALID"), F.count(F.lit(1))
    return validated.agg(n.alias("n_references"), bad.alias("n_rejected"), F.try_divide(bad, n).alias("rejection_rate"))
