"""Grounding and delivery of provider answers: two ladders over their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.ladders import first_match

# Languages, the word for none, the reasons of abstentions and deliveries (below).
LANGUAGES, UNSPECIFIED = ("en", "hi", "ta"), "UNSPECIFIED"
NO_EVIDENCE, NO_CITATIONS = "NO_EVIDENCE_AVAILABLE", "NO_VALID_CITATIONS_PRODUCED"
AS_IS, SAME_LANGUAGE = "LANGUAGE_UNSPECIFIED_NO_TRANSLATION_NEEDED", "SOURCE_MATCHES_REQUESTED_NO_TRANSLATION_NEEDED"


def ground(outputs: DataFrame) -> DataFrame:
    """Adds grounding_status and grounding_reason to outputs (n_evidence, success, answer, n_valid, and pack_valid if there).

    An untrustworthy pack counts as one without evidence. Only abstentions have a reason: a failure of the provider is a
    status of its own.
    """
    usable = F.coalesce("n_evidence", F.lit(0)) > 0
    usable = usable & F.coalesce("pack_valid", F.lit(True)) if "pack_valid" in outputs.columns else usable
    reason = first_match(
        [
            (~usable, NO_EVIDENCE),
            (~F.coalesce("success", F.lit(False)) | F.col("answer").isNull(), "GENERATION_FAILED"),
            (F.coalesce("n_valid", F.lit(0)) == 0, NO_CITATIONS),
        ],
        "GROUNDED",
    )
    abstained = reason.isin(NO_EVIDENCE, NO_CITATIONS)
    return outputs.withColumns({"grounding_reason": F.when(abstained, reason), "grounding_status": F.when(abstained, "ABSTAINED").otherwise(reason)})


def deliver(responses: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Adds delivery_reason, delivery_status and delivered_text to responses.

    responses: safety_status, grounding_status, requested_language, answer, source_language, translation (null: no
    provider), translation_ok. Only a delivered response carries a text.
    """
    c = F.col
    none = c("requested_language").isNull() | (c("requested_language") == UNSPECIFIED)
    reason = first_match(
        [
            (~c("safety_status").eqNullSafe("SAFE_TO_PRESENT"), "SAFETY_NOT_SAFE_TO_PRESENT"),
            (~c("grounding_status").eqNullSafe("GROUNDED"), "GROUNDING_NOT_GROUNDED"),
            (~none & ~c("requested_language").isin(*languages), "UNSUPPORTED_LANGUAGE_REQUESTED"),
            (none, AS_IS),
            (c("requested_language") == c("source_language"), SAME_LANGUAGE),
            (c("translation").isNull(), "MISSING_TRANSLATION_PROVIDER"),
            (~c("translation_ok").eqNullSafe(True), "TRANSLATION_PROVIDER_FAILED"),
        ],
        "TRANSLATION_SUCCEEDED",
    )
    r = c("delivery_reason")
    status = first_match(
        [
            (r.isin("SAFETY_NOT_SAFE_TO_PRESENT", "GROUNDING_NOT_GROUNDED"), "UPSTREAM_BLOCKED"),
            (r == "UNSUPPORTED_LANGUAGE_REQUESTED", "UNSUPPORTED_LANGUAGE"),
            (r.isin("MISSING_TRANSLATION_PROVIDER", "TRANSLATION_PROVIDER_FAILED"), "TRANSLATION_FAILED"),
        ],
        "DELIVERED",
    )
    text = F.when(r.isin(AS_IS, SAME_LANGUAGE), c("answer")).when(r == "TRANSLATION_SUCCEEDED", c("translation"))
    return responses.withColumn("delivery_reason", reason).withColumns({"delivery_status": status, "delivered_text": text})
