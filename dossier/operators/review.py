"""Review requests and what reviewers may do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.ladders import first_match
from dossier.functions.text import is_blank
from dossier.operators import records
from dossier.operators.safety import TRANSITIONS

#: What a case's snapshot holds where it is known.
SNAPSHOT = ("classification_state", "regulatory_track", "evidence_state", "jurisdiction_state", "grounding_status", "response_id", "pack_id", "n_references", "n_valid", "n_invalid", "n_unresolved", "safety_status", "band", "delivery_status", "requested_language", "synthetic")
#: Characters that a reviewer's comment may have.
MOST_COMMENT = 10_000
ACTIONS = tuple(dict.fromkeys(a for _, a, _ in TRANSITIONS))


def requests(cases: DataFrame) -> DataFrame:
    """A pending request for each case of safety.review_triggers() that fired, with its snapshot; other cases give no row.

    cases: input_id, query, and any of SNAPSHOT: what is missing is null in the snapshot, since it is unknown.
    """
    snapshot = F.struct(*((F.col(c) if c in cases.columns else F.lit(None).cast("string")).alias(c) for c in SNAPSHOT))
    fired = cases.where("requires_review")
    return fired.select(records.review_request_id().alias("review_request_id"), "input_id", "query", "trigger_reasons", "priority", F.lit("PENDING").alias("review_status"), snapshot.alias("snapshot"))


def check_actions(actions: DataFrame) -> DataFrame:
    """Adds ``action_problem`` to actions (reviewer, action, and comment if there): no reviewer, no known action, or a comment that is too long; null if none."""
    steps = [(is_blank(F.col("reviewer")), "REVIEWER_ID_MISSING"), (~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "UNKNOWN_ACTION")]
    if "comment" in actions.columns:
        steps.append((F.length("comment") > MOST_COMMENT, "COMMENT_TOO_LONG"))
    return actions.withColumn("action_problem", first_match(steps))


def fake_selections(selected: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``selected`` (pack_id, evidence_id) that the pack doesn't hold, compared exactly; a null pack holds none."""
    return selected.join(items.select("pack_id", "evidence_id").distinct(), ["pack_id", "evidence_id"], "left_anti")
