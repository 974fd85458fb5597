"""Presentation safety: nine ordered gates, a signal band, review triggers and review histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions.ladders import all_matches, first_match

# gates' reasons and statuses, triggers with priorities, and the transitions of a review.
GATES = (
    ("CLASSIFICATION_AMBIGUOUS", "ESCALATE"),
    ("CLASSIFICATION_UNRESOLVED", "ABSTAIN"),
    ("JURISDICTION_AMBIGUOUS", "ESCALATE"),
    ("JURISDICTION_UNRESOLVED", "ABSTAIN"),
    ("MISSING_GROUNDED_RESPONSE", "ABSTAIN"),
    ("GENERATION_FAILED", "ABSTAIN"),
    ("GENERATION_ABSTAINED", "ABSTAIN"),
    ("NO_VALID_CITATIONS", "ABSTAIN"),
    ("SAFE_GROUNDED_RESPONSE", "SAFE_TO_PRESENT"),
)
PRIORITIES = ("NORMAL", "HIGH", "CRITICAL")
TRIGGERS = {
    "SAFETY_ESCALATE": "CRITICAL",
    "SAFETY_ABSTAIN": "HIGH",
    "CLASSIFICATION_AMBIGUOUS": "HIGH",
    "CLASSIFICATION_UNRESOLVED": "NORMAL",
    "CLASSIFICATION_NEEDS_EVIDENCE": "NORMAL",
    "REGULATORY_TRACK_CONFLICTING": "HIGH",
    "JURISDICTION_AMBIGUOUS": "HIGH",
    "JURISDICTION_UNRESOLVED": "NORMAL",
    "CITATION_INTEGRITY_FAILURE": "HIGH",
    "GROUNDING_FAILURE": "HIGH",
    "MULTILINGUAL_DELIVERY_ISSUE": "NORMAL",
}
TRANSITIONS = (
    ("PENDING", "START_REVIEW", "IN_REVIEW"),
    ("PENDING", "APPROVE", "APPROVED"),
    ("PENDING", "REJECT", "REJECTED"),
    ("PENDING", "REQUEST_MORE_EVIDENCE", "NEEDS_MORE_EVIDENCE"),
    ("PENDING", "ESCALATE", "ESCALATED"),
    ("IN_REVIEW", "APPROVE", "APPROVED"),
    ("IN_REVIEW", "REJECT", "REJECTED"),
    ("IN_REVIEW", "REQUEST_MORE_EVIDENCE", "NEEDS_MORE_EVIDENCE"),
    ("IN_REVIEW", "ESCALATE", "ESCALATED"),
)


def signal_band(n_valid: Column, rate: Column) -> Column:
    return F.when((n_valid >= 2) & (rate >= 1.0), "STRONG").when((n_valid >= 1) & (rate >= 0.5), "MODERATE").otherwise("WEAK")


def gates(cases: DataFrame) -> DataFrame:
    """Adds reason_code, safety_status, band and gate_log to cases.

    cases: classification_state, jurisdiction_state, grounding_status (null: not supplied), n_valid (distinct valid
    citations), integrity_rate. The first gate that fires decides.
    """
    c = F.col
    fired = [
        c("classification_state") == "AMBIGUOUS",
        c("classification_state").isNull() | (c("classification_state") == "UNKNOWN"),
        c("jurisdiction_state") == "AMBIGUOUS",
        c("jurisdiction_state").isNull() | (c("jurisdiction_state") == "UNKNOWN"),
        c("grounding_status").isNull(),
        c("grounding_status") == "GENERATION_FAILED",
        c("grounding_status") == "ABSTAINED",
        F.coalesce(c("n_valid"), F.lit(0)) == 0,
        F.lit(True),
    ]
    gate = first_match([(x, str(i)) for i, x in enumerate(fired, 1)]).cast("int")
    numbered = cases.withColumn("_gate", gate)
    reasons, statuses = (F.array(*(F.lit(g[k]) for g in GATES)) for k in (0, 1))
    passes = F.transform(F.when(c("_gate") > 1, F.sequence(F.lit(1), c("_gate") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("G"), i.cast("string"), F.lit(":PASS")))
    return numbered.select(
        *cases.columns,
        F.element_at(reasons, c("_gate")).alias("reason_code"),
        F.element_at(statuses, c("_gate")).alias("safety_status"),
        F.when(c("_gate") == len(GATES), signal_band(c("n_valid"), c("integrity_rate"))).otherwise("NOT_APPLICABLE").alias("band"),
        F.concat(passes, F.array(F.concat(F.lit("G"), c("_gate").cast("string"), F.lit(":FIRED")))).alias("gate_log"),
    )


def review_triggers(cases: DataFrame) -> DataFrame:
    """Adds trigger_reasons (all that hold, in a fixed order), requires_review and priority (the highest).

    cases: safety_status, classification_state, regulatory_track, jurisdiction_state, n_failing_citations,
    grounding_status, delivery_status; null where a signal was not supplied.
    """
    c = F.col
    reasons = all_matches(
        [
            (c("safety_status") == "ESCALATE", "SAFETY_ESCALATE"),
            (c("safety_status") == "ABSTAIN", "SAFETY_ABSTAIN"),
            (c("classification_state") == "AMBIGUOUS", "CLASSIFICATION_AMBIGUOUS"),
            (c("classification_state") == "UNKNOWN", "CLASSIFICATION_UNRESOLVED"),
            (c("classification_state") == "NEEDS_EVIDENCE", "CLASSIFICATION_NEEDS_EVIDENCE"),
            (c("regulatory_track") == "CONFLICTING", "REGULATORY_TRACK_CONFLICTING"),
            (c("jurisdiction_state") == "AMBIGUOUS", "JURISDICTION_AMBIGUOUS"),
            (c("jurisdiction_state") == "UNKNOWN", "JURISDICTION_UNRESOLVED"),
            (c("n_failing_citations") > 0, "CITATION_INTEGRITY_FAILURE"),
            (c("grounding_status") != "GROUNDED", "GROUNDING_FAILURE"),
            (c("delivery_status").isin("TRANSLATION_FAILED", "UNSUPPORTED_LANGUAGE"), "MULTILINGUAL_DELIVERY_ISSUE"),
        ]
    )
    level = F.create_map(*(x for k, p in TRIGGERS.items() for x in (F.lit(k), F.lit(PRIORITIES.index(p)))))
    top = F.array_max(F.transform("trigger_reasons", lambda r: level[r]))
    done = cases.withColumn("trigger_reasons", reasons)
    return done.withColumns({"requires_review": F.size("trigger_reasons") > 0, "priority": F.when(F.size("trigger_reasons") == 0, "NOT_APPLICABLE").otherwise(F.element_at(F.array(*map(F.lit, PRIORITIES)), top + 1))})


def authorization(cases: DataFrame) -> DataFrame:
    """Adds ``presentation``: SAFE_TO_PRESENT goes out by itself, else an approving review action is needed (safety_status, action)."""
    return cases.withColumn("presentation", F.when(F.col("safety_status") == "SAFE_TO_PRESENT", "AUTOMATED").when(F.col("action") == "APPROVE", "HUMAN_APPROVED").otherwise("BLOCKED"))


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRANSITIONS), "previous_status string, action string, expected_status string")


def check_history(actions: DataFrame) -> DataFrame:
    """Adds ``problem`` to review actions (request_id, seq, action, previous_status, new_status); null if the action is sound.

    A request's actions count from 0 without a gap, each starts from the status before (PENDING at first), and the
    transition must be one of the table.
    """
    order = Window.partitionBy("request_id").orderBy("seq")
    table = F.broadcast(transitions(actions.sparkSession))  # a fixed short list
    rows = actions.withColumns({"_n": F.row_number().over(order) - 1, "_before": F.coalesce(F.lag("new_status").over(order), F.lit("PENDING"))}).join(table, ["previous_status", "action"], "left")
    problem = first_match([(F.col("seq") != F.col("_n"), "SEQUENCE_GAP"), (~F.col("previous_status").eqNullSafe(F.col("_before")), "BROKEN_CHAIN"), (~F.col("expected_status").eqNullSafe(F.col("new_status")), "ILLEGAL_TRANSITION")])
    return rows.withColumn("problem", problem).drop("_n", "_before", "expected_status")


def current_status(actions: DataFrame) -> DataFrame:
    """The last status of each request."""
    return actions.groupBy("request_id").agg(F.max_by("new_status", "seq").alias("status"), F.count(F.lit(1)).alias("n_actions"))
