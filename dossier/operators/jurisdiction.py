"""Jurisdiction decisions from up to two signals, and the filtering of evidence by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from dossier.functions.ladders import first_match
from dossier.functions.text import is_blank, stripped
from dossier.operators.admission import EVIDENCE_JURISDICTIONS

# Request jurisdictions, and the evidence that each permits.
PERMITTED = {"INDIA": ("INDIA",), "INTERNATIONAL": ("INTERNATIONAL",), "BOTH": ("INDIA", "INTERNATIONAL"), "UNSPECIFIED": ()}


def requested(raw: Column) -> Column:
    """A request jurisdiction, or null."""
    name = F.upper(stripped(raw))
    return F.when(name.isin(*PERMITTED), name)


def permitted(name: Column) -> Column:
    """The evidence jurisdictions that a decision permits; none for null."""
    out = F.array().cast("array<string>")
    for key, allowed in PERMITTED.items():
        if allowed:
            out = F.when(name == key, F.array(*map(F.lit, allowed))).otherwise(out)
    return out


def resolve(inputs: DataFrame) -> DataFrame:
    """Adds state, reason_code, normalized, allowed and blocked to inputs (explicit, classified): two signals, null if not given.

    Where explicit is a VARIANT, as untrusted requests bring it, one that is no text is invalid metadata: the jurisdiction is
    unknown whatever the other signal says, and nothing is guessed. It becomes a text column, null there.
    """
    invalid = F.lit(False)
    if isinstance(inputs.schema["explicit"].dataType, VariantType):
        invalid = F.coalesce(~F.schema_of_variant("explicit").isin("STRING", "VOID"), F.lit(False))
        inputs = inputs.withColumns({"_invalid": invalid, "explicit": F.when(F.schema_of_variant("explicit") == "STRING", F.try_variant_get("explicit", "$", "string"))})
        invalid = F.col("_invalid")
    a, b = requested(F.col("explicit")), requested(F.col("classified"))
    real = lambda x: F.coalesce(x != "UNSPECIFIED", F.lit(False))
    odd = lambda c: F.coalesce(~is_blank(F.col(c)) & (F.upper(stripped(F.col(c))) != "UNSPECIFIED"), F.lit(False))
    clash = real(a) & real(b) & (a != b)
    one = F.when(~clash, F.when(real(a), a).when(real(b), b))
    one = F.when(~invalid, one)
    state = F.when(invalid, "UNKNOWN").when(clash, "AMBIGUOUS").when(one.isNotNull(), "KNOWN").otherwise("UNKNOWN")
    reason = first_match([(invalid, "JURISDICTION_METADATA_INVALID"), (clash, "JURISDICTION_AMBIGUOUS"), (one.isNotNull(), "EXPLICIT_JURISDICTION_ACCEPTED"), (odd("explicit") | odd("classified"), "JURISDICTION_NOT_SUPPORTED")], "JURISDICTION_UNKNOWN")
    done = inputs.withColumns({"state": state, "reason_code": reason, "normalized": one}).drop("_invalid")
    universe = F.array(*map(F.lit, EVIDENCE_JURISDICTIONS))
    return done.withColumn("allowed", permitted(F.col("normalized"))).withColumn("blocked", F.array_except(universe, "allowed"))


def block_reason(evidence_jurisdiction: Column, state: Column, allowed: Column) -> Column:
    """Why a piece of evidence is blocked; null if it is allowed."""
    known = F.coalesce(evidence_jurisdiction.isin(*EVIDENCE_JURISDICTIONS), F.lit(False))
    return first_match([(~known, "JURISDICTION_METADATA_INVALID"), (state != "KNOWN", "CORPUS_NOT_PERMITTED"), (~F.array_contains(allowed, evidence_jurisdiction), "CROSS_JURISDICTION_EVIDENCE_BLOCKED")])


def filter_evidence(evidence: DataFrame, decisions: DataFrame, by: str) -> DataFrame:
    """Evidence (by, jurisdiction) with its decision's block_reason and ``allowed_here``; evidence without a decision is not permitted."""
    joined = evidence.join(decisions.select(by, "state", "allowed"), by, "left")
    return joined.withColumn("block_reason", block_reason(F.col("jurisdiction"), F.coalesce("state", F.lit("UNKNOWN")), F.col("allowed"))).withColumn("allowed_here", F.col("block_reason").isNull()).drop("state", "allowed")


def leakage_rate(filtered: DataFrame) -> DataFrame:
    """Share of allowed evidence from outside the permitted jurisdictions: filtered needs ``expected`` (should be allowed)."""
    n, leaks = F.count_if("allowed_here"), F.count_if(F.col("allowed_here") & ~F.col("expected"))
    return filtered.agg(n.alias("n_allowed"), leaks.alias("n_leaks"), F.try_divide(leaks, n).alias("leakage_rate"))
