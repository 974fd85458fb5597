"""Keyword classification of questions and the decision tree over its dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.ladders import all_matches, contains_any, first_match
from dossier.functions.text import is_blank

# Fixed values: (rule id, category, keywords) of each dimension, matched as substrings of lower-cased text.
TRACKS = (
    ("RT-01", "CLASSICAL_AYURVEDIC_DRUG", ("classical ayurvedic", "classical ayurveda")),
    ("RT-02", "PROPRIETARY_AYURVEDIC_DRUG", ("proprietary ayurvedic", "proprietary ayurveda")),
    ("RT-03", "NEW_AYURVEDIC_DRUG", ("new ayurvedic drug", "new ayurveda drug")),
    ("RT-04", "AYURVEDA_AAHARA_FOOD", ("ayurveda aahara", "ayurvedic aahara", "aahara", "ayurvedic food")),
    ("RT-05", "COSMETIC", ("cosmetic",)),
    ("RT-06", "PHYTOPHARMACEUTICAL", ("phytopharmaceutical", "phytopharma")),
)
IP_CATEGORIES = (
    ("IP-01", "PATENT", ("patent",)),
    ("IP-02", "TRADEMARK", ("trademark", "trade mark")),
    ("IP-03", "DESIGN", ("industrial design", "design registration", "design protection")),
    ("IP-04", "GEOGRAPHICAL_INDICATION", ("geographical indication", "gi tag", "gi registration")),
)
RELATIONS = (
    ("ATK-01", "TRADITIONAL_KNOWLEDGE_RELATED", ("traditional knowledge",)),
    ("ATK-02", "ACCESS_AND_BENEFIT_SHARING_RELATED", ("access and benefit sharing", "benefit sharing", "genetic resources")),
)
QUESTION_TYPES = (
    ("RQ-01", "INDIA_LEGISLATIVE", ("india code", "indian statute", "legislative")),
    ("RQ-02", "IP_REGISTRATION_AND_SEARCH", ("ip india", "patent office", "trademark registry", "patent registration", "trademark registration", "design registration", "gi registration")),
    ("RQ-03", "AYUSH_POLICY", ("ministry of ayush", "ayush ministry", "ayush policy")),
    ("RQ-04", "TRADITIONAL_DRUG_REGULATION", ("cdsco", "drugs and cosmetics", "traditional drug regulation")),
    ("RQ-05", "AYURVEDA_AAHARA_FOOD_LAW", ("fssai", "food safety")),
    ("RQ-06", "INTERNATIONAL_IP_TREATY", ("wipo", "wipo lex", "international treaty", "patent cooperation treaty")),
    ("RQ-07", "TRADITIONAL_KNOWLEDGE_DATABASE", ("tkdl", "traditional knowledge digital library")),
)
INTENTS = (
    ("UI-01", "DETERMINE_REGULATORY_CLASSIFICATION", ("regulatory category", "regulatory classification", "which category does", "what category does", "classify my formulation", "classify this formulation")),
    ("UI-02", "DETERMINE_IP_PROTECTION_PATHWAY", ("how can i protect", "ip protection", "protect this formulation", "patent this", "trademark this")),
    ("UI-03", "CHECK_COMPLIANCE_REQUIREMENT", ("compliance requirement", "what requirements apply", "what rules apply", "comply with")),
    ("UI-04", "LOOKUP_AUTHORITATIVE_SOURCE", ("what does the act say", "what does the rule say", "what does the regulation say", "look up the", "lookup the")),
)
INDIA, INTERNATIONAL = ("india", "indian"), ("international", "worldwide", "wipo")
NEED_EVIDENCE = ("DETERMINE_REGULATORY_CLASSIFICATION", "DETERMINE_IP_PROTECTION_PATHWAY", "CHECK_COMPLIANCE_REQUIREMENT", "LOOKUP_AUTHORITATIVE_SOURCE")

Table = tuple[tuple[str, str, tuple[str, ...]], ...]


def dimension(text: Column, table: Table, conflicting: str | None = None) -> tuple[Column, Column]:
    """(value, matched rule ids) of lower-cased text. Several matches are ``conflicting`` if that is a value, else undetermined."""
    ids = all_matches([(contains_any(text, words), rule) for rule, _, words in table])
    one = first_match([(contains_any(text, words), name) for _, name, words in table])
    return F.when(F.size(ids) == 1, one).when(F.size(ids) > 1, conflicting or "UNDETERMINED").otherwise("UNDETERMINED"), ids


def tree(intent: Column, track: Column, jurisdiction: Column, question: Column, evidence: Column) -> Column:
    """The rule R1 to R8 that decides."""
    needs = intent.isin(*NEED_EVIDENCE)
    known = question.isin(*(name for _, name, _ in QUESTION_TYPES))
    return first_match(
        [
            (intent == "UNDETERMINED", "R1"),
            (jurisdiction == "UNSPECIFIED", "R2"),
            (needs & (track == "UNDETERMINED"), "R3"),
            (track == "CONFLICTING", "R4"),
            (intent == "AMBIGUOUS_INTENT", "R5"),
            (question.isNull() | ~known, "R6"),
            (needs & ~evidence.eqNullSafe("SUFFICIENT_EVIDENCE"), "R7"),
        ],
        "R8",
    )


def state_of(rule: Column) -> Column:
    """Classification state of a tree rule."""
    return F.when(rule.isin("R1", "R2", "R3", "R6"), "UNKNOWN").when(rule.isin("R4", "R5"), "AMBIGUOUS").when(rule == "R7", "NEEDS_EVIDENCE").otherwise("KNOWN")


def classify(queries: DataFrame) -> DataFrame:
    """Adds the dimensions, the tree's rule and state, and ``basis`` (sorted rule ids) to queries (raw_query, description, evidence_state).

    Null query or description counts as empty; a null evidence state as NOT_EVALUATED.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("raw_query", F.lit("")), F.coalesce("description", F.lit(""))))
    rows = queries.withColumn("_text", text)
    t = F.col("_text")
    track, track_ids = dimension(t, TRACKS, "CONFLICTING")
    ip, ip_ids = dimension(t, IP_CATEGORIES)
    relation, relation_ids = dimension(t, RELATIONS)
    question, question_ids = dimension(t, QUESTION_TYPES)
    intent_ids = all_matches([(contains_any(t, words), rule) for rule, _, words in INTENTS])
    intent_name = first_match([(contains_any(t, words), name) for _, name, words in INTENTS])
    blank = is_blank(F.col("raw_query"))
    intent = F.when(F.size(intent_ids) > 1, "AMBIGUOUS_INTENT").when(F.size(intent_ids) == 1, intent_name).when(~blank, "GENERAL_INFORMATION_REQUEST").otherwise("UNDETERMINED")
    intent_basis = F.when((F.size(intent_ids) == 0) & ~blank, F.array(F.lit("UI-05"))).otherwise(intent_ids)
    here, abroad = contains_any(t, INDIA), contains_any(t, INTERNATIONAL)
    jurisdiction = F.when(here & abroad, "BOTH").when(here, "INDIA").when(abroad, "INTERNATIONAL").otherwise("UNSPECIFIED")
    jurisdiction_ids = all_matches([(here, "JX-01"), (abroad, "JX-02")])
    typed = rows.withColumns({"user_intent": intent, "regulatory_track": track, "ip_category": ip, "abs_tk_relation": relation, "question_type": question, "jurisdiction_input": jurisdiction, "_ids": F.concat(intent_basis, track_ids, ip_ids, relation_ids, question_ids, jurisdiction_ids)})
    rule = tree(F.col("user_intent"), F.col("regulatory_track"), F.col("jurisdiction_input"), F.col("question_type"), F.coalesce("evidence_state", F.lit("NOT_EVALUATED")))
    done = typed.withColumn("rule_id", rule).withColumn("classification_state", state_of(F.col("rule_id")))
    return done.withColumn("basis", F.array_sort(F.array_distinct(F.concat("_ids", F.array("rule_id"))))).drop("_text", "_ids")
