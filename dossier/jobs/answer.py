"""The whole question-answering job: many questions against a corpus at once, with a provider's answers given as a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import text
from dossier.operators import citation, classify, evidence, jurisdiction, lexical, respond, safety


def retrieve(questions: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """Evidence of each question (query_id, raw_query): ranked chunks with ids, in pack order.

    corpus: chunk_key, text, document_id, source_family_id, jurisdiction, block_ids, page_numbers.
    """
    ranked = lexical.bm25_topk(questions.select("query_id", F.col("raw_query").alias("query")), corpus, k, "chunk_key")
    items = evidence.evidence_items(corpus)
    return ranked.withColumnRenamed("rank", "pack_order").join(items, "chunk_key").join(questions.select("query_id", F.col("raw_query").alias("query")), "query_id")


def decide(questions: DataFrame, found: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row per question: classification, jurisdiction, grounding, safety, delivery and review.

    questions: query_id, raw_query, description, evidence_state, explicit, requested_language, source_language.
    outputs: query_id, success, answer, translation, translation_ok; made once and written by the caller, since a
    provider's calls must not be repeated when Spark reads a table again.
    """
    sorted_out = jurisdiction.resolve(classify.classify(questions).withColumn("classified", F.col("jurisdiction_input"))).withColumnsRenamed({"state": "jurisdiction_state", "reason_code": "jurisdiction_reason"})
    packs = evidence.packs(found).select("query_id", "pack_id", F.col("n_items").alias("n_evidence"))
    asked = found.select("query_id", "query").distinct()
    named = packs.join(asked, "query_id").select("query_id", "pack_id", F.lit(evidence.SCHEMA).alias("schema_version"), "query", F.lit(evidence.signature()).alias("config_signature"))
    items = found.join(packs.select("query_id", "pack_id"), "query_id")
    trusted = evidence.pack_validity(named, items).select("query_id", F.col("pack_problem").isNull().alias("pack_valid"))
    blank = [text.is_blank(F.col(c)) for c in ("document_id", "source_family_id", "jurisdiction", "content_hash", "chunk_id")]
    formed = ~reduce(lambda a, b: a | b, blank) & (F.size("block_ids") > 0) & (F.size("page_numbers") > 0)
    own = evidence.verify_items(found).join(trusted, "query_id").select(F.col("query_id").alias("pack_id"), "evidence_id", "intact", formed.alias("well_formed"), "pack_valid")
    markers = citation.extract(outputs.select(F.col("query_id").alias("answer_id"), F.col("query_id").alias("pack_id"), "answer"))
    cited = citation.coverage(citation.validate(markers, own)).select(F.col("answer_id").alias("query_id"), F.col("n_unique_valid").alias("n_valid"), "integrity_rate", (F.col("n_invalid") + F.col("n_unresolved")).alias("n_failing_citations"))
    joined = sorted_out.join(packs, "query_id", "left").join(trusted, "query_id", "left").join(outputs, "query_id", "left").join(cited, "query_id", "left")
    gated = safety.gates(respond.ground(joined))
    return safety.review_triggers(respond.deliver(gated))
