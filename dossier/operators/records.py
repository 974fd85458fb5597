"""Content-derived ids of answers, decisions, deliveries, reviews, requests and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.identity import digest, listed
from dossier.functions.ladders import first_match
from dossier.functions.text import is_blank
from dossier.operators.respond import LANGUAGES

VERSION = "1.0.0"
# How settings are written in ids; floats as Python prints them, so they are made on the driver.
JURISDICTION_CONFIG = f"jurisdiction-firewall-config:v{VERSION}"
SAFETY_CONFIG = f"safety-policy-config:v{VERSION}:require_citation=True:strong_count=2:strong_rate=1.0:moderate_rate=0.5"
DELIVERY_CONFIG = f"multilingual-config:v{VERSION}:languages={sorted(LANGUAGES)}"
REVIEW_CONFIG = f"human-review-config:v{VERSION}"
#: Characters that a question and its description may have.
MOST_CHARACTERS = 4_000


def bm25_config(k1: float = 1.5, b: float = 0.75) -> str:
    return f"bm25-config:v{VERSION}:k1={k1}:b={b}:tokenizer=v1"


def dense_config(index_type: str) -> str:
    return f"dense-index-config:v{VERSION}:type={index_type}"


def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def response_id() -> Column:
    """Of columns query, canonical_query, pack_id, provider_name, model_identifier, grounding_status, answer, cited_ids."""
    return digest("grounded-response-v1", VERSION, *_c("query", "canonical_query", "pack_id", "provider_name", "model_identifier", "grounding_status", "answer"), listed(F.col("cited_ids")))


def jurisdiction_decision_id() -> Column:
    """Of columns input_id, requested, normalized, state, reason_code, allowed."""
    return digest("jurisdiction-decision-v1", VERSION, *_c("input_id", "requested", "normalized", "state", "reason_code"), listed(F.array_sort("allowed")), JURISDICTION_CONFIG)


def python_text(value: Column, kind: str) -> Column:
    """A value as Python prints it: None for null, True and False. Floats are given as text already."""
    text = F.initcap(value.cast("string")) if kind == "boolean" else value.cast("string")
    return F.coalesce(text, F.lit("None"))


def safety_decision_id(summary: dict[str, Column]) -> Column:
    """Of columns input_id, safety_status, reason_code, band, and the statuses of ``summary`` (text), by name in order."""
    parts = F.concat_ws(",", *(F.concat(F.lit(f"{k}="), summary[k]) for k in sorted(summary)))
    return digest("safety-decision-v1", VERSION, *_c("input_id", "safety_status", "reason_code", "band"), parts, SAFETY_CONFIG)


def delivery_id() -> Column:
    """Of columns input_id, query, requested_language, delivery_status, delivery_reason, delivered_text."""
    return digest("multilingual-delivery-v1", VERSION, *_c("input_id", "query", "requested_language", "delivery_status", "delivery_reason", "delivered_text"), DELIVERY_CONFIG)


def review_request_id() -> Column:
    """Of columns input_id, query, trigger_reasons, priority."""
    return digest("human-review-request-v1", VERSION, *_c("input_id", "query"), listed(F.array_sort("trigger_reasons")), F.col("priority"), REVIEW_CONFIG)


def review_action_id() -> Column:
    """Of columns request_id, seq, reviewer, action, previous_status, new_status, comment, selected_ids."""
    return digest("human-review-action-v1", VERSION, *_c("request_id", "seq", "reviewer", "action", "previous_status", "new_status", "comment"), listed(F.col("selected_ids")), REVIEW_CONFIG)


def request_id() -> Column:
    """Of columns query, language, jurisdiction, description, source_language."""
    return digest("api-query-request-v1", *_c("query", "language", "jurisdiction", "description", "source_language"))


def request_problem(most: int = MOST_CHARACTERS) -> Column:
    """Why a request (query, description) isn't taken; null if it is."""
    return first_match([(is_blank(F.col("query")), "EMPTY_QUERY"), (F.length("query") > most, "QUERY_TOO_LONG"), (F.length("description") > most, "DESCRIPTION_TOO_LONG")])


def _shards(chunks: DataFrame, shard: str) -> DataFrame:
    """Per shard the chunk ids and content hashes in the order of ``position``. A shard is one index, bounded by whoever deals chunks to it."""
    gathered = chunks.groupBy(shard).agg(F.sort_array(F.collect_list(F.struct("position", "chunk_id", "content_hash"))).alias("_chunks"))
    return gathered.select(shard, F.size("_chunks").cast("long").alias("n_chunks"), *(listed(F.transform("_chunks", lambda x: x[k])).alias(f"_{k}") for k in ("chunk_id", "content_hash")))


def lexical_index_signatures(chunks: DataFrame, shard: str, config: str | None = None) -> DataFrame:
    """shard, n_chunks and index_signature of chunks (shard, position, chunk_id, content_hash)."""
    return _shards(chunks, shard).select(shard, "n_chunks", digest("bm25-index-v1", config or bm25_config(), *_c("_chunk_id", "_content_hash")).alias("index_signature"))


def dense_index_signatures(chunks: DataFrame, shard: str, model: str, dimension: int, normalize: bool, config: str) -> DataFrame:
    """As lexical_index_signatures(), of an index of vectors."""
    return _shards(chunks, shard).select(shard, "n_chunks", digest("dense-index-v1", model, str(dimension), str(normalize), config, *_c("_chunk_id", "_content_hash")).alias("index_signature"))


def index_problems(active: DataFrame, chunks: DataFrame, shard: str, config: str | None = None) -> DataFrame:
    """Shards of a stored index (shard, index_signature) whose chunks no longer give the signature: missing, unexpected or changed."""
    now = lexical_index_signatures(chunks, shard, config).select(shard, F.col("index_signature").alias("_now"))
    joined = active.select(shard, F.col("index_signature").alias("_then")).join(now, shard, "full_outer")
    problem = first_match([(F.col("_now").isNull(), "MISSING"), (F.col("_then").isNull(), "UNEXPECTED"), (F.col("_now") != F.col("_then"), "SIGNATURE_MISMATCH")])
    return joined.select(shard, problem.alias("problem")).where("problem IS NOT NULL")
