"""Evidence items and tamper-evident packs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import identity
from dossier.functions.ladders import first_match
from dossier.functions.text import is_blank
from dossier.operators.chunks import CONFIG as CHUNKING

# Version, and how the settings of a selection are written in ids.
SCHEMA = "1.0.0"


def signature(limit: int = 10, max_rank: int | None = None, min_score: float | None = None) -> str:
    return f"evidence-selection-config:v{SCHEMA}:max_items={limit}:max_rank={max_rank}:min_score={min_score}"


def evidence_items(chunks: DataFrame) -> DataFrame:
    """Adds text_hash and evidence_id to chunks (document_id, source_family_id, jurisdiction, text, block_ids, page_numbers).

    content_hash and chunk_id are kept where they come with the chunks; else the text is the whole document, and a chunk unsplit.
    """
    c = F.col
    named = chunks.withColumn("text_hash", F.sha2("text", 256))
    if "content_hash" not in chunks.columns:
        named = named.withColumn("content_hash", identity.content_hash(c("text")))
    if "chunk_id" not in chunks.columns:
        named = named.withColumn("chunk_id", identity.chunk_id(c("document_id"), c("content_hash"), CHUNKING, c("block_ids"), F.lit(0)))
    return named.withColumn("evidence_id", identity.evidence_id(SCHEMA, c("chunk_id"), c("content_hash"), c("document_id"), c("source_family_id"), c("jurisdiction"), c("block_ids"), c("page_numbers")))


def select_evidence(candidates: DataFrame, limit: int = 10, max_rank: int | None = None, min_score: float | None = None) -> DataFrame:
    """Evidence of each query: first occurrences by position, then rank and score filters, then the best ``limit`` by (rank, chunk_id).

    candidates: query_id, position, chunk_id, rank, and reranker_score, rrf_score, score (the first that isn't null counts).
    """
    primary = F.coalesce("reranker_score", "rrf_score", "score")
    once = candidates.withColumns({"primary_score": primary, "_n": F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("position"))}).where("_n = 1").drop("_n")
    kept = once if max_rank is None else once.where(F.col("rank") <= max_rank)
    kept = kept if min_score is None else kept.where(F.col("primary_score") >= min_score)
    return kept.withColumn("pack_order", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))).where(F.col("pack_order") <= limit)


def packs(selected: DataFrame, config: str | None = None) -> DataFrame:
    """query_id, pack_id, n_items, evidence_ids of each query's evidence (query_id, query, evidence_id, pack_order); ``limit`` items at most each."""
    gathered = selected.groupBy("query_id", "query").agg(F.sort_array(F.collect_list(F.struct("pack_order", "evidence_id"))).alias("items"))
    ids = F.transform("items", lambda x: x["evidence_id"])
    return gathered.select("query_id", identity.pack_id(SCHEMA, F.col("query"), ids, config or signature()).alias("pack_id"), F.size("items").cast("long").alias("n_items"), ids.alias("evidence_ids"))


def verify_items(items: DataFrame) -> DataFrame:
    """Adds ``intact``: text hash and evidence id still follow from the content."""
    c = F.col
    again = identity.evidence_id(SCHEMA, c("chunk_id"), c("content_hash"), c("document_id"), c("source_family_id"), c("jurisdiction"), c("block_ids"), c("page_numbers"))
    return items.withColumn("intact", F.sha2("text", 256).eqNullSafe(c("text_hash")) & again.eqNullSafe(c("evidence_id")))


def pack_validity(packs: DataFrame, items: DataFrame, versions: tuple[str, ...] = (SCHEMA,)) -> DataFrame:
    """Adds ``pack_problem`` (null if a pack may be trusted) to packs (pack_id, schema_version, query, config_signature).

    items: pack_id, pack_order, evidence_id, chunk_id; as many for a pack as a selection may hold. In order: a version
    that isn't supported, an evidence or a chunk that comes twice, a pack id that doesn't follow from the content.
    """
    gathered = items.groupBy("pack_id").agg(F.sort_array(F.collect_list(F.struct("pack_order", "evidence_id", "chunk_id"))).alias("_items"))
    joined = packs.join(gathered, "pack_id", "left").withColumn("_items", F.coalesce("_items", F.array().cast("array<struct<pack_order:int,evidence_id:string,chunk_id:string>>")))
    ids, chunks = (F.transform("_items", lambda x: x[k]) for k in ("evidence_id", "chunk_id"))
    repeated = lambda x: F.size(F.array_distinct(x)) < F.size(x)
    again = identity.digest("evidence-pack-v1", F.col("schema_version"), F.col("query"), identity.listed(ids), F.col("config_signature"))
    problem = first_match(
        [
            (~F.coalesce(F.col("schema_version").isin(*versions), F.lit(False)), "UNSUPPORTED_SCHEMA_VERSION"),
            (repeated(ids), "DUPLICATE_EVIDENCE_ID"),
            (repeated(chunks), "DUPLICATE_CHUNK_ID"),
            (~again.eqNullSafe(F.col("pack_id")), "PACK_ID_MISMATCH"),
        ]
    )
    return joined.withColumn("pack_problem", problem).drop("_items")


def pack_summary(items: DataFrame) -> DataFrame:
    """Per pack: items, distinct jurisdictions and source families in order, pages met, and whether any item is synthetic."""
    return items.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.array_sort(F.collect_set("jurisdiction")).alias("jurisdictions"),
        F.array_sort(F.collect_set("source_family_id")).alias("source_families"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("page_numbers")))).alias("page_numbers"),
        F.coalesce(F.bool_or("synthetic"), F.lit(False)).alias("synthetic"),
    )


def construction_counts(candidates: DataFrame, limit: int = 10, max_rank: int | None = None, min_score: float | None = None) -> DataFrame:
    """Per query: candidates given, those left after doubles go, and those a pack holds. Columns as for select_evidence()."""
    kept = select_evidence(candidates, limit, max_rank, min_score).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_selected"))
    given = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_distinct("chunk_id").alias("n_distinct"))
    return given.join(kept, "query_id", "left").withColumn("n_selected", F.coalesce("n_selected", F.lit(0)))


#: Candidate types and the scores that each of them has.
SCORES = {"BM25": ("score",), "DENSE": ("score",), "RRF": ("rrf_score", "bm25_rank", "bm25_score", "dense_rank", "dense_score"), "HYBRID": ("reranker_score", "rrf_rank", "rrf_score", "bm25_rank", "bm25_score", "dense_rank", "dense_score")}
ALL_SCORES = ("score", "reranker_score", "rrf_rank", "rrf_score", "bm25_rank", "bm25_score", "dense_rank", "dense_score")


def candidates(**by_type: DataFrame) -> DataFrame:
    """Rankings of several types (keys of SCORES) as one table: query_id, chunk_id, rank, retrieval_type and ALL_SCORES.

    A score that a type doesn't have, or that a ranking lacks, is null: unknown, never 0.
    """
    parts = []
    for kind, ranked in by_type.items():
        own = [F.col(c).cast("double").alias(c) if c in SCORES[kind] and c in ranked.columns else F.lit(None).cast("double").alias(c) for c in ALL_SCORES]
        parts.append(ranked.select("query_id", "chunk_id", "rank", F.lit(kind).alias("retrieval_type"), *own))
    return reduce(DataFrame.unionByName, parts)


def malformed_candidates(rows: DataFrame) -> DataFrame:
    """Adds ``problem`` to candidates (chunk_id, document_id, source_family_id, jurisdiction, content_hash, text, rank, score): the first field that is blank, or a rank or score out of range."""
    fields = ("chunk_id", "document_id", "source_family_id", "jurisdiction", "content_hash", "text")
    steps = [(is_blank(F.col(c)), f"MISSING_{c.upper()}") for c in fields]
    steps += [(F.col("rank").isNull() | (F.col("rank") < 1), "INVALID_RANK"), (F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")), "INVALID_SCORE")]
    return rows.withColumn("problem", first_match(steps))
