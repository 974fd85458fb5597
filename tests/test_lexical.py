"""The best documents by BM25: what is shuffled, blocks of queries and of texts, ids that come twice."""

import pytest
from pyspark.sql import functions as F

from dossier.jobs import queries, record_queries
from dossier.operators import fusion, lexical

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ranks(df, score="score"):
    return {(r.query_id, r["rank"]): (r.doc_id, round(r[score], 12)) for r in df.collect()}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def test_no_text_and_no_posting_is_shuffled(texts, asked):
    found = plan(lexical.bm25_topk(asked, texts, 5))
    assert found.count("Exchange") == 1 and "Exchange hashpartitioning(setting" in found


def test_best_are_those_of_all_scores_in_blocks_and_pieces(spark, texts, asked, monkeypatch):
    settings = ((1.5, 0.75), (1.2, 0.0))
    scored = lexical.bm25_scores(asked, texts, settings=settings)
    wanted = [ranks(lexical.top_ranked(scored.where(f"score_{i} > 0"), 4, f"score_{i}", "doc_id"), f"score_{i}") for i in range(2)]
    monkeypatch.setattr(lexical, "BLOCK", 400)
    monkeypatch.setattr(lexical, "AT_ONCE", 3_000)
    found = lexical.bm25_best(asked, texts, 4, settings=settings)
    assert plan(found).count("MapInArrow") > 2  # several blocks
    assert [ranks(found.where(f"setting = {i}")) for i in range(2)] == wanted


def test_texts_of_one_id_count_together(spark):
    rows = [(1, "a b"), (1, "b c"), (1, "a a a"), (2, "b"), (None, "a"), (None, "c a b"), (3, ""), (3, None), (4, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a"), (2, "b a b"), (3, "c"), (3, "b"), (4, "")], "query_id long, query string")
    scored = lexical.bm25_scores(asked, docs).withColumnRenamed("score_0", "score")
    assert ranks(lexical.bm25_topk(asked, docs, 3)) == ranks(lexical.top_ranked(scored, 3, "score", "doc_id"))


def test_ties_and_ids_of_text(spark):
    docs = spark.createDataFrame([(f"{i:03d}", "same words") for i in range(60)] + [("x", "words")], "doc_id string, text string").repartition(3)
    asked = spark.createDataFrame([("q", "same"), ("r", "none")], "query_id string, query string")
    assert [r.doc_id for r in lexical.bm25_topk(asked, docs, 4).orderBy("rank").collect()] == ["000", "001", "002", "003"]
    assert lexical.bm25_topk(asked.limit(0), docs).count() == 0


@pytest.mark.parametrize("name", ["candidate_types", "construction_counts"])
def test_queries_score_the_documents_once(spark, name):
    """What is left to do when a query returns reads the written ranking; it was scored once, or twice, in the query's own plan."""
    found = plan(queries.QUERIES[name](spark, SF))
    assert "documents.parquet" not in found and "MapInArrow" not in found and "ArrowEvalPython" not in found


def test_reranking_shuffles_no_text_but_the_candidates(spark, texts, asked):
    ranked = lexical.bm25_topk(asked, texts, 5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # else the small tables of a test are sent whole anyway
    try:
        found = plan(fusion.overlap_rerank(ranked, asked, texts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    semi = [x for x in found.splitlines() if "LeftSemi" in x]
    assert semi and all("BroadcastHashJoin" in x for x in semi)


@pytest.mark.parametrize("made", [record_queries._retrieved, queries.pack_summary, queries.provenance_conflicts])
def test_evidence_is_made_of_the_ranked_documents_alone(spark, made):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = plan(made(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    semi = [x for x in found.splitlines() if "LeftSemi" in x]
    assert semi and all("BroadcastHashJoin" in x for x in semi) and "MapInArrow" not in found


def test_evaluation_shuffles_no_chunk_but_the_ranked(spark, monkeypatch):
    """Chunks were shuffled to their documents, and each posting of theirs before."""
    from dossier.jobs import refresh

    rows = [(f"c{i}", f"d{i % 3}", f"word{i} common") for i in range(9)]
    found = spark.createDataFrame(rows, "chunk_id string, document_id string, text string")
    queries = spark.createDataFrame([(1, "word4"), (2, "common")], "query_id long, query string")
    relevant = spark.createDataFrame([(1, "d1"), (2, "d0")], "query_id long, document_id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        made = refresh.evaluated(found, queries, relevant)
        plan = made._jdf.queryExecution().executedPlan().toString()
        one = made.first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    semi = [x for x in plan.splitlines() if "LeftSemi" in x]
    assert semi and all("BroadcastHashJoin" in x for x in semi) and "MapInArrow" not in plan
    assert (one.reciprocal_rank, one.recall_at_k) == (1.0, 1.0)
