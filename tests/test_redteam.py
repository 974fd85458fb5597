"""Red-team cases: none comes through, and each way of telling does tell once a defence is taken away."""

import pytest
from pyspark.sql import functions as F

from dossier.jobs import redteam
from dossier.operators import citation, evidence, jurisdiction, review, safety


@pytest.fixture(scope="module")
def attacked(spark):
    questions = spark.createDataFrame([(1, "How is a mark kept?", "at the patent office of India"), (2, None, None), (3, "What of it?", None)], "query_id long, raw_query string, description string")
    questions = questions.withColumns({"evidence_state": F.lit("SUFFICIENT_EVIDENCE"), "explicit": F.lit("INDIA"), "requested_language": F.lit("UNSPECIFIED"), "source_language": F.lit("en")})
    chunks = spark.createDataFrame([(q, n, f"Text {n} of {q}.", f"d{q}{n}") for q in (1, 2) for n in (1, 2)], "query_id long, pack_order int, text string, document_id string")
    chunks = chunks.withColumns({"source_family_id": F.lit("SF-01"), "jurisdiction": F.lit("INDIA"), "block_ids": F.array(F.lit("b1")), "page_numbers": F.array(F.lit(1))})
    return questions, evidence.evidence_items(chunks).join(questions.select("query_id", F.coalesce("raw_query", F.lit("")).alias("query")), "query_id")


def came_through(rows):
    return {r.case_id for r in rows.where("succeeded").select("case_id").distinct().collect()}


def test_no_case_comes_through(attacked):
    found = {r.case_id: r for r in redteam.results(redteam.attempts(*attacked)).collect()}
    assert len(found) == 36 and all(r.n_successes == 0 for r in found.values())
    assert {k for k, r in found.items() if r.attack_success is None} == {"P19-06"}  # no browser here
    assert {r.n_attempts for k, r in found.items() if k in ("P19-07", *redteam.BY_RECORD)} == {3}
    assert {r.n_attempts for k, r in found.items() if k not in ("P19-06", "P19-07", *redteam.BY_RECORD)} == {2}  # question 3 has no evidence


def test_a_case_that_was_not_tried_is_no_defence(spark):
    tried = spark.createDataFrame([("RT-03", "1", True), ("RT-03", "2", False), ("RT-07", "1", False)], "case_id string, query_id string, succeeded boolean")
    found = redteam.results(tried)
    assert {(r.case_id, r.attack_success, r.n_successes) for r in found.where("n_attempts > 0").collect()} == {("RT-03", True, 1), ("RT-07", False, 0)}
    one = redteam.summary(found, ()).first()
    assert (one.n_cases, one.n_blocked, one.success_rate) == (2, 1, 0.5)


def test_citations_that_are_not_checked(attacked, monkeypatch):
    monkeypatch.setattr(citation, "validate", lambda refs, items: refs.withColumns({"status": F.lit("VALID"), "reason_code": F.lit(None).cast("string"), "is_duplicate": F.lit(False)}))
    assert {"RT-02", "RT-03", "RT-05", "RT-06", "P19-04", "P19-11"} <= came_through(redteam.through_answers(*attacked))


def test_gates_that_read_answers(attacked, monkeypatch):
    """Gates that believe what the provider or the question says."""
    gates = safety.gates

    def naive(cases):
        done = gates(cases)
        told = F.coalesce(F.col("answer").contains("SAFE_TO_PRESENT") | F.col("raw_query").contains("SAFE_TO_PRESENT"), F.lit(False))
        return done.withColumn("safety_status", F.when(told, "SAFE_TO_PRESENT").otherwise(F.col("safety_status")))

    monkeypatch.setattr(safety, "gates", naive)
    assert {"RT-10", "RT-15", "P19-01"} <= came_through(redteam.through_answers(*attacked))


def test_evidence_that_is_not_filtered(attacked, monkeypatch):
    monkeypatch.setattr(jurisdiction, "filter_evidence", lambda rows, decided, by: rows.withColumn("allowed_here", F.lit(True)))
    assert came_through(redteam.through_jurisdictions(attacked[1])) == {"RT-07", "P19-03", "P19-13"}
    monkeypatch.setattr(jurisdiction, "filter_evidence", lambda rows, decided, by: rows.withColumn("allowed_here", F.lit(False)))
    assert came_through(redteam.through_jurisdictions(attacked[1])) == {"RT-07", "P19-13"}  # what is permitted must stay


def test_reviews_that_are_not_checked(attacked, monkeypatch):
    monkeypatch.setattr(review, "fake_selections", lambda chosen, own: chosen.where("false"))
    assert came_through(redteam.through_selections(attacked[1])) == {"RT-04"}
    monkeypatch.setattr(safety, "check_history", lambda rows: rows.withColumn("problem", F.lit(None).cast("string")))
    assert came_through(redteam.through_records(attacked[0])) == {"RT-12", "P19-05"}
