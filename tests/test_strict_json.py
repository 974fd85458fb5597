"""Canonical JSON against Python's, and strict reading of damaged lines."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from dossier.operators import strict_json as J

AWKWARD = ["", "plain", 'q"uote \\ back', "tab\tnew\nline\r\f\b", "\x00\x01\x1f\x7f", "ü é 漢字 😀  ", "/slash/", None]


def dumps(x):
    return json.dumps({"content": x}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def test_lines_are_as_python_prints_them(spark):
    rng = random.Random(3)
    numbers = [0.0, -0.0, 1.0, 0.1, 1e-5, 1e-4, 123456789.0, 1e15, 1e16, 1.7976931348623157e308, 5e-324, 2.2250738585072014e-308, None] + [rng.uniform(-1, 1) * 10 ** rng.randint(-25, 25) for _ in range(300)]
    rows = [(AWKWARD[i % len(AWKWARD)], x, i, i % 2 == 0, [AWKWARD[i % 7], None], {"b": "1", "a": None, "é": "x"}, (1, None)) for i, x in enumerate(numbers)]
    df = spark.createDataFrame(rows, "z string, a double, n long, f boolean, l array<string>, m map<string,string>, s struct<y:int,x:string>")
    got = [r.json for r in J.to_lines(df.select(F.struct("*").alias("record"), "n"), keep=("n",)).orderBy("n").collect()]
    want = [dumps({"z": z, "a": a, "n": n, "f": f, "l": li, "m": m, "s": {"y": s[0], "x": s[1]}}) for z, a, n, f, li, m, s in rows]
    assert got == want


@pytest.fixture(scope="module")
def item(spark):
    rows = spark.createDataFrame([("d1", "SF-01", "INDIA", 'Some "text".\nMore', ["d1:p1:b1"], [1, 2], 1, 2.5)], "document_id string, source_family_id string, jurisdiction string, text string, block_ids array<string>, page_numbers array<int>, pack_order int, score double")
    from dossier.operators import evidence

    found = evidence.evidence_items(rows)
    return json.loads(J.to_lines(found.withColumn("record", J.evidence_record(found))).first().json)["content"]


def read(spark, lines, kind):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, json string")
    return J.from_lines(df, kind).orderBy("i").collect()


def changed(item, **more):
    return {k: v for k, v in {**item, **more}.items() if v != "GONE"}


def test_evidence_read_strictly(spark, item):
    deep = lambda **x: changed(item, retrieval_metadata={**item["retrieval_metadata"], **x})
    cases = [
        (item, None),
        (changed(item, extra=[1]), None),
        (deep(bm25_score=3), None),
        (changed(item, section_heading_text="GONE"), None),
        (changed(item, evidence_text="Other"), "TEXT_HASH_MISMATCH"),
        (changed(item, evidence_text="  "), "INVALID_VALUE evidence_text"),
        (changed(item, evidence_text=None), "WRONG_TYPE evidence_text"),
        (changed(item, evidence_text=5), "WRONG_TYPE evidence_text"),
        (changed(item, evidence_text_hash="ab"), "INVALID_VALUE evidence_text_hash"),
        (changed(item, jurisdiction="INTERNATIONAL"), "IDENTITY_MISMATCH"),
        (changed(item, page_numbers=[2, 1]), "IDENTITY_MISMATCH"),
        (changed(item, page_numbers=[]), "INVALID_VALUE page_numbers"),
        (changed(item, page_numbers=[1, "2"]), "WRONG_TYPE page_numbers"),
        (changed(item, page_numbers=[1.5]), "WRONG_TYPE page_numbers"),
        (changed(item, page_numbers=[None, 1]), "WRONG_TYPE page_numbers"),
        (changed(item, block_ids="d1:p1:b1"), "WRONG_TYPE block_ids"),
        (changed(item, synthetic=0), "WRONG_TYPE synthetic"),
        (changed(item, evidence_type="PAGE"), "INVALID_VALUE evidence_type"),
        (changed(item, chunk_id="GONE"), "MISSING_FIELD chunk_id"),
        (changed(item, retrieval_metadata=[]), "WRONG_TYPE retrieval_metadata"),
        (deep(rank=0), "INVALID_VALUE retrieval_metadata.rank"),
        (deep(rank="1"), "WRONG_TYPE retrieval_metadata.rank"),
        (deep(bm25_score="2.5"), "WRONG_TYPE retrieval_metadata.bm25_score"),
        (changed(item, version_info={"version_known": None}), None),
        ([item], "WRONG_TYPE content"),
        (None, "WRONG_TYPE content"),
    ]
    lines = [dumps(c) for c, _ in cases] + ["", "{", "[]", '{"other":1}', None, dumps(item)[:-1] + ',"content":{}}', dumps(item).replace('"synthetic":false', '"synthetic":NaN')]
    want = [p for _, p in cases] + ["MALFORMED_JSON", "MALFORMED_JSON", "MISSING_FIELD content", "MISSING_FIELD content", "MALFORMED_JSON", "MALFORMED_JSON", "MALFORMED_JSON"]
    rows = read(spark, lines, "evidence")
    assert [r.problem for r in rows] == want
    assert all((r.record is None) == (r.problem is not None) for r in rows)
    assert rows[0].record.page_numbers == [1, 2] and rows[2].record.retrieval_metadata.bm25_score == 3.0


def test_packs_read_strictly(spark, item):
    import hashlib

    def pack(items, query="q", **more):
        parts = ["evidence-pack-v1", "1.0.0", query, ",".join(i["evidence_id"] for i in items), "cfg"]
        return {"pack_id": hashlib.sha256("|".join(parts).encode()).hexdigest(), "schema_version": "1.0.0", "query": query, "evidence_items": items, "construction_metadata": {"config_signature": "cfg"}, **more}

    cases = [
        (pack([item]), None),
        (pack([]), None),
        (pack([item], query=""), None),
        (pack([item, item]), "DUPLICATE_EVIDENCE_ID"),
        (pack([item], pack_id="x"), "IDENTITY_MISMATCH"),
        (pack([changed(item, evidence_text="Other")]), "TEXT_HASH_MISMATCH"),
        (pack([item, changed(item, chunk_id=7)]), "WRONG_TYPE evidence_items[].chunk_id"),
        (pack([item], evidence_items=[item, 3]), "WRONG_TYPE evidence_items[]"),
        (pack([item], evidence_items={}), "WRONG_TYPE evidence_items"),
        (pack([item], construction_metadata={}), "MISSING_FIELD construction_metadata.config_signature"),
    ]
    assert [r.problem for r in read(spark, [dumps(c) for c, _ in cases], "evidence_pack")] == [p for _, p in cases]


def test_decisions_actions_and_reports_read_strictly(spark):
    import hashlib

    sha = lambda *parts: hashlib.sha256("|".join(parts).encode()).hexdigest()
    safety = {"schema_version": "1.0.0", "input_id": "i", "safety_status": "ABSTAIN", "reason_code": "R", "explanation": "", "engineering_signal_band": "WEAK", "hard_gate_results": [], "input_status_summary": {"b": "2", "a": None}, "abstained": True, "escalation_required": False, "synthetic": False, "config_signature": "c"}
    safety["decision_id"] = sha("safety-decision-v1", "1.0.0", "i", "ABSTAIN", "R", "WEAK", "a=None,b=2", "c")
    action = {"schema_version": "1.0.0", "review_request_id": "r", "sequence_number": 1, "reviewer_id": "me", "action": "APPROVE", "previous_status": "PENDING", "new_status": "APPROVED", "reviewer_comment": None, "selected_evidence_ids": ["e1"], "metadata": {}, "config_signature": "c"}
    action["review_action_id"] = sha("human-review-action-v1", action["schema_version"], "r", "1", "me", "APPROVE", "PENDING", "APPROVED", "", "e1", "c")
    assert [r.problem for r in read(spark, [dumps(x) for x in (safety, {**safety, "safety_status": "X"}, {**safety, "input_status_summary": []}, {**safety, "hard_gate_results": [1]})], "safety_decision")] == [None, "IDENTITY_MISMATCH", "WRONG_TYPE input_status_summary", "WRONG_TYPE hard_gate_results"]
    assert [r.problem for r in read(spark, [dumps(x) for x in (action, {**action, "sequence_number": 0}, {**action, "reviewer_comment": "new"}, {k: v for k, v in action.items() if k != "metadata"})], "review_action")] == [None, "INVALID_VALUE sequence_number", "IDENTITY_MISMATCH", "MISSING_FIELD metadata"]
    result = {"schema_version": "1.0.0", "metric_name": "M", "component": "C", "applicable": False, "value": None, "numerator": None, "denominator": None, "explanation": "", "ground_truth_origin": None}
    report = {"schema_version": "1.0.0", "component": "C", "case_count": 2, "results": [result], "passed_case_ids": ["b"], "failed_case_ids": ["a"], "notes": "", "config_signature": "c", "report_id": sha("evaluation-report-v1", "1.0.0", "C", "a,b", "c")}
    assert [r.problem for r in read(spark, [dumps(x) for x in (report, {**report, "case_count": 1}, {**report, "results": [{**result, "value": "1"}]}, {**report, "results": [{**result, "component": "D"}]})], "component_report")] == [None, "COUNT_MISMATCH", "WRONG_TYPE results[].value", "OTHER_COMPONENT"]
    assert [r.problem for r in read(spark, ['{"content":{"schema_version":"1","evidence_id":"e"}}', '{"content":{"evidence_id":"e"}}'], "citation_reference")] == [None, "MISSING_FIELD schema_version"]


def test_numbers_that_are_not_finite(spark):
    df = spark.createDataFrame([(x,) for x in (math.nan, math.inf, -math.inf)], "a double").select(F.struct("a").alias("record"))
    assert [r.json for r in J.to_lines(df).collect()] == [dumps({"a": x}) for x in (math.nan, math.inf, -math.inf)]
