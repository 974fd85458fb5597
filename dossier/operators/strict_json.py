"""Records as canonical JSON, and read back strictly: what is malformed, of another type or no longer matches its ids is told apart.

A line is ``{"content":{...}}`` with sorted keys and no white space; characters beyond ASCII stay. Reading goes through
VARIANT, so that a number is never taken for a text: every field must be there, with its type, and ids and hashes must
follow from the content anew. Lines that fail come out as rows with the first problem, never repaired, never dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions import identity
from dossier.functions.ladders import first_match
from dossier.functions.text import is_blank, number
from dossier.operators import evidence, records, reports, review

#: A record's fields by name. Kinds: text (not blank), string, hash (SHA-256 in hex), long, count (0 or more), place (1 or
#: more), double, boolean, texts and longs (lists), map (texts by name), a dict (a record) and a list of one dict (a list
#: of records). ``?``: may be null; ``~``: may also be absent.
Fields = dict[str, object]

RETRIEVAL: Fields = {"rank": "place", "bm25_rank": "place~", "bm25_score": "double~", "dense_rank": "place~", "dense_score": "double~", "dense_model_identity": "string~", "rrf_score": "double~", "reranker_score": "double~", "reranker_model_identity": "string~"}
VERSION: Fields = {"version_known": "boolean~", "effective_date_known": "boolean~", "publication_date": "string~", "supersession_status": "string~"}
EVIDENCE: Fields = {
    "evidence_id": "text", "evidence_schema_version": "text", "evidence_type": "text", "evidence_text": "text", "evidence_text_hash": "hash",
    "chunk_id": "text", "document_id": "text", "source_family_id": "text", "jurisdiction": "text", "content_hash": "hash", "synthetic": "boolean",
    "page_numbers": "longs", "block_ids": "texts", "retrieval_metadata": RETRIEVAL, "version_info": VERSION, "section_heading_text": "string~", "section_heading_level": "long~",
}
PACK: Fields = {"pack_id": "text", "schema_version": "text", "query": "string", "evidence_items": [EVIDENCE], "construction_metadata": {"config_signature": "text"}}
JURISDICTION: Fields = {
    "schema_version": "text", "decision_id": "text", "input_id": "text", "requested_jurisdiction": "string?", "normalized_jurisdiction": "string?", "state": "text", "reason_code": "text",
    "explanation": "string", "allowed_jurisdictions": "texts", "blocked_jurisdictions": "texts", "requires_evidence": "boolean", "requires_escalation": "boolean", "config_signature": "text",
}
SAFETY: Fields = {
    "schema_version": "text", "decision_id": "text", "input_id": "text", "safety_status": "text", "reason_code": "text", "explanation": "string", "engineering_signal_band": "text",
    "hard_gate_results": "texts", "input_status_summary": "map", "abstained": "boolean", "escalation_required": "boolean", "synthetic": "boolean", "config_signature": "text",
}
ACTION: Fields = {
    "schema_version": "text", "review_action_id": "text", "review_request_id": "text", "sequence_number": "place", "reviewer_id": "text", "action": "text", "previous_status": "text",
    "new_status": "text", "reviewer_comment": "string?", "selected_evidence_ids": "texts", "metadata": "map", "config_signature": "text",
}
RESULT: Fields = {"schema_version": "text", "metric_name": "text", "component": "text", "applicable": "boolean", "value": "double?", "numerator": "double?", "denominator": "count?", "explanation": "string", "ground_truth_origin": "string?"}
REPORT: Fields = {"schema_version": "text", "report_id": "text", "component": "text", "case_count": "count", "results": [RESULT], "passed_case_ids": "texts", "failed_case_ids": "texts", "notes": "string", "config_signature": "text"}
CITATION: Fields = {"schema_version": "text", "evidence_id": "text"}

_TYPES = {"text": "string", "string": "string", "hash": "string", "long": "bigint", "count": "bigint", "place": "bigint", "double": "double", "boolean": "boolean", "texts": "array<string>", "longs": "array<bigint>", "map": "map<string,string>"}


# ---- out


def _escaped(text: Column) -> Column:
    """A JSON string. Control characters become short escapes where there are some, else four hex digits in lower case."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for plain, short in (("\b", "\\b"), ("\t", "\\t"), ("\n", "\\n"), ("\f", "\\f"), ("\r", "\\r")):
        out = F.replace(out, F.lit(plain), F.lit(short))
    rare = F.transform(F.split(out, ""), lambda c: F.when(c.rlike(r"[\x00-\x1f]"), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))).otherwise(c))
    out = F.when(out.rlike(r"[\x00-\x1f]"), F.array_join(rare, "")).otherwise(out)
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1f"\\]'), out).otherwise(text), F.lit('"'))


def canonical(value: Column, kind: T.DataType) -> Column:
    """``value`` as JSON text: keys sorted, no white space, nulls kept."""
    if isinstance(kind, T.StructType):
        names = sorted(f.name for f in kind)
        parts = [F.concat(_escaped(F.lit(k)), F.lit(":"), canonical(value[k], kind[k].dataType)) for k in names]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.concat(_escaped(k), F.lit(":"), canonical(value[k], kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(kind, T.StringType):
        out = _escaped(value)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = number(value.cast("double"))
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        out = value.cast("string")
    else:
        raise TypeError(f"no JSON for {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(out)


def to_lines(rows: DataFrame, record: str = "record", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, json) of a struct column: a line for each row."""
    return rows.select(*keep, F.concat(F.lit('{"content":'), canonical(F.col(record), rows.schema[record].dataType), F.lit("}")).alias("json"))


# ---- in


#: What values of a kind must be beside their type.
_VALID: dict[str, Callable[[Column], Column]] = {
    "text": lambda x: ~is_blank(x),
    "hash": lambda x: x.rlike("^[0-9a-f]{64}$"),
    "count": lambda x: x >= 0,
    "place": lambda x: x >= 1,
    "double": lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")),
}


def _split(kind: str) -> tuple[str, bool, bool]:
    return kind.rstrip("?~"), kind[-1] in "?~", kind[-1] == "~"


def _type_of(fields: Fields) -> str:
    def one(kind: object) -> str:
        if isinstance(kind, dict):
            return _type_of(kind)
        return f"array<{_type_of(kind[0])}>" if isinstance(kind, list) else _TYPES[_split(str(kind))[0]]

    return "struct<" + ",".join(f"{name}:{one(kind)}" for name, kind in fields.items()) + ">"


def _steps(value: Column, fields: Fields, at: str = "") -> list[tuple[Column, Column | str]]:
    """Conditions under which an object isn't a record of ``fields``, with the problem that each of them means."""
    steps: list[tuple[Column, Column | str]] = []
    for name, kind in fields.items():
        x, where = F.try_variant_get(value, f"$.{name}", "variant"), f"{at}{name}"
        shape = F.schema_of_variant(x)
        wrong = f"WRONG_TYPE {where}"
        if isinstance(kind, dict):
            steps += [(x.isNull(), f"MISSING_FIELD {where}"), (~shape.startswith("OBJECT<"), wrong), *_steps(x, kind, f"{where}.")]
            continue
        if isinstance(kind, list):
            items = F.try_variant_get(value, f"$.{name}", "array<variant>")
            first = _first_problem(items, kind[0], f"{where}[].")
            steps += [(x.isNull(), f"MISSING_FIELD {where}"), (items.isNull(), wrong), (first.isNotNull(), first)]
            continue
        base, null, absent = _split(str(kind))
        there = x.isNotNull() & (shape != "VOID") if null else x.isNotNull()
        typed = F.try_variant_get(value, f"$.{name}", _TYPES[base])
        whole = shape == "BIGINT"
        if base in ("texts", "longs"):
            fits = (shape == ("ARRAY<STRING>" if base == "texts" else "ARRAY<BIGINT>")) | (shape.startswith("ARRAY<") & (F.size(typed) == 0))
        elif base == "double":
            fits = whole | (shape == "DOUBLE") | shape.startswith("DECIMAL")
        else:
            fits = shape.startswith("OBJECT<") if base == "map" else shape == "BOOLEAN" if base == "boolean" else whole if base in ("long", "count", "place") else shape == "STRING"
        holes = F.exists(typed, lambda v: v.isNull()) if base in ("texts", "longs") else F.lit(False)
        valid = _VALID[base](typed) if base in _VALID else F.lit(True)
        if not absent:
            steps.append((x.isNull(), f"MISSING_FIELD {where}"))
        steps += [(there & (~fits | typed.isNull() | holes), wrong), (there & ~F.coalesce(valid, F.lit(False)), f"INVALID_VALUE {where}")]
    return steps


def _first_problem(items: Column, fields: Fields, at: str) -> Column:
    """Of a list of VARIANTs."""
    return F.try_element_at(F.filter(F.transform(items, lambda i: problem_of(i, fields, at)), lambda p: p.isNotNull()), F.lit(1))


def problem_of(value: Column, fields: Fields, at: str = "") -> Column:
    """The first thing that keeps a VARIANT from being a record of ``fields``; null if nothing does."""
    out = F.lit(None).cast("string")
    for condition, problem in reversed(_steps(value, fields, at)):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(problem) if isinstance(problem, str) else problem).otherwise(out)
    shape = F.schema_of_variant(value)
    return F.when(value.isNull() | ~shape.startswith("OBJECT<"), F.lit(f"WRONG_TYPE {at.rstrip('.') or 'content'}")).otherwise(out)


def _item_problem(e: Column) -> Column:
    """Of an evidence record: a type that isn't known, no page or block, a text or id that no longer matches."""
    again = identity.digest("evidence-id-v1", e["evidence_schema_version"], e["chunk_id"], e["content_hash"], e["document_id"], e["source_family_id"], e["jurisdiction"], identity.listed(e["block_ids"]), identity.listed(e["page_numbers"]))
    return first_match(
        [
            (e["evidence_type"] != "CHUNK", "INVALID_VALUE evidence_type"),
            (F.size(e["page_numbers"]) == 0, "INVALID_VALUE page_numbers"),
            (F.size(e["block_ids"]) == 0, "INVALID_VALUE block_ids"),
            (F.sha2(e["evidence_text"], 256) != e["evidence_text_hash"], "TEXT_HASH_MISMATCH"),
            (again != e["evidence_id"], "IDENTITY_MISMATCH"),
        ]
    )


def _pack_problem(p: Column) -> Column:
    items = p["evidence_items"]
    inner = F.try_element_at(F.filter(F.transform(items, _item_problem), lambda x: x.isNotNull()), F.lit(1))
    of = lambda name: F.transform(items, lambda e: e[name])
    again = identity.digest("evidence-pack-v1", p["schema_version"], p["query"], identity.listed(of("evidence_id")), p["construction_metadata"]["config_signature"])
    twice = lambda name: F.size(F.array_distinct(of(name))) < F.size(of(name))
    own = first_match([(twice("evidence_id"), "DUPLICATE_EVIDENCE_ID"), (twice("chunk_id"), "DUPLICATE_CHUNK_ID"), (again != p["pack_id"], "IDENTITY_MISMATCH")])
    return F.coalesce(inner, own)


def _jurisdiction_problem(d: Column) -> Column:
    again = identity.digest("jurisdiction-decision-v1", d["schema_version"], d["input_id"], d["requested_jurisdiction"], d["normalized_jurisdiction"], d["state"], d["reason_code"], identity.listed(F.array_sort(d["allowed_jurisdictions"])), d["config_signature"])
    both = F.size(F.array_intersect(d["allowed_jurisdictions"], d["blocked_jurisdictions"])) > 0
    return first_match([(both, "ALLOWED_AND_BLOCKED"), (again != d["decision_id"], "IDENTITY_MISMATCH")])


def _safety_problem(d: Column) -> Column:
    summary = d["input_status_summary"]
    pairs = F.array_join(F.transform(F.array_sort(F.map_keys(summary)), lambda k: F.concat(k, F.lit("="), F.coalesce(summary[k], F.lit("None")))), ",")
    again = identity.digest("safety-decision-v1", d["schema_version"], d["input_id"], d["safety_status"], d["reason_code"], d["engineering_signal_band"], pairs, d["config_signature"])
    return first_match([(again != d["decision_id"], "IDENTITY_MISMATCH")])


def _action_problem(a: Column) -> Column:
    parts = [a[n] for n in ("schema_version", "review_request_id", "sequence_number", "reviewer_id", "action", "previous_status", "new_status", "reviewer_comment")]
    again = identity.digest("human-review-action-v1", *parts, identity.listed(a["selected_evidence_ids"]), a["config_signature"])
    return first_match([(F.length(a["reviewer_comment"]) > review.MOST_COMMENT, "INVALID_VALUE reviewer_comment"), (again != a["review_action_id"], "IDENTITY_MISMATCH")])


def _report_problem(r: Column) -> Column:
    ids = F.array_sort(F.concat(r["passed_case_ids"], r["failed_case_ids"]))
    again = identity.digest("evaluation-report-v1", r["schema_version"], r["component"], identity.listed(ids), r["config_signature"])
    other = F.exists(r["results"], lambda x: x["component"] != r["component"])
    return first_match([(F.size(ids) != r["case_count"], "COUNT_MISMATCH"), (other, "OTHER_COMPONENT"), (again != r["report_id"], "IDENTITY_MISMATCH")])


#: Kinds of record: their fields, and what must still be true of one whose fields are sound.
KINDS: dict[str, tuple[Fields, Callable[[Column], Column]]] = {
    "evidence": (EVIDENCE, _item_problem),
    "evidence_pack": (PACK, _pack_problem),
    "jurisdiction_decision": (JURISDICTION, _jurisdiction_problem),
    "safety_decision": (SAFETY, _safety_problem),
    "review_action": (ACTION, _action_problem),
    "component_report": (REPORT, _report_problem),
    "citation_reference": (CITATION, lambda _: F.lit(None).cast("string")),
}


def from_lines(lines: DataFrame, kind: str, json: str = "json") -> DataFrame:
    """``lines`` with ``record``, a struct, or ``problem``, a text: exactly one of them isn't null.

    Fields that a kind doesn't name are ignored, as are further ones of the line. A line that is null or no JSON object, or
    names a key twice, is MALFORMED_JSON.
    """
    fields, check = KINDS[kind]
    parsed = lines.withColumn("_line", F.try_parse_json(json)).withColumn("_content", F.try_variant_get("_line", "$.content", "variant"))
    formed = parsed.withColumn("_problem", F.when(F.col("_line").isNull(), "MALFORMED_JSON").when(F.col("_content").isNull(), "MISSING_FIELD content").otherwise(problem_of(F.col("_content"), fields)))
    typed = formed.withColumn("_record", F.when(F.col("_problem").isNull(), F.try_variant_get("_content", "$", _type_of(fields))))
    done = typed.withColumn("problem", F.coalesce("_problem", F.when(F.col("_record").isNull(), "WRONG_TYPE content"), check(F.col("_record"))))
    return done.withColumn("record", F.when(F.col("problem").isNull(), F.col("_record"))).drop("_line", "_content", "_problem", "_record")


# ---- records of this library's columns


def evidence_record(items: DataFrame, rank: str = "pack_order", score: str = "score") -> Column:
    """The record of an item that evidence_items() and a ranking describe."""
    null = lambda kind: F.lit(None).cast(kind)
    c = F.col
    retrieval = {"rank": c(rank).cast("long"), "bm25_rank": null("long"), "bm25_score": c(score).cast("double"), "dense_rank": null("long"), "dense_score": null("double"), "dense_model_identity": null("string"), "rrf_score": null("double"), "reranker_score": null("double"), "reranker_model_identity": null("string")}
    version = {"version_known": F.lit(False), "effective_date_known": F.lit(False), "publication_date": null("string"), "supersession_status": null("string")}
    synthetic = c("synthetic") if "synthetic" in items.columns else F.lit(False)
    own = {
        "evidence_id": c("evidence_id"), "evidence_schema_version": F.lit(evidence.SCHEMA), "evidence_type": F.lit("CHUNK"), "evidence_text": c("text"), "evidence_text_hash": c("text_hash"),
        "chunk_id": c("chunk_id"), "document_id": c("document_id"), "source_family_id": c("source_family_id"), "jurisdiction": c("jurisdiction"), "content_hash": c("content_hash"), "synthetic": synthetic,
        "page_numbers": c("page_numbers").cast("array<long>"), "block_ids": c("block_ids"), "retrieval_metadata": _struct(retrieval), "version_info": _struct(version), "section_heading_text": null("string"), "section_heading_level": null("long"),
    }
    return _struct(own)


def _struct(fields: dict[str, Column]) -> Column:
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def pack_records(items: DataFrame, config: str | None = None) -> DataFrame:
    """(query_id, record): a pack of each query's items (as for evidence_record(), with query_id and query), in pack order.

    Items of a pack are as few as its selection allows.
    """
    signature = config or evidence.signature()
    gathered = items.withColumn("_item", evidence_record(items)).groupBy("query_id", "query").agg(F.sort_array(F.collect_list(F.struct("pack_order", "_item"))).alias("_items"))
    listed = F.transform("_items", lambda x: x["_item"])
    ids = F.transform("_items", lambda x: x["_item"]["evidence_id"])
    own = {"pack_id": identity.pack_id(evidence.SCHEMA, F.col("query"), ids, signature), "schema_version": F.lit(evidence.SCHEMA), "query": F.col("query"), "evidence_items": listed, "construction_metadata": _struct({"config_signature": F.lit(signature), "selected_count": F.size("_items")})}
    return gathered.select("query_id", _struct(own).alias("record"))


def jurisdiction_record() -> Column:
    """Of columns input_id, requested, normalized, state, reason_code, allowed, blocked, requires_evidence, requires_escalation."""
    c = F.col
    own = {
        "schema_version": F.lit(records.VERSION), "decision_id": records.jurisdiction_decision_id(), "input_id": c("input_id"), "requested_jurisdiction": c("requested"), "normalized_jurisdiction": c("normalized"), "state": c("state"),
        "reason_code": c("reason_code"), "explanation": F.concat_ws(": ", "state", "reason_code"), "allowed_jurisdictions": F.array_sort("allowed"), "blocked_jurisdictions": F.array_sort("blocked"),
        "requires_evidence": c("requires_evidence"), "requires_escalation": c("requires_escalation"), "config_signature": F.lit(records.JURISDICTION_CONFIG),
    }
    return _struct(own)


def action_record() -> Column:
    """Of columns request_id, seq, reviewer, action, previous_status, new_status, comment, selected_ids, metadata."""
    c = F.col
    own = {
        "schema_version": F.lit(records.VERSION), "review_action_id": records.review_action_id(), "review_request_id": c("request_id"), "sequence_number": c("seq").cast("long"), "reviewer_id": c("reviewer"), "action": c("action"),
        "previous_status": c("previous_status"), "new_status": c("new_status"), "reviewer_comment": c("comment"), "selected_evidence_ids": c("selected_ids"), "metadata": c("metadata"), "config_signature": F.lit(records.REVIEW_CONFIG),
    }
    return _struct(own)


def report_records(by_component: DataFrame) -> DataFrame:
    """(component, record) of rows (component, passed_case_ids, failed_case_ids, results: an array of RESULT's fields)."""
    c = F.col
    ids = F.array_sort(F.concat("passed_case_ids", "failed_case_ids"))
    own = {
        "schema_version": F.lit(reports.VERSION), "report_id": identity.digest("evaluation-report-v1", reports.VERSION, c("component"), identity.listed(ids), reports.CONFIG), "component": c("component"), "case_count": F.size(ids).cast("long"),
        "results": c("results"), "passed_case_ids": c("passed_case_ids"), "failed_case_ids": c("failed_case_ids"), "notes": F.lit(""), "config_signature": F.lit(reports.CONFIG),
    }
    return by_component.select("component", _struct(own).alias("record"))
