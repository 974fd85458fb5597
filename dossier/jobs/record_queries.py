"""Queries over records as JSON lines, and over the gated release of a corpus; registered beside those of ``queries``."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.shared import Files, shared_dir, written
from dossier.jobs import corpus, providers, redteam, refresh
from dossier.jobs.queries import BM25_INPUT, CITED, DECIDED, ITEMS, ORACLE_SQL, QUERIES, _benchmark, _bm25_sql, _answers, _candidates, _items, _ranked, _signals, _terms, query, table
from dossier.operators import admission, citation, evidence, jurisdiction, lexical, log_events, pdf
from dossier.operators import strict_json as lines
from dossier.sources import artifacts, releases, snapshots
from dossier.streaming import arrivals

__all__ = ["ORACLE_SQL", "QUERIES"]


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of each benchmark item as evidence."""
    ranked = _ranked(spark, sf_dir, 5).withColumnRenamed("rank", "pack_order").withColumn("score", F.round("score", 4))
    return ranked.join(_items(spark, sf_dir, ranked), "doc_id").join(_benchmark(spark, sf_dir), "query_id")


RETRIEVED = f"""{BM25_INPUT}, {_bm25_sql('a', 1.5, 0.75, 5)}, {ITEMS},
e AS (SELECT query_id, b.text AS query, a.rank, i.doc_id, evidence_id, '{{"block_ids":["' || block || '"],"chunk_id":"' || chunk_id || '","content_hash":"' || content_hash || '","document_id":"' || document_id || '","evidence_id":"' || evidence_id || '","evidence_schema_version":"1.0.0","evidence_text":' || to_json(d.text)
  || ',"evidence_text_hash":"' || sha256(d.text) || '","evidence_type":"CHUNK","jurisdiction":"' || jurisdiction || '","page_numbers":[1],"retrieval_metadata":{{"bm25_rank":null,"bm25_score":' || round(score, 4)::VARCHAR || ',"dense_model_identity":null,"dense_rank":null,"dense_score":null,"rank":' || a.rank
  || ',"reranker_model_identity":null,"reranker_score":null,"rrf_score":null}},"section_heading_level":null,"section_heading_text":null,"source_family_id":"' || source_family_id || '","synthetic":false,"version_info":{{"effective_date_known":false,"publication_date":null,"supersession_status":null,"version_known":false}}}}' AS j
  FROM a JOIN items i USING (doc_id) JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = a.query_id)"""


@query(f"""WITH {RETRIEVED} SELECT query_id, doc_id, sha256('{{"content":' || j || '}}') AS line_hash FROM e""")
def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical lines of retrieved evidence, told by their hashes."""
    items = _retrieved(spark, sf_dir)
    out = lines.to_lines(items.withColumn("record", lines.evidence_record(items)), keep=("query_id", "doc_id"))
    return out.select("query_id", "doc_id", F.sha2("json", 256).alias("line_hash"))


def _damaged(json: Column, which: Column) -> Column:
    """One line in six is sound; the others are damaged in one way each."""
    return (
        F.when(which == 0, json)
        .when(which == 1, F.regexp_replace(json, '"evidence_text":"', '"evidence_text":"x'))
        .when(which == 2, F.regexp_replace(json, '"document_id":"', '"document_id":"9'))
        .when(which == 3, F.regexp_replace(json, '"synthetic":false', '"synthetic":"false"'))
        .when(which == 4, F.regexp_replace(json, ',"source_family_id":"[^"]*"', ""))
        .when(which == 5, F.left(json, F.length(json) - 1))
    )


@query(f"""WITH {RETRIEVED} SELECT query_id, doc_id, CASE doc_id % 6 WHEN 1 THEN 'TEXT_HASH_MISMATCH' WHEN 2 THEN 'IDENTITY_MISMATCH' WHEN 3 THEN 'WRONG_TYPE synthetic' WHEN 4 THEN 'MISSING_FIELD source_family_id' WHEN 5 THEN 'MALFORMED_JSON' END AS problem,
CASE WHEN doc_id % 6 = 0 THEN evidence_id END AS evidence_id, doc_id % 6 = 0 AS same FROM e""")
def evidence_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence written as lines, damaged by document, and read back: the problem of each, or the record, which gives its line again."""
    items = _retrieved(spark, sf_dir)
    out = lines.to_lines(items.withColumn("record", lines.evidence_record(items)), keep=("query_id", "doc_id"))
    read = lines.from_lines(out.withColumn("json", _damaged(F.col("json"), F.col("doc_id") % 6)), "evidence")
    again = F.concat(F.lit('{"content":'), lines.canonical(F.col("record"), read.schema["record"].dataType), F.lit("}"))
    return read.select("query_id", "doc_id", "problem", F.col("record.evidence_id").alias("evidence_id"), (F.col("record").isNotNull() & (again == F.col("json"))).alias("same"))


@query(
    f"""WITH {RETRIEVED}, pk AS (SELECT query_id, query, list(evidence_id ORDER BY rank) AS ids, list(j ORDER BY rank) AS js FROM e GROUP BY ALL)
SELECT query_id, CASE query_id % 4 WHEN 1 THEN 'IDENTITY_MISMATCH' WHEN 2 THEN 'WRONG_TYPE evidence_items[].page_numbers' WHEN 3 THEN 'DUPLICATE_EVIDENCE_ID' END AS problem,
CASE WHEN query_id % 4 = 0 THEN sha256('evidence-pack-v1|1.0.0|' || query || '|' || array_to_string(ids, ',') || '|{evidence.signature()}') END AS pack_id, CASE WHEN query_id % 4 = 0 THEN len(ids)::BIGINT END AS n_items FROM pk"""
)
def pack_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs written and read back; of three in four the query, an item's pages or the list of items was changed."""
    out = lines.to_lines(lines.pack_records(_retrieved(spark, sf_dir)), keep=("query_id",))
    which, json = F.col("query_id") % 4, F.col("json")
    twice = F.regexp_replace(json, r'(?s)"evidence_items":\[(\{.*?"version_known":false\}\})', r'"evidence_items":[$1,$1')
    changed = F.when(which == 1, F.regexp_replace(json, '"query":"', '"query":"x')).when(which == 2, F.regexp_replace(json, r'"page_numbers":\[1\]', '"page_numbers":["1"]')).when(which == 3, twice).otherwise(json)
    read = lines.from_lines(out.withColumn("json", changed), "evidence_pack")
    return read.select("query_id", "problem", F.col("record.pack_id").alias("pack_id"), F.size("record.evidence_items").cast("long").alias("n_items")).withColumn("n_items", F.when(F.col("problem").isNull(), F.col("n_items")))


@query(
    f"""WITH {DECIDED}, x AS (SELECT doc_id, state, coalesce(a, b) AS n, CASE WHEN state = 'AMBIGUOUS' THEN 'JURISDICTION_AMBIGUOUS' WHEN state = 'KNOWN' THEN 'EXPLICIT_JURISDICTION_ACCEPTED' WHEN odd THEN 'JURISDICTION_NOT_SUPPORTED' ELSE 'JURISDICTION_UNKNOWN' END AS reason,
  CASE doc_id % 5 WHEN 0 THEN ' india ' WHEN 1 THEN 'INTERNATIONAL' WHEN 2 THEN 'Unspecified' WHEN 3 THEN 'France' ELSE '' END AS asked FROM j),
y AS (SELECT doc_id, state, sha256('jurisdiction-decision-v1|1.0.0|' || doc_id || '|' || asked || '|' || CASE WHEN state = 'KNOWN' THEN n ELSE '' END || '|' || state || '|' || reason || '|' || CASE WHEN state <> 'KNOWN' THEN '' WHEN n = 'BOTH' THEN 'INDIA,INTERNATIONAL' ELSE n END || '|jurisdiction-firewall-config:v1.0.0') AS decision_id FROM x)
SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'IDENTITY_MISMATCH' WHEN 2 THEN 'WRONG_TYPE requires_evidence' WHEN 3 THEN 'MISSING_FIELD blocked_jurisdictions' WHEN 4 THEN 'WRONG_TYPE content' WHEN 5 THEN 'MALFORMED_JSON' END AS problem, CASE WHEN doc_id % 7 IN (0, 6) THEN decision_id END AS decision_id FROM y"""
)
def decision_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jurisdiction decisions written and read back; of five in seven one thing was changed."""
    known = F.col("state") == "KNOWN"
    rows = jurisdiction.resolve(_signals(spark, sf_dir)).withColumns({"input_id": F.col("doc_id").cast("string"), "requested": F.col("explicit"), "requires_evidence": known, "requires_escalation": ~known})
    out = lines.to_lines(rows.withColumn("record", lines.jurisdiction_record()), keep=("doc_id",))
    which, json = F.col("doc_id") % 7, F.col("json")
    changed = (
        F.when(which == 1, F.regexp_replace(json, '"input_id":"', '"input_id":"0'))
        .when(which == 2, F.regexp_replace(json, '"requires_evidence":(true|false)', '"requires_evidence":1'))
        .when(which == 3, F.regexp_replace(json, r'"blocked_jurisdictions":\[[^\]]*\],', ""))
        .when(which == 4, F.lit('{"content":[1]}'))
        .when(which == 5, F.regexp_replace(json, '"state":', '"reason_code":"","state":'))  # a key that comes twice
        .otherwise(json)
    )
    read = lines.from_lines(out.withColumn("json", changed), "jurisdiction_decision")
    return read.select("doc_id", "problem", F.col("record.decision_id").alias("decision_id"))


@query(
    """WITH c AS (SELECT 'part-' || doc_id // 40 AS component, doc_id // 40 AS k, doc_id::VARCHAR AS id, quality = 1 AS ok FROM labels),
r AS (SELECT component, any_value(k) AS k, list(id ORDER BY id) AS ids, count(*) AS n, count(*) FILTER (ok) AS n_ok FROM c GROUP BY component)
SELECT component, CASE k % 4 WHEN 1 THEN 'COUNT_MISMATCH' WHEN 2 THEN 'OTHER_COMPONENT' WHEN 3 THEN 'INVALID_VALUE results[].denominator' END AS problem, CASE WHEN k % 4 = 0 THEN n_ok / n::DOUBLE END AS value,
CASE WHEN k % 4 = 0 THEN sha256('evaluation-report-v1|1.0.0|' || component || '|' || array_to_string(ids, ',') || '|evaluation-config:v1.0.0:benchmark:v1.0.0') END AS report_id FROM r"""
)
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of components of forty ids each, written and read back; of three in four one thing was changed."""
    cases = table(spark, sf_dir, "labels").select(F.concat(F.lit("part-"), F.floor(F.col("doc_id") / 40).cast("string")).alias("component"), F.col("doc_id").cast("string").alias("id"), (F.col("quality") == 1).alias("ok"))
    ids = lambda x: F.array_sort(F.collect_list(F.when(x, F.col("id"))))
    by = cases.groupBy("component").agg(ids(F.col("ok")).alias("passed_case_ids"), ids(~F.col("ok")).alias("failed_case_ids"), F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"))
    result = F.struct(
        F.lit("1.0.0").alias("schema_version"), F.lit("PASSED").alias("metric_name"), F.col("component"), F.lit(True).alias("applicable"), (F.col("n_ok") / F.col("n")).alias("value"),
        F.col("n_ok").cast("double").alias("numerator"), F.col("n").alias("denominator"), F.lit("Share of cases passed.").alias("explanation"), F.lit(None).cast("string").alias("ground_truth_origin"),
    )
    out = lines.to_lines(lines.report_records(by.withColumn("results", F.array(result))), keep=("component",))
    which, json = F.substring_index("component", "-", -1).cast("long") % 4, F.col("json")
    changed = (
        F.when(which == 1, F.regexp_replace(json, '"case_count":', '"case_count":9'))
        .when(which == 2, F.regexp_replace(json, '"applicable":true,"component":"', '"applicable":true,"component":"x'))
        .when(which == 3, F.regexp_replace(json, '"denominator":', '"denominator":-'))
        .otherwise(json)
    )
    read = lines.from_lines(out.withColumn("json", changed), "component_report")
    return read.select("component", "problem", F.element_at("record.results", 1)["value"].alias("value"), F.col("record.report_id").alias("report_id"))


@query(f"WITH {CITED} SELECT doc_id AS answer_id, occurrence, CASE WHEN doc_id % 29 = 0 THEN 'INVALID_PACK' WHEN doc_id % 4 IN (1, 2) THEN 'SCHEMA_MISMATCH' ELSE reason_code END AS reason_code FROM checked")
def citation_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that say their version: an older one, none, and the known one."""
    answers, own = _answers(spark, sf_dir)
    which = F.col("answer_id") % 4
    versions = F.when(which == 1, "0.9.0").when(which != 2, "1.0.0")
    return citation.validate(citation.extract(answers).withColumn("schema_version", versions), own).select("answer_id", "occurrence", "reason_code")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 4) THEN 'KNOWN' ELSE 'UNKNOWN' END AS state, CASE doc_id % 5 WHEN 0 THEN 'EXPLICIT_JURISDICTION_ACCEPTED' WHEN 4 THEN 'EXPLICIT_JURISDICTION_ACCEPTED' ELSE 'JURISDICTION_METADATA_INVALID' END AS reason_code,
CASE doc_id % 5 WHEN 0 THEN 'INTERNATIONAL' WHEN 4 THEN 'INDIA' END AS normalized FROM documents"""
)
def jurisdiction_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as they come: a text, a number, a list, an object, JSON's null; the other signal always says INDIA."""
    i = F.col("doc_id") % 5
    raw = F.when(i == 0, '" international"').when(i == 1, F.col("doc_id").cast("string")).when(i == 2, '["INDIA"]').when(i == 3, '{"name":"INDIA"}').otherwise("null")
    other = F.when(i == 0, F.lit(None).cast("string")).otherwise("INDIA")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.parse_json(raw).alias("explicit"), other.alias("classified"))
    return jurisdiction.resolve(rows).select("doc_id", "state", "reason_code", "normalized")


# ---- release


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark items as questions; relevant is what the best document of each held, by BM25 over whole documents."""
    asked = _benchmark(spark, sf_dir)
    best = lexical.bm25_topk(asked, table(spark, sf_dir, "documents"), 1)
    return asked, best.select("query_id", F.col("doc_id").cast("string").alias("document_id"))


@query(
    f"""WITH {BM25_INPUT}, {_bm25_sql('a', 1.5, 0.75, 1)}, best AS (SELECT DISTINCT doc_id FROM a), n AS (SELECT count(*) AS n, count(*) FILTER (doc_id IN (FROM best)) AS n_best FROM documents WHERE length(trim(text)) > 0)
SELECT * FROM (SELECT unnest([
 {{'step': 'first', 'status': 'RELEASED', 'reason': NULL, 'stages': 5, 'n_candidates': n, 'active': 'first'}},
 {{'step': 'invalid', 'status': 'REJECTED', 'reason': 'VALIDATION_FAILED', 'stages': 1, 'n_candidates': n + 1, 'active': 'first'}},
 {{'step': 'worse', 'status': 'REJECTED', 'reason': 'EVALUATION_FAILED', 'stages': 3, 'n_candidates': n - n_best, 'active': 'first'}},
 {{'step': 'dry', 'status': 'DRY_RUN_COMPLETE', 'reason': NULL, 'stages': 3, 'n_candidates': n, 'active': 'first'}},
 {{'step': 'damaged', 'status': 'REJECTED', 'reason': 'BACKUP_FAILED', 'stages': 4, 'n_candidates': n + 1, 'active': 'first'}},
 {{'step': 'second', 'status': 'RELEASED', 'reason': NULL, 'stages': 5, 'n_candidates': n + 1, 'active': 'second'}},
 {{'step': 'rollback', 'status': 'RELEASED', 'reason': NULL, 'stages': 0, 'n_candidates': n, 'active': 'first'}}], recursive := true) FROM n)"""
)
def corpus_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release workspace over all documents: a first release, candidates that fail in three stages, a second one, a rollback."""
    root, registry = shared_dir(spark), admission.families(spark)
    docs = written(_candidates(spark, sf_dir), f"{shared_dir(spark)}/candidates")
    asked, relevant = (written(x, f"{shared_dir(spark)}/judged") for x in _judged(spark, sf_dir))
    extra = docs.orderBy("document_id").limit(1).withColumns({"document_id": F.lit("added"), "text": F.lit("0")})
    more, names, rows = docs.unionByName(extra), {}, []

    def step(name: str, candidates: DataFrame, **settings: bool) -> refresh.Refresh:
        done = refresh.run(spark, candidates, registry, asked, relevant, root=root, lock_version="1", **settings)
        if done.status == "RELEASED":
            names[done.snapshot_id] = name
        rows.append((name, done.status, done.reason, len(done.stages), done.stages[0][2], names.get(releases.read(spark, root).active_snapshot_id)))
        return done

    first = step("first", docs)
    step("invalid", docs.unionByName(docs.orderBy("document_id").limit(1)))
    step("worse", docs.join(relevant.select("document_id").distinct(), "document_id", "left_anti"))
    step("dry", docs, dry_run=True)
    # a folder of the second release's name that holds only half of it
    other = shared_dir(spark)
    chunks = written(refresh.indexed(more), f"{other}/chunks")
    second = snapshots.create(more.select("document_id", "text"), f"{other}/whole", "document_id", chunks)
    for part in ("documents", "chunks", "manifest"):
        held = spark.read.parquet(f"{other}/whole/{part}")
        (held.where("document_id <> 'added'") if part == "documents" else held).write.parquet(f"{root}/snapshots/{second}/{part}")
    Files(spark, other).delete("")
    step("damaged", more)
    Files(spark, root).delete(f"snapshots/{second}")
    step("second", more)
    back = releases.rollback(spark, root, first.snapshot_id, "1")
    rows.append(("rollback", "RELEASED", None, 0, docs.count(), names[back.active_snapshot_id]))
    return spark.createDataFrame(rows, "step string, status string, reason string, stages int, n_candidates long, active string")


# ---- the pinned corpus


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A manifest and a raw file of every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    path = F.concat("document_id", F.lit(".txt"))
    record = F.struct(
        "document_id", F.lit("SF-01").alias("source_family_id"), F.lit("INDIA").alias("jurisdiction"), F.lit(False).alias("synthetic"), F.sha2("text", 256).alias("content_hash"), F.lit("ADMIT").alias("admission_status"), path.alias("path"),
    )
    manifests = docs.select(F.concat(F.lit("m/"), "document_id", F.lit(".json")).alias("manifest_path"), F.to_json(record).alias("json"), "doc_id")
    return manifests, docs.select(path.alias("path"), F.lit(".txt").alias("extension"), F.col("text").cast("binary").alias("content"), "doc_id")


@query(
    """WITH d AS (SELECT doc_id, doc_id::VARCHAR AS document_id, coalesce(text, '') AS t, doc_id % 12 AS k FROM documents)
SELECT document_id, CASE WHEN length(t) = 0 OR k BETWEEN 6 AND 8 THEN 'INGESTION' WHEN k = 9 THEN 'CHUNKS' WHEN k = 10 THEN 'INDEX' ELSE 'MANIFEST' END AS layer,
CASE WHEN k = 1 THEN 'MANIFEST_MISSING' WHEN k = 2 THEN 'MANIFEST_MALFORMED' WHEN k = 3 THEN 'MANIFEST_TWICE' WHEN k = 4 THEN 'NOT_PINNED' WHEN k = 5 THEN 'PIN_MISMATCH' WHEN k = 6 OR length(t) = 0 THEN 'FILE_NOT_FOUND' WHEN k = 7 THEN 'CONTENT_HASH_MISMATCH' WHEN k = 8 THEN 'INVALID_ADMISSION_STATE' WHEN k = 9 THEN 'CHUNK_COUNT_MISMATCH' ELSE 'SIGNATURE_MISMATCH' END AS problem
FROM d WHERE length(trim(t)) > 0 AND k BETWEEN 1 AND 10
UNION ALL SELECT document_id, 'MANIFEST', 'MANIFEST_TWICE' FROM d WHERE length(trim(t)) > 0 AND k = 3"""
)
def corpus_build_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pinned corpus of all documents with text, of which ten in twelve are damaged in one way each."""
    manifests, raw = (x.where("length(trim(json)) > 0") if "json" in x.columns else x.where("length(trim(CAST(content AS STRING))) > 0") for x in _manifests(spark, sf_dir))
    manifests = manifests.join(raw.select("doc_id"), "doc_id", "left_semi")
    registry, k = admission.families(spark), F.col("doc_id") % 12
    pins = written(corpus.first_pins(manifests.drop("doc_id"), raw.drop("doc_id"), registry), f"{shared_dir(spark)}/pins")
    json = F.when(k == 2, F.regexp_replace("json", '"synthetic":false', '"synthetic":0')).when(k == 8, F.regexp_replace("json", "ADMIT", "REJECT")).otherwise(F.col("json"))
    bad_manifests = manifests.where(k != 1).withColumn("json", json)
    bad_manifests = bad_manifests.unionByName(bad_manifests.where(k == 3))
    bad_files = raw.where(k != 6).withColumn("content", F.when(k == 7, F.concat(F.col("content").cast("string"), F.lit(" ")).cast("binary")).otherwise(F.col("content")))
    n = F.col("document_id").cast("long") % 12
    bad_pins = pins.where(n != 4).withColumns({"jurisdiction": F.when(n == 5, "INTERNATIONAL").otherwise(F.col("jurisdiction")), "n_chunks": F.when(n == 9, F.col("n_chunks") + 1).otherwise(F.col("n_chunks")), "signature": F.when(n == 10, F.sha2("signature", 256)).otherwise(F.col("signature"))})
    return corpus.build(bad_manifests.drop("doc_id"), bad_files.drop("doc_id"), bad_pins, registry).problems.select("document_id", "layer", "problem")


@query("SELECT 'VALIDATED' AS status, count(*) AS n_documents, 0::BIGINT AS n_problems, 0::BIGINT AS n_without_provenance, 0::BIGINT AS n_over_budget FROM documents WHERE length(trim(coalesce(text, ''))) > 0")
def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same corpus, sound: its documents, and what was observed as its chunks were written."""
    manifests, raw = _manifests(spark, sf_dir)
    raw = raw.where("length(trim(CAST(content AS STRING))) > 0")
    manifests, registry = manifests.join(raw.select("doc_id"), "doc_id", "left_semi").drop("doc_id"), admission.families(spark)
    pins = written(corpus.first_pins(manifests, raw.drop("doc_id"), registry), f"{shared_dir(spark)}/pins")
    found = corpus.build(manifests, raw.drop("doc_id"), pins, registry).sound()
    one = found.chunks.agg(F.count_distinct("document_id").alias("n_documents")).withColumns({k: F.lit(found.counts[k]).cast("long") for k in ("n_without_provenance", "n_over_budget")})
    return one.select(F.lit("VALIDATED").alias("status"), "n_documents", F.lit(found.problems.count()).alias("n_problems"), "n_without_provenance", "n_over_budget")


# ---- providers


class Echo:
    """A provider that can be foretold: the hash of its input, and no answer to inputs of some lengths unless ``whole``."""

    output = "string"

    def __init__(self, model: str, whole: bool):
        self.name, self.model, self.whole = "echo", model, whole

    def load(self) -> Callable[[Sequence[str]], Sequence[object]]:
        def call(texts: Sequence[str]) -> list[object]:
            return [providers.CallFailed("too busy") if not self.whole and len(t) % 7 == 3 else hashlib.sha256(t.encode()).hexdigest() for t in texts]

        return call


@query("SELECT doc_id AS id, 1 AS n_first, CASE WHEN length(text) % 7 = 3 THEN 2 ELSE 1 END AS n_asked, text IS NOT NULL AS success, sha256(text) AS output, CASE WHEN text IS NULL THEN 'NULL_INPUT' END AS failure_reason FROM documents")
def provider_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents given to a provider: half of them first, then all, then those that failed; how often each was asked."""
    path = shared_dir(spark)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("input"))
    busy = Echo("one", False)
    providers.answered(rows.where(F.col("input").contains("e")), busy, path, size=400)
    providers.answered(rows, busy, path, size=400)  # asks for the rest alone
    first = spark.read.parquet(path).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n_first"))
    first = written(first, f"{shared_dir(spark)}/first")
    last = providers.answered(rows, Echo("one", True), path, again=True)
    times = spark.read.parquet(path).where("failure_reason IS NULL OR failure_reason <> 'NULL_INPUT' OR turn = 1").groupBy("id").agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("n_asked"))
    return last.join(first, "id").join(times, "id", "left").select("id", "n_first", F.coalesce("n_asked", F.lit(1)).alias("n_asked"), "success", "output", "failure_reason")


# ---- red-team cases


def _attacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item under attack; half of them are classified well enough to be answered."""
    known = F.when(F.col("query_id") % 2 == 0, "at the patent office of India")
    questions = _benchmark(spark, sf_dir).select("query_id", F.col("query").alias("raw_query"), known.alias("description"), F.lit("SUFFICIENT_EVIDENCE").alias("evidence_state"), F.lit("INDIA").alias("explicit"), F.lit("UNSPECIFIED").alias("requested_language"), F.lit("en").alias("source_language"))
    found = written(_retrieved(spark, sf_dir), f"{shared_dir(spark)}/found")
    return redteam.results(redteam.attempts(questions, found))


NOT_TRIED, BY_QUESTION = "P19-06", ("P19-07", *redteam.BY_RECORD)
TRIED = f"""{BM25_INPUT}, {_bm25_sql('a', 1.5, 0.75, 5)}, n AS (SELECT count(*) AS asked, count(*) FILTER (item_id IN (SELECT query_id FROM a)) AS answered FROM benchmark),
c AS (SELECT unnest([{', '.join(f"'{c[0]}'" for c in redteam.CASES)}]) AS case_id)"""


@query(f"WITH {TRIED} SELECT case_id, CASE WHEN case_id = '{NOT_TRIED}' THEN 0 WHEN case_id IN {BY_QUESTION} THEN asked ELSE answered END AS n_attempts, 0::BIGINT AS n_successes, CASE WHEN case_id <> '{NOT_TRIED}' THEN false END AS attack_success FROM c CROSS JOIN n")
def redteam_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cases against all questions; what a browser shows isn't this library's."""
    return _attacked(spark, sf_dir).select("case_id", "n_attempts", "n_successes", "attack_success")


# ---- documents that arrive


def _arrived(spark: SparkSession, sf_dir: str) -> str:
    """The root of a stream over all documents: three batches, the second done twice, every fifth document again in the last, every seventh with a false hash."""
    docs = table(spark, sf_dir, "documents")
    own = docs.select(F.concat(F.lit("a/"), "doc_id", F.lit(".txt")).alias("path"), "doc_id", F.col("text").cast("binary").alias("content"), F.sha2("text", 256).alias("sha"))
    again = own.where("doc_id % 5 = 0").withColumn("path", F.regexp_replace("path", "^a", "z"))
    claimed = F.when(F.col("doc_id") % 7 == 3, F.sha2("sha", 256)).otherwise(F.coalesce("sha", F.lit("none")))
    known = (F.col("doc_id").cast("string").alias("document_id"), F.lit("SF-01").alias("source_family_id"), F.lit("INDIA").alias("jurisdiction"), claimed.alias("content_hash"), F.lit("ADMIT").alias("admission_status"))
    shaped = lambda rows: rows.select("path", F.lit(".txt").alias("extension"), "content", *known)
    source, root = shared_dir(spark), shared_dir(spark)
    for batch in range(3):
        part = own.where(F.col("doc_id") % 3 == batch)
        shaped(part.unionByName(again) if batch == 2 else part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    registry = admission.families(spark)
    arrivals.start(stream, registry, root, shared_dir(spark), once=True).awaitTermination()
    arrivals.add(shaped(own.where("doc_id % 3 = 1")), 1, registry, root)
    return root


ARRIVED = "text IS NOT NULL AND strlen(text) > 0 AND doc_id % 7 <> 3"


@query(f"WITH {_terms('t', f'(SELECT * FROM documents WHERE {ARRIVED})', 'doc_id')} SELECT term, count(DISTINCT doc_id) AS df, (SELECT count(*) FROM t) AS n_docs, round((SELECT avg(len(toks)) FROM t), 6) AS avg_tokens FROM (SELECT doc_id, unnest(toks) AS term FROM t) GROUP BY term")
def arrival_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _arrived(spark, sf_dir)
    one = arrivals.corpus_stats(spark, root).withColumn("avg_tokens", F.round("avg_tokens", 6))
    return arrivals.document_frequency(spark, root).crossJoin(F.broadcast(one))  # one row


@query(
    f"""WITH a AS (SELECT doc_id, 'a/' AS folder, doc_id % 3 AS batch, text FROM documents UNION ALL SELECT doc_id, 'z/', 2, text FROM documents WHERE doc_id % 5 = 0)
SELECT doc_id::VARCHAR AS document_id, folder || doc_id || '.txt' AS path, batch, CASE WHEN text IS NULL THEN 'FILE_NOT_FOUND' WHEN strlen(text) = 0 THEN 'EMPTY_FILE' WHEN doc_id % 7 = 3 THEN 'CONTENT_HASH_MISMATCH' WHEN folder = 'z/' THEN 'DUPLICATE_DOCUMENT' END AS reason FROM a"""
)
def arrival_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals.read(spark, _arrived(spark, sf_dir), "outcomes").select("document_id", "path", "batch", "reason")


# ---- log events and artefacts


@query(
    """SELECT event_id, CASE WHEN event_id % 10 = 3 THEN 'UNKNOWN_LEVEL' WHEN event_id % 10 = 4 THEN 'INVALID_LATENCY' END AS problem, CASE WHEN event_id % 10 NOT IN (3, 4) THEN
'{"component":"API","error_type":null,"event_name":"' || event_type || '","latency_ms":' || value::VARCHAR || ',"level":"INFO","metadata":{"PASS-WORD":"***REDACTED***","inner":{"k":' || json_extract_string(props, '$.k') || '},"name":"' || event_type || '","z":[{"auth_token":"***REDACTED***","n":1,"told":"{\\"apiKey\\":\\"***REDACTED***\\"}"}]},"outcome":"DONE","request_id":"r' || event_id || '","schema_version":"1.0.0","timestamp":"2026-01-01T00:00:00+00:00"}' END AS line FROM events"""
)
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose details hold secrets by name, in a list, and in a text of JSON."""
    c = F.col
    told = F.lit('{"apiKey": "s3cret"}')
    detail = F.struct(c("event_type").alias("name"), F.from_json("props", "k long").alias("inner"), F.struct(c("props").alias("a")).alias("PASS-WORD"), F.array(F.struct(c("event_type").alias("auth_token"), F.lit(1).alias("n"), told.alias("told"))).alias("z"))
    rows = table(spark, sf_dir, "events").select(
        "event_id", c("event_type").alias("event_name"), F.lit("2026-01-01T00:00:00+00:00").alias("timestamp"), F.when(c("event_id") % 10 == 3, "LOUD").otherwise("INFO").alias("level"), F.lit("API").alias("component"), F.lit("DONE").alias("outcome"),
        F.concat(F.lit("r"), "event_id").alias("request_id"), F.when(c("event_id") % 10 == 4, -1.0).otherwise(c("value")).alias("latency_ms"), F.lit(None).cast("string").alias("error_type"), detail.alias("metadata"),
    )
    return log_events.events(rows).select("event_id", "problem", "line")


@query(
    """SELECT DISTINCT doc_id % 16 AS bucket, CASE doc_id % 16 WHEN 1 THEN 'UNEXPECTED' WHEN 2 THEN 'DUPLICATE_PATH' WHEN 3 THEN 'SIZE_MISMATCH' WHEN 4 THEN 'HASH_MISMATCH' WHEN 5 THEN 'MALFORMED_ENTRY' WHEN 6 THEN 'PATH_TRAVERSAL' WHEN 7 THEN 'MISSING' END AS problem
FROM documents WHERE doc_id % 16 BETWEEN 1 AND 7 UNION ALL SELECT DISTINCT doc_id % 16, 'UNEXPECTED' FROM documents WHERE doc_id % 16 IN (6, 7)"""
)
def artifact_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a file for each of 16 buckets; of seven of them the manifest says something else."""
    root, c = shared_dir(spark), F.col
    docs = table(spark, sf_dir, "documents").withColumn("bucket", c("doc_id") % 16)
    docs.repartition("bucket").write.partitionBy("bucket").option("maxRecordsPerFile", 0).parquet(root)
    bucket = lambda path: F.regexp_extract(path, "bucket=([0-9]+)", 1).cast("long")
    made = written(artifacts.manifest(spark, root).withColumn("bucket", bucket("path")), f"{shared_dir(spark)}/manifest").where("bucket <> 1")
    made = made.unionByName(made.where("bucket = 2"))
    b = c("bucket")
    path = F.when(b == 6, F.concat(F.lit("x/../../"), "path")).when(b == 7, F.concat("path", F.lit(".gone"))).otherwise(c("path"))
    said = made.select(path.alias("path"), F.when(b == 3, c("n_bytes") + 1).otherwise(c("n_bytes")).alias("n_bytes"), F.when(b == 4, F.sha2("sha256", 256)).when(b == 5, "x").otherwise(c("sha256")).alias("sha256"))
    return artifacts.verify(spark, said, root).select(bucket("path").alias("bucket"), "problem")


@query(
    r"""WITH d AS (SELECT doc_id, doc_id % 4 AS k, regexp_matches(coalesce(text, ''), '[^ \t\n\r\f\v\x00]') AS shown FROM documents)
SELECT doc_id, 1 AS page_number, CASE WHEN k > 1 THEN 'FAILED' WHEN shown THEN 'SUCCESS' ELSE 'OCR_REQUIRED' END AS status, CASE k WHEN 2 THEN 'ENCRYPTED_PDF_UNSUPPORTED' WHEN 3 THEN 'PARSER_EXCEPTION' ELSE CASE WHEN NOT shown THEN 'EMPTY_PAGE' END END AS warning FROM d
UNION ALL SELECT doc_id, 2, 'OCR_REQUIRED', 'EMPTY_PAGE' FROM d WHERE k = 1"""
)
def pdf_page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDF bytes: a page of text, one more without, an encrypted file, and one without its structure."""
    k = F.col("doc_id") % 4
    shown = F.concat(F.lit("BT /F1 12 Tf <"), F.hex(F.coalesce("text", F.lit("")).cast("binary")), F.lit("> Tj ET"))
    content = F.concat(F.lit("\n4 0 obj\n<< /Length "), F.length(shown), F.lit(" >>\nstream\n"), shown, F.lit("\nendstream\nendobj\n"))
    page = "\n{} 0 obj\n<< /Type /Page /Parent 2 0 R {} >>\nendobj"
    second = F.when(k == 1, page.format(5, "")).otherwise("")
    tree = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R"), F.when(k == 1, " 5 0 R").otherwise(""), F.lit("] >>\nendobj"), F.lit(page.format(3, "/Contents 4 0 R")), second)
    last = F.concat(F.lit("trailer\n<< /Root 1 0 R "), F.when(k == 2, "/Encrypt 9 0 R").otherwise(""), F.lit(" >>\nstartxref\n0\n%%EOF"))
    files = table(spark, sf_dir, "documents").select("doc_id", F.when(k == 3, F.concat(F.lit("%PDF-1.4\n"), shown)).otherwise(F.concat(tree, content, last)).cast("binary").alias("content"))
    return pdf.page_states(files, "doc_id")
