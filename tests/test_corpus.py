"""The pinned corpus, from real manifests and files: sound, and damaged in each way."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from dossier.jobs import corpus
from dossier.operators import admission
from dossier.sources import files

TEXTS = {"A": "PART ONE\n\nSome words here.\n\nMore words.", "B": "Only one line.", "C": "x" * 2500}


def manifest(name, **more):
    own = {"document_id": name, "source_family_id": "SF-05", "jurisdiction": "INDIA", "synthetic": False, "content_hash": hashlib.sha256(TEXTS[name].encode()).hexdigest(), "admission_status": "ADMIT", "path": f"{name}.txt"}
    return {k: v for k, v in {**own, **more}.items() if v != "GONE"}


@pytest.fixture
def work(spark, tmp_path):
    for folder in ("raw", "manifest"):
        (tmp_path / folder).mkdir()
    for name, text in TEXTS.items():
        (tmp_path / "raw" / f"{name}.txt").write_text(text)
        (tmp_path / "manifest" / f"{name}.json").write_text(json.dumps(manifest(name), indent=1))
    registry = admission.families(spark)

    def parts():
        return corpus.scan_manifests(spark, str(tmp_path / "manifest")), files.scan(spark, str(tmp_path / "raw"))

    rows = corpus.first_pins(*parts(), registry).collect()
    pins = spark.createDataFrame(rows, corpus.PINS)
    return tmp_path, parts, pins, registry


def problems(found):
    return sorted((r.document_id or "", r.layer, r.problem, r.detail) for r in found.problems.collect())


def test_a_sound_corpus(spark, work):
    _, parts, pins, registry = work
    found = corpus.build(*parts(), pins, registry).sound()
    held = found.chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")).collect()
    assert {r.document_id: r.n for r in held} == {r.document_id: r.n_chunks for r in pins.collect()} and {r.document_id: r.size for r in held}["C"] == 2500
    assert found.counts["n_chunks"] == sum(r.n for r in held) and found.counts["n_without_provenance"] == found.counts["n_over_budget"] == found.counts["n_without_block"] == 0
    assert corpus.status(*parts(), pins, registry) == "VALIDATED"


@pytest.mark.parametrize(
    ("damage", "want"),
    [
        (lambda p: (p / "manifest" / "A.json").unlink(), ("MANIFEST", "MANIFEST_MISSING", None)),
        (lambda p: (p / "manifest" / "A.json").write_text('{"document_id":"A",'), None),
        (lambda p: (p / "manifest" / "A.json").write_text(json.dumps(manifest("A", synthetic="no"))), ("MANIFEST", "MANIFEST_MALFORMED", "WRONG_TYPE synthetic")),
        (lambda p: (p / "manifest" / "A.json").write_text(json.dumps(manifest("A", path="GONE"))), ("MANIFEST", "MANIFEST_MALFORMED", "MISSING_FIELD path")),
        (lambda p: (p / "manifest" / "A2.json").write_text(json.dumps(manifest("A"))), ("MANIFEST", "MANIFEST_TWICE", None)),
        (lambda p: (p / "manifest" / "A.json").write_text(json.dumps(manifest("A", synthetic=True, jurisdiction="INTERNATIONAL"))), ("MANIFEST", "PIN_MISMATCH", "jurisdiction,synthetic")),
        (lambda p: (p / "raw" / "A.txt").unlink(), ("INGESTION", "FILE_NOT_FOUND", "QUARANTINED")),
        (lambda p: (p / "raw" / "A.txt").write_text("Other"), ("INGESTION", "CONTENT_HASH_MISMATCH", "QUARANTINED")),
        (lambda p: (p / "manifest" / "A.json").write_text(json.dumps(manifest("A", admission_status="REJECT"))), ("INGESTION", "INVALID_ADMISSION_STATE", "REJECTED_INPUT")),
        (lambda p: (p / "manifest" / "A.json").write_text(json.dumps(manifest("A", path="../raw/A.txt"))), ("INGESTION", "PATH_TRAVERSAL_ATTEMPT", "QUARANTINED")),
    ],
)
def test_damage(spark, work, damage, want):
    path, parts, pins, registry = work
    damage(path)
    found = corpus.build(*parts(), pins, registry)
    rows = problems(found)
    if want is None:  # no id can be read, so the pin misses its manifest and the file is told apart
        assert rows == [("", "MANIFEST", "MANIFEST_MALFORMED", "MALFORMED_JSON"), ("A", "MANIFEST", "MANIFEST_MISSING", None)]
    else:
        assert set(rows) == {("A", *want)}
    assert {r.document_id for r in found.chunks.collect()} == {"B", "C"}
    assert corpus.status(*parts(), pins, registry) == "UNAVAILABLE"
    with pytest.raises(corpus.CorpusFault, match="A|MALFORMED"):
        found.sound()


def test_pins_that_differ(spark, work):
    _, parts, pins, registry = work
    odd = pins.where("document_id <> 'C'").withColumns({"n_chunks": F.when(F.col("document_id") == "A", 9).otherwise(F.col("n_chunks")), "signature": F.when(F.col("document_id") == "B", "0").otherwise(F.col("signature"))})
    n = pins.where("document_id = 'A'").first().n_chunks
    assert problems(corpus.build(*parts(), odd, registry)) == [("A", "CHUNKS", "CHUNK_COUNT_MISMATCH", f"{n} for 9"), ("B", "INDEX", "SIGNATURE_MISMATCH", None), ("C", "MANIFEST", "NOT_PINNED", None)]
    assert corpus.status(spark.range(1), spark.range(1), pins, registry) == "UNAVAILABLE"  # not even the columns
    none = corpus.build(parts()[0].limit(0), parts()[1], pins.limit(0), registry).sound()
    assert none.chunks.count() == 0 and none.counts["n_chunks"] == 0
