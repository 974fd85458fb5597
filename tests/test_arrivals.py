"""The document-arrival stream: batches that stop halfway, come twice or hold nothing; equal to a batch over all."""

import hashlib

import pytest
from pyspark.sql import functions as F

from dossier.functions.shared import Files
from dossier.operators import admission, lexical
from dossier.streaming import arrivals

SCHEMA = "path string, extension string, content binary, document_id string, source_family_id string, jurisdiction string, content_hash string, admission_status string"


def files(spark, *rows):
    """Rows of (path, document_id, text)."""
    sha = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    return spark.createDataFrame([(p, ".txt", None if t is None else bytearray(t.encode()), d, "SF-01", "INDIA", sha(t) or "x", "ADMIT") for p, d, t in rows], SCHEMA)


def state(spark, root):
    df = {r.term: r.df for r in arrivals.document_frequency(spark, root).collect()}
    one = arrivals.corpus_stats(spark, root).first()
    why = {(r.batch, r.path): r.reason for r in arrivals.read(spark, root, "outcomes").collect()}
    return df, (one.n_docs, one.avg_tokens), why


@pytest.fixture
def registry(spark):
    return admission.families(spark)


def test_a_batch_counts_once_however_often_it_runs(spark, registry, tmp_path, monkeypatch):
    root = str(tmp_path / "root")
    assert state(spark, root) == ({}, (0, 0.0), {})
    first, second = files(spark, ("a", "d1", "one two two"), ("b", "d1", "other"), ("c", "d2", "...")), files(spark, ("e", "d3", "two ﬁve"), ("f", "d1", "late copy"), ("g", None, "no id"), ("h", "d4", None))
    arrivals.add(first, 0, registry, root)
    whole = ({"one": 1, "two": 1}, (2, 1.5), {(0, "a"): None, (0, "b"): "DUPLICATE_DOCUMENT", (0, "c"): None})
    assert state(spark, root) == whole
    # the second stops after its postings: nothing of it is seen, and the first stays
    written = Files.delete
    monkeypatch.setattr(lexical, "tokenized", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        arrivals.add(second, 1, registry, root)
    monkeypatch.undo()
    assert Files.delete is written and state(spark, root) == whole
    for _ in range(2):
        arrivals.add(second, 1, registry, root)
        df, stats, why = state(spark, root)
        assert df == {"one": 1, "two": 2, "five": 1} and stats == (3, 5 / 3)
        assert {p: r for (b, p), r in why.items() if b == 1} == {"e": None, "f": "DUPLICATE_DOCUMENT", "g": "MISSING_DOCUMENT_IDENTITY", "h": "FILE_NOT_FOUND"}
    arrivals.add(first, 0, registry, root)  # an old batch again: what came later stays as it is
    assert state(spark, root)[:2] == (df, stats)
    arrivals.add(second.where("false"), 2, registry, root)
    assert state(spark, root)[:2] == (df, stats)


def test_a_stopped_stream_goes_on(spark, registry, tmp_path):
    source, root, marks = (str(tmp_path / n) for n in ("in", "root", "marks"))
    texts = [(f"p{i}", f"d{i}", f"word{i} shared") for i in range(6)]
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    for part in (texts[:2], texts[2:4]):
        files(spark, *part).coalesce(1).write.mode("append").parquet(source)
    arrivals.start(stream(), registry, root, marks, once=True).awaitTermination()
    files(spark, *texts[4:], ("again", "d0", "word0 shared")).coalesce(1).write.mode("append").parquet(source)
    arrivals.start(stream(), registry, root, marks, once=True).awaitTermination()
    assert arrivals.read(spark, root, "batches").count() == 3
    docs = spark.createDataFrame([(d, t) for _, d, t in texts], "doc_id string, text string")
    assert sorted(arrivals.document_frequency(spark, root).collect()) == sorted(lexical.document_frequency(docs).collect())
    assert arrivals.corpus_stats(spark, root).first() == lexical.corpus_stats(docs).first()
    tf = {(r.document_id, r.term): r.tf for r in arrivals.read(spark, root, "postings").collect()}
    assert tf == {(r.doc_id, r.term): r.tf for r in lexical.term_counts(docs).collect()}
    assert arrivals.read(spark, root, "outcomes").where(F.col("reason") == "DUPLICATE_DOCUMENT").select("path").collect() == [("again",)]
