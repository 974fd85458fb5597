"""Provider stages: failures as rows, resumed runs, one load a task."""

import os
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from dossier.jobs import providers as P

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class Fake:
    """Counts its loads and calls in files, since tasks run elsewhere."""

    def __init__(self, folder, answer, output="string", model="m1", load_error=None):
        self.name, self.model, self.output, self.folder, self.answer, self.load_error = "fake", model, output, str(folder), answer, load_error

    def note(self, what, text):
        with open(os.path.join(self.folder, what), "a", encoding="utf-8") as f:
            f.write(f"{text}\n")

    def load(self):
        self.note("loads", "1")
        if self.load_error:
            raise RuntimeError(self.load_error)

        def call(batch):
            for x in batch:
                self.note("calls", x)
            return self.answer(batch)

        return call


def lines(folder, what):
    path = os.path.join(str(folder), what)
    return open(path, encoding="utf-8").read().split("\n")[:-1] if os.path.exists(path) else []


def upper(batch):
    if any(x == "bad" for x in batch):
        raise ValueError("no answer")
    return [x.upper() for x in batch]


def rows(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "id long, input string")


def by_id(found):
    return {r.id: (r.success, r.output, r.failure_reason) for r in found.collect()}


def test_one_bad_input_does_not_cost_the_others(spark, tmp_path):
    found = by_id(P.answered(rows(spark, ["a", "bad", "c", None, "", "d"]), Fake(tmp_path, upper), str(tmp_path / "out"), batch=4))
    assert found == {0: (True, "A", None), 1: (False, None, "ValueError: no answer"), 2: (True, "C", None), 3: (False, None, "NULL_INPUT"), 4: (False, None, "EMPTY_OUTPUT"), 5: (True, "D", None)}


def test_nothing_is_asked_twice(spark, tmp_path):
    path, fake = str(tmp_path / "out"), Fake(tmp_path, upper)
    P.answered(rows(spark, ["a", "b", "bad"]), fake, path)
    n = len(lines(tmp_path, "calls"))
    found = by_id(P.answered(rows(spark, ["a", "b", "bad", "new"]), fake, path))
    assert lines(tmp_path, "calls")[n:] == ["new"] and found[3] == (True, "NEW", None) and found[2][0] is False
    # a changed input, another model and failed inputs are asked
    assert by_id(P.answered(rows(spark, ["a", "other"]), fake, path))[1] == (True, "OTHER", None)
    assert by_id(P.answered(rows(spark, ["a"]), Fake(tmp_path, lambda b: [x * 2 for x in b], model="m2"), path)) == {0: (True, "aa", None)}
    healed = Fake(tmp_path, lambda b: [x.upper() for x in b])
    assert by_id(P.answered(rows(spark, ["a", "b", "bad"]), healed, path, again=True)) == {0: (True, "A", None), 1: (True, "B", None), 2: (True, "BAD", None)}
    assert lines(tmp_path, "calls")[-1] == "bad"


def test_a_killed_run_is_resumed(spark, tmp_path, monkeypatch):
    path, fake = str(tmp_path / "out"), Fake(tmp_path, upper)
    texts = [f"t{i}" for i in range(40)]
    real, n = P.ask, []

    def dies(*a, **k):
        n.append(1)
        if len(n) == 3:
            raise KeyboardInterrupt
        return real(*a, **k)

    monkeypatch.setattr(P, "ask", dies)
    with pytest.raises(KeyboardInterrupt):
        P.answered(rows(spark, texts), fake, path, size=10)
    monkeypatch.setattr(P, "ask", real)
    before = lines(tmp_path, "calls")
    assert 0 < len(before) < 40
    found = by_id(P.answered(rows(spark, texts), fake, path, size=10))
    assert {k: v[1] for k, v in found.items()} == {i: t.upper() for i, t in enumerate(texts)}
    assert sorted(lines(tmp_path, "calls")) == sorted(texts)  # each exactly once over both runs


def test_many_slices_are_few_jobs(spark, tmp_path):
    tracker, group = spark.sparkContext.statusTracker(), str(tmp_path)
    spark.sparkContext.setJobGroup(group, "")
    try:
        found = P.answered(rows(spark, [f"t{i}" for i in range(300)]), Fake(tmp_path, upper), str(tmp_path / "out"), size=2)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup(group)) < 100  # of 150 slices
    assert found.where("success").count() == 300 and sorted(lines(tmp_path, "calls")) == sorted(f"t{i}" for i in range(300))


def test_a_job_that_dies_keeps_the_slices_that_ended(spark, tmp_path, monkeypatch):
    path, folder = str(tmp_path / "out"), str(tmp_path)

    def dies(batch):
        if "t7" in batch:
            while not [x for x in (os.listdir(path) if os.path.exists(path) else ()) if x.endswith(".parquet")]:
                time.sleep(0.1)
            os._exit(1)
        return [x.upper() for x in batch]

    texts = [f"t{i}" for i in range(40)]
    monkeypatch.setattr(P, "JOBS", 1)
    with pytest.raises(Exception, match="(?i)abort|crash"):
        P.answered(rows(spark, texts), Fake(folder, dies), path, size=5)
    kept = {r.output for r in spark.read.parquet(path).collect()}
    assert 0 < len(kept) < 40
    found = by_id(P.answered(rows(spark, texts), Fake(folder, upper), path, size=5))
    assert {k: v[1] for k, v in found.items()} == {i: t.upper() for i, t in enumerate(texts)}
    calls = lines(tmp_path, "calls")
    assert all(calls.count(x.lower()) == 1 for x in kept)


def test_one_load_a_task_and_loads_that_fail(spark, tmp_path):
    P.answered(rows(spark, [f"t{i}" for i in range(200)]).repartition(2), Fake(tmp_path, upper), str(tmp_path / "a"), batch=3)
    assert 1 <= len(lines(tmp_path, "loads")) <= spark.sparkContext.defaultParallelism and len(lines(tmp_path, "calls")) == 200
    found = by_id(P.answered(rows(spark, ["a", "b"]), Fake(tmp_path, upper, load_error="no weights"), str(tmp_path / "b")))
    assert set(found.values()) == {(False, None, "RuntimeError: no weights")}
    short = by_id(P.answered(rows(spark, ["a", "b"]).coalesce(1), Fake(tmp_path, lambda b: []), str(tmp_path / "c")))
    assert set(short.values()) == {(False, None, "CallFailed: 0 answers for 1 inputs")}
    assert P.answered(rows(spark, []), Fake(tmp_path, upper), str(tmp_path / "d")).count() == 0


def test_embedding_reranking_generation_and_translation(spark, tmp_path):
    texts = spark.createDataFrame([(1, "ab"), (2, "short"), (3, "nan")], "id long, text string")
    vectors = Fake(tmp_path, lambda b: [[float("nan")] * 2 if x == "nan" else [1.0] if x == "short" else [1.0, 2.0] for x in b], "array<double>")
    found = {r.id: (r.embedding, r.failure_reason) for r in P.embedded(texts, vectors, str(tmp_path / "e"), 2).collect()}
    assert found == {1: ([1.0, 2.0], None), 2: (None, "WRONG_DIMENSION"), 3: (None, "NON_FINITE")}
    pairs = spark.createDataFrame([(1, 10, "q", "aaa"), (1, 11, "q", "a"), (1, 12, "q", "inf")], "query_id long, id long, query string, text string")
    scores = Fake(tmp_path, lambda b: [float("inf") if x["text"] == "inf" else float(len(x["text"])) for x in b], "double")
    ranked = P.reranked(pairs, F.struct("query", "text"), scores, str(tmp_path / "r"), 5).collect()
    assert [(r.query_id, r.id, r.score, r["rank"]) for r in sorted(ranked, key=lambda r: r["rank"])] == [(1, 10, 3.0, 1), (1, 11, 1.0, 2)]
    prompts = spark.createDataFrame([(1, "why"), (2, "bad")], "query_id long, prompt string")
    answers = P.generated(prompts, Fake(tmp_path, upper), str(tmp_path / "g"))
    done = {r.query_id: (r.success, r.answer, r.translation, r.translation_ok) for r in P.translated(answers, Fake(tmp_path, lambda b: [f"<{x}>" for x in b]), str(tmp_path / "t")).collect()}
    assert done == {1: (True, "WHY", "<WHY>", True), 2: (False, None, None, None)}
