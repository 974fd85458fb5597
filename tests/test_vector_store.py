"""The vector index on disk: round trips, every kind of damage, recall, awkward vectors."""

import pytest
from pyspark.sql import functions as F

from dossier.operators.dense import dense_topk
from dossier.sources import vector_store as V

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def rows(spark):
    found = spark.read.parquet(f"{SF}/embeddings.parquet")
    return found.select(F.format_string("c%05d", "vec_id").alias("chunk_id"), F.sha2(F.col("vec_id").cast("string"), 256).alias("content_hash"), F.col("embedding").alias("vector"), "vec_id", "label")


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "one")
    V.build(rows, path, "model-a", 64, shard=500)
    return path


def ranked(found):
    return {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 9)) for r in found.collect()}


def asked(rows):
    return rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")


def test_exact_search_equals_dense_topk(spark, rows, index):
    found = ranked(V.load(spark, index, "model-a", 64).search(asked(rows), 10))
    plain = dense_topk(asked(rows).withColumnRenamed("vector", "embedding"), rows.withColumnRenamed("vector", "embedding"), 10)
    assert found == ranked(plain.withColumn("chunk_id", F.format_string("c%05d", "vec_id")))


def test_recall_rises_with_the_cells_probed(spark, rows, index):
    store = V.load(spark, index)
    best = {(q, c[0]) for (q, _), c in ranked(store.search(asked(rows), 10)).items()}
    recall = [len({(q, c[0]) for (q, _), c in ranked(store.search(asked(rows), 10, probes=p)).items()} & best) / len(best) for p in (4, 16, 32)]
    assert recall == sorted(recall) and recall[1] > 0.7 and recall[2] > 0.93


def test_small_slices_and_blocks_change_nothing(spark, rows, index, monkeypatch):
    store = V.load(spark, index)
    whole = ranked(store.search(asked(rows), 3, probes=20))
    monkeypatch.setattr(V, "SLICE", 20)
    monkeypatch.setattr(V, "BLOCK", 7)
    assert ranked(store.search(asked(rows), 3, probes=20)) == whole


def test_the_signature_of_one_shard_is_that_of_the_index_in_id_order(spark, rows, tmp_path):
    import hashlib

    signature = V.build(rows.limit(40), str(tmp_path / "x"), "m", 64)
    held = rows.limit(40).orderBy("chunk_id").collect()
    parts = ["dense-index-v1", "m", "64", "True", "dense-index-config:v1.0.0:type=CELLS", ",".join(r.chunk_id for r in held), ",".join(r.content_hash for r in held)]
    assert signature == hashlib.sha256("|".join(parts).encode()).hexdigest()


def test_one_shard_of_any_size_is_signed_in_stretches(spark, rows, tmp_path):
    import hashlib

    some = rows.limit(700)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 50)
    try:
        signature = V.build(some, str(tmp_path / "x"), "m", 64, shard=None)
        assert V.faults(spark, str(tmp_path / "x"), "m", 64).count() == 0
    finally:
        spark.conf.set(key, before)
    held = some.orderBy("chunk_id").collect()
    parts = ["dense-index-v1", "m", "64", "True", "dense-index-config:v1.0.0:type=CELLS", ",".join(r.chunk_id for r in held), ",".join(r.content_hash for r in held)]
    assert signature == hashlib.sha256("|".join(parts).encode()).hexdigest()
    assert spark.read.parquet(str(tmp_path / "x" / "shards")).select("shard", "n_chunks").collect() == [(0, 700)]
    V.build(rows.limit(0), str(tmp_path / "none"), "m", 64, shard=None)
    assert V.faults(spark, str(tmp_path / "none"), "m", 64).count() == 0


@pytest.mark.parametrize("name", ["vector_index_build", "vector_index_faults"])
def test_queries_keep_one_shard_beyond_the_usual_size(spark, name, monkeypatch):
    import oracle
    from dossier.jobs.queries import ORACLE_SQL, QUERIES

    monkeypatch.setattr(V.build, "__defaults__", (True, None, 100))  # as if there were more vectors than SHARD
    assert oracle.difference(QUERIES[name](spark, SF), oracle.connect(SF), ORACLE_SQL[name]) == ""


def damaged(spark, index, to, table, change):
    for name in ("vectors", "cells", "shards", "meta"):
        df = spark.read.parquet(f"{index}/{name}")
        df = change(df) if name == table else df
        if df is not None:
            df.write.parquet(f"{to}/{name}")
    return {r.problem for r in V.faults(spark, str(to), "model-a", 64).collect()}


@pytest.mark.parametrize(
    ("table", "change", "problems"),
    [
        ("vectors", lambda d: d, set()),
        ("vectors", lambda d: d.where("vec_id <> 7"), {"COUNT_MISMATCH", "SIGNATURE_MISMATCH", "SHARD_MISMATCH"}),
        ("vectors", lambda d: d.unionByName(d.where("vec_id = 7")), {"DUPLICATE_ID", "COUNT_MISMATCH", "SIGNATURE_MISMATCH", "SHARD_MISMATCH"}),
        ("vectors", lambda d: d.withColumn("content_hash", F.when(F.col("vec_id") == 7, "0").otherwise(F.col("content_hash"))), {"SIGNATURE_MISMATCH", "SHARD_MISMATCH"}),
        ("vectors", lambda d: d.withColumn("vector", F.when(F.col("vec_id") == 7, F.slice("vector", 1, 63)).otherwise(F.col("vector"))), {"DIMENSION_MISMATCH"}),
        ("vectors", lambda d: d.withColumn("vector", F.when(F.col("vec_id") == 7, F.transform("vector", lambda x: x * float("nan"))).otherwise(F.col("vector"))), {"NON_FINITE"}),
        ("vectors", lambda d: d.drop("content_hash"), {"VECTORS_MALFORMED"}),
        ("vectors", lambda d: None, {"TABLE_MISSING"}),
        ("cells", lambda d: d.where("cell > 0"), {"CELLS_MISMATCH"}),
        ("shards", lambda d: d.where("shard <> 1"), {"SHARD_MISMATCH"}),
        ("meta", lambda d: None, {"META_MISSING"}),
        ("meta", lambda d: d.drop("signature"), {"META_MALFORMED"}),
        ("meta", lambda d: d.withColumn("model", F.lit(None).cast("string")), {"META_MALFORMED"}),
        ("meta", lambda d: d.withColumn("schema_version", F.lit("9")), {"UNSUPPORTED_VERSION"}),
        ("meta", lambda d: d.withColumn("dimension", F.lit(32)), {"DIMENSION_MISMATCH", "QUERY_DIMENSION_MISMATCH", "SIGNATURE_MISMATCH", "SHARD_MISMATCH"}),
        ("meta", lambda d: d.withColumn("signature", F.lit("0" * 64)), {"SIGNATURE_MISMATCH"}),
        ("meta", lambda d: d.withColumn("model", F.lit("other")), {"MODEL_MISMATCH", "SIGNATURE_MISMATCH", "SHARD_MISMATCH"}),
    ],
)
def test_damage_is_told(spark, index, tmp_path, table, change, problems):
    assert damaged(spark, index, tmp_path / "d", table, change) == problems
    if problems:
        with pytest.raises(V.IndexFault) as e:
            V.load(spark, str(tmp_path / "d"), "model-a", 64)
        assert e.value.problem in problems


def test_bytes_that_are_no_parquet(spark, index, tmp_path):
    import shutil

    shutil.copytree(index, tmp_path / "d")
    for path in (tmp_path / "d" / "meta").glob("*.parquet"):
        path.write_bytes(b"nothing")
    for path in (tmp_path / "d" / "meta").glob(".*.crc"):
        path.unlink()
    assert [r.problem for r in V.faults(spark, str(tmp_path / "d")).collect()] == ["META_UNREADABLE"]


@pytest.mark.parametrize(("change", "problem"), [("array(1.0D)", "DIMENSION_MISMATCH"), ("NULL", "DIMENSION_MISMATCH"), ("array(1.0D, double('inf'))", "NON_FINITE"), ("array(1.0D, NULL)", "NON_FINITE")])
def test_what_cannot_be_indexed(spark, tmp_path, change, problem):
    rows = spark.sql(f"SELECT 'a' AS chunk_id, 'h' AS content_hash, array(1.0D, 2.0D) AS vector UNION ALL SELECT 'b', 'h', {change}")
    with pytest.raises(V.IndexFault) as e:
        V.build(rows, str(tmp_path / "x"), "m", 2)
    assert e.value.problem == problem and not (tmp_path / "x").exists()


def test_awkward_indexes_and_queries(spark, tmp_path, index):
    with pytest.raises(V.IndexFault, match="ALREADY_EXISTS"):
        V.build(spark.sql("SELECT 'a' AS chunk_id, 'h' AS content_hash, array(1.0D) AS vector"), index, "m", 1)
    with pytest.raises(V.IndexFault, match="DUPLICATE_ID"):
        V.build(spark.sql("SELECT 'a' AS chunk_id, 'h' AS content_hash, array(1.0D) AS vector FROM range(2)"), str(tmp_path / "twice"), "m", 1)
    zero = spark.createDataFrame([("a", "h", [0.0, 0.0]), ("b", "h", [3.0, 0.0]), ("c", "h", [1.0, 0.0])], "chunk_id string, content_hash string, vector array<double>")
    V.build(zero, str(tmp_path / "zero"), "m", 2)
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 0.0])], "query_id long, vector array<double>")
    store = V.load(spark, str(tmp_path / "zero"))
    assert ranked(store.search(queries, 2)) == {(1, 1): ("b", 1.0), (1, 2): ("c", 1.0), (5, 1): ("a", 0.0), (5, 2): ("b", 0.0)}
    with pytest.raises(V.IndexFault, match="MODEL_MISMATCH"):
        store.search(queries, 2, model="other")
    V.build(zero.limit(0), str(tmp_path / "none"), "m", 2)
    assert V.load(spark, str(tmp_path / "none"), "m", 2).search(queries, 2).count() == 0
    V.build(zero, str(tmp_path / "dots"), "m", 2, normalize=False, cells=2)
    assert ranked(V.load(spark, str(tmp_path / "dots")).search(queries, 1))[(1, 1)] == ("b", 6.0)
