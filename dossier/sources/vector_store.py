"""A vector index on disk: written by coarse cell, verified before use, searched in some cells or in all.

Below its folder an index has ``vectors`` (rows sorted by cell), ``cells`` (the trained centroids), ``shards`` (signatures of
parts of the index) and, written last, ``meta``: one row with model, dimension, counts and the whole index's signature. A
folder without meta is no index, so an interrupted build is never read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions.identity import digest, listed
from dossier.functions.shared import Files
from dossier.operators import records

VERSION = "1.0.0"
#: Vectors per cell that centroids are fitted to, those with the smallest hash of their id; cells at most; rounds of the fit.
SAMPLE_PER_CELL, MOST_CELLS, ROUNDS, SEED = 64, 4_096, 10, 7
#: Chunks of a shard, whose ids and hashes are hashed in one row where there are several shards; vectors and queries that meet in one task.
SHARD, SLICE, BLOCK = 65_536, 32_768, 16_384
META = "schema_version string, model string, dimension int, normalize boolean, config string, n_vectors long, n_cells int, n_shards int, signature string"
FAULT = "problem string, detail string"


class IndexFault(Exception):
    """An index that can't be built, or must not be used: ``problem`` says why."""

    def __init__(self, problem: str, detail: str = ""):
        super().__init__(f"{problem}: {detail}" if detail else problem)
        self.problem, self.detail = problem, detail


def unit(vector: Column) -> Column:
    """A vector (of doubles) with norm 1; a zero one stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def _finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _checked(vectors: DataFrame, dimension: int) -> tuple[int, list[tuple[str, str]]]:
    """Number of vectors (chunk_id, content_hash, vector), and what is wrong with them: one pass, and one over the ids."""
    seen = vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("vector").isNull() | (F.size("vector") != dimension)).alias("width"),
        F.count_if(~F.coalesce(_finite(F.col("vector")), F.lit(True))).alias("finite"),
        F.count_if(F.col("chunk_id").isNull() | F.col("content_hash").isNull()).alias("unnamed"),
    ).first()
    twice = vectors.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()
    found = [
        ("DIMENSION_MISMATCH", seen.width, f"{seen.width} vectors are not of {dimension} numbers"),
        ("NON_FINITE", seen.finite, f"{seen.finite} vectors hold a null, infinite or undefined number"),
        ("MISSING_IDENTITY", seen.unnamed, f"{seen.unnamed} vectors have no id or hash"),
        ("DUPLICATE_ID", twice, f"{twice} ids come more than once"),
    ]
    return seen.n, [(problem, detail) for problem, n, detail in found if n]


def _signed(vectors: DataFrame, n_shards: int, model: str, dimension: int, normalize: bool, config: str) -> DataFrame:
    """(shard, n_chunks, index_signature): chunks are dealt by a hash of their id, in its order within a shard."""
    if n_shards == 1:
        return _signed_whole(vectors, model, dimension, normalize, config)
    dealt = vectors.select(F.pmod(F.xxhash64("chunk_id"), F.lit(n_shards)).alias("shard"), F.col("chunk_id").alias("position"), "chunk_id", "content_hash")
    return records.dense_index_signatures(dealt, "shard", model, dimension, normalize, config)


def _signed_whole(vectors: DataFrame, model: str, dimension: int, normalize: bool, config: str) -> DataFrame:
    """records.dense_index_signatures() of one shard of any size, of which no task holds more than a stretch.

    The ids, then the hashes, are sorted and joined to stretches of text by all tasks. One hash over all of them is what
    the signature is, so one task reads the stretches in order; it keeps one at a time. No chunks give no rows.
    """
    name, content = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("chunk_id", "content_hash"))
    parts = F.array(F.struct(F.lit(0).alias("kind"), name.alias("text")), F.struct(F.lit(1).alias("kind"), content.alias("text")))
    rows = vectors.select(F.col("chunk_id").alias("position"), F.col("content_hash").alias("tie"), F.inline(parts))
    order = ("kind", "position", "tie")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "kind", "text")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(b for b in batches if b.num_rows):
            kinds, texts = batch.column("kind").to_numpy(), batch.column("text")
            own = [(kind, texts.filter(pa.array(kinds == kind)).to_pylist()) for kind in np.unique(kinds).tolist()]
            held = [(batch.column("part")[0].as_py(), n, kind, len(x), ",".join(x)) for kind, x in own]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["part", "place", "kind", "n", "text"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, last, n = hashlib.sha256("|".join(["dense-index-v1", model, str(dimension), str(normalize), config]).encode()), -1, 0
        for batch in batches:
            for kind, count, text in zip(batch.column("kind").to_pylist(), batch.column("n").to_pylist(), batch.column("text"), strict=True):
                made.update(b"," if kind == last else b"|")
                made.update(text.as_py().encode())
                last, n = kind, n + count * (kind == 0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([n], pa.int64()), pa.array([made.hexdigest()])], names=["shard", "n_chunks", "index_signature"])

    stretches = dealt.mapInArrow(join, "part int, place int, kind int, n long, text string")
    return stretches.repartition(1).sortWithinPartitions("kind", "part", "place").mapInArrow(sign, "shard long, n_chunks long, index_signature string")


def _whole(shards: DataFrame) -> str:
    """An index's signature: its only shard's, or a hash of all of them in order. A row for every SHARD chunks is gathered."""
    rows = F.sort_array(F.collect_list(F.struct("shard", "index_signature")))
    signatures = F.transform(rows, lambda x: x["index_signature"])
    one = F.when(F.size(signatures) == 1, signatures[0]).otherwise(digest("dense-index-shards-v1", listed(signatures)))
    return shards.agg(one.alias("s")).first().s


def build(vectors: DataFrame, path: str, model: str, dimension: int, normalize: bool = True, cells: int | None = None, shard: int | None = SHARD) -> str:
    """Write an index of ``vectors`` (chunk_id, content_hash, vector; other columns are kept) at ``path``; returns its signature.

    cells: coarse cells, the root of the number of vectors unless said. shard: chunks of a shard, None for one shard of all,
    whose signature is made in one pass over ids and hashes. Nothing is written where an id comes twice or is
    missing, or a vector is null, of another dimension or not finite: IndexFault. An empty index has one cell, too.
    """
    spark = vectors.sparkSession
    if Files(spark, path).exists(""):
        raise IndexFault("ALREADY_EXISTS", path)
    n, wrong = _checked(vectors, dimension)
    if wrong:
        raise IndexFault(*wrong[0])
    config, n_shards = records.dense_config("CELLS"), max(1, -(-n // shard)) if shard else 1
    k = max(1, min(cells or math.isqrt(n), MOST_CELLS, max(n, 1)))
    own = F.transform("vector", lambda x: x.cast("double"))
    features = vectors.withColumn("_features", array_to_vector(unit(own) if normalize else own))
    if k > 1:
        sample = features.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE_PER_CELL * k).select("_features")
        fit = KMeans(k=k, seed=SEED, maxIter=ROUNDS, featuresCol="_features", predictionCol="cell").fit(sample)
        dealt, centres = fit.transform(features), [(i, [float(x) for x in c]) for i, c in enumerate(fit.clusterCenters())]
    else:
        dealt, centres = features.withColumn("cell", F.lit(0)), [(0, [0.0] * dimension)]
    # cells lie together, so that a search reads few row groups; a large one spreads over several files
    dealt.drop("_features").repartitionByRange("cell", F.xxhash64("chunk_id")).sortWithinPartitions("cell", "chunk_id").write.parquet(f"{path}/vectors")
    spark.createDataFrame(centres, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/cells")
    _signed(spark.read.parquet(f"{path}/vectors"), n_shards, model, dimension, normalize, config).write.parquet(f"{path}/shards")
    signature = _whole(spark.read.parquet(f"{path}/shards")) or digest_of_none(spark)
    meta = spark.createDataFrame([(VERSION, model, dimension, normalize, config, n, len(centres), n_shards, signature)], META)
    meta.coalesce(1).write.parquet(f"{path}/meta")
    return signature


def digest_of_none(spark: SparkSession) -> str:
    """The signature of an index without chunks."""
    return spark.range(1).select(digest("dense-index-shards-v1", "").alias("s")).first().s


def _meta(spark: SparkSession, path: str) -> dict:
    files = Files(spark, path)
    if not files.exists("meta"):
        raise IndexFault("META_MISSING", "the folder has no meta, or its build didn't end")
    try:
        rows = spark.read.parquet(f"{path}/meta").limit(2).collect()
    except Exception as e:
        raise IndexFault("META_UNREADABLE", type(e).__name__) from e
    names = [x.split()[0] for x in META.split(", ")]
    if len(rows) != 1 or any(c not in rows[0] or rows[0][c] is None for c in names):
        raise IndexFault("META_MALFORMED", "meta is not one row with every field")
    if rows[0].schema_version != VERSION:
        raise IndexFault("UNSUPPORTED_VERSION", str(rows[0].schema_version))
    for table in ("vectors", "cells", "shards"):
        if not files.exists(table):
            raise IndexFault("TABLE_MISSING", table)
    return rows[0].asDict()


def faults(spark: SparkSession, path: str, model: str | None = None, dimension: int | None = None) -> DataFrame:
    """(problem, detail) of everything that speaks against using the index at ``path``; no rows if it is sound.

    model, dimension: what the caller's queries are made with. Counts, numbers and signatures are made anew from the
    vectors; a damaged shard is told by its number. Never raises for a damaged index.
    """
    try:
        meta = _meta(spark, path)
        vectors = spark.read.parquet(f"{path}/vectors")
        if missing := {"chunk_id", "content_hash", "vector", "cell"} - set(vectors.columns):
            raise IndexFault("VECTORS_MALFORMED", f"no column {', '.join(sorted(missing))}")
        n, wrong = _checked(vectors, meta["dimension"])
        n_cells = spark.read.parquet(f"{path}/cells").count()
    except IndexFault as e:
        return spark.createDataFrame([(e.problem, e.detail)], FAULT)
    except Exception as e:  # unreadable Parquet, a lost file
        return spark.createDataFrame([("UNREADABLE", type(e).__name__)], FAULT)
    if model is not None and model != meta["model"]:
        wrong.append(("MODEL_MISMATCH", f"made with {meta['model']}, asked with {model}"))
    if dimension is not None and dimension != meta["dimension"]:
        wrong.append(("QUERY_DIMENSION_MISMATCH", f"{meta['dimension']} in the index, {dimension} asked"))
    if n != meta["n_vectors"]:
        wrong.append(("COUNT_MISMATCH", f"{n} vectors, {meta['n_vectors']} in meta"))
    if n_cells != meta["n_cells"]:
        wrong.append(("CELLS_MISMATCH", f"{n_cells} centroids, {meta['n_cells']} in meta"))
    now = _signed(vectors, meta["n_shards"], meta["model"], meta["dimension"], meta["normalize"], meta["config"])
    stored = spark.read.parquet(f"{path}/shards")
    if (_whole(now) or digest_of_none(spark)) != meta["signature"]:
        wrong.append(("SIGNATURE_MISMATCH", "the chunks no longer give the signature in meta"))
    both = stored.select("shard", F.col("index_signature").alias("then")).join(now.select("shard", F.col("index_signature").alias("now")), "shard", "full_outer")
    shards = both.where(~F.col("then").eqNullSafe(F.col("now"))).select(F.lit("SHARD_MISMATCH").alias("problem"), F.concat(F.lit("shard "), F.col("shard").cast("string")).alias("detail"))
    return spark.createDataFrame(wrong, FAULT).unionByName(shards)


class VectorIndex:
    """A verified index: its meta row as a dict, and its vectors."""

    def __init__(self, spark: SparkSession, path: str, meta: dict):
        self.spark, self.path, self.meta = spark, path, meta
        self.vectors = spark.read.parquet(f"{path}/vectors")

    def centroids(self) -> np.ndarray:
        """MOST_CELLS rows at most."""
        rows = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()
        return np.array([r.centroid for r in rows], float)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, model: str | None = None) -> DataFrame:
        """query_id, chunk_id, score, rank: the k nearest of each of ``queries`` (query_id, vector), ties by chunk_id.

        probes: how many of the nearest cells are searched; None searches all, and so is exact. Scores are cosines, or inner
        products in an index that isn't normalised. Queries that are null, of another dimension or not finite give no rows.
        model: IndexFault unless the index was made with it.
        """
        if k < 1 or (probes is not None and probes < 1):
            raise ValueError("k and probes must be positive")
        if model is not None and model != self.meta["model"]:
            raise IndexFault("MODEL_MISMATCH", f"made with {self.meta['model']}, asked with {model}")
        normalize, n_cells = self.meta["normalize"], self.meta["n_cells"]
        asked = queries.where((F.size("vector") == self.meta["dimension"]) & _finite(F.col("vector"))).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        sizes = self.vectors.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("n_slices"))  # n_cells rows
        n_blocks = max(1, -(-asked.count() // BLOCK))
        if probes is None or probes >= n_cells:
            near = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))))
        else:
            centres = self.centroids()

            def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        far = _distances(_matrix(batch.column("vector"), normalize), centres)
                        cells = np.argpartition(far, probes - 1, axis=1)[:, :probes].astype(np.int32)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, probes, dtype=np.int32)), pa.array(cells.ravel()))
                        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vector"), lists], names=["query_id", "vector", "cells"])

            kind = asked.schema["query_id"].dataType.simpleString()
            near = asked.mapInArrow(nearest, f"query_id {kind}, vector array<double>, cells array<int>").select("query_id", "vector", F.explode("cells").alias("cell"))
        # a slice of a cell meets a block of the queries that probe the cell: both sides of a group are bounded
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1 if isinstance(n, str) else F.lit(n - 1).cast("long")))
        small = F.broadcast(sizes)  # MOST_CELLS rows at most
        held = self.vectors.select("chunk_id", F.col("vector").cast("array<double>").alias("vector"), "cell").join(small, "cell")
        held = held.withColumn("slice", F.pmod(F.xxhash64("chunk_id"), F.col("n_slices"))).drop("n_slices").withColumn("block", every(n_blocks))
        near = near.join(small, "cell").withColumn("slice", every("n_slices")).drop("n_slices").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
        keys = ["cell", "slice", "block"]
        kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("query_id", near), ("chunk_id", held))}
        found = held.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInArrow(lambda a, b: _best(a, b, k, normalize), f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id")))
        return found.withColumn("rank", place).where(F.col("rank") <= k)


def load(spark: SparkSession, path: str, model: str | None = None, dimension: int | None = None) -> VectorIndex:
    """The index at ``path``, if nothing speaks against it; else IndexFault with the first problem."""
    wrong = faults(spark, path, model, dimension).limit(1).collect()
    if wrong:
        raise IndexFault(wrong[0].problem, wrong[0].detail)
    return VectorIndex(spark, path, _meta(spark, path))


def _matrix(column: pa.Array | pa.ChunkedArray, normalize: bool) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    if not normalize:
        return x
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres * centres).sum(axis=1) - 2 * x @ centres.T


def _best(vectors: pa.Table, queries: pa.Table, k: int, normalize: bool) -> pa.Table:
    """The k best of a slice for each query of a block."""
    ids, names = vectors.column("chunk_id"), queries.column("query_id")
    if not len(ids) or not len(names):
        return pa.table({"query_id": names.slice(0, 0), "chunk_id": ids.slice(0, 0), "score": pa.array([], pa.float64())})
    vectors = vectors.sort_by("chunk_id")
    x, asked = _matrix(vectors.column("vector"), normalize), _matrix(queries.column("vector"), normalize)
    rows, places, scores = [], [], []
    for first in range(0, len(asked), 512):
        score = asked[first : first + 512] @ x.T
        if score.shape[1] > k:  # the k-th best and all ties with it, then in order
            least = np.partition(score, -k, axis=1)[:, -k]
            row, place = np.nonzero(score >= least[:, None])
        else:
            row, place = np.nonzero(np.ones(score.shape, bool))
        value = score[row, place]
        order = np.lexsort((place, -value, row))
        row, place, value = row[order], place[order], value[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        rows.append(row[kept] + first)
        places.append(place[kept])
        scores.append(value[kept])
    row, place = pa.array(np.concatenate(rows)), pa.array(np.concatenate(places))
    return pa.table({"query_id": names.take(row), "chunk_id": vectors.column("chunk_id").take(place), "score": pa.array(np.concatenate(scores))})


