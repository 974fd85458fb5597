"""Files of a snapshot held against its manifest: what is missing, changed, stray, listed twice, linked or outside the folder."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.ladders import first_match
from dossier.functions.text import is_blank

#: Paths that climb out of a folder or start elsewhere.
OUTSIDE = r"(^|[/\\])\.\.([/\\]|$)|^[/\\]|^[A-Za-z]:|\\"


def _linked(root: str):
    """Whether a file, or a folder between it and the root, is a symbolic link. Only a local file system has them."""

    @F.pandas_udf("boolean")
    def linked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(path: str) -> bool:
            parts = path.split("/")
            return any(os.path.islink(os.path.join(root, *parts[: i + 1])) for i in range(len(parts)))

        for batch in batches:
            yield batch.map(one).astype(bool)

    return linked


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to the root, n_bytes, sha256, linked) of every file below the root, hidden ones aside.

    Spark lists no file without bytes. A file is read whole by one task, so artefacts are to be parts of 2 GB at most.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:") + "/"
    path = F.substring_index(F.regexp_replace("path", "^file:/+", "/"), base, -1)
    rows = found.select(path.alias("path"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
    local = "://" not in root or root.startswith("file:")
    return rows.withColumn("linked", _linked(base)(F.col("path")) if local else F.lit(False))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """What a snapshot says of its files when it is made."""
    return scan(spark, root).select("path", "n_bytes", "sha256")


def verify(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """(path, problem): one row for each listed or found file that isn't as the manifest (path, n_bytes, sha256) says; none if all is sound.

    Of a path's problems the first counts: listed without a path, without a size or hash, outside the folder, twice, as
    empty (nothing to restore, and no file that the scan would show), missing, a link, of another size, of another hash;
    last, a file that isn't listed. A path listed twice is one row. Paths are compared exactly.
    """
    listed = manifest.groupBy("path").agg(F.count(F.lit(1)).alias("_n"), F.min("n_bytes").alias("_bytes"), F.min("sha256").alias("_hash"))
    found = scan(spark, root).withColumn("_found", F.lit(True))
    joined = listed.withColumn("_listed", F.lit(True)).join(found, "path", "full_outer")
    of = F.col("_listed")
    problem = first_match(
        [
            (of & is_blank(F.col("path")), "PATH_MISSING"),
            (of & (F.col("_bytes").isNull() | (F.col("_bytes") < 0) | ~F.coalesce(F.col("_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))), "MALFORMED_ENTRY"),
            (of & F.col("path").rlike(OUTSIDE), "PATH_TRAVERSAL"),
            (F.col("_n") > 1, "DUPLICATE_PATH"),
            (of & F.col("_found").isNull() & (F.col("_bytes") == 0), "EMPTY_ENTRY"),
            (of & F.col("_found").isNull(), "MISSING"),
            (of.isNull() & F.col("linked"), "UNEXPECTED_LINK"),
            (F.col("linked"), "SYMBOLIC_LINK"),
            (of.isNull(), "UNEXPECTED"),
            (F.col("_bytes") != F.col("n_bytes"), "SIZE_MISMATCH"),
            (F.col("_hash") != F.col("sha256"), "HASH_MISMATCH"),
        ]
    )
    return joined.select("path", problem.alias("problem")).where("problem IS NOT NULL")
