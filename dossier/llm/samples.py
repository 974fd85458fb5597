"""Bounded, repeatable samples of documents for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: what sets held-out documents apart. A null id counts as no text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """``most`` rows of (doc_id, ...) at most: those whose id has the smallest hash. Ids are chosen before texts are read."""
    ids = [r.doc_id for r in rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    return rows.where(F.col("doc_id").isin(ids)) if ids else rows.limit(0)

