"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.containment import FOUND, WindowIndex
from dossier.llm.scratch import removed, written

#: Items, and bytes of their texts, in one index; more items are searched in further blocks.
ITEMS_A_BLOCK, BYTES_A_BLOCK = 20_000, 32 << 20


def indexes(benchmark: DataFrame) -> Iterator[WindowIndex]:
    """The items of ``benchmark`` (item_id, text) in blocks of bounded size; one block is held at a time. Nulls make no item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(1, -(-size.n // ITEMS_A_BLOCK), -(-size.bytes // BYTES_A_BLOCK))
    for block in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).orderBy("item_id", "text").collect()
        yield WindowIndex([r.item_id for r in rows], [r.text for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document of ``docs`` (doc_id, text) and an item of ``benchmark`` (item_id, text) that it holds.

    A document holds an item if at least 75 in 100 of the item's distinct five-word shingles are among its own (words are
    runs outside ``\\x20\\x09-\\x0D``, A-Z lower-cased). An item of fewer than five words is held where
    its words stand in a row. Null and empty texts on either side match nothing. Repeated rows give repeated pairs, those
    without a doc_id pairs without one. Other columns are ignored; an empty table gives no rows. A benchmark of several
    blocks is searched block by block, each written. Returns doc_id, item_id, n_shared, n_item, containment.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found, last = [], None
    for index in indexes(benchmark):
        if last is not None:
            found.append(written(last, "contaminated"))
        last = texts.mapInArrow(index.scan, FOUND)
    return reduce(DataFrame.unionByName, [*found, last]).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark``, as contaminated() means it, with all their columns.

    What a block of items leaves is written before the next one is searched, so a task holds one index at a time, and so
    does the driver; the tables before are deleted.
    """
    kept, last = docs, None
    for index in indexes(benchmark):
        if last is not None:
            further = written(last, "decontaminated")
            if kept is not docs:
                removed(kept)
            kept = further
        last = kept.mapInArrow(index.without, docs.schema)
    return last
