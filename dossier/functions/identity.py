"""Content-derived ids: SHA-256 over parts joined by bars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str) -> Column:
    """Hex SHA-256 of the parts joined by ``|``; a null part is empty. A str is a literal."""
    columns = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", *columns), 256)


def listed(items: Column) -> Column:
    """Array items joined by commas."""
    return F.array_join(items.cast("array<string>"), ",", "")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_id(document_id: Column, content: Column, signature: str, block_ids: Column, split_index: Column) -> Column:
    return digest("chunk-id-v1", document_id, content, signature, listed(block_ids), split_index)


def evidence_id(schema: str, chunk: Column, content: Column, document_id: Column, family: Column, jurisdiction: Column, block_ids: Column, pages: Column) -> Column:
    return digest("evidence-id-v1", schema, chunk, content, document_id, family, jurisdiction, listed(block_ids), listed(pages))


def pack_id(schema: str, query: Column, evidence_ids: Column, signature: str) -> Column:
    return digest("evidence-pack-v1", schema, query, listed(evidence_ids), signature)


def signature(name: str, *settings: object) -> str:
    """A configuration's signature: made on the driver, as floats print as Python prints them."""
    return "|".join([name, *map(str, settings)])
