"""Chunks of documents by section, within a budget of characters and without losing one."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET, GLUE = 1_000, "\n\n"


def config(budget: int = BUDGET) -> str:
    # Fixed value: how the settings are written in chunk ids.
    return f"chunking-config:v1.0.0:max={budget}:unit=UNICODE_CODE_POINTS"


CONFIG = config()
#: Columns of blocks that may be missing, and what they are then.
GIVEN = {"block_type": "PARAGRAPH", "heading_level": None, "page_number": 1, "rows": None, "warnings": None, "block_id": None}
KINDS = {"block_type": "string", "heading_level": "string", "page_number": "int", "rows": "array<array<string>>", "warnings": "array<string>", "block_id": "string"}
CHUNK = (
    "{id} {kind}, chunk_sequence long, chunk_id string, section long, section_heading_block_id string, section_heading_text string, section_heading_level string, "
    "block_ids array<string>, block_types array<string>, page_numbers array<int>, is_split boolean, split_index int, split_count int, list_group_id string, "
    "table_rows array<array<string>>, warnings array<string>, text string, text_size long, content_hash string"
)


def split_text(text: str, budget: int = BUDGET) -> list[str]:
    """Pieces of ``budget`` characters at most that join to the text: cut behind the last white space, else hard."""
    pieces = []
    while len(text) > budget:
        cut = next((i + 1 for i in range(budget - 1, 0, -1) if text[i].isspace()), budget)
        pieces.append(text[:cut])
        text = text[cut:]
    return [*pieces, text]


def table_text(rows: list[list[str]]) -> str:
    return "\n".join(" | ".join(row) for row in rows)


def row_groups(rows: list[list[str]], budget: int = BUDGET) -> list[list[list[str]]]:
    """Whole rows in groups whose text stays in the budget; a row beyond it is a group of its own. No row: one empty group."""
    groups: list[list[list[str]]] = [[]]
    for row in rows:
        if groups[-1] and len(table_text([*groups[-1], row])) > budget:
            groups.append([])
        groups[-1].append(row)
    return groups


class _Section:
    """The chunks of one section: small blocks are gathered while they fit, tables and large blocks stand alone."""

    def __init__(self, first: Any, budget: int):
        heading = first if first["block_type"] == "HEADING" else None
        self.head = (heading["block_id"], heading["text"], heading["heading_level"]) if heading else (None, None, None)
        self.budget = budget
        self.held: list[Any] = []
        self.list_id: str | None = None
        self.chunks: list[dict] = []

    def _add(self, blocks: list[Any], text: str, place: tuple[int, int], warnings: list[str], rows: list | None = None) -> None:
        self.chunks.append({
            "heading": self.head, "block_ids": [b["block_id"] for b in blocks], "block_types": [b["block_type"] for b in blocks], "page_numbers": sorted({b["page_number"] for b in blocks}),
            "split_index": place[0], "split_count": place[1], "list_group_id": self.list_id, "table_rows": rows, "warnings": list(dict.fromkeys(warnings)), "text": text,
        })

    def close(self) -> None:
        if self.held:
            text = self._joined(self.held)
            self._add(self.held, text, (0, 1), [] if text else ["CHUNK_TEXT_EMPTY"])
            self.held = []

    @staticmethod
    def _joined(blocks: list[Any]) -> str:
        return GLUE.join(b["text"] for b in blocks if b["text"].strip())

    def _enter(self, block: Any) -> None:
        """A list opens its group, its items keep it, anything else ends it."""
        if block["block_type"] != "LIST_ITEM":
            self.list_id = block["block_id"] if block["block_type"] == "LIST" else None

    def take(self, block: Any) -> None:
        large = bool(block["text"].strip()) and len(block["text"]) > self.budget
        if block["block_type"] == "TABLE" or large:
            self.close()
            self._enter(block)
            if block["block_type"] == "TABLE":
                groups = row_groups([list(r) for r in block["rows"]] if block["rows"] is not None else [], self.budget)
                for i, rows in enumerate(groups):
                    text = table_text(rows)
                    more = ["TABLE_SPLIT_ACROSS_CHUNKS"] * (len(groups) > 1) + ["TABLE_ROW_EXCEEDS_MAX_SIZE"] * (len(text) > self.budget)
                    self._add([block], text, (i, len(groups)), [*(block["warnings"] if block["warnings"] is not None else ()), *more], rows)
            else:
                pieces = split_text(block["text"], self.budget)
                for i, piece in enumerate(pieces):
                    self._add([block], piece, (i, len(pieces)), ["BLOCK_SPLIT_DUE_TO_SIZE"])
            return
        if self.held and len(self._joined([*self.held, block])) > self.budget:
            self.close()
        self._enter(block)
        self.held.append(block)


def chunk_blocks(blocks: list[Any], budget: int = BUDGET) -> list[tuple[int, dict]]:
    """(section, chunk) of one document's blocks in order."""
    out = []
    for number, own in groupby(blocks, key=lambda b: b["section"]):
        own = list(own)
        section = _Section(own[0], budget)
        for block in own:
            section.take(block)
        section.close()
        out += [(number, c) for c in section.chunks]
    return out


def chunk_documents(blocks: DataFrame, id_col: str = "doc_id", budget: int = BUDGET) -> DataFrame:
    """Chunks of the blocks (id, sequence, section, text, content_hash, and the columns of GIVEN) of each document.

    Packing is a fold over a document's blocks, so each document is one row with its blocks in order; documents are dealt
    over all tasks. Chunk ids derive from document, content hash, settings, blocks and split. Warnings are null-free and
    in order; a document without blocks gives no rows, see chunking_status().
    """
    kind = dict(blocks.dtypes)[id_col]
    mark = config(budget)
    own = [F.col(c) if c in blocks.columns else F.lit(v).cast(KINDS[c]).alias(c) for c, v in GIVEN.items() if c != "block_id"]
    named = F.coalesce(F.col("block_id") if "block_id" in blocks.columns else F.lit(None), F.concat(F.col(id_col).cast("string"), F.lit(":p1:b"), F.col("sequence").cast("string")))
    struct = F.struct("sequence", "section", F.coalesce("text", F.lit("")).alias("text"), *own, named.alias("block_id"))
    rows = blocks.groupBy(id_col).agg(F.sort_array(F.collect_list(struct)).alias("blocks"), F.first("content_hash").alias("content_hash"))
    names = [x.split()[0] for x in CHUNK.format(id=id_col, kind=kind).split(", ")]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content, items in zip(batch[id_col], batch["content_hash"], batch["blocks"], strict=True):
                for n, (section, c) in enumerate(chunk_blocks(list(items), budget), 1):
                    parts = ["chunk-id-v1", str(name), content or "", mark, ",".join(c["block_ids"]), str(c["split_index"])]
                    chunk_id = hashlib.sha256("|".join(parts).encode()).hexdigest()
                    out.append((
                        name, n, chunk_id, section, *c["heading"], c["block_ids"], c["block_types"], c["page_numbers"], c["split_count"] > 1, c["split_index"], c["split_count"],
                        c["list_group_id"], c["table_rows"], c["warnings"], c["text"], len(c["text"]), content,
                    ))
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(pack, CHUNK.format(id=id_col, kind=kind))


def chunking_status(docs: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of ``docs``: chunking_status, n_chunks and its distinct warnings in order of first occurrence."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("chunk_sequence", "warnings"))), lambda x: x["warnings"])
    found = chunks.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_chunks"), F.array_distinct(F.flatten(ordered)).alias("warnings"))
    warned = F.col("warnings")
    status = F.when(F.col("n_chunks").isNull(), "CHUNKING_SKIPPED").when(F.size(warned) > 0, "CHUNKING_PARTIAL").otherwise("CHUNKING_SUCCESS")
    return docs.select(id_col).join(found, id_col, "left").select(id_col, status.alias("chunking_status"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce(warned, F.array(F.lit("NO_BLOCKS_TO_CHUNK"))).alias("warnings"))
