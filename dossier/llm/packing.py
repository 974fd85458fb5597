"""Packing of documents into fixed-length token sequences along a space-filling curve.

Token ids are made once and written to the shared folder; a document's counts of tokens are projected to three
dimensions, its direction there gives a Hilbert key, documents are range-partitioned and sorted by that key, and each
partition cuts its stream of tokens into sequences. Neighbours along the curve share sequences.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import kernels as K
from dossier.llm.scratch import written

SEQUENCE, END_ID = 2048, 1
DIMENSIONS, BITS, SEED = 3, 10, 7
#: Bytes of token ids that a partition of the curve has on average.
PARTITION_BYTES = 32 << 20
#: Words that a Python worker remembers; beyond it, those not met again since the last time are forgotten.
MOST_WORDS = 600_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A file of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: itself where printable, else 256, 257, ..."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordIds:
    """Token ids of words that white space sets apart, remembered by their bytes.

    The vocabulary's pre-tokenizer never joins across white space, so a text's ids are its words' ids in order.
    Words of plain letters go straight to the BPE model; anything else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        splitter = parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(splitter).findall
        self.letters = dict(enumerate(_byte_letters()))
        self.size = self.whole.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        #: Words met of late, and those met in the time before that.
        self.by_word: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def piece(self, text: str) -> bytes:
        """Ids of what the pre-tokenizer doesn't split: that is a word too, or a part of some."""
        raw = text.encode()
        found = self.by_word.get(raw) or self.before.get(raw)
        if found is None:
            shown = text if text.isascii() else raw.decode("latin-1").translate(self.letters)
            found = self.by_word[raw] = array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()
        return found

    def word(self, raw: bytes) -> bytes:
        if raw.isalpha():  # ASCII letters alone
            return self.piece(raw.lower().decode())
        text = raw.decode("utf-8", "replace")
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).lower()
            plain = max(text) < "ɐ" and text.isprintable()
        else:
            text, plain = text.lower(), text.isprintable()
        if plain and "<|" not in text:
            return b"".join(map(self.piece, self.pieces(text)))
        return array(self.code, self.whole.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def texts(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and their offsets by text."""
        raw = buf.tobytes()
        plain = K.FOLD[buf] if b"<|" not in raw else buf  # A-Z make no difference, but in special tokens
        start, end, at = K.word_spans(plain, offsets)
        if not len(start):
            return np.zeros(0, self.kind), np.zeros(len(offsets), np.int64)
        first, inverse = K.interned(plain, start, end)
        if len(self.by_word) > MOST_WORDS:
            self.by_word, self.before = {}, self.by_word
        known, before, folded = self.by_word, self.before, plain.tobytes()
        found = []
        for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True):
            key = folded[a:b]
            ids = known.get(key)
            if ids is None:
                ids = known[key] = before.get(key) or self.word(raw[a:b])
            found.append(ids)
        flat = np.frombuffer(b"".join(found), self.kind)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        begins = np.cumsum(sizes) - sizes
        n = sizes[inverse]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1]) + np.repeat(begins[inverse] - (ends - n), n)]
        return ids, np.concatenate([[0], ends])[at]


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the Hilbert curve of points with ``bits``-bit coordinates (rows), by the transpose algorithm."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _curve(ids: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hilbert key of each text: its tokens' projected counts, as a direction."""
    sums = np.zeros((len(at) - 1, DIMENSIONS))
    filled = np.flatnonzero(np.diff(at))
    if len(filled):
        for k in range(DIMENSIONS):
            sums[filled, k] = np.add.reduceat(table[ids, k], at[filled])
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = sums / np.where(norm > 0, norm, 1)
    return hilbert_keys(np.clip(((unit + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1))


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a Python worker."""
    return WordIds(path)


def _tokens(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = word_ids(path)
    table = np.random.default_rng(SEED).standard_normal((known.size, DIMENSIONS))
    for batch in batches:
        for rows, buf, offsets in K.blocks(batch):
            ids, at = known.texts(buf, offsets)
            keys = _curve(ids, at, table)
            raw = [ids[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(keys), pa.array(np.diff(at) + 1), pa.array(raw, pa.binary())], names=["doc_id", "curve", "doc_tokens", "raw"])


def _cut(wide: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut a partition's stream of tokens into sequences. The rest at its end goes to sequences of powers of two."""
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    sequence = TaskContext.get().partitionId() << 40
    done: list[tuple] = []
    held: list[tuple] = []  # of the open sequence: doc_id, start, ids, doc_tokens
    filled = 0

    def close(size_of: list[int]) -> None:
        nonlocal sequence, held, filled
        at = 0
        for doc, start, ids, total in held:
            while len(ids):
                n = min(len(ids), size_of[0] - at)
                done.append((doc, start, n, ids[:n].tobytes(), total, sequence, at))
                start, ids, at = start + n, ids[n:], at + n
                if at == size_of[0]:
                    sequence, at = sequence + 1, 0
                    size_of.pop(0)
        held, filled = [], 0

    def ready() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        done.clear()
        return out

    for batch in batches:
        for doc, total, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "raw")), strict=True):
            ids = np.append(np.frombuffer(raw, "<u4" if wide else "<u2"), END_ID).astype("<u4")
            start = 0
            while len(ids):
                n = min(len(ids), SEQUENCE - filled)
                held.append((doc, start, ids[:n], total))
                filled, start, ids = filled + n, start + n, ids[n:]
                if filled == SEQUENCE:
                    close([SEQUENCE])
            if len(done) > 5_000:
                yield ready()
    if held:
        close([1 << k for k in range(SEQUENCE.bit_length() - 1, -1, -1) if filled >> k & 1])
    if done:
        yield ready()


def packing(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text; other columns are ignored) into sequences of 2048 tokens.

    A document is its tokens, then id 1; null and empty texts are that id alone. Documents are cut freely, no token is
    lost or doubled, and nothing is padded: what is left at a partition's end goes to sequences whose sizes are powers
    of two. Repeated rows are packed as often as they come. An empty table gives no rows.

    Returns one row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.
    """
    path = path or tokenizer_path()
    spark = docs.sparkSession
    wide = WordIds(path).kind.itemsize == 4
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _tokens(path, b), "doc_id long, curve long, doc_tokens long, raw binary")
    tokens = written(made.withColumn("n_row", F.monotonically_increasing_id()), "tokens")  # n_row parts rows of one doc_id among partitions
    width = 4 if wide else 2
    total = tokens.agg(F.coalesce(F.sum("doc_tokens"), F.lit(0)).alias("n")).first().n
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * width // PARTITION_BYTES))
    dealt = tokens.repartitionByRange(parts, "curve", "doc_id", "n_row").sortWithinPartitions("curve", "doc_id", "n_row")
    return dealt.drop("n_row").mapInArrow(lambda b: _cut(wide, b), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
