"""Vectorised text kernels that run inside Arrow tasks: rolling hashes, words, shingles.

Words are hashed eight bytes at a time by bijective mixing; spans of bounded length by polynomials modulo 2**64 with
random byte values. Hashes choose and count; where two texts or words are taken for the same, their bytes are compared,
or 128 bits of two independent hashes. Texts are taken as UTF-8 bytes. A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
BASE_INV = pow(BASE, -1, 1 << 64)
SHINGLE = 0xD6E8FEB86659FD93
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=U)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32  # A-Z as a-z
FOLDED_VALUES = BYTE_VALUES[FOLD]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: White space and ASCII punctuation, for words of letters and digits alone.
IS_BREAK = IS_SPACE.copy()
IS_BREAK[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
#: The lowest k bytes of a number, k from 0 to 8.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Bytes beyond which a word is hashed by itself.
LONG_WORD = 256
#: Bytes of text handled at once; a longer single text is handled alone.
BLOCK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: int, name: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    if len(_powers.get(name, ())) < n:
        x = np.full(max(n, BLOCK + 1), base, U)
        x[0] = 1
        _powers[name] = np.multiply.accumulate(x)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string or binary column; a null has length 0."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about BLOCK bytes of text, with their bytes and offsets."""
    if not batch.num_rows:
        return
    buf, offsets = utf8(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1
        last = max(first + 1, min(last, batch.num_rows))
        yield batch.slice(first, last - first), buf[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def prefix_hash(buf: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """P with n + 1 entries, so that span_hash() hashes any span."""
    out = np.zeros(len(buf) + 1, U)
    np.cumsum(values[buf] * powers(len(buf), BASE, "up"), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end): equal bytes, equal hash."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), BASE_INV, "down")[start] + (end - start).astype(U) * U(SHINGLE))


def _lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number; zeros follow the end."""
    padded = np.zeros(len(buf) + 16, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 8,), "<u8", padded, 0, (1,))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the words [start, end). Every step is a bijection of eight bytes, so words of up to eight never collide.

    Words over LONG_WORD bytes go through a cryptographic hash.
    """
    eight, size = _lanes(buf), end - start
    h = mix(size.astype(U) * U(BASE) + U(seed * 2 + 1))
    live = np.flatnonzero(size <= LONG_WORD)
    at, left = start[live], size[live]
    while len(live):
        h[live] = mix((h[live] ^ (eight[at] & _KEEP[np.minimum(left, 8)])) * U(SHINGLE))
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD):
        key = seed.to_bytes(8, "little")
        h[i] = U(int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8, key=key).digest(), "little"))
    return h


def same_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Of each word: has the word ``other`` (its number) the same bytes?"""
    eight, size = _lanes(buf), end - start
    same = size == size[other]
    live = np.flatnonzero(same & (other != np.arange(len(other))))
    at, to, left = start[live], start[other[live]], size[live]
    while len(live):
        differ = ((eight[at] ^ eight[to]) & _KEEP[np.minimum(left, 8)]) != 0
        same[live[differ]] = False
        more = np.flatnonzero(~differ & (left > 8))
        live, at, to, left = live[more], at[more] + 8, to[more] + 8, left[more] - 8
    return same


def interned(buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A word of each distinct byte string, and for every word the place of its string among those. Bytes decide."""
    hashes = word_hashes(buf, start, end) if hashes is None else hashes
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    apart: dict[bytes, int] = {}
    for i in np.flatnonzero(~same_words(buf, start, end, first[ids])):  # equal hashes of different words
        raw = buf[start[i] : end[i]].tobytes()
        if raw not in apart:
            apart[raw] = len(first)
            first = np.append(first, i)
        ids[i] = apart[raw]
    return first, ids


def word_spans(buf: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n + 1 word offsets of the texts."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~breaks[buf]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut))
    end = np.flatnonzero(before & (~inside | cut))
    return start, end, np.searchsorted(start, offsets, "left")


def words(buf: np.ndarray, offsets: np.ndarray, fold: bool = True, breaks: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word, and the n + 1 word offsets of the texts. fold: A-Z count as a-z."""
    start, end, at = word_spans(buf, offsets, breaks)
    return start, end, word_hashes(FOLD[buf] if fold else buf, start, end), at


def shingles(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words, and their offsets by text. Fewer words: one run of them all; no word: none."""
    counts = np.diff(at)
    total = len(hashes)
    h = hashes.copy()
    for k in range(1, size):
        n = max(total - k, 0)
        h[:n] = h[:n] * U(SHINGLE) + hashes[k:]
    keep = np.zeros(total, bool)
    n_out = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_at = np.zeros(len(at), np.int64)
    np.cumsum(n_out, out=out_at[1:])
    if total:
        text = np.repeat(np.arange(len(counts)), counts)
        keep = np.arange(total) - at[:-1][text] < n_out[text]
    short = np.flatnonzero((counts > 0) & (counts < size))
    for i in short:
        x = U(0)
        with np.errstate(over="ignore"):
            for v in hashes[at[i] : at[i + 1]]:
                x = x * U(SHINGLE) + v
            h[at[i]] = x + U(counts[i])
    return mix(h[keep]), out_at


def distinct_sorted(values: np.ndarray, at: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The distinct values of each text in rising order, and their offsets; of ``other`` (as long as values) those beside them."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, text)) if len(values) else np.zeros(0, np.int64)
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    out_at = np.zeros(len(at), np.int64)
    np.cumsum(np.bincount(text[new], minlength=len(at) - 1), out=out_at[1:])
    return (values[new], out_at) if other is None else (values[new], out_at, other[order][new])


def lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))
