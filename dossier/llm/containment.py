"""MinHash search for short known texts inside long documents, by size class, with exact shingle containment.

Items are classed by the number of their shingles: class L holds sizes in (L/2, L]. A document is read in windows of
2 L shingles that start every L, so that any run of L shingles lies in one window. A window meets an item where one
of the HASHES least values is the same. With containment 0.75 the Jaccard similarity of window and item is
0.75 q / (q + 2 L - 0.75 q), at least 0.176, so that 64 hashes miss with a chance under 5e-6. A run of one class
is two of the class below, so its least values come from those. Items of one or two shingles must be held whole, so one
of their shingles is looked up among all of a document's. Every pair that meets is decided by the exact share of the item's shingles that the document holds.

An item of fewer than WORDS words is one run of that many words, looked up among all runs of as many words of a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from dossier.llm import kernels as K

WORDS, PERCENT = 5, 75
HASHES, LEAST = 64, 4
MULTIPLIERS = np.random.default_rng(97).integers(1, 1 << 63, HASHES, dtype=K.U) * K.U(2) + K.U(1)
FOUND = "doc_id long, item_id long, n_shared long, n_item long"


def shingle_table(texts: list[str], breaks: np.ndarray = K.IS_SPACE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf, offsets = K.utf8(pa.array(texts, pa.string()))
    _, _, hashes, at = K.words(buf, offsets, breaks=breaks)
    values, at = K.distinct_sorted(*K.shingles(hashes, at, WORDS))
    return [values[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def _sieve(keys: np.ndarray) -> np.ndarray:
    """By lowest bits: does any key end so? Most values are told to be no key by it."""
    out = np.zeros(1 << max(12, (4 * len(keys)).bit_length()), bool)
    out[keys & K.U(len(out) - 1)] = True
    return out


class WindowIndex:
    """A bounded set of items, ready to be met by windows of documents."""

    def __init__(self, ids: list[int], texts: list[str], breaks: np.ndarray = K.IS_SPACE):
        self.breaks = breaks
        sets = shingle_table(texts, breaks)
        _, _, hashes, at = K.words(*K.utf8(pa.array(texts, pa.string())), breaks=breaks)
        counts = np.diff(at)
        #: By number of words: the runs of the short items in rising order, and the items' ids.
        self.short: dict[int, tuple[np.ndarray, list[int]]] = {}
        for n in sorted(set(counts[(counts > 0) & (counts < WORDS)].tolist())):
            runs, run_at = K.shingles(hashes, at, n)
            own = np.flatnonzero(counts == n)
            order = np.argsort(runs[run_at[own]], kind="stable")
            self.short[n] = (runs[run_at[own]][order], [ids[i] for i in own[order]])
        kept = [i for i, s in enumerate(sets) if len(s) and counts[i] >= WORDS]
        self.ids, self.sets = [ids[i] for i in kept], [sets[i] for i in kept]
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        sizes = [1 << (len(s) - 1).bit_length() for s in self.sets]
        tiny = sorted((int(s[0]), i) for i, s in enumerate(self.sets) if len(s) < 3)
        keys = np.array([x for x, _ in tiny], K.U)
        self.tiny = keys, np.array([i for _, i in tiny], np.int64), _sieve(keys)
        for length in sorted({n for n in sizes if n >= LEAST}):
            own = np.array([i for i, n in enumerate(sizes) if n == length])
            least = np.stack([[(self.sets[i] * m).min() for i in own] for m in MULTIPLIERS])
            order = np.argsort(least, axis=1, kind="stable")
            least = np.take_along_axis(least, order, 1)
            self.classes[length] = (least, own[order], np.stack([_sieve(row) for row in least]))

    def meets(self, shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distinct (text, item) that share a least value in a window; shingles in the order of the text."""
        found: set[tuple[int, int]] = set()
        if not len(shingles):
            return np.zeros((0, 2), np.int64)
        self._look_up(shingles, *self.tiny, np.repeat(np.arange(len(at) - 1), np.diff(at)), found)
        levels, length, sizes = [], min(self.classes, default=0), np.diff(at)
        while self.classes and length <= max(self.classes):
            runs = -(-sizes // length)
            text = np.repeat(np.arange(len(runs)), runs)
            first = np.cumsum(runs) - runs
            last = np.zeros(len(text), bool)
            last[(first + runs - 1)[runs > 0]] = True
            inner = np.arange(len(text)) - first[text]
            if not levels:  # where a run starts among the shingles
                parts = at[:-1][text] + inner * length
            else:  # the two runs of the class below, or the one that is left
                below = levels[-1][2]
                left = before[text] + 2 * inner
                parts = left, np.where(below[left], left, np.minimum(left + 1, len(below) - 1))
            levels.append((length, text, last, parts))
            before, length = first, 2 * length
        for k in range(HASHES):
            low = shingles * MULTIPLIERS[k]
            for i, (length, text, last, parts) in enumerate(levels):
                low = np.minimum(low[parts[0]], low[parts[1]]) if i else np.minimum.reduceat(low, parts)
                if length in self.classes:
                    window = low.copy()
                    window[:-1] = np.where(last[:-1], low[:-1], np.minimum(low[:-1], low[1:]))
                    least, item, sieves = self.classes[length]
                    self._look_up(window, least[k], item[k], sieves[k], text, found)
        return np.array(sorted(found), np.int64).reshape(-1, 2)

    @staticmethod
    def _look_up(values: np.ndarray, keys: np.ndarray, items: np.ndarray, sieve: np.ndarray, text: np.ndarray, found: set[tuple[int, int]]) -> None:
        """Adds (text, item) of every value that is among the sorted keys."""
        some = np.flatnonzero(sieve[values & K.U(len(sieve) - 1)])
        if not len(some):
            return
        place = np.searchsorted(keys, values[some])
        hit = np.flatnonzero(keys[np.minimum(place, len(keys) - 1)] == values[some])
        for i, p in zip(some[hit].tolist(), place[hit].tolist(), strict=True):
            while p < len(keys) and keys[p] == values[i]:
                found.add((int(text[i]), int(items[p])))
                p += 1

    def _holds_short(self, hashes: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
        """Distinct (text, words, place of the item in its class) of short items that the texts hold as a run."""
        found = set()
        for n, (runs, _) in self.short.items():
            own, own_at = K.shingles(hashes, at, n)
            place = np.searchsorted(runs, own)
            hit = np.flatnonzero(runs[np.minimum(place, len(runs) - 1)] == own)
            for i, text in zip(hit, np.searchsorted(own_at, hit, "right") - 1, strict=True):
                p = place[i]
                while p < len(runs) and runs[p] == own[i]:
                    found.add((int(text), n, int(p)))
                    p += 1
        return sorted(found)

    def held(self, buf: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item's id, shingles shared, shingles of the item) of all items that the texts hold."""
        _, _, hashes, at = K.words(buf, offsets, breaks=self.breaks)
        found = [(text, self.short[n][1][p], 1, 1) for text, n, p in self._holds_short(hashes, at)]
        shingles, at = K.shingles(hashes, at, WORDS)
        last, own = -1, np.zeros(0, K.U)
        for text, item in self.meets(shingles, at).tolist():
            if text != last:
                last, own = text, np.sort(shingles[at[text] : at[text + 1]])
            wanted = self.sets[item]
            place = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            n = int((own[place] == wanted).sum())
            if 100 * n >= PERCENT * len(wanted):
                found.append((text, self.ids[item], n, len(wanted)))
        return found

    def scan(self, batches: Iterator[pa.RecordBatch], choose: Callable[[list[tuple[int, int, int, int]]], list[tuple[int, int, int, int]]] = list) -> Iterator[pa.RecordBatch]:
        """Rows of FOUND for batches with doc_id and text. choose: which of the items that a block's texts hold stay."""
        for batch in batches:
            for rows, buf, offsets in K.blocks(batch):
                ids = rows.column("doc_id").to_pylist()
                found = [(ids[text], *rest) for text, *rest in choose(self.held(buf, offsets))]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 4, names=["doc_id", "item_id", "n_shared", "n_item"])

    def without(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows whose text holds no item, with all their columns."""
        for batch in batches:
            for rows, buf, offsets in K.blocks(batch):
                clean = np.ones(rows.num_rows, bool)
                clean[[text for text, *_ in self.held(buf, offsets)]] = False
                yield rows.filter(pa.array(clean))
