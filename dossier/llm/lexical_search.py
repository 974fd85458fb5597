"""Ranked lexical search: exact inner products by a sparse ball tree.

1. One pass over the texts counts their terms and keeps those that some item may hold: a bitmap of a fixed size says which.
2. A document is a sparse vector of integers over the items' terms, which say what the term adds to a score times the
   item's own number for it: the term's weight, as often as the item holds the term.
3. Each task builds ball trees over some thousand documents at a time: nodes are halved between two far members; a node
   knows its centroid and the radius around it. No item can score more in a node than its product with the centroid plus
   radius times the item's norm over the node's terms, rounded up.
4. Nodes are visited best first, for all items that can still gain there at once; subtrees under every item's tenth score
   are pruned. At leaves scores are exact sums of 64-bit integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm import kernels as K
from dossier.llm.scratch import written

TOP = 10
#: Bits of a term's hash that say whether an item may hold it.
BITMAP_BITS = 22
#: Documents and terms of a tree, documents of a leaf.
TREE_DOCS, TREE_TERMS, LEAF = 4_096, 1 << 20, 8
#: Terms of the items that are searched at once: they travel to every task.
BLOCK_TERMS = 1 << 20
#: What bounds are raised by, more than sums of doubles can lose.
SAFE = 1 + 1e-9
#: Stands for a null doc_id, behind all others.
NO_ID = np.iinfo(np.int64).max
TERMS = "array<struct<a:long,b:long,n:long>>"


def _counted(batches: Iterator[pa.RecordBatch], key: str, bitmap: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(key, n_terms, terms): all terms of a text, and how often it holds each of those that the bitmap has."""
    for batch in batches:
        for rows, buf, offsets in K.blocks(batch):
            start, end, hashes, at = K.words(buf, offsets, breaks=K.IS_BREAK)
            text = np.repeat(np.arange(rows.num_rows), np.diff(at))
            if bitmap is not None:
                kept = np.flatnonzero(bitmap[(hashes >> K.U(64 - BITMAP_BITS)).astype(np.int64)])
                start, end, hashes, text = start[kept], end[kept], hashes[kept], text[kept]
            other = K.word_hashes(K.FOLD[buf], start, end, 1)
            order = np.lexsort((other, hashes, text))
            hashes, other, text = hashes[order], other[order], text[order]
            new = np.ones(len(text), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (other[1:] != other[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(text)))
            lists_at = np.zeros(rows.num_rows + 1, np.int32)
            np.cumsum(np.bincount(text[first], minlength=rows.num_rows), out=lists_at[1:])
            terms = pa.StructArray.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(other[first].view(np.int64)), pa.array(n, pa.int64())], ["a", "b", "n"])
            yield pa.RecordBatch.from_arrays([rows.column(key).cast(pa.int64()), pa.array(np.diff(at), pa.int64()), pa.ListArray.from_arrays(pa.array(lists_at), terms)], names=[key, "n_terms", "terms"])


def term_vectors(texts: DataFrame, key: str, bitmap: np.ndarray | None = None) -> DataFrame:
    """(key, n_terms, terms) of the texts (key, text): terms are told by 128 bits of two hashes of their bytes."""
    return texts.select(F.col(key).cast("long").alias(key), "text").mapInArrow(lambda b: _counted(b, key, bitmap), f"{key} long, n_terms long, terms {TERMS}")


class Items:
    """A block of items by term: (term, item, gain), sorted by term; terms are numbered in the order of (a, b)."""

    def __init__(self, rows: pa.Table):
        a, b = (rows.column(c).to_numpy().view(K.U) for c in "ab")
        names, self.item = np.unique(rows.column("item_id").fill_null(int(NO_ID)).to_numpy(), return_inverse=True)
        self.names = names
        order = np.lexsort((self.item, b, a))
        a, b, self.item = a[order], b[order], self.item[order]
        self.gain = (rows.column("n").to_numpy() * rows.column("weight").to_numpy())[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        self.a, self.b = a[first], b[first]
        self.at = np.append(first, len(a))

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of the terms, -1 for those that no item of the block has. Terms with the same a are few."""
        out = np.full(len(a), -1)
        low, high = np.searchsorted(self.a, a, "left"), np.searchsorted(self.a, a, "right")
        live = np.flatnonzero(low < high)
        while len(live):
            same = self.b[low[live]] == b[live]
            out[live[same]] = low[live[same]]
            low[live] += 1
            live = live[~same & (low[live] < high[live])]
        return out

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the terms one after another: the place in ``terms`` of each posting, and the posting."""
        n = self.at[terms + 1] - self.at[terms]
        place = np.repeat(np.arange(len(terms)), n)
        return place, np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + self.at[terms][place]


class Tree:
    """A ball tree over sparse vectors: rows of (doc, term, value), sorted by doc."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, n_docs: int, n_terms: int):
        self.depth = max(0, int(np.ceil(np.log2(max(n_docs, 1) / LEAF))))
        x = value.astype(float)
        square = np.bincount(doc, x * x, n_docs)
        place, order = np.zeros(n_docs, np.int64), np.arange(n_docs)  # node of each document within its level
        self.levels = []
        for level in range(self.depth + 1):
            n_nodes = 1 << level
            size = np.bincount(place, minlength=n_nodes)
            keys, slot = np.unique(place[doc] * n_terms + term, return_inverse=True)
            node, centroid = keys // n_terms, np.bincount(slot, x, len(keys)) / size[keys // n_terms]
            own = np.bincount(node, centroid * centroid, n_nodes)
            from_centre = square - 2 * np.bincount(doc, x * centroid[slot], n_docs) + own[place]
            # squares cancel: what rounding can lose is far under 1e-9 of what was added
            radius = np.zeros(n_nodes)
            np.maximum.at(radius, place, np.maximum(from_centre, 0) + 1e-9 * (square + own[place]))
            self.levels.append((np.searchsorted(node, np.arange(n_nodes + 1)), keys % n_terms, centroid, np.sqrt(radius)))
            if level == self.depth:
                break
            # halves by nearness to two members: the farthest from the centroid, and the farthest from that one
            far = self._farthest(from_centre, place, n_nodes)
            one = self._distance(far, doc, x, slot, place, square, len(keys), n_docs)
            two = self._distance(self._farthest(one, place, n_nodes), doc, x, slot, place, square, len(keys), n_docs)
            order = np.lexsort((one - two, place))
            rank = np.arange(n_docs) - (np.cumsum(size) - size)[place[order]]
            place[order] = 2 * place[order] + (2 * rank >= size[place[order]])
        self.leaf_order = np.argsort(place, kind="stable")
        self.leaf_at = np.searchsorted(place[self.leaf_order], np.arange((1 << self.depth) + 1))
        self.doc_at, self.term, self.value = np.searchsorted(doc, np.arange(n_docs + 1)), term, value

    @staticmethod
    def _farthest(distance: np.ndarray, place: np.ndarray, n_nodes: int) -> np.ndarray:
        """A member of each node at the greatest distance; -1 for an empty node."""
        out = np.full(n_nodes, -1)
        order = np.lexsort((distance, place))
        out[place[order]] = order  # the last one stays
        return out

    @staticmethod
    def _distance(pivot: np.ndarray, doc: np.ndarray, x: np.ndarray, slot: np.ndarray, place: np.ndarray, square: np.ndarray, n_slots: int, n_docs: int) -> np.ndarray:
        """Of each document the squared distance to its node's pivot."""
        of = np.zeros(n_slots)
        mine = doc == pivot[place[doc]]
        of[slot[mine]] = x[mine]
        return square - 2 * np.bincount(doc, x * of[slot], n_docs) + square[pivot[place]]

    def leaf(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents of a leaf; of their terms: document's place in the leaf, term, value."""
        docs = self.leaf_order[self.leaf_at[k] : self.leaf_at[k + 1]]
        n = self.doc_at[docs + 1] - self.doc_at[docs]
        place = np.repeat(np.arange(len(docs)), n)
        at = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + self.doc_at[docs][place]
        return docs, place, self.term[at], self.value[at]


class Search:
    """The ``top`` best documents of each item so far. Of pairs of an item and a document: how many were scored, of how many."""

    def __init__(self, items: Items, top: int):
        self.items, self.top = items, top
        self.score = np.zeros((len(items.names), top), np.int64)
        self.doc = np.full((len(items.names), top), NO_ID)
        self.scored, self.seen = 0, 0

    def bounds(self, tree: Tree, level: int, node: int, active: np.ndarray) -> np.ndarray:
        """What the items may score at most in a node; -1 where they aren't active."""
        at, term, centroid, radius = tree.levels[level]
        own = slice(at[node], at[node + 1])
        place, posting = self.items.postings(term[own])
        item, gain = self.items.item[posting], self.items.gain[posting].astype(float)
        n = len(self.items.names)
        product = np.bincount(item, gain * centroid[own][place], n)
        norm = np.sqrt(np.bincount(item, gain * gain, n))
        return np.where(active, (product + norm * radius[node]) * SAFE, -1.0)

    def add(self, tree: Tree, ids: np.ndarray) -> None:
        self.seen += len(ids) * len(self.items.names)
        # an item gains where its bound reaches its last score; equal scores may have smaller ids
        open_to = lambda bound: (bound > 0) & (bound >= self.score[:, -1])
        bound = self.bounds(tree, 0, 0, np.ones(len(self.items.names), bool))
        scale = np.maximum(bound, 1e-300)
        heap = [(-1.0, 0, 0, bound)]
        while heap:
            _, level, node, bound = heapq.heappop(heap)
            active = open_to(bound)
            if not active.any():
                continue
            if level == tree.depth:
                self.exact(tree, node, active, ids)
                continue
            for child in (2 * node, 2 * node + 1):
                under = np.minimum(self.bounds(tree, level + 1, child, active), bound)
                if open_to(under).any():
                    heapq.heappush(heap, (-float((under / scale).max()), level + 1, child, under))

    def exact(self, tree: Tree, leaf: int, active: np.ndarray, ids: np.ndarray) -> None:
        docs, place, term, value = tree.leaf(leaf)
        self.scored += len(docs) * int(active.sum())
        rows = np.flatnonzero(active)
        number = np.full(len(active), -1)
        number[rows] = np.arange(len(rows))
        entry, posting = self.items.postings(term)
        row = number[self.items.item[posting]]
        entry, posting, row = entry[row >= 0], posting[row >= 0], row[row >= 0]
        score = np.zeros((len(rows), len(docs)), np.int64)
        np.add.at(score, (row, place[entry]), value[entry] * self.items.gain[posting])
        some = ((score > 0) & (score >= self.score[rows, -1:])).any(axis=1)
        rows, score = rows[some], score[some]
        every = np.concatenate([self.score[rows], score], axis=1)
        doc = np.concatenate([self.doc[rows], np.broadcast_to(ids[docs], score.shape)], axis=1)
        best = np.lexsort((doc, -every), axis=1)[:, : self.top]
        self.score[rows], self.doc[rows] = np.take_along_axis(every, best, 1), np.take_along_axis(doc, best, 1)

    def found(self) -> pa.RecordBatch:
        row, place = np.nonzero(self.score > 0)
        ids = lambda x: pa.array(x, pa.int64(), mask=x == NO_ID)
        return pa.RecordBatch.from_arrays([ids(self.items.names[row]), ids(self.doc[row, place]), pa.array(self.score[row, place])], names=["item_id", "doc_id", "score"])


def _searched(batches: Iterator[pa.RecordBatch], items: Items, n_docs: int, n_terms: int, top: int) -> Iterator[pa.RecordBatch]:
    """A task's best documents of every item. n_docs, n_terms: documents with a term and terms of the corpus."""
    search, held = Search(items, top), []

    def planted() -> None:
        ids, sizes, doc, term, n = (np.concatenate([h[k] for h in held]) for k in range(5))
        doc = doc + np.repeat(np.cumsum([0, *(len(h[0]) for h in held[:-1])]), [len(h[2]) for h in held])
        m = 100 - 75 + (75 * sizes * n_docs) // n_terms
        value = (1_000_000_000 * n) // (1000 * n + 8 * m[doc])
        kept, doc = np.unique(doc, return_inverse=True)
        if len(kept):
            search.add(Tree(doc, term, value, len(kept), len(items.a)), ids[kept])
        held.clear()

    for batch in batches:
        lists = batch.column("terms")
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        terms, at = lists.flatten(), np.cumsum(np.append(0, sizes))
        a, b, n = (terms.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        place = items.places(a.view(K.U), b.view(K.U))
        ids = batch.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
        lengths = batch.column("n_terms").to_numpy(zero_copy_only=False)
        first = 0
        while first < len(ids):  # as many documents as a tree has room for, one at least
            room = TREE_DOCS - sum(len(h[0]) for h in held), TREE_TERMS - sum(len(h[2]) for h in held)
            last = min(first + room[0], int(np.searchsorted(at, at[first] + room[1], "right")) - 1)
            if last <= first and held:
                planted()
                continue
            last = min(max(last, first + 1), len(ids))
            own = slice(at[first], at[last])
            hit = place[own] >= 0
            held.append((ids[first:last], lengths[first:last], np.repeat(np.arange(last - first), sizes[first:last])[hit], place[own][hit], n[own][hit]))
            first = last
    if held:
        planted()
    yield search.found()


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best of all ``docs`` (doc_id, text) for each of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Terms are runs of characters other than ASCII punctuation, controls and space, A-Z lower-cased. Scores are exact sums
    of 64-bit integers and above 0; of equal scores the smaller doc_id comes first, a null one last. Null and empty texts
    have no term. Rows of ``docs`` that repeat, or share a doc_id, are documents of their own. Of items that share an
    item_id, or have none, the first text in order counts. No document or no item: no rows. Other columns are ignored.
    """
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").groupBy("item_id").agg(F.min("text").alias("text"))
    terms = written(term_vectors(asked, "item_id").select("item_id", F.inline("terms")), "item-terms")
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    place = F.shiftrightunsigned("a", 64 - BITMAP_BITS).alias("place")
    bitmap[terms.select(place).distinct().toArrow().column("place").to_numpy()] = True  # its bits at most
    vectors = written(term_vectors(docs, "doc_id", bitmap), "term-vectors")
    corpus = vectors.agg(F.count_if(F.col("n_terms") > 0).alias("n"), F.sum("n_terms").alias("total")).first()
    frequency = vectors.select(F.explode("terms").alias("t")).groupBy("t.a", "t.b").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(float(2 * corpus["n"] + 2)) / (2 * F.col("df") + 1)))
    weighed = written(terms.join(frequency, ["a", "b"]).withColumn("weight", weight).drop("df"), "weighed-terms")
    n_blocks = -(-weighed.count() // BLOCK_TERMS)
    parts = []
    for block in range(n_blocks):
        held = Items(weighed.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).toArrow())
        part = vectors.mapInArrow(lambda b, held=held: _searched(b, held, corpus["n"], corpus["total"], top), "item_id long, doc_id long, score long")
        parts.append(written(part, "best") if n_blocks > 1 else part)
    if not parts:
        return vectors.select(F.col("doc_id").alias("item_id"), F.lit(1).alias("rank"), "doc_id", F.col("n_terms").alias("score")).limit(0)
    best = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", best).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
