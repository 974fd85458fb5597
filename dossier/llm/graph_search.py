"""Approximate nearest neighbours by robust-pruned directed graphs, one in each shard.

1. Vectors are dealt into shards by a hash of their id, so copies and hot sources spread; within a shard equal vectors
   are one node with several ids.
2. A coordinate is added that makes all norms equal, so that the largest inner product is the least distance.
3. Nodes enter in random order, in batches: a greedy beam search proposes neighbours; of these, nearest first, one is kept
   unless a kept one lies nearer to it by the factor RELAXED than the node itself. Edges are given back, and lists that
   grow over EDGES are pruned alike.
4. Blocks of queries meet every shard; a beam of BEAM nodes is followed through its graph, and the best of all shards,
   scored anew in doubles, are ranked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.scratch import written

TOP = 20
#: Vectors of a shard on average, queries of a block.
SHARD, QUERIES = 8_192, 4_096
#: Edges of a node, nodes of a beam in building and in search, nodes of it followed at once.
EDGES, BUILD_BEAM, BEAM, FOLLOWED = 32, 48, 80, 4
RELAXED = 1.2
#: Nodes that enter, or queries that are followed, together.
TOGETHER = 512
SEED = 11
NODE = "shard long, place int, ids array<long>, vector array<double>, edges array<int>"


def usable(vector: Column) -> Column:
    """Not null, not zero, no component null or not finite."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, sound), F.lit(False)) & F.exists(vector, lambda x: x != 0)


def vectors_of(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the usable rows of the commonest width; of rows that share an id the least vector counts."""
    found = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    width = found.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    return found.where(F.size("vector") == (width["width"] if width else 0))


def _dots(x: np.ndarray, places: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Inner products of each asked vector with its own row of places."""
    return np.matmul(x[places], asked[:, :, None])[:, :, 0]


class Graph:
    """Rows of ``x`` with their edges (places; -1 where there are fewer)."""

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None):
        norms = (x * x).sum(axis=1)
        # rows of equal norm: distances order as inner products do
        self.x = np.concatenate([x, np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0))[:, None]], axis=1).astype(np.float32)
        self.edges = np.full((len(x), EDGES), -1, np.int32) if edges is None else edges
        self.entries = np.arange(min(len(x), EDGES))

    def beam(self, asked: np.ndarray, width: int, n: int, followed: list[np.ndarray] | None = None) -> np.ndarray:
        """The ``width`` nearest nodes of the first n that greedy search finds for each asked vector, nearest first; -1 where fewer.

        followed: gets the places whose edges were followed, step by step.
        """
        q = len(asked)
        seen = np.zeros((q, n + 1), bool)
        row = np.arange(q)[:, None]
        entries = self.entries[self.entries < n]
        near = np.broadcast_to(entries, (q, len(entries))).astype(np.int32)
        score = asked @ self.x[entries].T
        seen[:, entries] = True
        order = np.argsort(-score, axis=1, kind="stable")[:, :width]
        near, score = np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1)
        done = np.zeros(near.shape, bool)
        live = np.arange(q)
        out = np.full((q, width), -1, np.int32)
        while len(live):
            # the best nodes of each beam not yet followed
            wait = np.where(done, np.int32(width), np.arange(near.shape[1], dtype=np.int32))
            place = np.sort(np.partition(wait, min(FOLLOWED, wait.shape[1]) - 1, axis=1)[:, :FOLLOWED], axis=1)
            more = place < width
            at = np.where(more, place, place[:, :1])  # one at least waits
            own = np.arange(len(live))[:, None]
            nodes = np.where(more, near[own, at], n)
            done[own, at] = True
            if followed is not None:
                step = np.full((q, nodes.shape[1]), -1, np.int32)
                step[live] = np.where(more, nodes, -1)
                followed.append(step)
            out_edges = self.edges[np.minimum(nodes, n - 1)]
            fresh = np.where(more[:, :, None], out_edges, -1).reshape(len(live), -1)
            fresh = np.sort(np.where((fresh < 0) | (fresh >= n), n, fresh), axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
            fresh = np.where(seen[live[:, None], fresh], n, fresh)
            fresh = np.sort(fresh, axis=1)
            fresh = fresh[:, : max(1, int((fresh < n).sum(axis=1).max(initial=0)))]
            seen[live[:, None], fresh] = True
            seen[:, n] = False
            new = np.where(fresh < n, _dots(self.x, np.minimum(fresh, n - 1), asked[live]), -np.inf).astype(np.float32)
            near, score, done = np.concatenate([near, fresh], axis=1), np.concatenate([score, new], axis=1), np.concatenate([done, new == -np.inf], axis=1)
            if near.shape[1] > width:
                order = np.argpartition(-score, width - 1, axis=1)[:, :width]
                near, score, done = (np.take_along_axis(a, order, 1) for a in (near, score, done))
            order = np.argsort(-score, axis=1, kind="stable")
            near, score, done = (np.take_along_axis(a, order, 1) for a in (near, score, done))
            over = done.all(axis=1)
            if over.any():
                out[live[over], : near.shape[1]] = np.where(np.isfinite(score[over]), near[over], -1)
                live, near, score, done = live[~over], near[~over], score[~over], done[~over]
        return out

    def pruned(self, nodes: np.ndarray, near: np.ndarray) -> np.ndarray:
        """EDGES of ``near`` (a row of places for each node, -1 for none) that are diverse; places may repeat."""
        near = np.sort(np.where(near == nodes[:, None], -1, near), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        held = np.maximum(near, 0)
        other = self.x[held]
        far = np.where(near < 0, np.inf, ((other - self.x[nodes][:, None]) ** 2).sum(axis=2))
        order = np.argsort(far, axis=1, kind="stable")
        near, far, other = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1), np.take_along_axis(other, order[:, :, None], 1)
        square = (other * other).sum(axis=2)
        apart = np.maximum(square[:, :, None] + square[:, None] - 2 * other @ other.transpose(0, 2, 1), 0)
        alive = np.isfinite(far)
        out, row = np.full((len(nodes), EDGES), -1, np.int32), np.arange(len(nodes))
        for k in range(EDGES):
            first = alive.argmax(axis=1)
            some = alive[row, first]
            if not some.any():
                break
            out[:, k] = np.where(some, near[row, first], -1)
            alive[row, first] = False
            alive &= ~(some[:, None] & (RELAXED * RELAXED * apart[row, first] <= far))
        return out

    def grow(self) -> Graph:
        """Enter all nodes; the rows of x must be in random order."""
        first = len(self.entries)
        everyone = np.broadcast_to(np.arange(first, dtype=np.int32), (first, first))
        self.edges[:first] = self.pruned(np.arange(first), everyone)
        n = first
        while n < len(self.x):
            nodes = np.arange(n, min(n + min(TOGETHER, n), len(self.x)))
            followed: list[np.ndarray] = []
            near = self.beam(self.x[nodes], BUILD_BEAM, n, followed)
            mates = np.broadcast_to(nodes.astype(np.int32), (len(nodes), len(nodes)))
            if len(nodes) > EDGES // 2:  # those that enter together see the nearest of each other
                scores = self.x[nodes] @ self.x[nodes].T
                mates = nodes[np.argpartition(-scores, EDGES // 2, axis=1)[:, : EDGES // 2]].astype(np.int32)
            self.edges[nodes] = self.pruned(nodes, np.concatenate([near, *followed[:8], mates], axis=1))
            self.give_back(nodes)
            n = int(nodes[-1]) + 1
        return self

    def give_back(self, nodes: np.ndarray) -> None:
        """Every edge of ``nodes`` gets one in return."""
        place, _ = np.nonzero(self.edges[nodes] >= 0)
        to = self.edges[nodes][self.edges[nodes] >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], nodes[place[order]].astype(np.int32)
        target, first, n = np.unique(to, return_index=True, return_counts=True)
        rank = np.arange(len(to)) - np.repeat(first, n)
        # lists as wide as a node's edges thrice: of more that come at once, the rest finds it by the others
        width = int(min(n.max(initial=0), 2 * EDGES))
        wide = np.full((len(target), EDGES + width), -1, np.int32)
        wide[:, :EDGES] = self.edges[target]
        kept = rank < width
        wide[np.repeat(np.arange(len(target)), n)[kept], EDGES + rank[kept]] = source[kept]
        wide = -np.sort(-wide, axis=1)
        crowded = wide[:, EDGES] >= 0 if wide.shape[1] > EDGES else np.zeros(len(target), bool)
        self.edges[target[~crowded]] = wide[~crowded, :EDGES]
        for part in np.array_split(np.flatnonzero(crowded), max(1, -(-int(crowded.sum()) // TOGETHER))):
            self.edges[target[part]] = self.pruned(target[part], wide[part])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _built(rows: pa.Table) -> pa.Table:
    """The graph of a shard's rows (shard, id, vector)."""
    ids, x = rows.column("id").to_numpy(), _matrix(rows.column("vector")) + 0.0  # -0.0 counts as 0.0
    order = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[order], x[order]
    once = np.concatenate([[True], ids[1:] != ids[:-1]])
    ids, x = ids[once], x[once]
    x, of = np.unique(x, axis=0, return_inverse=True)
    mixed = np.random.default_rng(SEED).permutation(len(x))
    x, place = x[mixed], np.argsort(mixed)[of]
    order = np.lexsort((ids, place))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(place[order], np.arange(len(x) + 1)).astype(np.int32)), pa.array(ids[order]))
    edges = Graph(x).grow().edges
    rows_of = lambda a, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.ravel(), kind))
    return pa.table({"shard": pa.array(np.full(len(x), rows.column("shard")[0].as_py()), pa.int64()), "place": pa.array(np.arange(len(x)), pa.int32()), "ids": lists, "vector": rows_of(x, pa.float64()), "edges": rows_of(edges, pa.int32())})


def graph_index(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """A written table with a graph for each of the shards that the usable rows are dealt into; every row is in it."""
    found = vectors_of(rows, id_col, vector_col)
    n = max(1, -(-found.count() // shard))
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n)))
    return written(dealt.groupBy("shard").applyInArrow(_built, NODE), "graph-index")


def _best(nodes: pa.Table, queries: pa.Table, top: int, beam: int) -> pa.Table:
    """(query_id, vec_id, score): of each query of a block the ``top`` nearest that a shard's graph finds."""
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not nodes.num_rows or not queries.num_rows:
        return empty
    nodes = nodes.sort_by("place")
    x, lists = _matrix(nodes.column("vector")), nodes.column("ids").combine_chunks()
    ids, ids_at = lists.flatten().to_numpy(), np.cumsum(np.append(0, lists.value_lengths().to_numpy()))
    names, order = np.unique(queries.column("id").to_numpy(), return_index=True)
    asked = _matrix(queries.column("vector"))
    if len(order) < len(asked):  # rows that share an id: the least vector, as in the index
        rank = np.lexsort((*asked.T[::-1], queries.column("id").to_numpy()))
        order = rank[np.unique(queries.column("id").to_numpy()[rank], return_index=True)[1]]
    asked = asked[order]
    graph, out = Graph(x, _matrix(nodes.column("edges"))), []
    for first in range(0, len(names), TOGETHER):
        part = asked[first : first + TOGETHER]
        wide = np.concatenate([part, np.zeros((len(part), 1))], axis=1).astype(np.float32)
        near = graph.beam(wide, max(beam, top + 1), len(x))
        row, at = np.nonzero(near >= 0)
        node = near[row, at]
        score = (x[node] * part[row]).sum(axis=1)
        n = np.minimum(ids_at[node + 1] - ids_at[node], top + 1)  # of copies those with the smallest ids, one more as one may be the query
        entry = np.repeat(np.arange(len(node)), n)
        vec = ids[ids_at[node][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)]
        row, score = row[entry], score[entry]
        other = vec != names[first + row]
        row, score, vec = row[other], score[other], vec[other]
        order = np.lexsort((vec, -score, row))
        row, score, vec = row[order], score[order], vec[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < top
        out.append((names[first + row[kept]], vec[kept], score[kept]))
    return pa.table({k: pa.array(np.concatenate([o[i] for o in out])) for i, k in enumerate(("query_id", "vec_id", "score"))})


def graph_search(rows: DataFrame, queries: DataFrame, top: int = TOP, index: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """The ``top`` nearest of ``rows`` found for each of ``queries`` (both: id, vector), the row of the query's own id left out.

    Nearness is the inner product of the vectors in doubles; equal ones rank by id. All others, where there are fewer than
    ``top``. index: what graph_index() gave for ``rows``, else made here. Vectors that are null, empty, zero or hold a null
    or non-finite component, those of another width than most, and those without an id take no part, neither as queries.
    Of rows that share an id the one with the least vector counts. Copies of a vector under ids of their own are all found.
    An empty table gives no rows; other columns are ignored. Returns query_id, rank, vec_id, score.
    """
    index = graph_index(rows, id_col, vector_col, shard) if index is None else index
    asked = vectors_of(queries, id_col, vector_col)
    shape = index.agg(F.coalesce(F.max("shard") + 1, F.lit(0)).alias("shards"), F.max(F.size("vector")).alias("width")).first()
    asked = asked.where(F.size("vector") == F.lit(shape["width"] or 0))
    n_blocks = max(1, -(-asked.count() // QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long")))
    # every shard meets every block of queries: pairs of two groups of bounded size
    nodes = index.withColumn("block", every(n_blocks)).groupBy("shard", "block")
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks))).withColumn("shard", every(shape["shards"])).groupBy("shard", "block")
    found = nodes.cogroup(blocks).applyInArrow(lambda a, b: _best(a, b, top, beam), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
