"""Operators 11 to 13: against brute force on small tables, awkward rows, recall."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from dossier.llm import graph_search as G
from dossier.llm import lexical_search as L
from dossier.llm import spelling as S

VECTORS = "vec_id long, embedding array<double>, note string, id string"
TEXTS = "doc_id long, text string, lang string, item_id string"


def nearest(rows, asked, top):
    """By brute force: query -> its nearest others."""
    x = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    out = {}
    for q, v in asked:
        s = (x * np.array(v)).sum(axis=1)
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:top]
        out[q] = [(int(ids[k]), float(s[k])) for k in order]
    return out


def listed(found):
    out = collections.defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def test_graph_search_recall_over_several_shards(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = rows.where("vec_id % 20 = 0")
    held = [(r.vec_id, r.embedding) for r in rows.collect()]
    exact = nearest(held, [x for x in held if x[0] % 20 == 0], 20)
    found = listed(G.graph_search(rows, asked, shard=600))
    assert set(found) == set(exact)
    for q, best in found.items():
        assert len(best) == 20 and best == sorted(best, key=lambda x: (-x[1], x[0]))
        scores = dict(exact[q])
        assert all(abs(scores[v] - s) < 1e-12 for v, s in best if v in scores)
    hits = [len({v for v, _ in found[q]} & {v for v, _ in exact[q]}) / 20 for q in exact]
    assert np.mean(hits) > 0.95


def test_graph_search_by_inner_product_of_unequal_norms(spark):
    rng = np.random.default_rng(3)
    held = [(i, [float(v) for v in rng.standard_normal(12) * rng.gamma(2.0)]) for i in range(1500)]
    rows = spark.createDataFrame(held, "vec_id long, embedding array<double>")
    exact = nearest(held, held[::20], 20)
    found = listed(G.graph_search(rows, rows.where("vec_id % 20 = 0"), shard=500))
    assert np.mean([len({v for v, _ in found[q]} & {v for v, _ in exact[q]}) / 20 for q in exact]) > 0.9


def test_graph_search_of_awkward_rows(spark):
    good = [(i, [math.cos(i), math.sin(i)], "x", "y") for i in range(0, 9)]
    copies = [(100 + i, [2.0, 0.0], None, None) for i in range(60)]
    bad = [(200, None, "", ""), (220, [], "", ""), (240, [0.0, -0.0], "", ""), (260, [1.0, None], "", ""), (280, [float("nan"), 1.0], "", ""), (300, [float("inf"), 1.0], "", ""), (320, [1.0, 2.0, 3.0], "", ""), (None, [9.0, 9.0], "", "")]
    twice = [(5, [math.cos(5), math.sin(5)], "again", ""), (100, [2.0, 0.0], None, None)]
    rows = spark.createDataFrame([*good, *copies, *bad, *twice], VECTORS)
    asked = rows.where("vec_id % 20 = 0")
    found = listed(G.graph_search(rows, asked, shard=40))
    exact = nearest([r[:2] for r in [*good, *copies]], [r[:2] for r in [*good, *copies] if r[0] % 20 == 0], 20)
    assert set(found) == {0, 100, 120, 140} and {q: [v for v, _ in x] for q, x in found.items()} == {q: [v for v, _ in x] for q, x in exact.items()}
    few = G.graph_search(rows.where("vec_id < 5"), asked)
    assert all(len(v) == (4 if q == 0 else 5) for q, v in listed(few).items())
    assert G.graph_search(rows.limit(0), asked).count() == 0 and G.graph_search(rows, asked.limit(0)).count() == 0


def test_graph_of_many_nodes_reaches_them_all():
    x = np.random.default_rng(1).standard_normal((3000, 8))
    graph = G.Graph(x).grow()
    found = graph.beam(graph.x[::7], 1, len(x))
    assert (found[:, 0] == np.arange(0, 3000, 7)).mean() > 0.99
    assert graph.edges.max() < 3000 and (graph.edges != np.arange(3000)[:, None]).all()


def test_robust_pruning_drops_what_a_kept_neighbour_covers():
    x = np.array([[0.0, 0.0], [1.0, 0.0], [1.1, 0.0], [0.0, 2.0]])
    graph = G.Graph(np.concatenate([x, np.full((1, 2), 9.0)]))
    kept = graph.pruned(np.array([0]), np.array([[1, 2, 3, 0, -1, 1]], np.int32))[0]
    assert kept[kept >= 0].tolist() == [1, 3]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(S.UPPER, S.LOWER)))


def ranked(docs, items, top=10):
    """By brute force over (doc_id, text) and (item_id, text)."""
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in items:
        scored = []
        for d, c in counts:
            n = sum(c.values())
            m = 25 + (75 * n * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out[item] = [(k[3], -k[0]) for k in sorted(scored)[:top]]
    return {i: x for i, x in out.items() if x}


def by_item(found):
    out = collections.defaultdict(list)
    for r in found.orderBy("item_id", "rank").collect():
        assert r["rank"] == len(out[r.item_id]) + 1
        out[r.item_id].append((r.doc_id, r.score))
    return dict(out)


@pytest.mark.parametrize("seed", range(3))
def test_lexical_search_equals_brute_force(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["Ümlaut", "É", "x-y"]
    text = lambda n: " ".join(rng.choice(words, n))
    docs = [(i, text(rng.integers(0, 30))) for i in range(400)] + [(500 + i, "w1 w2 w3 w3") for i in range(40)]
    items = [(i, text(rng.integers(1, 9))) for i in range(30)]
    monkeypatch.setattr(L, "TREE_DOCS", 64)
    found = L.lexical_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert by_item(found) == ranked(docs, items)


def test_lexical_search_in_several_blocks_of_items(spark, monkeypatch):
    docs = [(i, f"a{i % 7} b{i % 5} c") for i in range(60)]
    items = [(i, f"a{i % 7} b{i % 3} b1") for i in range(40)]
    monkeypatch.setattr(L, "BLOCK_TERMS", 25)
    found = L.lexical_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), top=3)
    assert by_item(found) == ranked(docs, items, 3)


def test_lexical_search_of_awkward_rows(spark):
    long = " ".join(f"t{i % 5000}" for i in range(300_000))
    docs = [(1, None), (2, ""), (3, "--- !"), (4, "The cat"), (4, "the CAT the"), (None, "the cat"), (6, long), (7, "the cat"), (7, "the cat")]
    items = [(1, "cat the the"), (2, None), (3, ""), (4, "t4999 nothing"), (None, "the"), (5, "zebra"), (5, "cat")]
    first = [*items[:5], (5, "cat")]  # of the texts of an item the first in order
    rows = lambda x, a: spark.createDataFrame([(i, t, "en", "z") for i, t in x], f"{a} long, text string, lang string, score string")
    found = by_item(L.lexical_search(rows(docs, "doc_id"), rows(items, "item_id")))
    assert found == ranked(docs, first)
    assert L.lexical_search(rows(docs, "doc_id").limit(0), rows(items, "item_id")).count() == 0
    assert L.lexical_search(rows(docs, "doc_id"), rows(items, "item_id").limit(0)).count() == 0


def test_ball_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    n, v = 600, 50
    group = rng.integers(0, 6, n)
    doc, term = np.nonzero(rng.random((n, v)) < np.where(np.arange(v) // 9 == group[:, None], 0.5, 0.01))
    value = rng.integers(1, 1_000_000, len(doc))
    dense = np.zeros((n, v), np.int64)
    dense[doc, term] = value
    items = object.__new__(L.Items)
    items.names, items.item, items.gain, items.at, items.a = np.arange(4), np.repeat(np.arange(4)[None], v, 0).ravel(), rng.integers(0, 2, 4 * v) * 5000, np.arange(v + 1) * 4, np.arange(v)
    some = np.unique(doc)
    tree = L.Tree(np.searchsorted(some, doc), term, value, len(some), v)
    search = L.Search(items, 3)
    exact = dense[some] @ items.gain.reshape(v, 4)
    for k in range(1 << tree.depth):
        bound = search.bounds(tree, tree.depth, k, np.ones(4, bool))
        assert (exact[tree.leaf(k)[0]] <= bound).all()
    search.add(tree, some)
    assert (np.sort(exact, axis=0)[::-1][:3].T == search.score).all()


def variants(docs, least=S.LEAST_COUNT):
    """By brute force over (doc_id, text)."""
    counts = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(S.UPPER, S.LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= least}

    def one_apart(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {a: [b for b in n if abs(len(a) - len(b)) < 2 and one_apart(a, b)] for a in n}
    best = {a: min(b, key=lambda w: (-n[w], w)) for a, b in near.items() if b}
    form = {a: best[a] if a in best and n[best[a]] >= 2 * n[a] else None for a in n}

    def root(a):
        return root(form[a]) if form[a] else a

    return {a: (a, form[a], root(a), n[a], len(near[a]), n[form[a]] if form[a] else None) for a in n}


def spelt(found):
    return {r.word: tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize(("seed", "most"), [(0, S.MOST), (1, 20)])
def test_spelling_equals_brute_force(spark, seed, most):
    """Short alphabets make near words plenty; small blocks are split into pieces."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abÀÿé"), rng.integers(4, 8)))
    words = [word() for _ in range(250)]
    chance = rng.pareto(1.0, len(words)) + 0.2
    docs = [(i, " ".join(rng.choice(words, 40, p=chance / chance.sum()))) for i in range(120)]
    found = spelt(S.spelling(spark.createDataFrame(docs, "doc_id long, text string"), most))
    assert found == variants(docs) and any(v[1] for v in found.values())


def test_spelling_of_awkward_rows(spark):
    huge, other = "ab" * 400, "ab" * 200 + "c" + "ab" * 200
    chain = ["alpha"] * 40 + ["alphx"] * 18 + ["alphxx"] * 8 + ["alphxxx"] * 3
    docs = [(1, None), (2, ""), (3, "1234 --"), (4, f"{huge} " * 9), (5, f"{other} " * 3), (None, "Straße straße STRASSE Strasse " * 3), (6, " ".join(chain)), (6, " ".join(chain)), (7, "naïve×naïve÷ Naïve naive " * 3), (8, "abcde fghij " * 50_000)]
    rows = spark.createDataFrame([(i, t, "de", "w") for i, t in docs], "doc_id long, text string, lang string, word string")
    found = spelt(S.spelling(rows))
    assert found == variants(docs)
    assert found[other][1] == huge and found["alphxxx"][2] == "alpha"
    assert S.spelling(rows.limit(0)).count() == 0 and S.spelling(rows.where("doc_id < 4")).count() == 0


def test_bit_slices_find_all_pairs_of_one_error():
    rng = np.random.default_rng(9)
    words = list({"".join(rng.choice(list("ab"), rng.integers(1, 7))) for _ in range(90)})
    rows = np.array([list(w.encode().ljust(7, b"\0")) for w in words], np.uint8)
    a, b = S.one_error(rows, rows)
    got = sorted(zip(a.tolist(), b.tolist(), strict=True))

    def near(x, y):
        return x != y and any(y in (x[:i] + c + x[i + 1 :], x[:i] + c + x[i:], x[:i] + x[i + 1 :]) for i in range(len(x) + 1) for c in "ab")

    assert got == [(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if near(x, y)]
