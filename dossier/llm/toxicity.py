"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs.

A step reads one word: an embedding of the word, beside the mean embedding of its letter triples (hashed). Words of the
vocabulary, those of several training documents, have a row each; all others share one. A row's first number stays what
it starts as: by how many standard errors the shares of toxic and of other documents that hold the word differ. A window of WINDOW words is pooled by attention and scored; windows start every STRIDE words, so they overlap and cover the
whole text. A document's score is its highest window's, in training as in use, since labels mark whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import gru
from dossier.llm import kernels as K
from dossier.llm.samples import bucket, sampled

WINDOW, STRIDE, HIDDEN, BATCH = 32, 16, 12, 2048
TRIPLE_ROWS, WORD_DIM, TRIPLE_DIM = 1 << 13, 8, 8
#: Training documents of each label at most, steps, documents a step and toxic ones of these.
TRAIN_DOCS, STEPS, STEP, TOXIC_A_STEP, RATE, SEED = 1_200, 240, 48, 12, 0.01, 5
#: Word hashes that near-copies are told by: of many copies each weighs its part.
SKETCH = 16
#: Documents that hold a word of the vocabulary at least; its words at most, the most widespread; share of embeddings zeroed in training; decay of the embeddings a step.
LEAST_DOCS, MOST_WORDS, DROPPED, DECAY = 3, 1 << 16, 0.3, 0.002
#: Share of the steps, the last ones, whose mean the parameters are.
SETTLED = 0.25
#: Parameters are multiples of this in training: what another order of sums changes is far less, and so is lost at each step.
GRID = 2.0**-18
#: Blocks of windows that training scores at once; their number changes no result.
THREADS = 4
SCORED = "doc_id long, score double"


class Words:
    """The distinct words of some texts with their hashed features, and the texts' windows."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray):
        start, end, hashes, at = K.words(buf, offsets, breaks=K.IS_BREAK)
        unique, first, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(vocabulary, unique), max(len(vocabulary) - 1, 0))
        self.row = np.where(vocabulary[place] == unique, place + 1, 0) if len(vocabulary) else np.zeros(len(unique), np.int64)
        # letter triples of each distinct word, with its borders as letters of their own
        a, n = start[first], (end - start)[first]
        self.of = np.repeat(np.arange(len(a)), n)
        inner = np.arange(len(self.of)) - np.repeat(np.cumsum(n) - n, n)
        at_byte = np.repeat(a, n) + inner
        value = K.FOLDED_VALUES
        here = value[buf[at_byte]] if len(at_byte) else np.zeros(0, K.U)
        left = np.where(inner > 0, value[buf[np.maximum(at_byte - 1, 0)]], K.U(1)) if len(at_byte) else here
        right = np.where(inner < np.repeat(n, n) - 1, value[buf[np.minimum(at_byte + 1, len(buf) - 1)]], K.U(2)) if len(at_byte) else here
        self.triple = (K.mix(left * K.U(3) + here * K.U(K.BASE) + right * K.U(K.SHINGLE)) % K.U(TRIPLE_ROWS)).astype(np.int64)
        self.head, self.share = np.cumsum(n) - n, 1 / np.maximum(n, 1)
        #: In training: which words' two embeddings are seen.
        self.seen: np.ndarray | None = None
        self._windows(at)

    def _windows(self, at: np.ndarray) -> None:
        self.at, counts = at, np.diff(at)
        windows = np.where(counts > 0, np.maximum(-(-(counts - WINDOW) // STRIDE), 0) + 1, 0)
        self.text = np.repeat(np.arange(len(counts)), windows)
        k = np.arange(len(self.text)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.start = at[:-1][self.text] + k * STRIDE
        self.size = np.minimum(at[1:][self.text] - self.start, WINDOW)

    def only(self, words: np.ndarray) -> Words:
        """Features of some distinct words alone, in rising order; no windows."""
        out = object.__new__(Words)
        out.row, out.share, out.seen = self.row[words], self.share[words], None if self.seen is None else self.seen[words]
        n = np.append(self.head, len(self.triple))[words + 1] - self.head[words]
        out.head, out.of = np.cumsum(n) - n, np.repeat(np.arange(len(words)), n)
        out.triple = self.triple[np.arange(len(out.of)) + (self.head[words] - out.head)[out.of]]
        return out

    def part(self, texts: np.ndarray) -> Words:
        """What these texts alone would give, without reading them anew."""
        spans = [self.word[self.at[i] : self.at[i + 1]] for i in texts]
        held = np.zeros(len(self.row), bool)
        for x in spans:
            held[x] = True
        out = self.only(np.flatnonzero(held))
        out.word = (np.cumsum(held) - 1)[np.concatenate(spans)]
        out._windows(np.append(0, np.cumsum([len(x) for x in spans])))
        return out

    def grid(self, rows: np.ndarray | slice, kind: np.dtype = np.dtype(float)) -> tuple[np.ndarray, np.ndarray]:
        """Distinct word of every step (time, window), and the mask of steps that exist."""
        t = np.arange(WINDOW)[:, None]
        return self.word[np.minimum(self.start[rows] + t, len(self.word) - 1)], (t < self.size[rows]).astype(kind)


def copies(held: list[np.ndarray]) -> np.ndarray:
    """Of each text, given its distinct word hashes: how many of the texts share half of its SKETCH smallest ones, itself included."""
    sketch = np.full((len(held), SKETCH), K.U((1 << 64) - 1))
    for i, h in enumerate(held):
        sketch[i, : len(h)] = h[:SKETCH]
    n = np.ones(len(held))
    for i, h in enumerate(held):
        own = h[:SKETCH]
        if len(own):
            place = np.minimum(np.searchsorted(own, sketch), len(own) - 1)
            n[i] = max(1, ((own[place] == sketch).sum(axis=1) * 2 >= max(len(own), 2)).sum())
    return n


class ToxicityModel:
    def __init__(self, vocabulary: np.ndarray | None = None, marks: np.ndarray | None = None, seed: int = SEED):
        """vocabulary: sorted word hashes; marks: the first number of their rows."""
        rng = np.random.default_rng(seed)
        small = lambda *shape, size=0.3: rng.standard_normal(shape) * size
        self.vocabulary = np.zeros(0, K.U) if vocabulary is None else vocabulary
        # embeddings start near 0: words that training never met then say little
        self.p: gru.Params = {"word": small(len(self.vocabulary) + 1, WORD_DIM, size=0.02), "triple": small(TRIPLE_ROWS, TRIPLE_DIM, size=0.05)}
        self.p["word"][:, 0] = 0
        if marks is not None:
            self.p["word"][1:, 0] = marks
        for d in "fb":
            self.p[f"w{d}"] = small(3 * HIDDEN, WORD_DIM + TRIPLE_DIM)
            self.p[f"u{d}"], self.p[f"c{d}"] = (a.astype(float) for a in gru.gates(rng, HIDDEN))
        self.p |= {"att": small(HIDDEN, 2 * HIDDEN), "v": small(1, HIDDEN), "o": small(1, 2 * HIDDEN), "bias": np.full((1, 1), -1.0)}

    @property
    def kind(self) -> np.dtype:
        """Doubles in training, 32 bits in use."""
        return self.p["o"].dtype

    def features(self, words: Words) -> np.ndarray:
        """(word, feature)"""
        sums = np.add.reduceat(self.p["triple"][words.triple], words.head, axis=0) if len(words.head) else np.zeros((0, TRIPLE_DIM), self.kind)
        x = np.concatenate([self.p["word"][words.row], sums * words.share[:, None].astype(self.kind)], axis=1)
        return x if words.seen is None else x * np.repeat(words.seen, (WORD_DIM, TRIPLE_DIM), axis=1)

    def logits(self, inputs: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """A score for each window. inputs: by direction, the gates' input of each distinct word (3 hidden, word)."""
        states = []
        for d in "fb":
            kept = keep.setdefault(d, []) if keep is not None else None
            states.append(gru.run(lambda t, x=inputs[d]: x.take(ids[t], axis=1), mask, self.p[f"u{d}"], self.p[f"c{d}"], d == "b", kept))
        h = np.concatenate(states, axis=1)
        a = np.tanh(self.p["att"] @ h)
        e = (self.p["v"] @ a)[:, 0] + (mask - 1) * 30
        e = np.exp(e - e.max(axis=0))
        e *= mask
        e /= np.maximum(e.sum(axis=0), 1e-9)
        pooled = np.einsum("thb,tb->hb", h, e)
        if keep is not None:
            keep |= {"h": h, "a": a, "e": e, "pooled": pooled}
        return (self.p["o"] @ pooled + self.p["bias"])[0]

    def scores(self, inputs: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """logits(), with the inputs of the words in ids alone: of many distinct words, those of some windows then lie together."""
        if inputs["f"].shape[1] > ids.size:
            own, ids = (a.reshape(shape) for a, shape in zip(np.unique(ids, return_inverse=True), (-1, ids.shape), strict=True))
            inputs = {d: x.take(own, axis=1) for d, x in inputs.items()}
        return self.logits(inputs, ids, mask)

    def inputs(self, words: Words) -> dict[str, np.ndarray]:
        x = self.features(words).T
        return {d: np.ascontiguousarray(self.p[f"w{d}"] @ x) for d in "fb"}

    @classmethod
    def trained(cls, texts: list[str], labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> ToxicityModel:
        """Vocabulary and marks of the whole texts, then logistic loss of each document's highest window; the labels weigh alike.

        Fitted in doubles, so that other machines and numbers of threads give the same model, and then used in 32 bits.
        """
        held = [np.unique(K.words(*K.utf8(pa.array([t], pa.string())), breaks=K.IS_BREAK)[2]) for t in texts]
        weight = 1 / copies(held)
        flat, by = np.concatenate(held), np.repeat(weight, [len(h) for h in held])
        words, place = np.unique(flat, return_inverse=True)
        n = np.bincount(place, by)
        n_toxic = np.bincount(place, by * np.repeat(labels == 1, [len(h) for h in held]))
        chosen = np.flatnonzero(n > LEAST_DOCS - 0.5)
        chosen = np.sort(chosen[np.lexsort((words[chosen], -n[chosen]))[:MOST_WORDS]])
        words, n, n_toxic = words[chosen], n[chosen], n_toxic[chosen]
        n_1, n_0 = weight[labels == 1].sum(), weight[labels == 0].sum()
        share = (n + 1) / (n_1 + n_0 + 2)
        errors = (n_toxic / n_1 - (n - n_toxic) / n_0) / np.sqrt(share * (1 - share) * (1 / n_1 + 1 / n_0))
        model = cls(words, (np.sign(errors) * np.round(np.tanh(np.maximum(np.abs(errors) - 2, 0) / 4) / GRID) * GRID), seed)
        model.fit(texts, labels, weight, steps, seed)
        model.p = {k: v.astype(gru.F4) for k, v in model.p.items()}
        return model

    def fit(self, texts: list[str], labels: np.ndarray, weight: np.ndarray, steps: int, seed: int = SEED) -> None:
        """Steps of STEP documents, TOXIC_A_STEP of them toxic, drawn by weight; the mean of the last SETTLED of the steps stays.

        Texts are read once, and a document that a step draws again is scored once in it, so a few long ones don't hold it up.
        """
        rng, adam = np.random.default_rng(seed), gru.Adam(self.p, RATE)
        whole = Words(*K.utf8(pa.array(texts, pa.large_string())), self.vocabulary)
        mean, n_mean = {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        chance = [np.where(labels == y, weight, 0) / weight[labels == y].sum() for y in (0, 1)]
        for step in range(steps):
            adam.rate = RATE * (1 - step / steps)
            docs = np.concatenate([rng.choice(len(texts), n, p=p) for n, p in zip((STEP - TOXIC_A_STEP, TOXIC_A_STEP), chance, strict=True)])
            drawn, place = np.unique(docs, return_inverse=True)
            words = whole.part(drawn)
            if not len(words.text):
                continue
            words.seen = (rng.random((len(words.row), 2)) >= DROPPED).astype(self.kind)
            inputs = self.inputs(words)
            with ThreadPoolExecutor(THREADS) as pool:
                scores = np.concatenate(list(pool.map(lambda i, w=words, x=inputs: self.scores(x, *w.grid(slice(i, i + BATCH), self.kind)), range(0, len(words.text), BATCH))))
            order = np.lexsort((-scores, words.text))
            first = order[np.concatenate([[True], words.text[order][1:] != words.text[order][:-1]])]
            of_text = np.full(len(drawn), -1)
            of_text[words.text[first]] = first
            best = of_text[place]
            y, best = labels[docs][best >= 0], best[best >= 0]
            self.descend(adam, self.gradients(words, inputs, best, y))
            if step >= steps * (1 - SETTLED):
                n_mean += 1
                for k, v in self.p.items():
                    mean[k] += v
        if n_mean:
            self.p |= {k: v / n_mean for k, v in mean.items()}

    def descend(self, adam: gru.Adam, g: gru.Params) -> None:
        g["word"][:, 0] = 0
        marks = self.p["word"][:, 0].copy()
        adam.step(g)
        self.p["word"] *= self.kind.type(1 - DECAY)
        self.p["triple"] *= self.kind.type(1 - DECAY)
        self.p["word"][:, 0] = marks
        for v in self.p.values():
            np.round(v / GRID, out=v)
            v *= GRID

    def gradients(self, words: Words, inputs: dict, rows: np.ndarray, y: np.ndarray) -> gru.Params:
        """Of the mean logistic loss of the windows ``rows`` with labels y. Only their words have any."""
        ids, mask = words.grid(rows, self.kind)
        own, near = np.unique(ids, return_inverse=True)
        ids, words, inputs = near.reshape(ids.shape), words.only(own), {d: x.take(own, axis=1) for d, x in inputs.items()}
        kept: dict = {}
        score = self.logits(inputs, ids, mask, kept)
        d = ((1 / (1 + np.exp(-score)) - y) / len(rows)).astype(self.kind)[None]
        h, a, e = kept["h"], kept["a"], kept["e"]
        g = {"o": d @ kept["pooled"].T, "bias": d.sum(keepdims=True)}
        d_pooled = self.p["o"].T @ d
        d_e = np.einsum("thb,hb->tb", h, d_pooled)
        d_e = e * (d_e - (e * d_e).sum(axis=0))
        d_a = self.p["v"].T[None] * d_e[:, None] * (1 - a * a)
        g["v"] = np.einsum("thb,tb->h", a, d_e)[None]
        g["att"] = np.einsum("tab,thb->ah", d_a, h)
        d_h = e[:, None] * d_pooled[None] + self.p["att"].T @ d_a
        d_x = np.zeros((len(words.row), WORD_DIM + TRIPLE_DIM), self.kind)
        x = self.features(words)
        for k, way in enumerate("fb"):
            d_in, g[f"u{way}"], g[f"c{way}"] = gru.backward(d_h[:, k * HIDDEN : (k + 1) * HIDDEN], kept[way], mask, self.p[f"u{way}"])
            by_word = gru.scatter_rows((len(words.row), 3 * HIDDEN), ids.ravel(), d_in.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN))
            g[f"w{way}"] = by_word.T @ x
            d_x += by_word @ self.p[f"w{way}"]
        if words.seen is not None:
            d_x *= np.repeat(words.seen, (WORD_DIM, TRIPLE_DIM), axis=1)
        g["word"] = gru.scatter_rows(self.p["word"].shape, words.row, d_x[:, :WORD_DIM])
        g["triple"] = gru.scatter_rows((TRIPLE_ROWS, TRIPLE_DIM), words.triple, (d_x[:, WORD_DIM:] * words.share[:, None])[words.of])
        return g

    def documents(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of each text: that of its highest window; that of a window without signal if it has no word."""
        words = Words(buf, offsets, self.vocabulary)
        best = np.full(len(offsets) - 1, -np.inf)
        if len(words.text):
            inputs = self.inputs(words)
            for i in range(0, len(words.text), BATCH):
                part = slice(i, i + BATCH)
                np.maximum.at(best, words.text[part], self.logits(inputs, *words.grid(part, self.kind)))
        return 1 / (1 + np.exp(-np.where(np.isfinite(best), best, np.minimum(float(self.p["bias"][0, 0]), -1.0))))


def toxicity_model(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> ToxicityModel | None:
    """A model of ``labels`` (doc_id, toxic), without those held out; None unless both labels have a text.

    Ids that are labelled both ways teach nothing; every text of an id that repeats has its label.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(F.col("toxic").isin(0, 1) & (bucket("doc_id", 5) != 0))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").select("doc_id", "toxic")
    chosen = [sampled(known.where(F.col("toxic") == y), most) for y in (1, 0)]
    marks = {r.doc_id: r.toxic for part in chosen for r in part.collect()}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull() & F.col("doc_id").isin(list(marks)))
    found = texts.orderBy("doc_id", "text").limit(2 * most).collect()  # bounded in rows; whole texts
    y = np.array([marks[r.doc_id] for r in found], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    return ToxicityModel.trained([r.text for r in found], y)


def _scored(model: ToxicityModel | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, offsets in K.blocks(batch):
            p = model.documents(buf, offsets) if model else np.zeros(rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(p, pa.float64())], names=["doc_id", "score"])


def toxicity(docs: DataFrame, labels: DataFrame | None = None, model: ToxicityModel | None = None) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text; other columns are ignored), with a model fitted to ``labels``.

    Null and empty texts, and those without a word, get a low score; all texts get 0 where the labels don't hold both
    values. Repeated rows give repeated results; an empty table gives none. Returns doc_id, held_out, score, predicted.
    """
    model = model or toxicity_model(docs, labels)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _scored(model, b), SCORED)
    return found.select("doc_id", (bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame | None = None, model: ToxicityModel | None = None) -> DataFrame:
    """The rows of ``docs`` that toxicity() doesn't predict to be toxic, with all their columns."""
    model = model or toxicity_model(docs, labels)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offsets in K.blocks(batch):
                yield rows.filter(pa.array(model.documents(buf, offsets) < 0.5))

    return docs.mapInArrow(clean, docs.schema) if model else docs
