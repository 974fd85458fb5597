"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte of a text; a document's probabilities are the means over its bytes. Texts are read in
windows of WINDOW bytes, all of them, so that memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm import gru
from dossier.llm import kernels as K
from dossier.llm.samples import bucket

WINDOW, HIDDEN, BATCH = 64, 8, 2048
#: Training documents at most, steps, windows a step, drawn from the whole texts.
TRAIN_DOCS, STEPS, STEP, RATE, SEED = 800, 200, 256, 0.01, 11
#: Training documents of each language at least, where it has them, whatever TRAIN_DOCS says; the most that a rare language's weigh.
LEAST_OF_A_LANG, MOST_WEIGHT = 20, 10.0
UNKNOWN = "und"
PREDICTED = "doc_id long, lang_pred string, score double"


def windows(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and size of consecutive windows of every text."""
    sizes = np.diff(offsets)
    n = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][text] + inner * WINDOW
    return text, start, np.minimum(offsets[1:][text] - start, WINDOW)


def grid(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (time, window) and the mask of those that exist."""
    t = np.arange(WINDOW)[:, None]
    ids = buf[np.minimum(start + t, len(buf) - 1)]
    return ids, (t < size).astype(gru.F4)


class LanguageModel:
    def __init__(self, langs: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p: gru.Params = {}
        for d in "fb":
            self.p[f"x{d}"] = (rng.standard_normal((256, 3 * HIDDEN)) * 0.3).astype(gru.F4)
            self.p[f"u{d}"], self.p[f"c{d}"] = gru.gates(rng, HIDDEN)
            self.p[f"o{d}"] = (rng.standard_normal((len(langs), HIDDEN)) * 0.3).astype(gru.F4)
        self.p["o"] = np.zeros((len(langs), 1), gru.F4)

    def logits(self, ids: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(time, language, window)"""
        out = np.broadcast_to(self.p["o"], (len(ids), len(self.langs), ids.shape[1])).copy()
        for d in "fb":
            table = np.ascontiguousarray(self.p[f"x{d}"].T)
            kept = keep.setdefault(d, []) if keep is not None else None
            states = gru.run(lambda t, table=table: table.take(ids[t], axis=1), mask, self.p[f"u{d}"], self.p[f"c{d}"], d == "b", kept)
            if keep is not None:
                keep[f"h{d}"] = states
            out += self.p[f"o{d}"] @ states
        return out

    @staticmethod
    def softmax(x: np.ndarray) -> np.ndarray:
        x = np.exp(x - x.max(axis=1, keepdims=True))
        x /= x.sum(axis=1, keepdims=True)
        return x

    def train(self, texts: list[bytes], labels: np.ndarray) -> None:
        """Cross entropy of every byte's label with the document's language; languages weigh alike up to MOST_WEIGHT, and so do the documents of one."""
        counts = np.bincount(labels, minlength=len(self.langs))
        weight = np.minimum(counts.mean() / np.maximum(counts, 1), MOST_WEIGHT)[labels]
        buf, offsets = K.utf8(pa.array(texts, pa.binary()))
        text, start, size = windows(buf, offsets)
        chance = (weight / np.maximum(np.bincount(text, minlength=len(texts)), 1))[text]  # a document's windows share its weight
        rng, adam = np.random.default_rng(SEED), gru.Adam(self.p, RATE)
        for step in range(STEPS if len(text) else 0):
            adam.rate = RATE * (1 - step / STEPS)
            rows = rng.choice(len(text), STEP, p=chance / chance.sum())
            adam.step(self.gradients(*grid(buf, start[rows], size[rows]), labels[text[rows]]))

    def gradients(self, ids: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> gru.Params:
        """Of the mean cross entropy of all bytes with their windows' labels."""
        kept: dict = {}
        d = self.softmax(self.logits(ids, mask, kept))
        d[:, labels, np.arange(len(labels))] -= 1
        d *= mask[:, None] / mask.sum()
        grads = {"o": d.sum(axis=(0, 2))[:, None]}
        for way in "fb":
            grads[f"o{way}"] = np.einsum("tlb,thb->lh", d, kept[f"h{way}"])
            d_in, grads[f"u{way}"], grads[f"c{way}"] = gru.backward(self.p[f"o{way}"].T @ d, kept[way], mask, self.p[f"u{way}"])
            grads[f"x{way}"] = gru.scatter_rows((256, 3 * HIDDEN), ids.ravel(), d_in.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN))
        return grads

    def documents(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(document, language): mean probabilities over all bytes; 0 for empty texts."""
        text, start, size = windows(buf, offsets)
        sums = np.zeros((len(offsets) - 1, len(self.langs)))
        for i in range(0, len(text), BATCH):
            part = slice(i, i + BATCH)
            ids, mask = grid(buf, start[part], size[part])
            p = self.softmax(self.logits(ids, mask))
            p *= mask[:, None]
            np.add.at(sums, text[part], p.sum(axis=0).T)
        return sums / np.maximum(np.diff(offsets), 1)[:, None]


def quotas(counts: dict[str, int], most: int) -> dict[str, int]:
    """Training documents of each language: ``most`` in equal parts, what rare ones leave going to others, LEAST_OF_A_LANG at least."""
    out, left = {}, most
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(left // (len(counts) - k), LEAST_OF_A_LANG))
        left = max(0, left - out[lang])
    return out


def language_model(docs: DataFrame, most: int = TRAIN_DOCS) -> LanguageModel | None:
    """A model of all languages of ``docs`` (doc_id, text, lang), without those held out; None without labelled text."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket("doc_id", 3) != 1))
    ids = rows.select("doc_id", "lang").distinct()
    counts = {r.lang: r["count"] for r in ids.groupBy("lang").count().collect()}
    share = quotas(counts, most)
    if not share:
        return None
    by_lang = lambda x: F.create_map(*(F.lit(v) for pair in x.items() for v in pair))[F.col("lang")]
    # those with the smallest hashes; what lies far above the wanted number's place needs no order
    reach = {lang: (n + 8 * n**0.5 + 16) / counts[lang] for lang, n in share.items()}
    low = ids.where(F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5 <= by_lang(reach))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = {(r.doc_id, r.lang) for r in low.withColumn("place", place).where(F.col("place") <= by_lang(share)).collect()}
    texts = rows.where(F.col("doc_id").isin([i for i, _ in chosen]))  # whole texts of so many rows
    found = [r for r in texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).orderBy("doc_id", "lang").collect() if (r.doc_id, r.lang) in chosen]
    if not found:
        return None
    langs = sorted({r.lang for r in found})
    model = LanguageModel(langs)
    model.train([r.text.encode() for r in found], np.array([langs.index(r.lang) for r in found]))
    return model


def _predicted(model: LanguageModel | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, offsets in K.blocks(batch):
            raw = buf.tobytes()
            lettered = np.array([any(map(str.isalpha, raw[i:j].decode("utf-8", "replace"))) for i, j in zip(offsets[:-1], offsets[1:], strict=True)], bool)
            if model is None:
                names, scores = [UNKNOWN] * rows.num_rows, np.zeros(rows.num_rows)
            else:
                p = model.documents(buf, offsets)
                best = p.argmax(axis=1)
                names = [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)]
                scores = np.where(lettered, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])


def language_id(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """Predict the language of every whole text of ``docs`` (doc_id, text, and lang for fitting; others are ignored).

    A null or empty text and one without a letter is ``und`` with score 0, as is every text where nothing is labelled.
    Repeated rows give repeated results; an empty table gives none. Returns doc_id, held_out, lang_pred, score.
    """
    model = model or language_model(docs)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _predicted(model, b), PREDICTED)
    return found.select("doc_id", (bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
