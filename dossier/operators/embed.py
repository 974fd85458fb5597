"""A deterministic embedding for tests and dry runs: one seeded Gaussian for each token, summed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import normalized, tokens

#: Tokens that a task remembers the vectors of; beyond it, it starts anew.
MOST_TOKENS = 50_000


def embeddings(docs: DataFrame, dimension: int = 16, id_col: str = "doc_id", text_col: str = "text", normalize: bool = True) -> DataFrame:
    """id and embedding (float32 array) of every text, in Arrow batches. Null texts and those without a token are zero vectors."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            out = []
            for words in batch:
                total = np.zeros(dimension, np.float32)
                for word in words:
                    if word not in known:
                        if len(known) >= MOST_TOKENS:
                            known.clear()
                        seed = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")
                        known[word] = np.random.default_rng(seed).standard_normal(dimension).astype(np.float32)
                    total = total + known[word]
                norm = float(np.sqrt((total.astype(float) ** 2).sum()))
                out.append((total / norm).astype(np.float32) if normalize and norm else total)
            yield pd.Series(out)

    texts = normalized(docs.select(id_col, text_col), text_col)
    return texts.select(id_col, vectors(tokens(F.col(text_col))).alias("embedding"))
