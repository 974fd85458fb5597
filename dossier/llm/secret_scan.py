"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import kernels as K
from dossier.llm.samples import sampled

# The kinds in the order in which they are listed, and their patterns.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: Least length of what the models judge; the least log-likelihood ratio that makes a secret, see SecretModel.
LEAST_CANDIDATE, LEAST_TOTAL = 16, 12.0
#: Documents whose words train the chain of identifiers; random strings of each style; seed.
SAMPLE_DOCS, RANDOM_STRINGS, SEED = 400, 2_000, 23
#: Share of identifiers that may be taken for secrets; letters of a word of the sample at most: longer ones are no names.
FALSE_ALARMS, LONGEST_WORD = 0.001, 64
# Alphabets of random strings.
STYLES = {
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "url_base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-",
    "alphanumeric": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "small": "abcdefghijklmnopqrstuvwxyz0123456789",
    "hex": "0123456789abcdef",
    "capital_hex": "0123456789ABCDEF",
}
SPANS = "doc_id long, spans array<struct<kind:string,start:int,stop:int>>"
_CODE = np.full(128, -1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
_IN_TOKEN = np.zeros(256, bool)
_IN_TOKEN[[ord(c) for c in ALPHABET]] = True


def _bigrams(texts: list[str]) -> np.ndarray:
    """log P(next character | character) with add-one counts; row len(ALPHABET) is a text's start."""
    n = len(ALPHABET)
    counts = np.ones((n + 1, n))
    for text in texts:
        codes = _CODE[np.frombuffer(text.encode("ascii"), np.uint8)]
        np.add.at(counts, (np.concatenate([[n], codes[:-1]]), codes), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def random_strings(style: str, n: int = RANDOM_STRINGS, seed: int = SEED) -> list[str]:
    """Labelled positives: n random strings over an alphabet of STYLES."""
    rng = np.random.default_rng([seed, list(STYLES).index(style)])
    return ["".join(rng.choice(list(STYLES[style]), size)) for size in rng.integers(LEAST_CANDIDATE, 64, n)]


def ordinary_words(docs: DataFrame) -> list[str]:
    """Distinct token-like words of a bounded sample of whole documents.

    Without those that a pattern finds, those over LONGEST_WORD, and those of a candidate's length that mix letters and
    digits otherwise than names with numbers do: the sample isn't labelled, and may hold secrets.
    """
    texts = sampled(docs.select("doc_id", "text"), SAMPLE_DOCS)
    found = texts.select(F.explode(F.regexp_extract_all("text", F.lit(f"({CANDIDATE.pattern})"), 1)).alias("word")).where(F.length("word").between(3, LONGEST_WORD)).distinct()
    mixed = lambda w: len(w) >= LEAST_CANDIDATE and any(c.isdigit() for c in w) and any(c.isalpha() for c in w) and not re.fullmatch(r"(?:[A-Za-z]*[0-9]{0,6}[-_./=])*[A-Za-z]*[0-9]{0,6}", w)
    return sorted(w for w in (r.word for r in found.collect()) if not base_spans(w) and not mixed(w)) or ["value", "name", "document"]


def identifiers(words: list[str], seed: int = SEED) -> list[str]:
    """Labelled negatives: the words, their compounds in the usual spellings, names with numbers at their end and inside, plain numbers and dates."""
    rng = np.random.default_rng(seed)
    pick = lambda: words[rng.integers(len(words))]
    joined = [sep.join(pick() for _ in range(rng.integers(2, 5))) for sep in ("_", "-", ".", "/", "") for _ in range(600)]
    camel = ["".join(pick().capitalize() for _ in range(rng.integers(2, 5))) for _ in range(600)]
    numbered = [f"{pick()}{sep}{rng.integers(1, 3000)}" for sep in ("_", "-", "/", "=", ".", "") for _ in range(200)]
    inside = [f"{pick()}{rng.integers(1, 3000)}{sep}{pick()}{rng.integers(0, 10)}" for sep in ("_", "-", "/", "") for _ in range(150)]
    numbers = ["".join(rng.choice(list("0123456789"), n)) for n in rng.integers(2, 24, 600)]
    dates = [f"{rng.integers(1990, 2040)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}" for _ in range(100)]
    versions = [".".join(str(rng.integers(0, 256)) for _ in range(rng.integers(2, 5))) for _ in range(200)]
    return words + joined + camel + numbered + inside + numbers + dates + versions + [w.upper() for w in joined[::5]]


class SecretModel:
    """Log-likelihood ratio of Markov chains: the likeliest of random strings' chains, one for each style, against identifiers.

    Every fourth identifier is kept from training. A secret's mean ratio by character lies above those of all but
    FALSE_ALARMS of them, and its whole ratio is LEAST_TOTAL at least; so a few odd words, however long, move nothing.
    """

    def __init__(self, random: dict[str, list[str]], ordinary: list[str]):
        fit = [w for i, w in enumerate(ordinary) if i % 4]
        plain = _bigrams(fit)
        self.ratios = np.stack([_bigrams(strings) - plain for strings in random.values()])
        spared = [self.score(w) / len(w) for w in ordinary[::4] if len(w) >= LEAST_CANDIDATE]
        self.least = float(np.quantile(spared, 1 - FALSE_ALARMS)) if spared else 0.0

    def score(self, token: str) -> float:
        codes = _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]
        return float(self.ratios[:, np.concatenate([[len(ALPHABET)], codes[:-1]]), codes].sum(axis=1).max() - np.log(len(self.ratios)))

    def secret(self, token: str) -> bool:
        total = self.score(token)
        return total >= LEAST_TOTAL and total > self.least * len(token)

    def spans(self, text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Candidates that seem random and touch no span already taken."""
        found = []
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            if b - a >= LEAST_CANDIDATE and all(b <= x or y <= a for x, y in taken) and self.secret(m[0]):
                found.append((a, b))
        return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST_HEX]
    return sorted(found)


def _has_run(inside: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """Of each text: has it ``least`` such bytes in a row? A run over two texts only adds a text to look at."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    out = np.zeros(len(offsets) - 1, bool)
    for at, stop in zip(start[long], end[long], strict=True):
        out[np.searchsorted(offsets, at, "right") - 1 : np.searchsorted(offsets, stop, "left")] = True
    return out


def _scan(model: SecretModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        for rows, buf, offsets in K.blocks(batch):
            # exact test on bytes: a span of any kind but assign is a run of LEAST_CANDIDATE token characters or more, and one of that kind holds ":" or "="
            look = _has_run(_IN_TOKEN[buf], offsets, min(LEAST_CANDIDATE, LEAST_ACCESS, LEAST_HEX))
            marks = np.flatnonzero((buf == 58) | (buf == 61))
            look[np.searchsorted(offsets, marks, "right") - 1] = True
            out: list[list[dict]] = [[] for _ in range(rows.num_rows)]
            raw = buf.tobytes()
            for i in np.flatnonzero(look):
                text = raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")
                base = base_spans(text)
                more = [(a, 3, b) for a, b in model.spans(text, [(a, b) for a, _, b in base])]
                out[i] = [{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in sorted(base + more)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(out, kind)], names=["doc_id", "spans"])


def secret_model(docs: DataFrame) -> SecretModel:
    return SecretModel({style: random_strings(style) for style in STYLES}, identifiers(ordinary_words(docs)))


def secret_scan(docs: DataFrame, model: SecretModel | None = None) -> DataFrame:
    """Every span of a secret in every text of ``docs`` (doc_id, text; other columns are ignored).

    Spans are in code points, the end exclusive, in order of start, then kind. Patterns: see KINDS; the models add spans
    of kind ``markov`` that touch no other. Null and empty texts have no span. Repeated rows give repeated results; an
    empty table gives none. Returns doc_id, spans.
    """
    model = model or secret_model(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _scan(model, b), SPANS)


def digest(found: DataFrame) -> DataFrame:
    """Counts and hashes of the spans of secret_scan()."""
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count(KINDS[3]))


def redacted(docs: DataFrame, model: SecretModel | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with ``mark`` in place of every span in ``text``; all rows and other columns stay."""
    model = model or secret_model(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches(list(_scan(model, iter([batch.select(["doc_id", "text"])]))))
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(found.column("spans").to_pylist()):
                end, parts = 0, []
                for s in spans:
                    if s["stop"] > end:
                        parts += [texts[i][end : max(end, s["start"])], mark if s["start"] >= end else ""]
                        end = s["stop"]
                if spans:
                    texts[i] = "".join(parts) + texts[i][end:]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.schema.field("text").type))

    return docs.mapInArrow(cut, docs.schema)


def assigned(text: str) -> str:
    """base_sha256 of one text, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base_spans(text)).encode()).hexdigest()
