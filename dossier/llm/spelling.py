"""Spelling variants: words of a corpus that differ by one letter from a much more frequent word.

1. Count the words natively, partial counts first.
2. Two words within one edit share the first or the last half of the shorter one's letters. Each word is listed under
   these halves, and lists are dealt into blocks; a block beyond MOST words or MOST_LETTERS is split into pieces and every
   pair of pieces is compared, so no list is gathered whole and none is cut.
3. A block has a bit-sliced position index: for each position and letter the set of words with that letter there, as
   bits. Word-parallel recurrences go over the positions of many words at once and keep the sets of words met without an
   error and with one (a replaced, an inserted, a deleted letter), the latter two through the slices of the next and the
   last position.
4. Forms are followed to their roots by pointer doubling over tables.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.sizes import broadcast_if, is_small
from dossier.llm.scratch import removed, written

#: Letters of a word and its occurrences, at least.
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One occurrence in so many loses a letter, chosen by its hash.
DAMAGED = 97
#: Words a block has on average; words and letters from which it is split.
BLOCK, MOST, MOST_LETTERS = 1_024, 8_192, 1 << 24
#: Letters from which a word's list is a block of its own.
LONG = 64
#: Words whose sets are followed together.
TOGETHER = 1_024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = "word string, n_near long, form_n long, form string"


def words_of(doc_id: Column, text: Column) -> Column:
    """The words of a text, as an array: runs of letters, A-Z lower-cased; of some, told by a hash, one letter is taken out.

    A null id counts as empty in the hash. Runs under LEAST_LETTERS can't give a word and are left out.
    """
    runs = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}"), F.lit(0))
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"))

    def one(run: Column) -> Column:
        h = F.crc32(F.concat(key, run).cast("binary"))
        at = (h % F.length(run)).cast("int")
        return F.when(h % DAMAGED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)

    return F.transform(runs, one)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all documents."""
    found = docs.select(F.explode(words_of(F.col("doc_id"), F.col("text"))).alias("word")).where(F.length("word") >= LEAST_LETTERS)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _slices(letters: np.ndarray, position: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The bitsets of one position, a row for each letter that occurs there and one of zeros; and each letter's row."""
    n, width = len(letters), max(width, 1)
    column = letters[:, position] if 0 <= position < letters.shape[1] else np.zeros(n, np.uint8)
    present = np.unique(column) if position >= 0 else np.zeros(0, np.uint8)
    bits = np.zeros((len(present) + 1, width * 8), np.uint8)
    packed = np.packbits(column[None] == present[:, None], axis=1, bitorder="little")
    bits[: len(present), : packed.shape[1]] = packed
    row = np.full(256, len(present), np.int64)
    row[present] = np.arange(len(present))
    return bits.view("<u8"), row


def one_error(asked: np.ndarray, indexed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (asked, indexed) of all pairs of words that differ by one letter put in, taken out or replaced.

    Both are matrices of letters, a row for each word, with zeros behind its end. Zeros count as a letter, so that a
    letter at the end is met by a replaced zero.
    """
    n, width = len(indexed), -(-len(indexed) // 64)
    length = max(asked.shape[1], indexed.shape[1])
    every = np.zeros(width * 8, np.uint8)
    every[: -(-n // 8)] = np.packbits(np.ones(n, bool), bitorder="little")
    places = []
    for first in range(0, len(asked), TOGETHER):
        part = asked[first : first + TOGETHER]
        exact = np.tile(every.view("<u8"), (len(part), 1))
        replaced, inserted, deleted = (np.zeros_like(exact) for _ in range(3))
        before, here, after = (_slices(indexed, i, width) for i in (-1, 0, 1))
        for i in range(length + 1):
            letter = part[:, i] if i < part.shape[1] else np.zeros(len(part), np.uint8)
            same = here[0][here[1][letter]]
            inserted |= exact
            inserted &= after[0][after[1][letter]]
            deleted &= before[0][before[1][letter]]
            deleted |= exact
            replaced &= same
            replaced |= exact & ~same
            exact &= same
            before, here, after = here, after, _slices(indexed, i + 2, width)
        near = (replaced | inserted | deleted) & ~exact
        row, at = np.nonzero(near)
        which, bit = np.nonzero(np.unpackbits(near[row, at].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        places.append((row[which] + first, at[which] * 64 + bit))
    return (np.concatenate([p[0] for p in places]), np.concatenate([p[1] for p in places])) if places else (np.zeros(0, np.int64),) * 2


class Listed:
    """Rows (word, n, shorter, ending, piece) of a block, words as matrices of letters."""

    def __init__(self, rows: pa.Table):
        self.word, self.n = rows.column("word").combine_chunks(), rows.column("n").to_numpy()
        raw = [w.encode("latin-1") for w in self.word.to_pylist()]
        self.size = np.array([len(w) for w in raw], np.int64)
        width = int(self.size.max())
        self.letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in raw), np.uint8).reshape(len(raw), width)
        self.shorter, self.ending = rows.column("shorter").to_numpy(), rows.column("ending").to_numpy(zero_copy_only=False)
        half, place = (self.shorter // 2)[:, None], np.arange(int((self.shorter // 2).max()))
        self.head = np.where(place < half, self.letters[:, : len(place)], 0)
        self.tail = np.where(place < half, np.take_along_axis(self.letters, np.maximum(self.size[:, None] - 1 - place, 0), 1), 0)
        order = np.argsort(np.array(raw, dtype=object), kind="stable")
        self.order = np.empty(len(raw), np.int64)
        self.order[order] = np.arange(len(raw))

    def near(self, asked: np.ndarray, indexed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of near words, each pair of words in one list alone: that of their common head, else of their common tail."""
        a, b = one_error(self.letters[asked], self.letters[indexed])
        a, b = asked[a], indexed[b]
        one_list = (self.shorter[a] == self.shorter[b]) & (self.ending[a] == self.ending[b]) & (np.minimum(self.size[a], self.size[b]) == self.shorter[a])
        a, b = a[one_list], b[one_list]
        head = (self.head[a] == self.head[b]).all(axis=1)
        kept = np.where(self.ending[a], ~head & (self.tail[a] == self.tail[b]).all(axis=1), head)
        return a[kept], b[kept]


def _near(rows: pa.Table) -> pa.Table:
    """Of each row of a block with near words in it: their number, and the most frequent of them, the first in order if several are."""
    x = Listed(rows)
    piece = rows.column("piece").to_numpy()
    pieces = [np.flatnonzero(piece == p) for p in np.unique(piece)]
    whole = rows.column("a")[0] == rows.column("b")[0]
    pairs = [(pieces[0], pieces[0])] if whole else [(pieces[0], pieces[1]), (pieces[1], pieces[0])] if len(pieces) == 2 else []
    found = [x.near(*p) for p in pairs]
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    order = np.lexsort((x.order[b], -x.n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(a)))
    return pa.table({"word": x.word.take(pa.array(a[first])), "n_near": pa.array(counts, pa.int64()), "form_n": pa.array(x.n[b[first]], pa.int64()), "form": x.word.take(pa.array(b[first]))})


def near_words(words: DataFrame, most: int = MOST, scratch: list[DataFrame] | None = None) -> DataFrame:
    """(word, n_near, form_n, form) of the words (word, n) with a near one: how many there are, and the most frequent.

    Words must be distinct, without null, of code points up to 255. scratch: gets the written table that the result reads.
    """
    n_blocks = max(1, -(-4 * words.count() // BLOCK))
    size = F.length("word")
    # as the shorter or as long a word of a pair, and as the longer; by head and by tail
    own = [F.struct((size - less).alias("shorter"), F.lit(tail).alias("ending")) for less in (0, 1) for tail in (False, True)]
    listed = words.select("word", "n", F.explode(F.array(*own)).alias("list")).select("word", "n", "list.*").where(F.col("shorter") >= LEAST_LETTERS)
    half = (F.col("shorter") / 2).cast("int")
    key = F.xxhash64("shorter", "ending", F.when(F.col("ending"), F.right("word", half)).otherwise(F.left("word", half)))
    listed = listed.withColumn("block", F.when(F.col("shorter") < LONG, F.pmod(key, F.lit(n_blocks))).otherwise(key))
    sizes = listed.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("word")).alias("letters"))
    large = sizes.where((F.col("rows") > most) | (F.col("letters") > MOST_LETTERS)).select("block", F.greatest(F.ceil(F.col("rows") / most), F.ceil(F.col("letters") / MOST_LETTERS)).alias("n_pieces"))
    large = written(large, "large-blocks")
    if scratch is not None:
        scratch.append(large)
    dealt = listed.join(broadcast_if(is_small(large), large), "block", "left").withColumn("piece", F.pmod(F.xxhash64("word"), F.coalesce("n_pieces", F.lit(1))))
    others = F.sequence(F.lit(0).cast("long"), F.coalesce("n_pieces", F.lit(1)) - 1)
    pairs = dealt.withColumn("other", F.explode(others)).withColumns({"a": F.least("piece", "other"), "b": F.greatest("piece", "other")})
    found = pairs.select("block", "a", "b", "piece", "word", "n", "shorter", "ending").groupBy("block", "a", "b").applyInArrow(_near, FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("order"), "form"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", (-F.col("best.order")).alias("form_n"), F.col("best.form").alias("form"))


def roots(links: DataFrame, most: int) -> DataFrame:
    """(word, root): the ends of the chains that ``links`` (word, form) make; the words are distinct and there is no circle.

    most: links of the longest chain. A round of pointer doubling is a join of a written table with itself.
    """
    found = written(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(max(most, 1)))):
        step = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = written(found.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        removed(found)
        found = further
    return found


def spelling(docs: DataFrame, most: int = MOST) -> DataFrame:
    """Each word of ``docs`` (doc_id, text; other columns are ignored) with the frequent word that it may be a variant of.

    Words are those of words_of() that occur LEAST_COUNT times over all documents. Near words differ by exactly one
    letter. A word's form is its most frequent near word (of several the first in code-point order), if that occurs twice
    as often at least, else null. Null and empty texts hold no word; repeated rows count repeatedly; null ids count as
    empty ones; an empty table gives no rows. most: rows of a block before it is split; changes no result.
    Returns word, form, root, n, n_near, form_n.
    """
    words = written(vocabulary(docs), "words")
    scratch = [words]
    near = words.join(near_words(words, most, scratch), "word", "left")
    is_form = F.col("form_n") >= 2 * F.col("n")
    found = near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    found = written(found, "forms")
    largest = words.agg(F.max("n").alias("n")).first()["n"] or LEAST_COUNT
    ends = roots(found.where("form IS NOT NULL"), int(math.log2(largest / LEAST_COUNT)))  # counts double at each link
    removed(*scratch)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
