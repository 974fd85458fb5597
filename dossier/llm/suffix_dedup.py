"""Removal of long repeated byte strings: depth-limited radix sort of suffixes at anchors.

A suffix matters only through its first LENGTH bytes, so equal groups after radix passes over that depth are exactly
the repeated strings. Sorting every suffix would shuffle many times the corpus, so the passes run on anchors:

* An anchor is a position whose GRAM-byte hash is the smallest in some LENGTH-byte string that holds it. Every
  LENGTH-byte string holds an anchor, and equal strings hold them at the same places.
* First pass (most significant digit): anchors by gram hash. An anchor alone in its group repeats nothing.
* Second digit: the hash of the anchor's whole surroundings, all bytes of all LENGTH-byte strings through it, and its
  place in them. Of equal ones all but the first repeat as a whole.
* Last digit: where one gram has several surroundings, their LENGTH-byte strings themselves, each by its hash with the
  bytes compared; the first occurrence stays.

No key gathers what grows with the corpus. Anchors are counted by bucket of grams first. Grams of crowded buckets are
dealt by surroundings, and their LENGTH-byte strings by a 128-bit hash of each; in both, a task sends only what is no
repeat of what it sent before, so a hot key has some rows a task, and rows of one key are read as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import kernels as K
from dossier.llm.scratch import bounded_bytes, keyed, removed, written

LENGTH, GRAM = 100, 16
#: Anchors, or rows of surroundings, that a task sorts at once; a group is never cut.
ROWS_AT_ONCE, CONTEXTS_AT_ONCE = 150_000, 40_000
#: Buckets that grams are counted by. One with more rows than this, and than CROWDED times the mean, is dealt by
#: surroundings and LENGTH-byte string instead of gram.
BUCKETS, MOST_CONTEXTS, CROWDED = 1 << 18, 200_000, 4
#: Firsts that a task remembers; then it begins anew, which only sends more.
REMEMBERED = 200_000
#: state: 0 dealt by gram, 1 by surroundings, 2 a known repeat.
ANCHORS = "gram long, around long, doc_id long, at int, start int, stop int, state int"
STRINGS = "h1 long, h2 long, doc_id long, start int, stop int, known boolean"
OTHER_VALUES = np.random.default_rng(20240301).integers(1, 1 << 64, 256, dtype=K.U)
SPANS = "doc_id long, at int, start int, stop int, gram long, kind int"


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    h = K.BYTE_VALUES[buf]
    width = 1
    while width < GRAM:
        step = K.U(pow(K.BASE, width, 1 << 64))
        h = h[:-width] * step + h[width:]
        width *= 2
    return K.mix(h)


def _sliding(h: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every run of ``width`` values."""
    size = 1
    while size * 2 <= width:
        h = pick(h[:-size], h[size:])
        size *= 2
    return pick(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def anchors(text: np.ndarray) -> np.ndarray:
    """Anchor positions of one text; none if it is shorter than LENGTH."""
    if len(text) < LENGTH:
        return np.zeros(0, np.int64)
    h = _gram_hashes(text)
    width = LENGTH - GRAM + 1
    least = _sliding(h, width, np.minimum)  # of the string that starts at i
    pad = np.zeros(width - 1, K.U)
    reached = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)  # the largest over strings that hold the gram
    return np.flatnonzero(reached == h)


def _block_anchors(ids: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """gram, around, doc_id, at, start, stop of each anchor in that order, and whether it repeats an earlier one of the block as a whole."""
    reach = LENGTH - GRAM
    texts, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(ids)):
        at = anchors(buf[offsets[i] : offsets[i + 1]])
        where.append(at)
        texts.append(np.full(len(at), i))
    at, text = np.concatenate(where), np.concatenate(texts)
    prefix = K.prefix_hash(buf)
    base, size = offsets[text], (offsets[text + 1] - offsets[text])
    start, stop = np.maximum(at - reach, 0), np.minimum(at + LENGTH, size)
    grams = K.span_hash(prefix, base + at, base + at + GRAM)
    around = K.span_hash(prefix, base + start, base + stop) + (at - start).astype(K.U)  # the same bytes around another place count as others
    order = np.lexsort((at, ids[text], around, grams))
    grams, around, text, at, start, stop = (x[order] for x in (grams, around, text, at, start, stop))
    doc = ids[text]
    own = np.zeros(len(order), bool)
    own[1:] = (grams[1:] == grams[:-1]) & (around[1:] == around[:-1])
    own[1:] &= ~((doc[1:] == doc[:-1]) & (at[1:] == at[:-1]))
    return grams, around, doc, at, start, stop, own


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams % K.U(BUCKETS)).astype(np.int64)


def _loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors by bucket, without repeats inside a block."""
    n = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for rows, buf, offsets in K.blocks(batch):
            grams, *_, own = _block_anchors(rows.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False), buf, offsets)
            n += np.bincount(_bucket(grams[~own]), minlength=BUCKETS)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], names=["bucket", "n"])


def crowded(texts: DataFrame, most: int = MOST_CONTEXTS) -> np.ndarray:
    """The buckets whose grams may stand in more than ``most`` rows."""
    found = texts.mapInArrow(_loads, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    n = found.column("n").to_numpy()
    return np.sort(found.column("bucket").to_numpy()[n > max(most, CROWDED * n.sum() / BUCKETS)])


def _anchored(hot: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of each text. Of equal surroundings within a block only the first is sent on; the rest are known repeats.

    The same within a task for grams of the buckets ``hot``, whose rows are keyed by gram and surroundings.
    """
    is_hot = np.zeros(BUCKETS, bool)
    is_hot[hot] = True
    firsts: dict[tuple[int, int], tuple[int, int]] = {}
    for batch in batches:
        for rows, buf, offsets in K.blocks(batch):
            ids = rows.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            grams, around, doc, at, start, stop, own = _block_anchors(ids, buf, offsets)
            if not len(at):
                continue
            state = np.where(own, 2, np.where(is_hot[_bucket(grams)], 1, 0))
            spread = np.flatnonzero(state == 1)
            for i, key, place in zip(spread.tolist(), zip(grams[spread].tolist(), around[spread].tolist(), strict=True), zip(doc[spread].tolist(), at[spread].tolist(), strict=True), strict=True):
                if firsts.setdefault(key, place) < place:
                    state[i] = 2
                else:
                    firsts[key] = place
            if len(firsts) > REMEMBERED:
                firsts.clear()
            grams = np.where(state == 1, K.mix(grams * K.U(K.BASE) + around), grams)
            # a known repeat needs no group: it goes to a place of its own
            grams = np.where(state == 2, K.mix(doc.astype(K.U) * K.U(K.BASE) + at.astype(K.U)), grams)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(around.view(np.int64)), pa.array(doc), *(pa.array(x, pa.int32()) for x in (at, start, stop, state))], names=["gram", "around", "doc_id", "at", "start", "stop", "state"])


def _groups(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Runs of rows of about ``most`` rows that end where the (sorted) key changes."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        cut = int(np.argmax(keys == keys[-1]))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        n = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _second_digit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram. Out: repeats as a whole (kind 0), and surroundings to compare (kind 1; 2: by string, of crowded buckets)."""
    for table in _groups(batches, "gram", ROWS_AT_ONCE):
        gram, around, doc, at, start, stop, state = (table.column(c).to_numpy() for c in ("gram", "around", "doc_id", "at", "start", "stop", "state"))
        order = np.lexsort((at, doc, around, gram))
        gram, around, doc, at, start, stop, state = (x[order] for x in (gram, around, doc, at, start, stop, state))
        new_gram = np.ones(len(gram), bool)
        new_gram[1:] = gram[1:] != gram[:-1]
        new = new_gram.copy()
        new[1:] |= around[1:] != around[:-1]
        group = np.cumsum(new_gram) - 1
        several = np.bincount(group[new])
        first_doc, first_at = (x[np.flatnonzero(new)[np.cumsum(new) - 1]] for x in (doc, at))
        repeat = (state == 2) | (~new & ~((doc == first_doc) & (at == first_at)))
        compare = new & ((several[group] > 1) & (state == 0) | (state == 1))
        kind = np.where(state == 1, 2, 1)
        for keep, kinds in ((repeat, np.zeros(len(gram), np.int64)), (compare, kind)):
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), *(pa.array(x[keep], pa.int32()) for x in (at, start, stop)), pa.array(gram[keep]), pa.array(kinds[keep], pa.int32())], names=["doc_id", "at", "start", "stop", "gram", "kind"])


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, doc_id, at, start, bytes) of the surroundings of anchors."""
    for batch in _few(batches):
        keys, docs, ats, starts, raw = [], [], [], [], []
        for doc, text, at, start, stop, gram in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "at", "start", "stop", "gram")), strict=True):
            text = (text or "").encode()
            raw.extend(text[i:j] for i, j in zip(start, stop, strict=True))
            keys.extend(gram)
            docs.extend([doc] * len(at))
            ats.extend(at)
            starts.extend(start)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(ats, pa.int32()), pa.array(starts, pa.int32()), pa.array(raw, pa.binary())], names=["gram", "doc_id", "at", "start", "raw"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, doc_id, start, stop) of the LENGTH-byte strings of spans; merged where they repeat what this task has sent (known)."""
    firsts: dict[tuple[int, int], tuple[int, int]] = {}
    for batch in _few(batches):
        for doc, text, first, stop in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "start", "stop")), strict=True):
            buf = np.frombuffer((text or "").encode(), np.uint8)
            starts = np.zeros(len(buf) + 1, bool)
            for i, j in zip(first, stop, strict=True):
                starts[i : j - LENGTH + 1] = True
            start = np.flatnonzero(starts)
            h1, h2 = (K.span_hash(K.prefix_hash(buf, v), start, start + LENGTH).view(np.int64) for v in (K.BYTE_VALUES, OTHER_VALUES))
            known = np.zeros(len(start), bool)
            for i, (key, at) in enumerate(zip(zip(h1.tolist(), h2.tolist(), strict=True), start.tolist(), strict=True)):
                place = (doc, at)
                if firsts.setdefault(key, place) < place:
                    known[i] = True
                else:
                    firsts[key] = place
            if len(firsts) > REMEMBERED:
                firsts.clear()
            again = start[known]
            begin = np.ones(len(again), bool)
            begin[1:] = again[1:] > again[:-1] + LENGTH
            head = np.flatnonzero(begin)
            tail = np.append(head[1:], len(again))[: len(head)] - 1
            own = K.mix(np.full(len(head), doc, np.int64).view(K.U) * K.U(K.BASE) + again[head].astype(K.U)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([h1[~known], own])),
                    pa.array(np.concatenate([h2[~known], own])),
                    pa.array(np.full(int((~known).sum()) + len(head), doc, np.int64)),
                    pa.array(np.concatenate([start[~known], again[head]]), pa.int32()),
                    pa.array(np.concatenate([start[~known], again[tail]]) + LENGTH, pa.int32()),
                    pa.array(np.repeat([False, True], [(~known).sum(), len(head)])),
                ],
                names=["h1", "h2", "doc_id", "start", "stop", "known"],
            )


def _later_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of STRINGS sorted by hashes, document and place, as a stream: all but the first of each string."""
    last = None  # hashes, document and place of the first row of the string that the batch before ended in
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, start, stop, known = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "doc_id", "start", "stop", "known"))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        first_doc, first_start = doc[head], start[head]
        if last and last[:2] == (h1[0], h2[0]):
            first_doc, first_start = np.where(head == 0, last[2], first_doc), np.where(head == 0, last[3], first_start)
        last = (h1[-1], h2[-1], first_doc[-1], first_start[-1])
        keep = known | (doc != first_doc) | (start != first_start)
        yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(start[keep], pa.int32()), pa.array(stop[keep], pa.int32())], names=["doc_id", "start", "stop"])


def _lines(raw: np.ndarray, offsets: np.ndarray, low: np.ndarray, width: int, rows: int = 4096) -> np.ndarray:
    """Byte strings as lines of a matrix, each from its column ``low`` on; a few rows at a time, as a place takes eight times a byte."""
    matrix = np.zeros((len(low), width), np.uint8)
    for i in range(0, len(low), rows):
        first, last = offsets[i], offsets[min(i + rows, len(low))]
        size = np.diff(offsets[i : i + rows + 1])
        shift = np.arange(len(size)) * width + low[i : i + rows] - (offsets[i : i + rows + 1][:-1] - first)
        matrix[i : i + rows].reshape(-1)[np.arange(last - first) + np.repeat(shift, size)] = raw[first:last]
    return matrix


def _repeats(doc: np.ndarray, at: np.ndarray, raw: np.ndarray, offsets: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and stop of what each row repeats: the LENGTH-byte strings that an earlier row of the same key holds at the same place from its anchor.

    Rows lie as lines of a matrix, anchors below each other; one column of strings is handled at a time. The strings of
    a row begin less than LENGTH bytes apart, so those that repeat make one span.
    """
    reach = LENGTH - GRAM
    low = reach - (at - start)
    high = low + np.diff(offsets)
    order = np.lexsort((at, doc, key))
    matrix = _lines(raw, offsets, low, reach + LENGTH)[order]
    low, high, doc, at, key = low[order], high[order], doc[order], at[order], key[order]
    values, base = K.BYTE_VALUES, K.U(K.BASE)
    top = K.U(pow(K.BASE, LENGTH - 1, 1 << 64))
    h = np.zeros(len(doc), K.U)
    for c in range(LENGTH):
        h = h * base + values[matrix[:, c]]
    first_o, last_o = np.full(len(doc), -1, np.int32), np.zeros(len(doc), np.int32)
    for o in range(reach + 1):
        if o:
            h = (h - values[matrix[:, o - 1]] * top) * base + values[matrix[:, o + LENGTH - 1]]
        here = np.flatnonzero((low <= o) & (o + LENGTH <= high))
        mark = K.mix(h[here]) ^ key[here]
        by = np.argsort(mark, kind="stable")  # rows are in order of document and place already
        here, mark = here[by], mark[by]
        new = np.ones(len(here), bool)
        new[1:] = mark[1:] != mark[:-1]
        first = here[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(here) else here
        later = np.flatnonzero(~new & ((doc[here] != doc[first]) | (at[here] != at[first])))
        for i in range(0, len(later), 20_000):
            x, y = here[later[i : i + 20_000]], first[later[i : i + 20_000]]
            x = x[(matrix[x, o : o + LENGTH] == matrix[y, o : o + LENGTH]).all(axis=1)]
            first_o[x] = np.where(first_o[x] < 0, o, first_o[x])
            last_o[x] = o
    some = np.flatnonzero(first_o >= 0)
    start = at[some] - reach
    return doc[some], start + first_o[some], start + last_o[some] + LENGTH


def _last_digit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram: the LENGTH-byte strings in the surroundings that also start earlier, as one span a row."""
    for table in _groups(batches, "gram", CONTEXTS_AT_ONCE):
        doc, start, at, key = (table.column(c).to_numpy() for c in ("doc_id", "start", "at", "gram"))
        raw, offsets = K.utf8(table.column("raw").combine_chunks())
        d, s, e = _repeats(doc, at.astype(np.int64), raw, offsets, key.astype(np.int64).view(K.U), start.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["doc_id", "start", "stop"])


def _few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a few rows, as Python objects take many times the room of Arrow's."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def _listed(columns: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document: one row for each, with lists."""
    for table in _groups(batches, "doc_id", ROWS_AT_ONCE):
        doc = table.column("doc_id").to_numpy()
        head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        at = np.append(head, len(doc))
        yield pa.RecordBatch.from_arrays([pa.array(doc[head]), *(K.lists(table.column(c).to_numpy(), at, table.column(c).type) for c in columns)], names=["doc_id", *columns])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted by document: one row for each, with lists of the starts and stops of its runs; touching spans are one run."""
    for table in _groups(batches, "doc_id", ROWS_AT_ONCE):
        doc, start, stop = (table.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "start", "stop"))
        order = np.lexsort((start, doc))
        doc, start, stop = doc[order], start[order], stop[order]
        apart = np.cumsum(np.append(0, doc[1:] != doc[:-1])) << 33  # more than any place, so that no document reaches the next
        end = np.maximum.accumulate(stop + apart)
        head = np.flatnonzero(np.append(True, start[1:] + apart[1:] > end[:-1]))
        tail = np.append(head[1:], len(doc)) - 1
        of = doc[head]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        at = np.append(first, len(of))
        yield pa.RecordBatch.from_arrays([pa.array(of[first]), K.lists(start[head], at, pa.int32()), K.lists((end - apart)[tail], at, pa.int32())], names=["doc_id", "start", "stop"])


def _cut(with_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _few(batches):
        out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []} | ({"kept_text": []} if with_text else {})
        for doc, text, start, stop in zip(*(batch.column(c).to_pylist() for c in ("given_id", "text", "start", "stop")), strict=True):
            raw, start, stop = (text or "").encode(), start or [], stop or []
            rest = b"".join(raw[i:j] for i, j in zip([0, *stop], [*start, len(raw)], strict=True))
            for k, v in zip(out, (doc, len(raw), len(raw) - len(rest), len(start), hashlib.sha256(rest).hexdigest(), rest), strict=False):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string()), *([pa.array(out["kept_text"], pa.binary())] if with_text else [])], names=list(out))


def _per_doc(spans: DataFrame, *columns: str) -> DataFrame:
    """Lists by document, bounded by its length; sorted and gathered in Arrow, as sets of structs would fill the JVM's heap."""
    kinds = ", ".join(f"{c} array<{spans.schema[c].dataType.simpleString()}>" for c in columns)
    return _by_doc(spans.select("doc_id", *columns)).mapInArrow(lambda b: _listed(columns, b), f"doc_id long, {kinds}")


def _by_doc(rows: DataFrame) -> DataFrame:
    return rows.repartition("doc_id").sortWithinPartitions("doc_id")


def suffix_dedup(docs: DataFrame, most: int = MOST_CONTEXTS, with_text: bool = True) -> DataFrame:
    """Remove from every text of ``docs`` (doc_id, text; other columns are ignored) what repeats earlier bytes.

    Each byte goes that a 100-byte string covers which also starts earlier: in a smaller doc_id or earlier in the same
    text. Null texts count as empty. Every row is a text of its own and gives one row, with its doc_id as it is: rows
    that share a doc_id come after each other, those without one after all others. An empty table gives no rows.
    ``most``: rows of a gram that one task may hold. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text (the bytes left; a cut may split a character; not ``with_text``: without it).
    """
    bounded_bytes(docs.sparkSession)
    rows, _ = keyed(docs.select("doc_id", "text"), "row")
    rows = rows.select(F.coalesce("row", F.lit(0)).alias("doc_id"), "text", F.col("doc_id").cast("long").alias("given_id"))  # never null, so both joins below share one exchange
    texts = rows.select("doc_id", "text")
    hot = crowded(texts, most)
    found = texts.mapInArrow(lambda b: _anchored(hot, b), ANCHORS).repartition("gram").sortWithinPartitions("gram").mapInArrow(_second_digit, SPANS)
    found = written(found, "anchors")
    dealt = rows.repartition("doc_id")
    open_spans = _per_doc(found.where("kind = 1"), "at", "start", "stop", "gram")
    strings = dealt.join(open_spans, "doc_id").mapInArrow(_surroundings, "gram long, doc_id long, at int, start int, raw binary")
    later = strings.repartition("gram").sortWithinPartitions("gram").mapInArrow(_last_digit, "doc_id long, start int, stop int")
    spans = found.where("kind = 0").select("doc_id", "start", "stop").unionByName(later)
    if len(hot):
        strings = dealt.join(_per_doc(found.where("kind = 2"), "start", "stop"), "doc_id").mapInArrow(_strings, STRINGS)
        spans = spans.unionByName(strings.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "start").mapInArrow(_later_strings, "doc_id long, start int, stop int"))
    runs = _by_doc(spans).mapInArrow(_runs, "doc_id long, start array<int>, stop array<int>")
    return dealt.join(runs, "doc_id", "left").mapInArrow(lambda b: _cut(with_text, b), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text binary" * with_text)
