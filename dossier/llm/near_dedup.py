"""Near-duplicate classes by bottom-k sketches from one hash function.

1. Per document the 64 smallest shingle hashes (its sketch), the set's size and a hash of the set: 128 bits, of two
   independent word hashes.
2. Equal sets make one class at once; one document stands for it.
3. Inverted lists of retained values, rarest first: two documents that share enough of their 32 smallest values must
   meet in a list of their rarest ones, so lists of values that many unrelated documents hold stay short.
4. In a list, members are held against its leader, not against each other. Lists that then still hold several
   components give their members to an exact prefix filter on full sets, ordered by rarity.
5. The union-sketch estimate filters; exact Jaccard on the full sets decides, whose words are compared byte by byte.
6. Components by hooking and pointer jumping over the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import kernels as K
from dossier.llm.scratch import keyed, removed, written

WORDS, PERCENT = 5, 75
#: Retained values of a sketch, and how many of the smallest are listed.
SKETCH, LISTED = 64, 32
#: Two documents at 0.75 share 24 of 32 values on average; under 11 has a chance of 2.4e-7. So the rarest 22 suffice.
SHARED = 11
#: Least share of the union's 64 smallest values that both hold; at 0.75 the share is under 0.45 with a chance of 1e-7.
LEAST_ESTIMATE = 0.45
#: Rounds of links to leaders before the rest is compared.
TURNS = 2
#: Documents checked against one copy of a leader's set.
PER_COPY = 512
SIGNATURE = "rep long, n_shingles long, set_a long, set_b long, sketch array<long>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, offsets in K.blocks(batch):
            folded = K.FOLD[buf]
            start, end, word_at = K.word_spans(folded, offsets)
            one, at = K.shingles(K.word_hashes(folded, start, end), word_at, WORDS)
            two, _ = K.shingles(K.word_hashes(folded, start, end, 1), word_at, WORDS)
            values, at, others = K.distinct_sorted(one, at, two)
            counts = np.diff(at)
            a, b = np.zeros(len(values) + 1, K.U), np.zeros(len(values) + 1, K.U)
            np.cumsum(K.mix(values), out=a[1:])
            np.cumsum(K.mix(others), out=b[1:])
            kept = np.arange(len(values)) - np.repeat(at[:-1], counts) < SKETCH
            kept_at = np.zeros(len(at), np.int64)
            np.cumsum(np.minimum(counts, SKETCH), out=kept_at[1:])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("rep"),
                    pa.array(counts, pa.int64()),
                    pa.array((a[at[1:]] - a[at[:-1]]).view(np.int64)),
                    pa.array((b[at[1:]] - b[at[:-1]]).view(np.int64)),
                    K.lists(values[kept].view(np.int64), kept_at, pa.int64()),
                ],
                names=["rep", "n_shingles", "set_a", "set_b", "sketch"],
            )


def _estimate(mine: str, other: str) -> F.Column:
    """Share of the union's SKETCH smallest values that both sketches hold. Values order as unsigned."""
    order = lambda x: x.bitwiseXOR(F.lit(-(1 << 63)))
    union = F.slice(F.sort_array(F.transform(F.array_union(mine, other), order)), 1, SKETCH)
    both = F.transform(F.array_intersect(mine, other), order)
    return F.size(F.array_intersect(union, both)) / F.size(union)


def _lists(reps: DataFrame) -> DataFrame:
    """(rep, n_shingles, central, value): each document in the lists of its rarest listed values that any other holds.

    central: how many documents share its values; of a family the one that most resemble has the highest.
    """
    listed = reps.select("rep", "n_shingles", F.explode(F.slice("sketch", 1, LISTED)).alias("value"))
    counts = listed.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = listed.join(counts, "value").groupBy("rep", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("ranked"))  # LISTED at most
    held = F.least(F.col("n_shingles"), F.lit(LISTED))
    # values that no other document holds come first in the order; they use up places
    places = held - F.when(held < LISTED, F.floor(held / 2)).otherwise(SHARED) + 1 - (held - F.size("ranked"))
    central = F.aggregate("ranked", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    rows = ranked.where(places > 0).select("rep", "n_shingles", central.alias("central"), F.explode(F.slice("ranked", 1, places.cast("int"))).alias("x"))
    return rows.select("rep", "n_shingles", "central", F.col("x.value").alias("value"))


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, members): a text's words in order, A-Z lower-cased, one space between."""
    for batch in batches:
        for rows, buf, offsets in K.blocks(batch):
            raw = buf.tobytes()
            members = [b" ".join(raw[i:j].lower().split()) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("rep"), pa.array(members, pa.binary())], names=["rep", "members"])


def overlap(one: bytes, other: bytes) -> tuple[int, int]:
    """Shingles that two members of _full_sets() share, and those that either has. Words count as equal by their bytes."""
    buf = np.frombuffer(one + b" " + other, np.uint8)
    start, end, at = K.word_spans(buf, np.array([0, len(one) + 1, len(buf)]))
    n, m = int(at[1]), int(at[2] - at[1])
    if min(n, m) < WORDS:
        return (1, 1) if one == other and n else (0, max(1, n + m))  # a shorter sequence equals no five words
    runs = word = K.interned(buf, start, end)[1].astype(K.U)
    for k in range(1, WORDS):  # exact: a run's number beside the next word's number is renumbered
        runs = np.unique((runs[:-1] << K.U(32)) | word[k:], return_inverse=True)[1].astype(K.U)
    a, b = np.unique(runs[: n - WORDS + 1]), np.unique(runs[n:])
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, salt), the hub's own first: holds one hub's set at a time."""
    key, own = None, b""
    for batch in batches:
        a, b = [], []
        for hub, salt, rep, raw in zip(*(batch.column(c).to_pylist() for c in ("hub", "salt", "rep", "members")), strict=True):
            if rep == hub:
                key, own = (hub, salt), raw
            elif key == (hub, salt):
                both, either = overlap(own, raw)
                if 100 * both >= PERCENT * either:
                    a.append(hub)
                    b.append(rep)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, offsets in K.blocks(batch, "members"):
            _, _, hashes, at = K.words(buf, offsets, fold=False)
            values, at = K.distinct_sorted(*K.shingles(hashes, at, WORDS))
            row = pa.array(np.repeat(np.arange(rows.num_rows), np.diff(at)))
            yield pa.RecordBatch.from_arrays([rows.column(c).take(row) for c in ("rep", "n_shingles", "root")] + [pa.array(values.view(np.int64))], names=["rep", "n_shingles", "root", "value"])


def _prefix_pairs(reps: DataFrame, sets: DataFrame) -> DataFrame:
    """(hub, rep) of different roots whose full sets may be similar enough; none that are is missed.

    Shingles are ordered by how many of ``reps`` hold them. Two sets of sizes m and n must share (m + n) * 3 / 7 members,
    so their first common one stands early in both: within the first quarter, and with enough members behind it.
    """
    flat = reps.join(sets, "rep").select("rep", "n_shingles", "root", "members").mapInArrow(_members, "rep long, n_shingles long, root long, value long")
    flat = written(flat, "members")
    counts = flat.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = flat.join(counts, "value").groupBy("rep", "n_shingles", "root").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("ranked"))  # as long as the text
    alone = F.col("n_shingles") - F.size("ranked")  # held by no other: first in the order
    first = F.col("n_shingles") - F.ceil(F.col("n_shingles") * PERCENT / 100) + 1
    early = ranked.withColumns({"alone": alone, "places": (first - alone).cast("int")}).where("places > 0")
    early = early.select("rep", "n_shingles", "root", "alone", F.posexplode(F.slice("ranked", 1, F.col("places"))).alias("pos", "x")).select("rep", "n_shingles", "root", (F.col("n_shingles") - F.col("alone") - F.col("pos")).alias("behind"), F.col("x.value").alias("value"))
    x, y = early.alias("x"), early.alias("y")
    fits = F.least("x.behind", "y.behind") * (100 + PERCENT) >= (F.col("x.n_shingles") + F.col("y.n_shingles")) * PERCENT
    sizes = (F.col("x.n_shingles") * 100 >= F.col("y.n_shingles") * PERCENT) & (F.col("y.n_shingles") * 100 >= F.col("x.n_shingles") * PERCENT)
    apart = (F.col("x.rep") < F.col("y.rep")) & (F.col("x.root") != F.col("y.root"))
    return x.join(y, (F.col("x.value") == F.col("y.value")) & apart & sizes & fits).select(F.col("x.rep").alias("hub"), F.col("y.rep").alias("rep")).distinct()


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (hub, rep) whose full sets are similar enough. A hub's set is copied once for PER_COPY partners."""
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / PER_COPY).cast("int").alias("copies"))
    salted = pairs.join(sizes, "hub").select("hub", "rep", F.pmod(F.xxhash64("rep"), F.col("copies")).cast("int").alias("salt"))
    hubs = sizes.select("hub", F.col("hub").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    rows = salted.unionByName(hubs).join(sets, "rep").select("hub", "salt", (F.col("rep") != F.col("hub")).alias("partner"), "rep", "members")
    return rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "partner").mapInArrow(_confirmed, "a long, b long")


def components(nodes: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """(rep, root): the smallest node reachable over ``links`` (a, b). Every round joins on keys; nothing is collected."""
    edges = links.selectExpr("a AS u", "b AS v").unionByName(links.selectExpr("b AS u", "a AS v"))
    linked = written(edges.distinct(), f"{tag}-edges")
    table = written(linked.select(F.col("u").alias("rep")).distinct().withColumn("root", F.col("rep")), f"{tag}-labels")
    label = table
    while True:
        # the smallest label around a node, then the label of that label
        near = linked.join(label, linked.v == label.rep).groupBy("u").agg(F.min("root").alias("near"))
        hooked = label.join(near, label.rep == near.u).select("rep", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = hooked.select(F.col("rep").alias("root"), F.col("root").alias("further"))
        moved = written(hooked.join(jump, "root", "left").select("rep", "old", F.least("root", F.coalesce("further", "root")).alias("root")), f"{tag}-labels")
        label = moved.select("rep", "root")
        removed(table)
        table = moved
        if moved.where("root <> old").isEmpty():
            break
    removed(linked)
    return nodes.join(label, "rep", "left").select("rep", F.coalesce("root", "rep").alias("root"))


def classes(texts: DataFrame) -> DataFrame:
    """(rep, n_shingles, root) of every row of ``texts`` (rep, text), where rep is a long that no two rows share.

    root is the smallest rep of the row's class: links are 100 * intersection >= 75 * union of the shingle sets.
    """
    texts = texts.select("rep", "text")
    sketched = written(texts.mapInArrow(_signatures, SIGNATURE), "sketches")
    same_set = ["n_shingles", "set_a", "set_b"]
    firsts = sketched.where("n_shingles > 0").groupBy(*same_set).agg(F.min(F.struct("rep", "sketch")).alias("least"))
    reps = written(firsts.select(*same_set, F.col("least.rep").alias("rep"), F.col("least.sketch").alias("sketch")), "classes")
    marks = written(sketched.drop("sketch"), "marks")
    removed(sketched)
    lists = written(_lists(reps), "lists")

    # one full set of each document that shares a list with another
    shared = lists.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value")
    wanted = lists.join(shared, "value").select("rep").distinct()
    sets = written(texts.join(wanted, "rep", "left_semi").mapInArrow(_full_sets, "rep long, members binary"), "sets")
    sketches = reps.select("rep", "sketch")
    known = None
    roots = reps.select("rep", F.col("rep").alias("root"))

    def filtered(pairs: DataFrame) -> DataFrame:
        """hub, rep, estimate of the pairs that pass the union-sketch estimate."""
        both = pairs.join(sketches.withColumnsRenamed({"rep": "hub", "sketch": "hub_sketch"}), "hub").join(sketches, "rep")
        return both.withColumn("estimate", _estimate("hub_sketch", "sketch")).where(F.col("estimate") >= LEAST_ESTIMATE).select("hub", "rep", "estimate")

    similar_size = (F.col("n_shingles") * 100 >= F.col("hub_n") * PERCENT) & (F.col("hub_n") * 100 >= F.col("n_shingles") * PERCENT)
    leader = F.max_by(F.struct("rep", "n_shingles", "root"), F.struct("central", -F.col("rep"))).alias("leader")
    for turn in range(TURNS):
        # each member against the most central one of its lists; in later turns, of those outside the first one's component
        members = lists.join(roots, "rep")
        by_root = members.groupBy("value").agg(leader, F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        if turn:
            by_root = members.join(by_root, "value").where("root <> leader.root").select("value", "rep", "n_shingles", "central", "root").groupBy("value").agg(leader)
        pairs = members.join(by_root.select("value", F.col("leader.rep").alias("hub"), F.col("leader.n_shingles").alias("hub_n"), F.col("leader.root").alias("hub_root")), "value")
        pairs = filtered(pairs.where((F.col("root") != F.col("hub_root")) & similar_size).select("hub", "rep").distinct())
        nearest = pairs.groupBy("rep").agg(F.max_by("hub", F.struct("estimate", -F.col("hub"))).alias("hub"))
        links = written(_confirm(nearest, sets), "links")
        known = links if known is None else known.unionByName(links)
        roots = written(components(reps.select("rep"), known, f"turn{turn}"), "roots")

    # lists that still hold several components: their members are compared by exact prefixes of their full sets
    members = lists.join(roots, "rep")
    mixed = members.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("value")
    open_reps = written(members.join(mixed, "value").select("rep", "n_shingles", "root").distinct(), "open")
    rest = written(filtered(_prefix_pairs(open_reps, sets)), "rest")
    known = known.unionByName(_confirm(rest, sets))
    roots = written(components(reps.select("rep"), known, "last").join(reps.select("rep", *same_set), "rep").select(*same_set, "root"), "classed")
    removed(reps, lists, sets, open_reps, rest)

    # few distinct sets may hold most documents: the join deals those anew (adaptive skew join)
    empty = marks.where("n_shingles = 0").select("rep", "n_shingles", F.col("rep").alias("root"))
    return marks.where("n_shingles > 0").join(roots, same_set).select("rep", "n_shingles", "root").unionByName(empty)


def near_dedup(docs: DataFrame) -> DataFrame:
    """Class every row of ``docs`` (doc_id, text; other columns are ignored) with its near-duplicates.

    Words are runs outside ``\\x20\\x09-\\x0D`` with A-Z lower-cased; the set holds the distinct five-word shingles (the
    whole sequence if shorter). Links: 100 * intersection >= 75 * union. Null and empty texts have an empty set and link
    with nothing. Every row counts as a document of its own and gives one row, also where doc_id is null or repeated:
    component_id is the smallest doc_id of the class (null if none has one); kept: doc_id = component_id, and where no
    row of the class has a doc_id, one of them. An empty table gives no rows. Returns doc_id, n_shingles, component_id, kept.
    """
    rows, by_id = keyed(docs.select("doc_id", "text"), "rep")
    found = classes(rows)
    if by_id:
        named = found.select("*", F.col("rep").alias("doc_id"), F.col("root").alias("component_id"))
    else:
        ids = rows.select("rep", F.col("doc_id").cast("long").alias("doc_id"))
        roots = found.select("root").distinct().join(ids.withColumnRenamed("rep", "root"), "root").withColumnRenamed("doc_id", "component_id")
        named = found.join(ids, "rep").join(roots, "root")
    return named.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("rep") == F.col("root")).alias("kept"))


def first_of_each_class(docs: DataFrame) -> DataFrame:
    """One row of each class of near_dedup(), the first of those with the smallest doc_id, with its columns as they are."""
    rows, _ = keyed(docs, "near_dedup_row")
    gone = classes(rows.select(F.col("near_dedup_row").alias("rep"), "text")).where("rep <> root").select(F.col("rep").alias("near_dedup_row"))
    return rows.join(gone, "near_dedup_row", "left_anti").select(docs.columns)
