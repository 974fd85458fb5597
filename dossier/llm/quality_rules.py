"""Quality rules: text statistics, and distance of a document's histograms from its language's references.

Only DataFrame functions: per-row array work, one small aggregation for the references, no shuffle of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.scratch import written

# Frequent function words of the languages covered.
COMMON_WORDS = (
    "the of and to in is that it for was on are as with be by at this from or an have not "
    "der die und das von zu den mit ist im ein dem nicht auf für eine des sich sie es "
    "le la les et un une du que qui dans en pour est au par sur ne pas il ce "
    "el los las y una del se con para por su al como más no lo o"
).split()
CLASSES = ("lower", "upper", "digit", "punct", "space", "other")
BY_CLASS = {"lower": "[a-z]+", "upper": "[A-Z]+", "digit": "[0-9]+", "punct": r"[!-/:-@\[-`{-~]+"}
SYMBOLS = "[#*$%&|<>]+"
#: A reference needs so many documents, a document so many words for its word histogram to be held against it.
MIN_REFERENCE_DOCS, MIN_WORDS, MIN_HISTOGRAM_WORDS = 20, 50, 100
#: Largest Jensen-Shannon distances (base 2, 0 to 1) of documents that are kept.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.60


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def _held(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and the new columns, computed once: Catalyst doesn't paste them through inline() into what reads them."""
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def _windows(words: Column) -> Column:
    """Hashes of the three-word windows."""
    n = F.size(words)
    pairs = F.zip_with(words, F.slice(words, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hashes = F.zip_with(pairs, F.slice(words, 3, n), lambda p, c: F.xxhash64(p["a"], p["b"], c))
    return F.slice(hashes, 1, F.greatest(n - 2, F.lit(0)))


def _repeats(ranked: Column) -> Column:
    """Starts of the windows that have an equal one, rising; ``ranked``: sorted (hash, start)."""
    n = F.size(ranked)
    twins = F.zip_with(F.slice(ranked, 1, F.greatest(n - 1, F.lit(0))), F.slice(ranked, 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))


def features(docs: DataFrame) -> DataFrame:
    """One row per document: the rule counts, ``classes`` (a count per CLASSES) and ``common`` (word, count)."""
    own = docs.select(F.col("doc_id"), F.col("lang"), F.coalesce("text", F.lit("")).alias("text"))
    split = _held(
        own,
        ["doc_id", "lang", "text"],
        words=F.filter(F.split("text", "[ \\t\\n\\u000b\\f\\r]+"), lambda w: w != ""),
        lines=F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t\\n\\u000b\\f\\r]")),
    )
    counts = {
        "n_words": F.size("words").cast("long"),
        "n": F.length("text").cast("long"),
        "word_chars": F.length(_without(F.col("text"), "[ \\t\\n\\u000b\\f\\r]+")).cast("long"),
        "n_symbols": (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    } | {k: (F.length("text") - F.length(_without(F.col("text"), p))).cast("long") for k, p in BY_CLASS.items()}
    hashed = _held(split, ["doc_id", "lang"], **counts, windows=_windows(F.col("words")), hits=F.filter(F.transform("words", F.lower), lambda w: w.isin(COMMON_WORDS)))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    ranked = _held(hashed, ["doc_id", "lang", *counts, "hits"], ranked=F.when(twice, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))), found=F.array_distinct("hits"))
    starts = _held(ranked, ["doc_id", "lang", *counts, "hits", "found"], starts=_repeats(F.col("ranked")))
    m = F.size("starts")
    gaps = F.zip_with(F.slice("starts", 1, F.greatest(m - 1, F.lit(0))), F.slice("starts", 2, F.greatest(m, F.lit(0))), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.when(F.col("starts").isNull() | (m < 1), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda s, g: s + g)).cast("long")
    classes = [F.col(k) for k in BY_CLASS] + [F.col("n") - F.col("word_chars")]
    other = F.col("n") - sum(classes[1:], classes[0])
    common = F.transform("found", lambda w: F.struct(w.alias("word"), F.size(F.filter("hits", lambda x: x == w)).cast("long").alias("n")))
    return starts.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), F.array(*classes, other).alias("classes"), common.alias("common"))


def references(found: DataFrame) -> DataFrame:
    """A row per language over all documents: class shares and word shares. The row with null ``lang`` pools all languages."""
    by_class = [F.sum(F.col("classes")[i]).cast("double").alias(f"c{i}") for i in range(len(CLASSES))]
    sums = found.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), *by_class)
    word_sums = found.select("lang", F.inline("common")).groupBy("lang", "word").agg(F.sum("n").cast("double").alias("n"))
    vocabulary = F.map_from_entries(F.collect_list(F.struct("word", "n")))  # as many entries as COMMON_WORDS at most
    per_lang = sums.where(F.col("lang").isNotNull() & (F.col("n_docs") >= MIN_REFERENCE_DOCS)).join(word_sums.groupBy("lang").agg(vocabulary.alias("by_word")), "lang", "left")
    pooled = (
        sums.agg(F.sum("n_docs").alias("n_docs"), *(F.sum(f"c{i}").alias(f"c{i}") for i in range(len(CLASSES))))
        .crossJoin(word_sums.groupBy("word").agg(F.sum("n").alias("n")).agg(vocabulary.alias("by_word")))  # one row each
        .select(F.lit(None).cast("string").alias("lang"), "n_docs", *(f"c{i}" for i in range(len(CLASSES))), "by_word")
    )
    total = sum((F.col(f"c{i}") for i in range(1, len(CLASSES))), F.col("c0"))
    word_total = F.aggregate(F.map_values("by_word"), F.lit(0.0), lambda s, x: s + x)
    return per_lang.unionByName(pooled).select(
        F.col("lang").alias("ref_lang"),
        F.array(*(F.col(f"c{i}") / total for i in range(len(CLASSES)))).alias("ref_classes"),
        F.transform_values("by_word", lambda _, v: v / word_total).alias("ref_words"),
    )


def _term(p: Column, q: Column) -> Column:
    """A value's part of the Jensen-Shannon divergence of p and q, base 2."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (part(p) + part(q)) / 2


def distances(joined: DataFrame) -> DataFrame:
    n = F.aggregate("classes", F.lit(0).cast("long"), lambda s, x: s + x).cast("double")
    by_class = F.aggregate(F.zip_with("classes", "ref_classes", lambda a, q: _term(a / n, q)), F.lit(0.0), lambda s, x: s + x)
    n_common = F.aggregate("common", F.lit(0).cast("long"), lambda s, x: s + x["n"]).cast("double")
    shares = F.transform("common", lambda x: F.struct((x["n"] / n_common).alias("p"), F.coalesce(F.element_at("ref_words", x["word"]), F.lit(0.0)).alias("q")))
    # words that the document lacks give half their share of the reference
    by_word = F.aggregate(shares, F.lit(0.5), lambda s, x: s + _term(x["p"], x["q"]) - x["q"] / 2)
    return joined.withColumns(
        {
            "class_distance": F.when(n > 0, F.sqrt(F.greatest(by_class, F.lit(0.0)))).otherwise(1.0),
            "word_distance": F.when(n_common > 0, F.sqrt(F.greatest(by_word, F.lit(0.0)))).otherwise(1.0),
        }
    )


def quality_rules(docs: DataFrame, max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Judge every document of ``docs`` (doc_id, text, lang; other columns are ignored).

    Null text counts as empty: zero counts, base_failed, not kept. Null or rare ``lang`` is held against the reference
    pooled over all languages. A text under MIN_HISTOGRAM_WORDS words is held against character classes alone. Repeated
    doc_id give one row each. An empty table gives no rows.
    """
    found = written(features(docs), "quality")
    refs = written(references(found), "quality-refs")  # a row per language
    fallback = refs.where("ref_lang IS NULL").select(F.col("ref_classes").alias("all_classes"), F.col("ref_words").alias("all_words"))
    joined = (
        found.join(refs.where("ref_lang IS NOT NULL"), F.col("lang") == F.col("ref_lang"), "left")
        .crossJoin(F.broadcast(fallback))  # one row
        .withColumns({"ref_classes": F.coalesce("ref_classes", "all_classes"), "ref_words": F.coalesce("ref_words", "all_words", F.create_map().cast("map<string,double>"))})
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    near = (F.col("class_distance") <= max_class_distance) & ((F.col("n_words") < MIN_HISTOGRAM_WORDS) | (F.col("word_distance") <= max_word_distance))
    return distances(joined).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & near).alias("kept"), "class_distance", "word_distance")
