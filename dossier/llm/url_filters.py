"""URL filters: host and path rules, then gradient-boosted trees on lexical features, which judge what no rule fits.

The trees are fitted to labelled URLs: those given, or else the URLs that a rule labels.

Only DataFrame and MLlib operations; one pass over the URLs, no shuffle of them.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.scratch import written

#: (rule, verdict): a host, and what the path must start with.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Labelled URLs of each label that the trees are fitted to at most, those with the smallest hash of their url. One in
#: HELD_OUT labelled URLs, by another hash, is never fitted to.
MAX_LABELLED, HELD_OUT = 10_000, 5
TREES, DEPTH, SEED = 20, 3, 17
#: Folds of the sample: a row's statistics come from the other ones, so that no URL sees its own label. URLs that a value
#: has at least, else it says nothing.
FOLDS, LEAST_SUPPORT = 5, 4
#: Features that a split of a tree chooses from, so that all kinds of them count.
FEATURES_A_SPLIT = "onethird"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEXICAL = ("url_length", "host_length", "path_length", "path_depth", "host_depth", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "n_params", "query_length", "has_fragment", "suffix_rate", "suffix_support", "head_rate", "head_support")


def host_and_path(pages: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path``; both empty where url is null or has no ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract("url", "://([^/?#]*)([^?#]*)", k), F.lit(""))
    return pages.withColumns({"host": F.translate(part(1), UPPER, LOWER), "path": part(2)})


def rule_columns(rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule of a row with host and path, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: len(r[0])):
        host, slash, rest = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the lexical features but for the statistics, and what those are of: ``suffix``, the host's last label, and ``head``, the path's first part."""
    url = F.coalesce("url", F.lit(""))
    share = lambda c: F.when(F.length(c) > 0, F.length(F.regexp_replace(c, "[^0-9]+", "")) / F.length(c)).otherwise(0.0)
    letters = F.split(F.col("host"), "")
    counts = F.transform(F.array_distinct(letters), lambda x: F.size(F.filter(letters, lambda y: y == x)) / F.size(letters))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return pages.withColumns(
        {
            "url_length": F.length(url),
            "host_length": F.length("host"),
            "path_length": F.length("path"),
            "path_depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
            "host_depth": F.size(F.split("host", "\\.")),
            "digit_ratio": share(url),
            "host_digit_ratio": share(F.col("host")),
            "hyphens": F.length(F.regexp_replace("host", "[^-]+", "")),
            "entropy": F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(p)),
            "n_params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")),
            "query_length": F.length(query),
            "has_fragment": url.contains("#").cast("int"),
            "suffix": F.substring_index("host", ".", -1),
            "head": F.regexp_extract("path", "^/([^/]*)", 1),
        }
    )


def labelled_by_rules(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(url, label) of the distinct URLs that a rule fits: 1.0 where it blocks, else 0.0."""
    verdict = rule_columns(rules)[1]
    return host_and_path(pages.select("url")).select("url", verdict.alias("verdict")).where("verdict IS NOT NULL").select("url", (F.col("verdict") == "block").cast("double").alias("label")).distinct()


def is_held_out() -> Column:
    return F.crc32(F.encode("url", "utf-8")) % HELD_OUT == 0


def training_sample(labelled: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """Of each label of ``labelled`` (url, label) ``most`` rows at most, by hash, without those held out; labels weigh alike."""
    found = labelled.select("url", F.col("label").cast("double").alias("label")).where(F.col("url").isNotNull() & ~is_held_out())
    take = lambda label: found.where(F.col("label") == label).orderBy(F.xxhash64("url"), "url").limit(most)
    both = take(1.0).unionByName(take(0.0))
    sizes = both.groupBy("label").agg((1000 / F.count(F.lit(1))).alias("weight"))  # two rows
    return lexical(host_and_path(both.join(F.broadcast(sizes), "label")))


def _rates(n_block: Column, n: Column, part: str) -> list[Column]:
    """Smoothed share of blocked URLs, and log of the count; of a value with few URLs as of one never met."""
    enough = n >= LEAST_SUPPORT
    return [F.when(enough, (n_block + 1) / (n + 2)).otherwise(0.5).alias(f"{part}_rate"), F.when(enough, F.log1p(n)).otherwise(0.0).alias(f"{part}_support")]


def statistics(sample: DataFrame, part: str) -> DataFrame:
    """Per value of ``part`` in the bounded sample, over all of it."""
    by = sample.groupBy(part).agg(F.sum("label").alias("n_block"), F.count(F.lit(1)).alias("n"))
    return by.select(part, *_rates(F.col("n_block"), F.col("n"), part))


def fold() -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS))


def other_folds(sample: DataFrame, part: str) -> DataFrame:
    """(part, fold): the statistics of a value over the URLs of all other folds."""
    by = sample.groupBy(part, fold().alias("fold")).agg(F.sum("label").alias("b"), F.count(F.lit(1)).alias("n"))
    every = sample.groupBy(part).agg(F.sum("label").alias("all_b"), F.count(F.lit(1)).alias("all_n"))
    return by.join(F.broadcast(every), part).select(part, "fold", *_rates(F.col("all_b") - F.col("b"), F.col("all_n") - F.col("n"), part))


class UrlModel:
    """Trees on the lexical features of labelled URLs, and the statistics of the sample's suffixes and path heads.

    In training a URL's statistics leave out its fold: a head of its own says nothing of it, as of a new URL's.
    """

    def __init__(self, labelled: DataFrame):
        sample = written(training_sample(labelled), "url-sample")
        self.stats = [statistics(sample, part) for part in ("suffix", "head")]
        self.trees: GBTClassificationModel | None = None
        if sample.select("label").distinct().count() == 2:
            own = [other_folds(sample, part) for part in ("suffix", "head")]
            rows = self._features(sample.withColumn("fold", fold()), own).select("features", "label", "weight").repartition(4)
            self.trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32, stepSize=0.3, weightCol="weight", featureSubsetStrategy=FEATURES_A_SPLIT).fit(rows)

    def _features(self, urls: DataFrame, by_fold: list[DataFrame] | None = None) -> DataFrame:
        for stats, part in zip(by_fold or self.stats, ("suffix", "head"), strict=True):
            # as many rows as the labelled sample at most, so it may be broadcast
            urls = urls.join(F.broadcast(stats), [part, "fold"] if by_fold else part, "left").fillna({f"{part}_rate": 0.5, f"{part}_support": 0.0})
        return VectorAssembler(inputCols=list(LEXICAL), outputCol="features").transform(urls)

    def scored(self, urls: DataFrame) -> DataFrame:
        """``urls`` (of lexical()) with ``score``: 0 to 1, higher where a block is likelier; 0.5 without labels of both kinds."""
        if self.trees is None:
            return urls.withColumn("score", F.lit(0.5))
        return self.trees.transform(self._features(urls)).withColumn("score", vector_to_array("probability")[1])


def held_out_accuracy(labelled: DataFrame) -> DataFrame:
    """One row: n, accuracy, and the shares of blocked and of allowed URLs judged rightly, of the labelled URLs held out."""
    rows = lexical(host_and_path(labelled.where(F.col("url").isNotNull() & is_held_out())))
    right = ((F.col("score") > 0.5) == (F.col("label") == 1)).cast("double")
    return UrlModel(labelled).scored(rows).agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.avg(F.when(F.col("label") == 1, right)).alias("blocked"), F.avg(F.when(F.col("label") == 0, right)).alias("allowed"))


def url_filters(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url; other columns are ignored).

    labelled: url and label (1 block, 0 allow); labelled_by_rules() of the pages where None. A null url, and one without ``://``, has
    empty host and path, fits no rule and is judged by the trees. Without labels of both kinds all such rows are
    allowed, with score 0.5. Repeated rows give repeated results; an empty table gives none.
    Returns page_id, host, path, rule, verdict, score.
    """
    model = UrlModel(labelled_by_rules(pages, rules) if labelled is None else labelled)
    rule, verdict = rule_columns(rules)
    scored = model.scored(lexical(host_and_path(pages.select("page_id", "url"))).withColumns({"rule": rule, "by_rule": verdict}))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")
