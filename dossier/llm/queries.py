"""The queries of this folder's operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.decontamination import contaminated
from dossier.llm.graph_search import graph_search
from dossier.llm.language_id import language_id
from dossier.llm.lexical_search import lexical_search
from dossier.llm.license_scan import TEMPLATES, license_scan
from dossier.llm.near_dedup import near_dedup
from dossier.llm.packing import packing
from dossier.llm import quality_rules as rules
from dossier.llm.quality_rules import quality_rules
from dossier.llm.secret_scan import digest, secret_scan
from dossier.llm.spelling import spelling
from dossier.llm.suffix_dedup import suffix_dedup
from dossier.llm.toxicity import toxicity
from dossier.llm.url_filters import url_filters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters(table(spark, sf_dir, "pages"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secret_scan(table(spark, sf_dir, "documents")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op11_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return graph_search(rows, rows.where(F.col("vec_id") % 20 == 0))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_url_filters": op2_url_filters,
    "op3_near_dedup": op3_near_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_packing": op5_packing,
    "op6_secret_scan": op6_secret_scan,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_quality_rules": op9_quality_rules,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_graph_search": op11_graph_search,
    "op12_lexical_search": op12_lexical_search,
    "op13_spelling": op13_spelling,
}


def _shingled(name: str, source: str, key: str, words: str) -> str:
    """SQL of (key, g): the distinct five-word shingles of a table's texts; fewer words are one shingle."""
    return f"""{name}_w AS (SELECT {key}, {words} AS x FROM {source}),
{name} AS (SELECT DISTINCT {key}, unnest(CASE WHEN len(x) >= 5 THEN list_transform(range(1, len(x) - 3), lambda i: array_to_string(x[i:i + 4], ' ')) WHEN len(x) > 0 THEN [array_to_string(x, ' ')] ELSE [] END) AS g FROM {name}_w)"""


def _held(name: str, items: str, key: str, words: str, item_words: str) -> str:
    """SQL of (doc_id, key, n_shared): items of fewer than five words that a document holds as a run of words."""
    runs = f"list_transform(range(1, len(d.x) - len(i.x) + 2), lambda k: array_to_string(d.x[k:k + len(i.x) - 1], ' '))"
    return f"""{name}_i AS (SELECT {key}, {item_words} AS x FROM {items}),
{name}_d AS (SELECT doc_id, {words} AS x FROM documents),
{name} AS (SELECT d.doc_id, i.{key}, 1::BIGINT AS n_shared FROM {name}_i i JOIN {name}_d d ON len(i.x) BETWEEN 1 AND 4 AND len(d.x) >= len(i.x) AND list_contains({runs}, array_to_string(i.x, ' ')))"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"
_TOKENS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

NEAR_DEDUP_SQL = f"""WITH RECURSIVE {_shingled('s', 'documents', 'doc_id', _WORDS)},
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
two_way AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN two_way l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""

DECONTAMINATION_SQL = f"""WITH {_shingled('s', 'documents', 'doc_id', _WORDS)}, {_shingled('q', 'benchmark', 'item_id', _WORDS)}, {_held('r', 'benchmark', 'item_id', _WORDS, _WORDS)},
n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM s JOIN q USING (g) WHERE item_id NOT IN (SELECT item_id FROM r_i WHERE len(x) < 5) GROUP BY ALL UNION ALL FROM r)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item::DOUBLE AS containment FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 75 * n_item"""

_TEMPLATES = "SELECT * FROM (VALUES " + ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES)) + ") AS v(template_id, license, text)"
LICENSE_SQL = f"""WITH t AS ({_TEMPLATES}), {_shingled('s', 'documents', 'doc_id', _TOKENS)}, {_shingled('q', 't', 'template_id', _TOKENS)}, {_held('r', 't', 'template_id', _TOKENS, _TOKENS)},
n AS (SELECT template_id, count(*) AS n_template FROM q GROUP BY ALL),
m AS (SELECT doc_id, template_id, n_shared, n_template, n_shared / n_template::DOUBLE AS containment FROM (SELECT doc_id, template_id, count(*) AS n_shared FROM s JOIN q USING (g) WHERE template_id NOT IN (SELECT template_id FROM r_i WHERE len(x) < 5) GROUP BY ALL UNION ALL FROM r) JOIN n USING (template_id) WHERE 100 * n_shared >= 75 * n_template),
kin AS (SELECT DISTINCT a.template_id AS a, b.template_id AS b FROM q a JOIN q b ON a.g = b.g AND a.template_id <> b.template_id)
SELECT doc_id, m.template_id, license, n_shared, n_template, containment FROM m JOIN t USING (template_id)
WHERE NOT EXISTS (SELECT 1 FROM m o JOIN kin ON kin.b = o.template_id WHERE kin.a = m.template_id AND o.doc_id = m.doc_id AND o.containment > m.containment)"""

def _jensen(p: str, q: str) -> str:
    """A value's part of the Jensen-Shannon divergence, base 2."""
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"({part(p)} + {part(q)}) / 2"


_COUNTED = ", ".join(f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g')) AS k{i}" for i, pattern in enumerate(rules.BY_CLASS.values()))
QUALITY_SQL = f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS x FROM d),
tri AS (SELECT doc_id, i, x[i] || ' ' || x[i + 1] || ' ' || x[i + 2] AS g FROM (SELECT doc_id, x, unnest(range(1, len(x) - 1)) AS i FROM w WHERE len(x) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM rep) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (SELECT doc_id, lang, len(x) AS n_words, length(array_to_string(x, '')) AS word_chars, length(t) - length(regexp_replace(t, '{rules.SYMBOLS}', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, length(t) AS n, {_COUNTED} FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id)),
k AS (SELECT *, n - word_chars AS k4, word_chars - k0 - k1 - k2 - k3 AS k5 FROM base),
hit AS (SELECT doc_id, lang, word, count(*) AS n FROM (SELECT doc_id, lang, lower(unnest(x)) AS word FROM w) WHERE word IN ({', '.join(f"'{x}'" for x in dict.fromkeys(rules.COMMON_WORDS))}) GROUP BY ALL),
big AS (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {rules.MIN_REFERENCE_DOCS}),
of AS (SELECT doc_id, CASE WHEN lang IN (FROM big) THEN lang ELSE '*' END AS ref FROM k),
kr AS (SELECT lang AS ref, {', '.join(f'sum(k{i})::DOUBLE AS r{i}' for i in range(6))} FROM k WHERE lang IN (FROM big) GROUP BY lang UNION ALL SELECT '*', {', '.join(f'sum(k{i})::DOUBLE' for i in range(6))} FROM k),
kq AS (SELECT ref, {', '.join(f'r{i} / (r0 + r1 + r2 + r3 + r4 + r5) AS q{i}' for i in range(6))} FROM kr),
wr AS (SELECT lang AS ref, word, sum(n)::DOUBLE AS n FROM hit WHERE lang IN (FROM big) GROUP BY ALL UNION ALL SELECT '*', word, sum(n)::DOUBLE FROM hit GROUP BY word),
wq AS (SELECT ref, word, n / sum(n) OVER (PARTITION BY ref) AS q FROM wr),
c AS (SELECT doc_id, CASE WHEN n = 0 THEN 1.0 ELSE sqrt(greatest({' + '.join(_jensen(f'(k{i} / n::DOUBLE)', f'q{i}') for i in range(6))}, 0)) END AS class_distance FROM k JOIN of USING (doc_id) JOIN kq USING (ref)),
p AS (SELECT doc_id, word, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM hit),
v AS (SELECT doc_id, sqrt(greatest(0.5 + sum({_jensen('p', 'coalesce(q, 0)')} - coalesce(q, 0) / 2), 0)) AS word_distance FROM p JOIN of USING (doc_id) LEFT JOIN wq USING (ref, word) GROUP BY doc_id),
j AS (SELECT k.*, class_distance, coalesce(word_distance, 1.0) AS word_distance, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM k JOIN c USING (doc_id) LEFT JOIN v USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND class_distance <= {rules.MAX_CLASS_DISTANCE} AND (n_words < {rules.MIN_HISTOGRAM_WORDS} OR word_distance <= {rules.MAX_WORD_DISTANCE}) AS kept,
round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance FROM j"""

#: Every byte that a 100-byte string covers which also starts earlier, by listing all of them.
SUFFIX_DEDUP_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, pos, substr(h, 2 * pos + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS pos FROM d WHERE len(h) >= 200)),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS place FROM w) WHERE place > 1),
g AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 100 THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT doc_id, min(pos) AS a, max(pos) + 100 AS b FROM (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g) GROUP BY doc_id, run),
c AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS gone, count(*) AS spans FROM i GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, spans + 1), lambda k: substr(h, 2 * (CASE WHEN k = 0 THEN 0 ELSE b[k] END) + 1, 2 * ((CASE WHEN k = spans THEN len(h) // 2 ELSE a[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE b[k] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)"""

LEXICAL_SEARCH_SQL = f"""WITH d AS (SELECT doc_id, {_TOKENS} AS x FROM documents), i AS (SELECT item_id, unnest({_TOKENS}) AS t FROM benchmark),
c AS (SELECT count(*) AS n_docs, sum(len(x))::BIGINT AS total FROM d WHERE len(x) > 0),
p AS (SELECT doc_id, t, n, count(*) AS tf FROM (SELECT doc_id, len(x) AS n, unnest(x) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t, n_docs),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // total))))::BIGINT AS score FROM i JOIN p USING (t) JOIN w USING (t), c GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""

#: CRC-32 byte by byte with the polynomial's table; near words meet in a word less one letter, kept with its place.
SPELLING_SQL = """WITH RECURSIVE crc AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{5,}')) AS run FROM documents),
k AS (SELECT doc_id, run, count(*) AS n, hex(encode(concat(doc_id, ':', run))) AS x FROM r GROUP BY doc_id, run),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM k, crc),
v AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
g AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
e AS (SELECT a.word, b.word AS other, b.n AS other_n FROM g a JOIN g b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, v.word, v.n FROM g JOIN v ON v.word = g.rest UNION SELECT v.word, g.word, g.n FROM g JOIN v ON v.word = g.rest),
b AS (SELECT word, count(*) AS n_near, min(struct_pack(k := -other_n, w := other)) AS best FROM e GROUP BY word),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.k >= 2 * n THEN best.w END AS form, CASE WHEN -best.k >= 2 * n THEN -best.k END AS form_n FROM v LEFT JOIN b USING (word)),
chain(word, root, steps) AS (SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, max_by(root, steps) AS root FROM chain GROUP BY word) USING (word)"""

ORACLE_SQL: dict[str, str] = {"op12_lexical_search": LEXICAL_SEARCH_SQL, "op13_spelling": SPELLING_SQL, "op10_suffix_dedup": SUFFIX_DEDUP_SQL, "op9_quality_rules": QUALITY_SQL, "op3_near_dedup": NEAR_DEDUP_SQL, "op4_license_scan": LICENSE_SQL, "op8_decontamination": DECONTAMINATION_SQL}
