"""Small cases of the operators: ties, nulls, empty inputs, documented quirks."""

import itertools

import pytest
from pyspark.sql import functions as F

from dossier.functions.text import is_blank, normalized, script, stripped, tokens
from dossier.operators import admission, blocks, chunks, citation, classify, dense, embed, evidence, fusion, html, jurisdiction, lexical, observe, prompts, safety

CORPUS = [
    ("TM-1", "A trademark registration begins when someone files with the trademark registry."),
    ("TM-2", "At the trademark registry each registration is looked at for confusion with older marks."),
    ("PT-1", "A patent needs a drawing or a text from which others can build the thing."),
    ("PT-2", "In examination the office asks of a patent whether it has novelty."),
    ("AY-1", "Makers of an ayurveda syrup ask the ministry for registration."),
    ("IRRELEVANT", "Rain fell on the hills for nine days and the river rose."),
]


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_tokens_and_scripts(spark):
    rows = spark.createDataFrame([("Part 7.10, item (c): holds!",), ("half-open",), ("औषधि पंजीकरण",), ("",), (None,)], "t string")
    got = [r.x for r in rows.select(tokens(F.col("t")).alias("x")).collect()]
    assert got == [["part", "7", "10", "item", "c", "holds"], ["half", "open"], ["औषधि", "पंजीकरण"], [], []]
    kinds = spark.createDataFrame([("abc",), ("औषधि",), ("தமிழ்",), ("a औ",), ("12",), (None,)], "t string").select(script(F.col("t")).alias("s"))
    assert [r.s for r in kinds.collect()] == ["LATIN", "DEVANAGARI", "TAMIL", "MIXED", "UNKNOWN", "UNKNOWN"]
    joined = normalized(spark.createDataFrame([("café",), (None,)], "t string"), "t").select(tokens(F.col("t")).alias("x"))
    assert [r.x for r in joined.collect()] == [["café"], []]


def test_strip_is_unicode_aware(spark):
    row = spark.createDataFrame([(" \t a b  \n",)], "t string").select(stripped(F.col("t")).alias("s"), is_blank(F.lit(" ")).alias("b")).first()
    assert (row.s, row.b) == ("a b", True)


def test_bm25_ranks_the_small_corpus(spark):
    docs = spark.createDataFrame(CORPUS, "doc_id string, text string")
    asked = spark.createDataFrame([(1, "trademark registration"), (2, "patent examination novelty"), (3, "zzz"), (4, None)], "query_id int, query string")
    top = lexical.bm25_topk(asked, docs, 3).orderBy("query_id", "rank")
    found = values(top, "query_id", "doc_id")
    assert set(found[:2]) == {(1, "TM-1"), (1, "TM-2")}
    assert (2, "PT-2") == next(x for x in found if x[0] == 2)
    assert {q for q, _ in found} == {1, 2}
    assert lexical.bm25_topk(asked, docs.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        lexical.bm25_topk(asked, docs, 0)


def test_repeated_query_terms_count_again_and_ties_go_by_id(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "x"), (2, "x x")], "query_id int, query string")
    got = {(q, d): (s, r) for q, d, s, r in values(lexical.bm25_topk(asked, docs, 5), "query_id", "doc_id", "score", "rank")}
    assert got[2, "a"][0] == pytest.approx(2 * got[1, "a"][0])
    assert got[1, "a"][1] == 1 and got[1, "b"][1] == 2


def test_dense_handles_zero_null_and_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 0.0]), (5, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(9, [3.0, 0.0])], "query_id long, embedding array<float>")
    assert values(dense.dense_topk(asked, rows, 5).orderBy("rank"), "vec_id", "score") == [(1, 1.0), (4, 1.0), (2, 0.0)]
    assert dense.dense_topk(asked.limit(0), rows, 5).count() == 0


def test_fusion_and_metrics(spark):
    first = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, doc_id string, rank int")
    second = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, doc_id string, rank int")
    assert values(fusion.reciprocal_rank_fusion(first, second).orderBy("rank"), "doc_id") == [("b",), ("a",), ("c",)]
    relevant = spark.createDataFrame([(1, "a"), (1, "z")], "query_id int, doc_id string")
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = values(fusion.ranking_metrics(first, relevant, asked, 4, "doc_id").orderBy("query_id"), "precision_at_k", "recall_at_k", "reciprocal_rank")
    assert got == [(0.5, 0.5, 1.0), (0.0, 0.0, 0.0)]


def test_headings(spark):
    lines = ["1. Definitions", "2.1 Scope", "3.2.1 Sub-clause", "SCOPE", "A sentence.", "Trailing,", "", "A" * 200, "1.1.1.1.1.1.1 deep"]
    got = [r.h for r in spark.createDataFrame([(x,) for x in lines], "t string").select(blocks.heading_level(F.col("t")).alias("h")).collect()]
    assert got == ["1", "2", "3", "UNKNOWN", None, None, None, None, "6"]


def test_blocks_and_chunks_lose_nothing(spark):
    text = "Intro line\r\nsecond line\n\n1. Scope\n\n" + "word " * 300 + "\n\n\nEnd of it"
    found = blocks.sections(blocks.text_blocks(spark.createDataFrame([(1, text), (2, None), (3, " \n ")], "doc_id int, text string")))
    rows = values(found.orderBy("sequence"), "block_type", "section", "parent_section")
    assert rows == [("PARAGRAPH", 0, None), ("HEADING", 1, None), ("PARAGRAPH", 1, "1:p1:b2"), ("PARAGRAPH", 1, "1:p1:b2")]
    made = chunks.chunk_documents(found).orderBy("chunk_sequence").collect()
    assert max(len(r.text) for r in made) <= chunks.BUDGET
    assert len({r.chunk_id for r in made}) == len(made)
    for text in ("a" * 2500, "word " * 700, "", "x" * 1000):
        assert "".join(chunks.split_text(text)) == text


def test_html_quirks(spark):
    pages = spark.createDataFrame([(1, "<title>T</title><h2>Sub</h2><p>Text.</p><ul><li><p>x</p></li></ul><table><tr><td colspan=2>a</td><td>b</td></tr></table>"), (2, None), (3, "<<<not html>>>")], "page_id long, html string")
    rows = html.html_blocks(pages).where("page_id = 1").orderBy("sequence").collect()
    assert [(r.block_type, r.text) for r in rows] == [("HEADING", "Sub"), ("PARAGRAPH", "Text."), ("LIST", ""), ("PARAGRAPH", "x"), ("LIST_ITEM", "x"), ("TABLE", "")]
    assert rows[-1].rows == [["a", "b"]]
    assert rows[0].title == "T" and rows[0].simplified and rows[1].parent_section == "1:p1:b1" and rows[-1].warnings == ["TABLE_STRUCTURE_SIMPLIFIED"]


def test_classification_sentences(spark):
    cases = [
        ("is there an ayush policy of the indian states", None, "KNOWN"),
        ("how can i protect my herbal balm, and which compliance requirement holds in india", None, "AMBIGUOUS"),
        ("one compliance requirement that cdsco sets for a new ayurvedic drug made in india", None, "NEEDS_EVIDENCE"),
        ("", None, "UNKNOWN"),
    ]
    rows = spark.createDataFrame([(q, d, None) for q, d, _ in cases], "raw_query string, description string, evidence_state string")
    assert [r.classification_state for r in classify.classify(rows).collect()] == [s for *_, s in cases]


def test_tree_over_all_inputs(spark):
    intents = [n for _, n, _ in classify.INTENTS] + ["GENERAL_INFORMATION_REQUEST", "AMBIGUOUS_INTENT", "UNDETERMINED"]
    tracks = [n for _, n, _ in classify.TRACKS] + ["UNDETERMINED", "CONFLICTING"]
    places, questions = ["INDIA", "INTERNATIONAL", "BOTH", "UNSPECIFIED"], [n for _, n, _ in classify.QUESTION_TYPES] + ["UNDETERMINED"]
    rows = list(itertools.product(intents, tracks, places, questions, ["SUFFICIENT_EVIDENCE", None]))
    got = spark.createDataFrame(rows, "i string, t string, j string, q string, e string").withColumn("r", classify.tree(*map(F.col, "itjqe")))

    def rule(i, t, j, q, e):
        needs = i in classify.NEED_EVIDENCE
        for name, hit in (("R1", i == "UNDETERMINED"), ("R2", j == "UNSPECIFIED"), ("R3", needs and t == "UNDETERMINED"), ("R4", t == "CONFLICTING"), ("R5", i == "AMBIGUOUS_INTENT"), ("R6", q == "UNDETERMINED"), ("R7", needs and e is None)):
            if hit:
                return name
        return "R8"

    assert all(r.r == rule(*r[:5]) for r in got.collect())


def test_jurisdiction(spark):
    rows = spark.createDataFrame([(1, " india ", None), (2, "INDIA", "INTERNATIONAL"), (3, None, None), (4, "France", None), (5, "unspecified", "BOTH")], "i int, explicit string, classified string")
    got = values(jurisdiction.resolve(rows).orderBy("i"), "state", "reason_code", "allowed")
    assert got == [("KNOWN", "EXPLICIT_JURISDICTION_ACCEPTED", ["INDIA"]), ("AMBIGUOUS", "JURISDICTION_AMBIGUOUS", []), ("UNKNOWN", "JURISDICTION_UNKNOWN", []), ("UNKNOWN", "JURISDICTION_NOT_SUPPORTED", []), ("KNOWN", "EXPLICIT_JURISDICTION_ACCEPTED", ["INDIA", "INTERNATIONAL"])]


def test_citations_are_exact(spark):
    own = spark.createDataFrame([(1, "x", True, True, True)], "pack_id int, evidence_id string, intact boolean, well_formed boolean, pack_valid boolean")
    answers = spark.createDataFrame([(7, 1, "a [[CITE:x]] b [[CITE: x ]] c [[CITE:]] d [[CITE:x]]"), (8, 1, None)], "answer_id int, pack_id int, answer string")
    done = citation.validate(citation.extract(answers), own).orderBy("occurrence")
    assert values(done, "status", "reason_code", "is_duplicate") == [("VALID", None, False), ("UNRESOLVED", "EVIDENCE_NOT_FOUND", False), ("INVALID", "MALFORMED_REFERENCE", False), ("VALID", None, True)]
    assert citation.coverage(done).first().integrity_rate == 0.5


def test_tampering_shows(spark):
    rows = spark.createDataFrame([("d", "SF-01", "INDIA", "text", ["b"], [1])], "document_id string, source_family_id string, jurisdiction string, text string, block_ids array<string>, page_numbers array<int>")
    items = evidence.evidence_items(rows)
    assert evidence.verify_items(items).first().intact
    assert not evidence.verify_items(items.withColumn("text", F.lit("other"))).first().intact
    assert not evidence.verify_items(items.withColumn("jurisdiction", F.lit("INTERNATIONAL"))).first().intact


def test_review_history(spark):
    rows = spark.createDataFrame([(1, 0, "START_REVIEW", "PENDING", "IN_REVIEW"), (1, 1, "APPROVE", "IN_REVIEW", "APPROVED"), (1, 2, "REJECT", "APPROVED", "REJECTED"), (2, 1, "APPROVE", "PENDING", "APPROVED")], "request_id int, seq int, action string, previous_status string, new_status string")
    assert values(safety.check_history(rows).orderBy("request_id", "seq"), "problem") == [(None,), (None,), ("ILLEGAL_TRANSITION",), ("SEQUENCE_GAP",)]


def test_empty_inputs_give_nulls_not_zeros(spark):
    none = spark.createDataFrame([], "value double")
    row = observe.latency(none, "value").first()
    assert (row.n, row.total, row["mean"]) == (0, 0.0, None)
    assert citation.rejection_rate(spark.createDataFrame([], "status string")).first().rejection_rate is None


def test_stream_equals_batch(spark, tmp_path):
    from dossier.streaming import events

    source = "/root/testdata/sf0.001/events.parquet"
    batch = events.windowed(spark.read.parquet(source))
    copy = str(tmp_path / "in")
    spark.read.parquet(source).repartition(1).write.parquet(copy)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(copy)
    run = events.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(map(key, spark.table("windows").collect())) == sorted(map(key, batch.collect()))


def test_stateful_review_status(spark, tmp_path):
    from dossier.streaming import events

    copy = str(tmp_path / "in")
    rows = [(1, 0, "START_REVIEW"), (1, 1, "APPROVE"), (1, 2, "REJECT"), (2, 0, "ESCALATE")]
    spark.createDataFrame(rows, "request_id long, seq long, action string").coalesce(1).write.parquet(copy)
    stream = spark.readStream.schema("request_id long, seq long, action string").parquet(copy)
    run = events.review_status(stream).writeStream.outputMode("update").format("memory").queryName("statuses").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(values(spark.table("statuses"), "request_id", "status", "n_illegal")) == [(1, "APPROVED", 1), (2, "ESCALATED", 0)]


def test_admission_of_files(spark, tmp_path):
    import hashlib

    from dossier.operators import admission
    from dossier.sources import files

    (tmp_path / "in").mkdir()
    contents = {"a.txt": b"good text", "b.exe": b"x", "c.txt": b"", "d.txt": b"tampered", "e.txt": b"bad \xff byte"}
    for name, data in contents.items():
        (tmp_path / "in" / name).write_bytes(data)
    records = [(n, n, "SF-01", "INDIA", hashlib.sha256(b"other" if n == "d.txt" else d).hexdigest(), "ADMIT") for n, d in contents.items()]
    records += [("gone.txt", "g", "SF-01", "INDIA", "0", "ADMIT"), ("../up.txt", "u", "SF-01", "INDIA", "0", "ADMIT")]
    provenance = spark.createDataFrame(records, "path string, document_id string, source_family_id string, jurisdiction string, content_hash string, admission_status string")
    got = {r.path: (r.pipeline_state, r.reason, r.text, r.decode_warning) for r in files.ingest(files.scan(spark, str(tmp_path / "in")), provenance, admission.families(spark)).collect()}
    assert got["a.txt"] == ("READY_FOR_INGESTION", None, "good text", False)
    assert got["e.txt"] == ("READY_FOR_INGESTION", None, "bad � byte", True)
    # Spark's file scan lists no file without bytes
    assert {k: v[1] for k, v in got.items() if v[1]} == {"b.exe": "UNSUPPORTED_DOCUMENT_TYPE", "c.txt": "FILE_NOT_FOUND", "d.txt": "CONTENT_HASH_MISMATCH", "gone.txt": "FILE_NOT_FOUND", "../up.txt": "PATH_TRAVERSAL_ATTEMPT"}


def test_snapshots(spark, tmp_path):
    from dossier.sources import snapshots

    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "doc_id long, text string")
    name = snapshots.create(docs, str(tmp_path / "one"))
    assert name == snapshots.create(docs.repartition(3), str(tmp_path / "two"))
    assert snapshots.verify(spark, str(tmp_path / "one")).isEmpty()
    assert snapshots.restore(spark, str(tmp_path / "one"), str(tmp_path / "back"), name).count() == 3
    docs.withColumn("text", F.lit("x")).write.mode("overwrite").parquet(str(tmp_path / "two" / "documents"))
    assert snapshots.verify(spark, str(tmp_path / "two")).count() == 3
    with pytest.raises(ValueError):
        snapshots.restore(spark, str(tmp_path / "two"), str(tmp_path / "no"), name)


def test_answers_end_to_end(spark):
    from dossier.jobs import answer

    corpus = spark.createDataFrame([(n, t, n, "SF-01", "INDIA", [f"{n}:p1:b1"], [1]) for n, t in CORPUS], "chunk_key string, text string, document_id string, source_family_id string, jurisdiction string, block_ids array<string>, page_numbers array<int>")
    asked = spark.createDataFrame([(1, "trademark registration with the trademark registry in India", None, None, None, None, "en"), (2, "zzz", None, None, None, None, "en")], "query_id long, raw_query string, description string, evidence_state string, explicit string, requested_language string, source_language string")
    found = answer.retrieve(asked, corpus)
    first = found.where("query_id = 1").orderBy("pack_order").first().evidence_id
    outputs = spark.createDataFrame([(1, True, f"So it is [[CITE:{first}]]", None, None)], "query_id long, success boolean, answer string, translation string, translation_ok boolean")
    done = {r.query_id: r for r in answer.decide(asked, found, outputs).collect()}
    assert (done[1].safety_status, done[1].band, done[1].delivery_status, done[1].priority) == ("SAFE_TO_PRESENT", "MODERATE", "DELIVERED", "NOT_APPLICABLE")
    assert (done[2].safety_status, done[2].grounding_reason) == ("ABSTAIN", "NO_EVIDENCE_AVAILABLE")


def test_compatibility_forms_are_one_word(spark):
    docs = spark.createDataFrame([(1, "file act"), (2, "other"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "ﬁle Ａｃｔ")], "query_id long, query string")
    assert values(lexical.bm25_topk(asked, docs, 3), "doc_id") == [(1,)]
    wide = spark.createDataFrame([(1, "ﬁle Ａｃｔ"), (2, "other")], "doc_id long, text string")
    assert values(lexical.bm25_topk(spark.createDataFrame([(1, "file act")], "query_id long, query string"), wide, 3), "doc_id") == [(1,)]


def test_sensitive_names_in_any_spelling(spark):
    names = ["X-API-Key", "api key", "accessKey", "auth", "bearer", "pwd", "passwd", "Client.Secret", "pass-word", "TOKENS_USED", "credential"]
    plain = ["query", "latency", "status"]
    row = spark.range(1).select(observe.redacted(F.create_map(*(F.lit(x) for n in names + plain for x in (n, "v")))).alias("m")).first()
    assert {k for k, v in row.m.items() if v == observe.REDACTED} == set(names) and all(row.m[n] == "v" for n in plain)
    assert spark.range(1).select(observe.redacted(F.lit(None).cast("map<string,string>")).alias("m")).first().m == {}


def block(n, kind, text="", rows=None, section=0, page=1, level=None):
    return {"sequence": n, "section": section, "block_type": kind, "text": text, "rows": rows, "warnings": [], "page_number": page, "block_id": f"d:p{page}:b{n}", "heading_level": level}


def test_tables_and_lists_make_chunks_of_their_own():
    rows = [[f"r{i}", "x" * 10] for i in range(12)] + [["y" * 90]]
    own = [block(1, "LIST"), block(2, "LIST_ITEM", "one"), block(3, "TABLE", rows=rows), block(4, "PARAGRAPH", " "), block(5, "HEADING", "Top", section=1, level="1"), block(6, "LIST", section=1), block(7, "LIST_ITEM", "two", section=1, page=2), block(8, "PARAGRAPH", "z" * 120, section=1), block(9, "TABLE", section=1)]
    made = [c for _, c in chunks.chunk_blocks(own, 50)]
    assert made[0]["block_ids"] == ["d:p1:b1", "d:p1:b2"] and made[0]["text"] == "one" and made[0]["list_group_id"] == "d:p1:b1"
    tables = [c for c in made if c["block_types"] == ["TABLE"]]
    first = [c for c in tables if c["block_ids"] == ["d:p1:b3"]]
    assert [r for c in first for r in c["table_rows"]] == rows and all(len(c["text"]) <= 50 or len(c["table_rows"]) == 1 for c in first)
    assert [c["split_index"] for c in first] == list(range(len(first))) and {c["split_count"] for c in first} == {len(first)}
    assert first[0]["warnings"] == ["TABLE_SPLIT_ACROSS_CHUNKS"] and first[-1]["warnings"] == ["TABLE_SPLIT_ACROSS_CHUNKS", "TABLE_ROW_EXCEEDS_MAX_SIZE"]
    assert first[0]["list_group_id"] is None and first[0]["text"].startswith("r0 | xxxxxxxxxx\nr1 | ")
    blank = next(c for c in made if c["block_ids"] == ["d:p1:b4"])
    assert blank["text"] == "" and blank["warnings"] == ["CHUNK_TEXT_EMPTY"]
    gathered = next(c for c in made if c["block_ids"][0] == "d:p1:b5")
    assert gathered["text"] == "Top\n\ntwo" and gathered["page_numbers"] == [1, 2] and gathered["heading"] == ("d:p1:b5", "Top", "1") and gathered["list_group_id"] == "d:p1:b6"
    split = [c for c in made if c["block_ids"] == ["d:p1:b8"]]
    assert "".join(c["text"] for c in split) == "z" * 120 and split[0]["warnings"] == ["BLOCK_SPLIT_DUE_TO_SIZE"] and split[0]["list_group_id"] is None
    assert (tables[-1]["table_rows"], tables[-1]["text"], tables[-1]["split_count"]) == ([], "", 1)


def test_pages_become_chunks(spark):
    big = "".join(f"<tr><td>{i}</td><td>{'c' * 300}</td></tr>" for i in range(8))
    pages = spark.createDataFrame([(1, f"<h1>A</h1><p>text</p><ul><li>x</li><li>y</li></ul><table>{big}</table><h2>B</h2><p>more</p>"), (2, None), (3, "<p></p>")], "page_id long, html string")
    found = chunks.chunk_documents(blocks.sections(html.html_blocks(pages), "page_id"), "page_id")
    rows = found.where("page_id = 1").orderBy("chunk_sequence").collect()
    assert [r.block_types for r in rows][:2] == [["HEADING", "PARAGRAPH", "LIST", "LIST_ITEM", "LIST_ITEM"], ["TABLE"]] and rows[0].text == "A\n\ntext\n\nx\n\ny"
    assert sum(len(r.table_rows or []) for r in rows) == 8 and all(r.is_split for r in rows if r.table_rows)
    assert rows[-1].section_heading_text == "B" and rows[-1].section_heading_level == "2"
    state = {r.page_id: (r.chunking_status, r.warnings) for r in chunks.chunking_status(pages, found, "page_id").collect()}
    assert state == {1: ("CHUNKING_PARTIAL", ["TABLE_SPLIT_ACROSS_CHUNKS"]), 2: ("CHUNKING_SKIPPED", ["NO_BLOCKS_TO_CHUNK"]), 3: ("CHUNKING_SKIPPED", ["NO_BLOCKS_TO_CHUNK"])}


def test_dense_keeps_the_best_over_batches(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    vectors = draw.integers(-2, 3, (500, 3)).astype(float)  # many ties
    asked = vectors[:7] + 0.5
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(3)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = dense.dense_topk(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<float>"), rows, 9).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    unit = lambda x: x / np.where((n := np.sqrt((x * x).sum(axis=1, keepdims=True))) == 0, 1, n)
    scores = unit(asked) @ unit(vectors).T
    for q in range(7):
        best = sorted(range(500), key=lambda i: (-round(scores[q, i], 9), i))[:9]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [round(r.score, 6) for r in mine] == [round(scores[q, i], 6) for i in best] and len({r.vec_id for r in mine}) == 9


def test_embeddings_are_sums_of_seeded_vectors(spark):
    import hashlib

    import numpy as np

    texts = ["file ACT file", "", None, "ﬁle"]
    got = [np.array(r.embedding) for r in embed.embeddings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), 8, normalize=False).orderBy("doc_id").collect()]
    one = lambda w: np.random.default_rng(int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")).standard_normal(8).astype(np.float32)
    assert np.allclose(got[0], one("file") + one("act") + one("file"), atol=1e-6) and np.allclose(got[3], one("file"), atol=1e-6)
    assert not got[1].any() and not got[2].any()


def test_prompts_without_evidence(spark):
    asked = spark.createDataFrame([(1, "why", None), (2, None, "x")], "query_id long, query string, canonical_query string")
    items = spark.createDataFrame([], "query_id long, pack_order int, evidence_id string, document_id string, source_family_id string, jurisdiction string, page_numbers array<int>, block_ids array<string>, synthetic boolean, text string")
    made = {r.query_id: r for r in prompts.build(asked, items, instructions="Go.").collect()}
    assert made[1].prompt == "Go.\n\nALLOWED EVIDENCE IDS (0 total):\n(none)\n\nEVIDENCE:\n(no evidence supplied)\n\nQUESTION:\nwhy" and made[1].allowed_ids == []


def test_refresh_stops_at_the_first_failure(spark, tmp_path):
    from dossier.jobs import refresh
    from dossier.sources import snapshots

    docs = spark.createDataFrame([(n, t, "SF-01", "INDIA", "h", "ADMIT") for n, t in CORPUS], "document_id string, text string, source_family_id string, jurisdiction string, content_hash string, admission_status string")
    asked = spark.createDataFrame([(1, "trademark registry"), (2, "patent novelty examination")], "query_id long, query string")
    relevant = spark.createDataFrame([(1, "TM-1"), (1, "TM-2"), (2, "PT-2")], "query_id long, document_id string")
    families = admission.families(spark)
    run = lambda found, **more: refresh.run(spark, found, families, asked, relevant, **more)
    dry = run(docs)
    assert (dry.status, [x[0] for x in dry.stages]) == ("DRY_RUN_COMPLETE", ["VALIDATE", "REINDEX", "EVALUATE"])
    done = run(docs, target=str(tmp_path / "release"), active={"recall_at_k": 1.0})
    assert (done.status, done.reason) == ("RELEASED", None) and [x[0] for x in done.stages] == list(refresh.STAGES)
    assert snapshots.verify(spark, str(tmp_path / "release")).isEmpty()
    assert run(docs, target=str(tmp_path / "release")).reason == "BACKUP_FAILED"  # a release is never overwritten
    assert run(docs, active={"precision_at_k": 1.1}).reason == "EVALUATION_FAILED"
    assert run(docs.withColumn("text", F.when(F.col("document_id") == "TM-1", " ").otherwise(F.col("text")))).reason == "INDEXING_FAILED"
    for bad in (docs.limit(0), docs.union(docs.limit(1)), docs.withColumn("document_id", F.lit(" ")), docs.withColumn("admission_status", F.lit("REJECT"))):
        assert (bad_run := run(bad)).status == "REJECTED" and bad_run.reason == "VALIDATION_FAILED" and len(bad_run.stages) == 1
    assert dry.log(spark).count() == 3


def test_ids_as_written_out(spark):
    import hashlib

    row = spark.createDataFrame([("doc", "a text", "SF-01", "INDIA", ["doc:p1:b1", "doc:p1:b2"], [1, 2])], "document_id string, text string, source_family_id string, jurisdiction string, block_ids array<string>, page_numbers array<int>")
    item = evidence.evidence_items(row).first()
    sha = lambda *parts: hashlib.sha256("|".join(parts).encode()).hexdigest()
    content = hashlib.sha256(b"a text").hexdigest()
    chunk = sha("chunk-id-v1", "doc", content, "chunking-config:v1.0.0:max=1000:unit=UNICODE_CODE_POINTS", "doc:p1:b1,doc:p1:b2", "0")
    assert item.chunk_id == chunk and item.evidence_id == sha("evidence-id-v1", "1.0.0", chunk, content, "doc", "SF-01", "INDIA", "doc:p1:b1,doc:p1:b2", "1,2")
    assert evidence.signature(4, 8, 0.5) == "evidence-selection-config:v1.0.0:max_items=4:max_rank=8:min_score=0.5"


def test_ranking_takes_texts_in_their_normal_form(spark):
    """Ligatures, full-width letters, composed and decomposed accents: counts, lengths, frequencies and overlap agree with BM25."""
    from dossier.operators import fusion, lexical

    docs = spark.createDataFrame([(1, "\ufb01le \uff21\uff43\uff54"), (2, "re\u0301sume\u0301 r\u00e9sum\u00e9"), (3, None), (4, "other act")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "file act"), (2, "R\u00c9SUM\u00c9")], "query_id long, query string")
    assert {(r.doc_id, r.term): r.tf for r in lexical.term_counts(docs).collect()} == {(1, "file"): 1, (1, "act"): 1, (2, "r\u00e9sum\u00e9"): 2, (4, "other"): 1, (4, "act"): 1}
    assert {r.doc_id: r.n_tokens for r in lexical.lengths(docs).collect()} == {1: 2, 2: 2, 3: 0, 4: 2}
    assert {r.term: r.df for r in lexical.document_frequency(docs).collect()} == {"file": 1, "act": 2, "r\u00e9sum\u00e9": 1, "other": 1}
    assert tuple(lexical.corpus_stats(docs).first()) == (4, 1.5)
    ranked = lexical.bm25_topk(asked, docs)
    assert {(r.query_id, r.doc_id, r.overlap) for r in fusion.overlap_rerank(ranked, asked, docs).collect()} == {(1, 1, 2), (1, 4, 1), (2, 2, 2)}
