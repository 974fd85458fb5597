"""A pinned corpus: built from manifests and raw files, and used only if everything is as it was when it was pinned.

A pin names a document with its family, jurisdiction, hash, number of chunks and index signature. Each check that fails is a
row (document_id, layer, problem, detail) of the first layer at which a document fails; nothing is repaired, skipped or
replaced. Totals of all layers come from the one pass that writes the chunks, by ``DataFrame.observe``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions.shared import shared_dir, written
from dossier.operators import admission, blocks, chunks, records, strict_json
from dossier.sources import files as raw_files

#: The fields of a manifest, all of them pinned.
MANIFEST = {"document_id": "text", "source_family_id": "text", "jurisdiction": "text", "synthetic": "boolean", "content_hash": "hash", "admission_status": "text", "path": "text"}
PINNED = ("source_family_id", "jurisdiction", "synthetic", "content_hash")
PINS = "document_id string, source_family_id string, jurisdiction string, synthetic boolean, content_hash string, n_chunks long, signature string"
PROBLEM = "document_id string, layer string, problem string, detail string"


class CorpusFault(Exception):
    """The corpus isn't what was pinned; ``problems`` has a row for each document that fails."""

    def __init__(self, problems: DataFrame, n: int):
        first = problems.orderBy("document_id").first()
        super().__init__(f"{n} problems, the first of {first.document_id}: {first.problem} {first.detail or ''}".strip())
        self.problems, self.n = problems, n


@dataclass
class Corpus:
    """Chunks that passed every check, problems of the others, and what was counted as the chunks were written."""

    chunks: DataFrame
    problems: DataFrame
    counts: dict[str, int]

    def sound(self) -> Corpus:
        """This corpus, if nothing is wrong with it; else CorpusFault."""
        n = self.problems.count()
        if n:
            raise CorpusFault(self.problems, n)
        return self


def scan_manifests(spark: SparkSession, root: str) -> DataFrame:
    """(path, json) of every manifest file below ``root``, a JSON object each."""
    found = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return found.select(F.col("_metadata.file_path").alias("manifest_path"), F.col("value").alias("json"))


def read_manifests(manifests: DataFrame) -> DataFrame:
    """``manifests`` (manifest_path, json) with the fields of MANIFEST (null if malformed) and ``manifest_problem``."""
    parsed = manifests.withColumn("_v", F.try_parse_json("json"))
    problem = F.when(F.col("_v").isNull(), "MALFORMED_JSON").otherwise(strict_json.problem_of(F.col("_v"), MANIFEST))
    typed = {name: F.try_variant_get("_v", f"$.{name}", "boolean" if kind == "boolean" else "string") for name, kind in MANIFEST.items()}
    # an id is kept where there is one, so that its problem is told under its name
    return parsed.withColumn("manifest_problem", problem).select("manifest_path", "manifest_problem", *(v.alias(k) for k, v in typed.items()))


def _step(condition: Column, layer: str, problem: str | Column, detail: Column | None = None) -> Column:
    name = F.lit(problem) if isinstance(problem, str) else problem
    return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(layer).alias("layer"), name.alias("problem"), (F.lit(None).cast("string") if detail is None else detail).alias("detail")))


def build(manifests: DataFrame, files: DataFrame, pins: DataFrame, registry: DataFrame, budget: int = chunks.BUDGET) -> Corpus:
    """The corpus that ``pins`` (PINS) describe, of manifests (manifest_path, json) and files (path, extension, content).

    Layers in order: MANIFEST (missing, malformed, given twice, not pinned, a field that differs from its pin), INGESTION
    (no file, admission, file safety, bytes that aren't those pinned, no text), CHUNKS (their number), INDEX (signature). A
    null number or signature in a pin is not held against a document.
    Documents don't share a task's memory: each is a row, and what is gathered by document is bounded by one.
    """
    spark = pins.sparkSession
    own = read_manifests(manifests)
    named = own.withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy("document_id")))
    pinned = pins.select("document_id", *(F.col(c).alias(f"pin_{c}") for c in (*PINNED, "n_chunks", "signature")), F.lit(True).alias("pinned"))
    # manifests without an id stay rows of their own
    joined = named.join(pinned, "document_id", "full_outer")
    differs = F.filter(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"pin_{c}")), F.lit(c)) for c in PINNED)), lambda x: x.isNotNull())
    manifest_step = F.coalesce(
        _step(F.col("manifest_path").isNull(), "MANIFEST", "MANIFEST_MISSING"),
        _step(F.col("manifest_problem").isNotNull(), "MANIFEST", "MANIFEST_MALFORMED", F.col("manifest_problem")),
        _step(F.col("_times") > 1, "MANIFEST", "MANIFEST_TWICE"),
        _step(F.col("pinned").isNull(), "MANIFEST", "NOT_PINNED"),
        _step(F.size(differs) > 0, "MANIFEST", "PIN_MISMATCH", F.array_join(differs, ",")),
    )
    checked = written(joined.withColumn("_fault", manifest_step).drop("json"), f"{shared_dir(spark)}/manifests")
    passed = checked.where("_fault IS NULL")
    taken = raw_files.ingest(files, passed.select("path", "document_id", "source_family_id", "jurisdiction", "content_hash", "admission_status", "synthetic", "pin_n_chunks", "pin_signature"), registry)
    no_text = F.col("reason").isNull() & F.coalesce(F.trim("text") == "", F.lit(True))
    ingest_step = F.coalesce(_step(F.col("reason").isNotNull(), "INGESTION", F.col("reason"), F.col("pipeline_state")), _step(no_text, "INGESTION", "NO_TEXT", F.col("document_type")))
    ingested = written(taken.withColumn("_fault", ingest_step), f"{shared_dir(spark)}/ingested")
    texts = ingested.where("_fault IS NULL").select("document_id", "text", "content_hash")
    cut = chunks.chunk_documents(blocks.sections(blocks.text_blocks(texts.select("document_id", "text"), "document_id"), "document_id"), "document_id", budget)
    # chunks carry their document's provenance, and what is wrong with them is counted as they are written
    provenance = ingested.select("document_id", "source_family_id", "jurisdiction", "synthetic", F.col("content_hash").alias("document_hash"))
    with_source = cut.join(provenance, "document_id", "left")
    seen = Observation("corpus")
    orphan = F.col("source_family_id").isNull() | F.col("jurisdiction").isNull() | F.col("document_hash").isNull()
    watched = with_source.observe(
        seen,
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.count_if(orphan).alias("n_without_provenance"),
        F.count_if(F.length("text") > budget).alias("n_over_budget"), F.count_if(F.size("block_ids") == 0).alias("n_without_block"),
    )
    kept = written(watched, f"{shared_dir(spark)}/corpus-chunks")
    counts = {k: int(v or 0) for k, v in seen.get.items()}
    signed = records.lexical_index_signatures(kept.select("document_id", F.col("chunk_sequence").alias("position"), "chunk_id", F.col("document_hash").alias("content_hash")), "document_id")
    made = ingested.where("_fault IS NULL").select("document_id", "pin_n_chunks", "pin_signature").join(signed, "document_id", "left")
    n_now = F.coalesce("n_chunks", F.lit(0))
    chunk_step = F.coalesce(
        _step(n_now != F.col("pin_n_chunks"), "CHUNKS", "CHUNK_COUNT_MISMATCH", F.concat_ws(" for ", n_now.cast("string"), F.col("pin_n_chunks").cast("string"))),
        _step(F.col("pin_signature").isNotNull() & ~F.col("index_signature").eqNullSafe(F.col("pin_signature")), "INDEX", "SIGNATURE_MISMATCH"),
    )
    failed = [df.where("_fault IS NOT NULL").select("document_id", "_fault.*") for df in (checked, ingested, made.withColumn("_fault", chunk_step))]
    problems = written(failed[0].unionByName(failed[1]).unionByName(failed[2]), f"{shared_dir(spark)}/problems")
    good = kept.join(problems.where("document_id IS NOT NULL").select("document_id").distinct(), "document_id", "left_anti")
    return Corpus(good, problems, counts)


def first_pins(manifests: DataFrame, files: DataFrame, registry: DataFrame) -> DataFrame:
    """Pins (PINS) of what the manifests say and the files hold now, to be looked through before they are used.

    Documents whose manifest or file fails have none.
    """
    own = read_manifests(manifests).where("manifest_problem IS NULL")
    loose = own.select("document_id", *PINNED, F.lit(None).cast("long").alias("n_chunks"), F.lit(None).cast("string").alias("signature"))
    rows = build(manifests, files, loose.dropDuplicates(["document_id"]), registry).chunks
    signed = records.lexical_index_signatures(rows.select("document_id", F.col("chunk_sequence").alias("position"), "chunk_id", F.col("document_hash").alias("content_hash")), "document_id")
    one = rows.groupBy("document_id").agg(*(F.first(c).alias(c) for c in ("source_family_id", "jurisdiction", "synthetic")), F.first("document_hash").alias("content_hash"))
    return one.join(signed, "document_id").select("document_id", *PINNED, "n_chunks", F.col("index_signature").alias("signature"))


def status(manifests: DataFrame, files: DataFrame, pins: DataFrame, registry: DataFrame) -> str:
    """VALIDATED if the corpus builds without a problem, else UNAVAILABLE; never raises."""
    try:
        return "VALIDATED" if build(manifests, files, pins, registry).problems.isEmpty() else "UNAVAILABLE"
    except Exception:
        return "UNAVAILABLE"
