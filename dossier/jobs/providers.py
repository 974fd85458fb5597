"""Calls of outside models as a stage: one load a worker, batches, failures as rows, and no call made twice.

A provider is any object with ``name``, ``model``, ``output`` (the SQL type of an answer) and ``load()``, which gives a
function from a batch of inputs to as many answers. What was answered is appended to a table as Parquet, slice by slice; a
run that was killed is resumed by asking only for what that table hasn't got for the same input, provider and model.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.identity import digest
from dossier.functions.shared import Files, shared_dir
from dossier.operators.lexical import top_ranked

#: Inputs that go to a provider at once, and about how many a slice has, which is what a killed task can lose.
BATCH, SLICE = 32, 1_000_000
#: Jobs of a run at most: each takes its part of the slices, a task a slice.
JOBS = 32


class Provider(Protocol):
    name: str
    model: str
    output: str

    def load(self) -> Callable[[Sequence[Any]], Sequence[Any]]:
        """Called once in each worker task; what it gives is called with BATCH inputs at most."""
        ...


class CallFailed(Exception):
    """What a provider raises, or gives in an answer's place, to say why there is none."""


def _schema(id_kind: str, output: str) -> str:
    return f"id {id_kind}, input_hash string, provider string, model string, success boolean, output {output}, failure_reason string"


def _problem(answer: Any, output: str, width: int | None) -> str | None:
    """Why an answer can't be taken; None if it can."""
    if isinstance(answer, Exception):
        return f"{type(answer).__name__}: {str(answer)[:300]}"
    if output == "string":
        return None if isinstance(answer, str) and answer.strip() else "EMPTY_OUTPUT"
    if output in ("double", "float"):
        return None if isinstance(answer, (int, float)) and not isinstance(answer, bool) and math.isfinite(answer) else "INVALID_NUMBER"
    if output.startswith("array<"):
        values = None if answer is None else list(answer)
        if not values or (width is not None and len(values) != width):
            return "WRONG_DIMENSION"
        return None if all(isinstance(float(x), float) and math.isfinite(float(x)) for x in values) else "NON_FINITE"
    return "EMPTY_OUTPUT" if answer is None else None


def ask(inputs: DataFrame, provider: Provider, batch: int = BATCH, width: int | None = None) -> DataFrame:
    """An answer, or the reason there is none, for each of ``inputs`` (id, input, input_hash): rows as in the table of answers.

    A batch that fails is asked input by input, so that one bad input doesn't cost the others. A provider that can't be
    loaded, or gives another number of answers than inputs, fails all of the batch. width: numbers of an array answer.
    """
    name, model, output = provider.name, provider.model, provider.output

    def answers(call: Callable, held: list) -> list:
        try:
            found = list(call(held))
            if len(found) != len(held):
                raise CallFailed(f"{len(found)} answers for {len(held)} inputs")
            return found
        except Exception as e:
            if len(held) == 1:
                return [e]
        return [x for one in held for x in answers(call, [one])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, why = None, None
        for frame in frames:
            if call is None and why is None and len(frame):
                try:
                    call = provider.load()
                except Exception as e:
                    why = e
            for first in range(0, len(frame), batch):
                part = frame.iloc[first : first + batch]
                found = [why] * len(part) if why else answers(call, list(part["input"]))
                reasons = [_problem(x, output, width) for x in found]
                yield pd.DataFrame({
                    "id": part["id"].to_numpy(), "input_hash": part["input_hash"].to_numpy(), "provider": name, "model": model, "success": [r is None for r in reasons],
                    "output": [x if r is None else None for x, r in zip(found, reasons, strict=True)], "failure_reason": reasons,
                })

    return inputs.select("id", "input", "input_hash").mapInPandas(run, _schema(dict(inputs.dtypes)["id"], output))


def answered(inputs: DataFrame, provider: Provider, path: str, batch: int = BATCH, width: int | None = None, size: int = SLICE, again: bool = False) -> DataFrame:
    """The answers for ``inputs`` (id, input: any column that can be printed, or a struct), asked where ``path`` hasn't got them.

    Null inputs get a failure (NULL_INPUT) without a call. again: failed ones are asked once more; their last answer counts.
    Inputs are dealt to slices of about ``size`` at most, written as they are due and then read once. A slice is a task that
    appends one file as it ends, so each is there whole or not at all, also where its job is killed; a store whose own
    committer waits for the job can lose one job of JOBS. Ids must be distinct.
    """
    spark = inputs.sparkSession
    kind = dict(inputs.dtypes)["id"]
    schema = _schema(kind, provider.output)
    shown = F.to_json(F.struct("input"))
    named = inputs.select("id", "input").withColumn("input_hash", digest("provider-input-v1", F.coalesce(shown, F.lit(""))))

    def stored() -> DataFrame:
        if not Files(spark, path).exists(""):
            return spark.createDataFrame([], schema + ", turn int")
        own = spark.read.schema(schema + ", turn int").parquet(path)
        return own.where((F.col("provider") == provider.name) & (F.col("model") == provider.model))

    before = stored()
    turn = (before.agg(F.max("turn").alias("t")).first().t or 0) + 1
    settled = before.where("success") if again else before
    todo = named.join(settled.select("id", "input_hash").distinct(), ["id", "input_hash"], "left_anti")
    name = f"{shared_dir(spark)}/due"
    try:
        todo.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(JOBS)).cast("int")).write.partitionBy("bucket").parquet(name)
        due = spark.read.schema(todo.withColumn("bucket", F.lit(0)).schema).parquet(name)
        sizes = {r.bucket: r.n for r in due.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # JOBS rows at most
        n_jobs = min(JOBS, max(1, -(-sum(sizes.values()) // size)))
        for job in range(n_jobs):
            own = due.where(F.col("bucket").isin(*(b for b in range(JOBS) if b % n_jobs == job)))
            n = sum(m for b, m in sizes.items() if b % n_jobs == job)
            slices = max(1, -(-n // size), min(spark.sparkContext.defaultParallelism, -(-n // batch)))
            asked = own.where("input IS NOT NULL").repartition(slices, "id")
            empty = own.where("input IS NULL").select("id", "input_hash", F.lit(provider.name).alias("provider"), F.lit(provider.model).alias("model"), F.lit(False).alias("success"), F.lit(None).cast(provider.output).alias("output"), F.lit("NULL_INPUT").alias("failure_reason"))
            found = ask(asked, provider, batch, width).unionByName(empty).withColumn("turn", F.lit(turn))
            # a task's file is moved to its place as the task ends, not as the job does
            found.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    finally:
        Files(spark, name).delete("")
    return _last(named, stored())


def _last(named: DataFrame, rows: DataFrame) -> DataFrame:
    """Of each input the last answer."""
    order = F.struct(F.col("turn"), F.col("success"))
    newest = rows.groupBy("id", "input_hash").agg(*(F.max_by(c, order).alias(c) for c in ("provider", "model", "success", "output", "failure_reason")))
    return newest.join(named.select("id", "input_hash"), ["id", "input_hash"], "left_semi")


def embedded(texts: DataFrame, provider: Provider, path: str, dimension: int, **settings: Any) -> DataFrame:
    """(id, embedding, failure_reason) of ``texts`` (id, text); vectors of another dimension or not finite are failures."""
    found = answered(texts.select("id", F.col("text").alias("input")), provider, path, width=dimension, **settings)
    return found.select("id", F.col("output").alias("embedding"), "failure_reason")


def reranked(pairs: DataFrame, texts: Column, provider: Provider, path: str, k: int, **settings: Any) -> DataFrame:
    """query_id, id, score, rank of the k best of ``pairs`` (query_id, id) by a provider's score of ``texts``, a struct column.

    Pairs without a score are left out of the ranking; the table at ``path`` says why.
    """
    rows = pairs.select(F.struct("query_id", "id").alias("id"), texts.alias("input"))
    found = answered(rows, provider, path, **settings).where("success")
    return top_ranked(found.select("id.query_id", "id.id", F.col("output").alias("score")), k, "score", "id")


def generated(prompts: DataFrame, provider: Provider, path: str, **settings: Any) -> DataFrame:
    """query_id, success, answer, failure_reason of ``prompts`` (query_id, prompt): what jobs.answer.decide() takes as outputs."""
    found = answered(prompts.select(F.col("query_id").alias("id"), F.col("prompt").alias("input")), provider, path, **settings)
    return found.select(F.col("id").alias("query_id"), "success", F.col("output").alias("answer"), "failure_reason")


def translated(answers: DataFrame, provider: Provider, path: str, **settings: Any) -> DataFrame:
    """``answers`` (query_id, success, answer) with translation and translation_ok; only answers that exist are translated."""
    asked = answers.where("success").select(F.col("query_id").alias("id"), F.col("answer").alias("input"))
    found = answered(asked, provider, path, **settings).select(F.col("id").alias("query_id"), F.col("output").alias("translation"), F.col("success").alias("translation_ok"))
    return answers.join(found, "query_id", "left")
