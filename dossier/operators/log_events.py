"""Structured log events: details made safe for JSON and cleared of secrets at every depth, one canonical line each."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.ladders import first_match
from dossier.functions.text import is_blank
from dossier.operators import strict_json
from dossier.operators.observe import REDACTED, SENSITIVE

# Version, levels, and what stands for details that are no object.
VERSION = "1.0.0"
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
NO_OBJECT = "_diagnostic_metadata_type_error"
FIELDS = ("schema_version", "event_name", "timestamp", "level", "component", "outcome", "request_id", "latency_ms", "error_type", "metadata")
_PLAIN, _WORDS = re.compile("[^a-z0-9]"), re.compile("|".join(SENSITIVE))


def _cleared(value: Any) -> Any:
    """Secrets replaced wherever their names stand; a text that holds JSON objects or lists is cleared inside too. Recursion is bounded by json's own."""
    if isinstance(value, dict):
        return {k: REDACTED if _WORDS.search(_PLAIN.sub("", k.lower())) else _cleared(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_cleared(v) for v in value]
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            inner = json.loads(value)
        except (ValueError, RecursionError):
            return value
        clean = _cleared(inner)
        return value if clean == inner else _dumped(clean)
    return value


def _dumped(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def clear(text: str | None) -> str:
    """Canonical JSON of details without their secrets: an object always. Null gives an empty one, and what is no object says so; nothing raises."""
    if text is None:
        return "{}"
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return _dumped({NO_OBJECT: "no JSON"})
    if not isinstance(found, dict):
        return _dumped({} if found is None else {NO_OBJECT: f"expected an object, got {type(found).__name__}"})
    try:
        return _dumped(_cleared(found))
    except RecursionError:
        return _dumped({NO_OBJECT: "nested too deep"})


def cleared(text: Column) -> Column:
    """Details as JSON text, in Arrow batches: they nest to any depth, which a fixed expression can't follow."""

    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(clear, na_action=None)

    return apply(text)


def details(column: str, kind: T.DataType) -> Column:
    """A column of details as JSON text: text and VARIANT as they are; of structs and maps, values without a JSON form by the name of their type."""

    def safe(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(value.isNotNull(), F.struct(*(safe(value[f.name], f.dataType).alias(f.name) for f in kind)))
        if isinstance(kind, T.MapType):
            named = F.transform_keys(value, lambda k, _: k.cast("string")) if not isinstance(kind.keyType, T.StringType) else value
            return F.transform_values(named, lambda _, v: safe(v, kind.valueType))
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda v: safe(v, kind.elementType))
        if isinstance(kind, (T.BinaryType, T.CalendarIntervalType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
            return F.when(value.isNotNull(), F.lit(f"<unserializable:{kind.typeName()}>"))
        return value

    if isinstance(kind, T.StringType):
        return F.col(column)
    return F.to_json(F.col(column) if isinstance(kind, T.VariantType) else safe(F.col(column), kind), {"ignoreNullFields": "false"})


def problem() -> Column:
    """Why a row is no event; null if it is one."""
    c = F.col
    return first_match(
        [
            (is_blank(c("event_name")), "MISSING_EVENT_NAME"),
            (is_blank(c("timestamp")), "MISSING_TIMESTAMP"),
            (is_blank(c("component")), "MISSING_COMPONENT"),
            (~F.coalesce(c("level").isin(*LEVELS), F.lit(False)), "UNKNOWN_LEVEL"),
            (F.isnan("latency_ms") | (F.abs("latency_ms") == float("inf")) | (c("latency_ms") < 0), "INVALID_LATENCY"),
        ]
    )


def events(rows: DataFrame) -> DataFrame:
    """``rows`` with ``line``, the event as canonical JSON, or ``problem``: exactly one of them isn't null.

    rows: event_name, timestamp (text, in ISO form, given and never taken from a clock, so that equal rows give equal lines), level, component, and
    where known outcome, request_id, latency_ms, error_type (null otherwise), metadata (text of JSON, VARIANT, struct or map).
    """
    named = rows.withColumn("latency_ms", F.col("latency_ms").cast("double")).withColumn("_details", cleared(details("metadata", rows.schema["metadata"].dataType)))
    record = F.struct(F.lit(VERSION).alias("schema_version"), *(F.col(n) for n in FIELDS[1:-1]))
    kind = T.StructType([T.StructField(n, T.DoubleType() if n == "latency_ms" else T.StringType()) for n in FIELDS[:-1]])
    # metadata stands between level and outcome in order of names
    parts = [F.concat(F.lit(f'"{n}":'), F.col("_details") if n == "metadata" else strict_json.canonical(record[n], kind[n].dataType)) for n in sorted(FIELDS)]
    done = named.withColumn("problem", problem())
    return done.withColumn("line", F.when(F.col("problem").isNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))).drop("_details")
