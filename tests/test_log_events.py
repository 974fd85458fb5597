"""Log events: no secret comes out at any depth, nothing raises, equal rows give equal lines."""

import datetime
import json

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier.operators import log_events


def test_secrets_at_every_depth():
    deep = {"a": [{"b": {"Client-Secret": ["s3cret"], "c": [[{"X-API-Key": "s3cret", "n": 1}]]}}], "text": '{"in":{"pass_word":"s3cret"},"ok":1}', "list": '[{"bearer":"s3cret"}]', "plain": "{no json"}
    line = log_events.clear(json.dumps(deep))
    assert "s3cret" not in line
    found = json.loads(line)
    assert found["a"][0]["b"] == {"Client-Secret": "***REDACTED***", "c": [[{"X-API-Key": "***REDACTED***", "n": 1}]]} and found["plain"] == "{no json"
    assert json.loads(found["text"]) == {"in": {"pass_word": "***REDACTED***"}, "ok": 1} and json.loads(found["list"]) == [{"bearer": "***REDACTED***"}]


def test_details_that_are_no_object():
    assert [log_events.clear(x) for x in (None, "null", "{}")] == ["{}"] * 3
    for odd in ("", "{", "[1]", "1", '"x"', "\ufffe", "[" * 100_000, '{"a":' * 100_000):
        assert list(json.loads(log_events.clear(odd))) == [log_events.NO_OBJECT]


VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "to-ken", "AUTH", "my key"]), x, max_size=3), max_leaves=20)


@given(st.dictionaries(st.text(max_size=4), VALUES, max_size=3))
def test_clearing_twice_changes_nothing(details):
    once = log_events.clear(json.dumps(details))
    assert log_events.clear(once) == once == json.dumps(json.loads(once), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


BASE = {"event_name": "ASKED", "timestamp": "2026-01-01T00:00:00+00:00", "level": "INFO", "component": "API", "outcome": None, "request_id": "r", "latency_ms": 2.5, "error_type": None}
SCHEMA = "event_name string, timestamp string, level string, component string, outcome string, request_id string, latency_ms double, error_type string"


def test_lines_are_canonical(spark):
    rows = spark.createDataFrame([tuple(BASE.values())], SCHEMA).select("*", F.explode(F.array(F.lit('{"b":1,"a":"é"}'), F.lit('{ "a":"é", "b":1 }'))).alias("metadata"))
    lines = [r.line for r in log_events.events(rows).collect()]
    assert lines[0] == lines[1] == json.dumps({**BASE, "schema_version": "1.0.0", "metadata": {"a": "é", "b": 1}}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_details_of_every_type(spark):
    one = spark.createDataFrame([tuple(BASE.values())], SCHEMA)
    odd = F.struct(F.lit(b"raw").alias("blob"), F.lit(datetime.timedelta(1)).alias("span"), F.lit(None).cast("int").alias("none"), F.create_map(F.lit(1), F.array(F.lit(b"x"))).alias("by_number"), F.struct(F.lit("s3cret").alias("token")).alias("inner"))
    for details, expected in (
        (odd, {"blob": "<unserializable:binary>", "span": "<unserializable:interval>", "none": None, "by_number": {"1": ["<unserializable:binary>"]}, "inner": {"token": "***REDACTED***"}}),
        (F.parse_json(F.lit('{"z":[{"pwd":1}]}')), {"z": [{"pwd": "***REDACTED***"}]}),
        (F.create_map(F.lit("auth"), F.lit("s3cret"), F.lit("x"), F.lit("y")), {"auth": "***REDACTED***", "x": "y"}),
        (F.lit(None).cast("struct<a:int>"), {}),
    ):
        found = json.loads(log_events.events(one.withColumn("metadata", details)).first().line)["metadata"]
        assert {k: (v if k != "span" else "<unserializable:interval>") for k, v in found.items()} == expected


def test_rows_that_are_no_events(spark):
    bad = [{"event_name": " "}, {"timestamp": None}, {"component": ""}, {"level": "loud"}, {"level": None}, {"latency_ms": -0.5}, {"latency_ms": float("nan")}, {"latency_ms": float("inf")}, {"latency_ms": None}]
    rows = spark.createDataFrame([(i, *{**BASE, **x}.values()) for i, x in enumerate(bad)], f"i int, {SCHEMA}").withColumn("metadata", F.lit("{}"))
    found = [(r.problem, r.line is None) for r in log_events.events(rows).orderBy("i").collect()]
    assert found == [(p, True) for p in ("MISSING_EVENT_NAME", "MISSING_TIMESTAMP", "MISSING_COMPONENT", "UNKNOWN_LEVEL", "UNKNOWN_LEVEL", "INVALID_LATENCY", "INVALID_LATENCY", "INVALID_LATENCY")] + [(None, False)]
