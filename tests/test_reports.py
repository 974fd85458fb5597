"""Report ids over totals of any size."""

import hashlib

import pytest

from dossier.operators import reports


@pytest.mark.parametrize(("seconds", "shown"), [([1.5, 2.0], "3.5"), ([9_999_999.0, 1.0], "10000000.0"), ([29_700_000.0], "29700000.0"), ([123_456_789.25], "123456789.25"), ([1e16], "1e+16"), ([], "0.0")])
def test_a_total_is_printed_as_python_prints_it(spark, seconds, shown):
    one = spark.range(2)
    held = spark.createDataFrame([(s,) for s in seconds], "seconds double")
    metrics = spark.createDataFrame([], "precision_at_k double, recall_at_k double, reciprocal_rank double")
    found = reports.operations(one, held, metrics, spark.createDataFrame([("VALID",)], "status string"), spark.createDataFrame([("ABSTAIN",)], "safety_status string")).first()
    text = f"observability-report-v1|1.0.0|2|lat:{len(seconds)}:{shown}|ret:0|cit:1:0|abs:1:0:0"
    assert shown == str(sum(seconds, 0.0)) and found.report_id == hashlib.sha256(text.encode()).hexdigest()
