"""Operational and evaluation reports: one-row summaries put together, metrics by component, what wasn't run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.identity import digest, listed
from dossier.functions.text import number
from dossier.operators import observe

VERSION = "1.0.0"
# Fixed value: how the settings of an evaluation are written in ids.
CONFIG = f"evaluation-config:v{VERSION}:benchmark:v{VERSION}"
RESULT = ("component", "metric_name", "applicable", "value", "denominator", "explanation")


def operations(requests: DataFrame, latencies: DataFrame, metrics: DataFrame, citations: DataFrame, decisions: DataFrame, seconds: str = "seconds") -> DataFrame:
    """One row over all requests: latency, retrieval, citations, abstentions, and the report's id.

    latencies: seconds. metrics: precision_at_k, recall_at_k, reciprocal_rank by query. citations: status. decisions:
    safety_status. The parts are independent: none needs as many rows as another. Means and rates are null without rows.
    """
    rejected = F.count_if(F.col("status") != "VALID")
    parts = [
        requests.agg(F.count(F.lit(1)).alias("n_requests")),
        observe.latency(latencies, seconds).withColumnsRenamed({c: f"latency_{c}" for c in ("n", "total", "mean", "least", "greatest")}),
        metrics.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("precision_at_k").alias("mean_precision"), F.avg("recall_at_k").alias("mean_recall"), F.avg("reciprocal_rank").alias("mrr")),
        citations.agg(F.count(F.lit(1)).alias("n_references"), rejected.alias("n_rejected"), F.try_divide(rejected, F.count(F.lit(1))).alias("rejection_rate")),
        observe.abstentions(decisions).withColumnRenamed("n", "n_decisions"),
    ]
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each
    # a total is printed as Python prints it: Spark's own text of a double has an exponent from 1e7 on
    shown = lambda n: number(F.col(n)) if n == "latency_total" else F.col(n).cast("string")
    mark = lambda head, *names: F.concat_ws(":", F.lit(head), *map(shown, names))
    report_id = digest("observability-report-v1", VERSION, F.col("n_requests"), mark("lat", "latency_n", "latency_total"), mark("ret", "n_queries"), mark("cit", "n_references", "n_rejected"), mark("abs", "n_abstain", "n_escalate", "n_safe_to_present"))
    return one.withColumn("report_id", report_id)


def result(component: str, name: str, value: Column, n: Column, explanation: str) -> Column:
    """A metric that is applicable only where it has a value: without cases it wasn't run, which isn't 0."""
    ran = value.isNotNull()
    fields = (F.lit(component), F.lit(name), ran, value.cast("double"), F.when(ran, n).cast("long"), F.when(ran, F.lit(explanation)).otherwise("NOT RUN: no queries were run in this benchmark"))
    return F.struct(*(x.alias(k) for x, k in zip(fields, RESULT, strict=True)))


def not_run(component: str, name: str, reason: str) -> Column:
    fields = (F.lit(component), F.lit(name), F.lit(False), F.lit(None).cast("double"), F.lit(None).cast("long"), F.lit(f"NOT RUN: {reason}"))
    return F.struct(*(x.alias(k) for x, k in zip(fields, RESULT, strict=True)))


def retrieval_results(metrics: DataFrame, component: str, k: int, validated: bool = False) -> DataFrame:
    """Rows of RESULT for a ranking's metrics by query: mean precision, recall and reciprocal rank, and that no real model was run unless ``validated``."""
    one = metrics.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in ("precision_at_k", "recall_at_k", "reciprocal_rank")))
    rows = [result(component, name, F.col(c), F.col("n"), f"Mean over queries of {component}.") for name, c in ((f"PRECISION_AT_{k}", "precision_at_k"), (f"RECALL_AT_{k}", "recall_at_k"), ("MEAN_RECIPROCAL_RANK", "reciprocal_rank"))]
    rows += [] if validated else [not_run(component, "REAL_MODEL_RETRIEVAL_QUALITY", "no real model was used in this run")]
    return one.select(F.inline(F.array(*rows)))


def component_reports(cases: DataFrame) -> DataFrame:
    """Per component of cases (component, case_id, passed): counts, the failed ids in order, and the report's id.

    Cases are written by hand and few to a component.
    """
    ids = F.array_sort(F.collect_set("case_id"))
    failed = F.array_sort(F.collect_set(F.when(~F.coalesce("passed", F.lit(False)), F.col("case_id"))))
    by = cases.groupBy("component").agg(F.count(F.lit(1)).alias("n_cases"), F.count_if("passed").alias("n_passed"), failed.alias("failed_case_ids"), ids.alias("_ids"))
    return by.withColumn("report_id", digest("evaluation-report-v1", VERSION, F.col("component"), listed(F.col("_ids")), CONFIG)).drop("_ids")


def evaluation_report(components: DataFrame) -> DataFrame:
    """One row over component_reports(): counts, the components in order, and the report's id."""
    names = F.array_sort(F.collect_set("component"))  # a closed vocabulary of a few names
    one = components.agg(F.count(F.lit(1)).alias("n_components"), F.coalesce(F.sum("n_cases"), F.lit(0)).alias("n_cases"), F.coalesce(F.sum("n_passed"), F.lit(0)).alias("n_passed"), names.alias("_names"))
    return one.withColumn("report_id", digest("evaluation-report-top-v1", VERSION, VERSION, listed(F.col("_names")), CONFIG)).withColumn("components", listed(F.col("_names"))).drop("_names")
