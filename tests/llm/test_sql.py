"""The operators that SQL can express, against DuckDB on the smallest tables."""

import oracle
import pytest
from pyspark.sql import functions as F

from dossier.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    assert oracle.difference(QUERIES[name](spark, SF), oracle.connect(SF), ORACLE_SQL[name]) == ""


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op1_language_id"](spark, sf).where("held_out").join(docs, "doc_id")
    assert found.selectExpr("avg(CAST(lang = lang_pred AS INT)) AS share").first().share > 0.97


@pytest.mark.parametrize(("sf", "least", "most"), [("sf0.01", 0.6, 0.05), ("sf0.1", 0.9, 0.03)])
def test_toxicity_of_held_out_documents(spark, sf, least, most):
    """Shares found of toxic documents, and of others. Some labels of toxic documents without a telling word can't be learnt."""
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").select("doc_id", "toxic")
    found = QUERIES["op7_toxicity"](spark, f"/root/testdata/{sf}").where("held_out").join(labels, "doc_id")
    share = {r.toxic: r.share for r in found.groupBy("toxic").agg(F.avg("predicted").alias("share")).collect()}
    assert share[1] > least and share[0] < most
