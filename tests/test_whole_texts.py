"""Queries without SQL read whole texts."""

from pyspark.sql import functions as F

from sigmill.plans.queries import QUERIES


def test_a_date_behind_character_200(spark, tmp_path):
    rows = [(10, "x " * 300 + "2026-08-15 23:33 멈춤"), (24, "x " * 300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.dated for r in QUERIES["occurred_at"](spark, str(tmp_path)).select("doc_id", F.col("occurred_at").isNotNull().alias("dated")).collect()}
    assert found == {10: True, 24: False}
