"""Queries over whole tables and texts, on rows where each case has one."""

import pytest
from planwatch.operators.classify import judged
from planwatch.plans import queries as plans
from pyspark.sql import functions as F

from conftest import SF_DIR


def test_whole_bridge(spark):
    assert plans.QUERIES["bridge_join"](spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()


def test_day_has_events(spark):
    assert plans.QUERIES["usage_on_day"](spark, SF_DIR).first()["n"] > 0


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    head = "the same forty letters and more begin here "
    spark.createDataFrame([(1, head + "alpha"), (2, head + "beta"), (3, head + "gamma 7")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(10, f"before {head}alpha after"), (11, f"{head}gamma 77")], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(20, 0, "none"), (20, 1, f"It was {head}BETA.")], "conv_id long, turn int, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def test_whole_recall(spark, tables):
    got = sorted(tuple(r) for r in plans.QUERIES["recall_theta"](spark, tables).collect())
    assert got == [(1, True, "document", 10), (2, True, "conversation", 20), (3, False, None, None)]
    assert tuple(plans.QUERIES["recall_summary"](spark, tables).first()) == (2, 3)


def test_whole_reasons(spark, tmp_path):
    late = "keine Baugenehmigung und kein Baubeginn im Text (Frühphase)"
    pages = [
        ("https://a.example.net/x", "de the Baugenehmigung", "Website ausgeschlossen (a.example.net)"),
        ("https://b.org/1", "the Baugenehmigung", "Ort de nicht genannt"),
        ("https://b.org/2", "de Baugenehmigung", "kein Wohnbau"),
        ("https://b.org/3", "de the", late),
        ("https://b.org/4", "de the Spatenstich ist geplant", late),
        ("https://b.org/5", "de the Spatenstich war gestern", None),
        ("https://b.org/6", "de the Baugenehmigung", None),
        ("https://b.org/7", "de the Baugenehmigung, 8 Wohnungen, nur ETW", "reines Eigentumsprojekt mit 8 WE (unter 12)"),
    ]
    spark.createDataFrame([(i, u, t) for i, (u, t, _) in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = spark.read.parquet(f"{tmp_path}/pages.parquet").select("page_id", "url", F.lit("").alias("title"), F.col("html").alias("content"), F.lit("de").alias("place"))
    got = {r["page_id"]: r["reject_reason"] for r in judged(rows, 2026, plans.HOME, ("example.net",)).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(pages)}
