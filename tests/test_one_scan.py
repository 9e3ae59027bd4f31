"""Queries that need several results of the block scan read the documents once."""

import pytest

from quillgauge.catalog import queries as q


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    text = ". ".join("word " * (n % 9 + 1) + "end" for n in range(60))
    rows = [(n, text, "en", "web", len(text)) for n in range(6)]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").write.parquet(f"{root}/documents.parquet")
    return root


@pytest.mark.parametrize("name", ["q_statements", "q_union", "q_located", "q_report", "q_not_modified"])
def test_documents_are_read_at_most_once_by_the_last_plan(spark, tables, name):
    made = getattr(q, name)(spark, tables)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation spark") <= 1
    assert made.count() >= 0
