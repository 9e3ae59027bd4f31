"""The trees of the personal-data scan learn and are calibrated on all proposals."""

from quillgauge.llm import pii


def test_all_proposals_count_for_the_threshold(spark):
    sure = [(i, f"{'so ' * i}call +49 170 {1000000 + 7919 * i} now") for i in range(40)]
    other = [(100 + i, f"{'so ' * i}part no {10000000 + 104729 * i} shelf") for i in range(40)]
    docs = spark.createDataFrame([*sure, *other], "doc_id BIGINT, text STRING")
    # Twenty confirmed ones are needed: a quarter of these is too few, all are enough.
    more = pii.added(pii.durable(pii.proposals_and_spans(docs)))
    assert more is not None
    assert more.count() == 0  # none of the others looks like a confirmed one
