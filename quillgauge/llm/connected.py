"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgauge.operators.scale import durable


def both_ways(links: DataFrame) -> DataFrame:
    """(node, other) of all links, each once from either side."""
    return links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct().withColumnsRenamed({"a": "node", "b": "other"})


def thinned(both: DataFrame) -> DataFrame:
    """Links that connect the same nodes and are no more: a node's larger neighbours are linked to its smallest one instead."""
    least = both.groupBy("node").agg(F.min("other").alias("least")).withColumn("least", F.least("node", "least"))
    return both.filter("other > node").join(least, "node").select(F.col("other").alias("a"), F.col("least").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of `links` (a, b); label is the smallest node it can reach.

    Where nodes have many links, these are thinned first, as long as that halves them. Then each
    round takes the smallest label among a node's neighbours, by an aggregation that
    combines before the shuffle, and then the label of its label, so rounds grow with the
    logarithm of a chain's length. Rounds are written to the shared folder. Nothing but the
    number of links and of changed labels reaches the driver.
    """
    both = durable(both_ways(links))
    number = both.count()
    while True:
        fewer = durable(both_ways(thinned(both)))
        before, number, both = number, fewer.count(), fewer
        if 2 * number >= before:
            break
    labels = durable(
        both.groupBy("node").agg(F.min("other").alias("label")).withColumn("label", F.least("node", "label"))
    )
    while True:
        seen = labels.withColumnsRenamed({"node": "other", "label": "seen"})
        lower = both.join(seen, "other").groupBy("node").agg(F.min("seen").alias("lower"))
        stepped = labels.join(lower, "node").select("node", "label", F.least("label", "lower").alias("step"))
        jump = labels.withColumnsRenamed({"node": "step", "label": "far"})
        after = durable(
            stepped.join(jump, "step")
            .select("node", F.least("step", "far").alias("label"), (F.least("step", "far") < F.col("label")).alias("moved"))
        )
        labels = after.drop("moved")
        if not after.filter("moved").limit(1).count():
            return labels
