"""Mixing sources to target weights by Pareto order sampling.

A source with target t and size s takes floor(t / s) certain whole copies of every document.
The rest is a sample with inclusion odds p / (1 - p), p being the fraction that is left. Each
document gets a uniform number u from its id, and is ranked by (u / (1 - u)) / (p / (1 - p)),
over the document's own `odds` where such a column is named (so probabilities may differ inside
a source as they do between sources). The sample is of fixed size, counted in words: documents
are taken in rank order as long as half of the next one still fits into what is left.

Ranking never sorts a whole source in one task: words are summed per (source, range of ranks),
running totals over the ranges find the one range that the cut falls into, and only the
documents of that range are ordered. Nothing is collected.

Nulls: a null text has size 0; a null source is a source of its own, last in order. Rows with
size 0 take 0 words. Repeated rows are each a document; ties of rank go by id, then size. An
empty table gives an empty result. Other columns of the input pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgauge.operators.scale import broadcast_if_small, durable

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
RANGES = 1 << 14
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Number of runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("bigint")


def uniform(doc_id: str = "doc_id", seed: str = "mix") -> Column:
    """A number in (0, 1) from the id: 48 bits of a digest, moved off the ends."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(doc_id).cast("string"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Words each source should give: by weight, none above `most` times its own size.

    With sources ordered by cap / weight, those that stop at their cap come first; a source
    stops there if the water level at its own ratio needs less than the whole. `sizes` has a
    row for each source (source, source_size), so the ordering windows see one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ruled = (
        sizes.withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size").cast("double") * most)
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.sum(F.col("source_size")).over(everything).cast("double") * share)
        .withColumn("_weights", F.sum("_w").over(everything))
        .withColumn("_caps_before", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_left", F.col("_weights") - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_stops", F.col("_caps_before") + F.col("_ratio") * F.col("_left") <= F.col("_all"))
    )
    # The first source that does not stop sets the level; later ones have the same or none.
    first_free = F.first(F.when(~F.col("_stops"), (F.col("_all") - F.col("_caps_before")) / F.col("_left")), ignorenulls=True).over(
        Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return ruled.select(
        "source", "source_size",
        F.when(F.col("_stops"), F.col("_cap")).otherwise(F.least(first_free * F.col("_w"), F.col("_cap"))).alias("target"),
    )


def mix(
    docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST,
    odds: str | None = None, seed: str = "mix",
) -> DataFrame:
    """All documents with size, source_size, target, copies (how often it is taken) and taken.

    Columns of the input with these names are replaced; a null in `odds` counts as 1.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    weight = F.greatest(F.coalesce(F.col(odds).cast("double"), F.lit(1.0)), F.lit(1e-9)) if odds else F.lit(1.0)
    # Ids, sizes and odds only: the text is read for its size once and is never shuffled.
    slim = durable(docs.select("doc_id", "source", word_count().alias("size"), weight.alias("_weight")))
    per_source = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    has_words = F.col("source_size") > 0
    per_source = durable(
        per_source
        .withColumn("_whole", F.when(has_words, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
        .withColumn("_need", F.col("target") - F.col("_whole") * F.col("source_size"))
        .withColumn("_p", F.when(has_words, F.col("_need") / F.col("source_size")).otherwise(0.0))
        .withColumnRenamed("source", "_source")
    )

    def ranked(rows: DataFrame, sources: DataFrame) -> DataFrame:
        u = uniform(seed=seed)
        rank = u / (1 - u) / (F.col("_weight") * F.col("_p") / (1 - F.col("_p")))
        return (
            rows.join(broadcast_if_small(sources), rows["source"].eqNullSafe(F.col("_source"))).drop("_source")
            .withColumn("_rank", F.when((F.col("_p") > 0) & (F.col("_p") < 1), rank))
        )

    # rank / (1 + rank) is in (0, 1), so its ranges cover every rank.
    ranges = ranked(slim, per_source).filter(F.col("_rank").isNotNull()).withColumn(
        "_range", F.floor(F.col("_rank") / (1 + F.col("_rank")) * RANGES).cast("int")
    )
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        ranges.groupBy("source", "_range").agg(F.sum("size").alias("_words"), F.max("_need").alias("_limit"))
        .withColumn("_before", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
        .filter(F.col("_before") <= F.col("_limit"))
        .groupBy("source").agg(F.max(F.struct("_range", "_before")).alias("_cut"))
        .select(F.col("source").alias("_cut_source"), F.col("_cut._range").alias("_cut_range"), F.col("_cut._before").alias("_before"))
    )
    inside = Window.partitionBy("source").orderBy("_rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        ranges.join(
            broadcast_if_small(durable(cuts)),
            ranges["source"].eqNullSafe(F.col("_cut_source")) & (F.col("_range") == F.col("_cut_range")),
        )
        .withColumn("_before", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        # Taken as long as half of it fits; the first that does not fit ends the sample.
        .groupBy("source").agg(
            F.min(F.when(F.col("_before") + F.col("size") / 2 > F.col("_need"), F.struct("_rank", "doc_id", "size"))).alias("_end"),
            F.max("_range").alias("_end_range"),
        )
        .withColumnRenamed("source", "_end_source")
    )
    rules = durable(
        per_source.join(last, per_source["_source"].eqNullSafe(F.col("_end_source")), "left").drop("_end_source")
    )
    sized = docs.withColumn("size", word_count()).withColumn("_weight", weight)
    chosen = (
        F.when(F.col("_rank").isNull(), F.lit(False))
        .when(F.col("_end").isNotNull(), F.struct("_rank", "doc_id", "size") < F.col("_end"))
        .otherwise(F.floor(F.col("_rank") / (1 + F.col("_rank")) * RANGES) <= F.col("_end_range"))
    )
    return (
        ranked(sized, rules)
        .withColumn("copies", F.col("_whole") + chosen.cast("bigint"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_weight", "_whole", "_need", "_p", "_rank", "_end", "_end_range")
    )
