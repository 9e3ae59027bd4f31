"""Personal data: candidate spans from high-recall generators, chosen by boosted trees.

Base spans (mail addresses, IP addresses, card and phone numbers that pass their tests) are
always reported. Beside them two generators propose what the patterns miss: digit groups of any
form and written-out mail addresses ("name at host dot org"). Gradient-boosted trees score each
proposal by its format (length, digits, groups, separators, signs) and its context (the characters
around it). They learn from all proposals of the same texts: those that a base span confirms are
positive. A threshold is calibrated on all of them too, each scored by trees that learned from the
other half: the lowest score from which on at least PRECISION of them are confirmed. Proposals that
reach it by the trees of all proposals and overlap no base span are added.

Spark functions and Spark's own trees only. Texts are read once, in the row; only matches are
shuffled, keyed by row. Null texts are empty. Rows without a match stay, with counts of 0. Repeated
rows are reported each. Cost grows with text and matches, so very long texts need no cut. Empty
tables give empty results. Columns other than doc_id and text do not matter.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgauge.llm.secrets import by_kind, count_of
from quillgauge.llm.spans import ROW, joined_spans, matches, near, placed
from quillgauge.operators.scale import durable

# Possessive forms of the given patterns: they match the same and never go back. A match may
# start only where a run of its characters starts, or where the match before it ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Proposals.
DIGITS = r"(?<![A-Za-z0-9])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"
WRITTEN = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,64}+\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[a-z0-9-]{2,64}+(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[a-z0-9-]{2,24}+)+"
BASE = ("email", "ip", "card", "phone")
PROPOSED = ("number", "mail")
FEATURES = (
    "length", "digits", "letters", "groups", "longest", "spaces", "hyphens", "dots", "parens", "plus", "at",
    "left_space", "left_letter", "left_digit", "left_sign", "right_space", "right_letter", "right_sign", "mail",
)
TREES, DEPTH, SEED = 12, 3, 9
PRECISION, LEAST_HELD, BINS = 0.95, 20, 50


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Whether a number of at most 19 digits has the right check digit."""
    size = F.char_length(digits)
    terms = F.transform(F.split(digits, ""), lambda d, k: F.when(
        F.pmod(size - k, F.lit(2)) == 0, F.element_at(F.array(*[F.lit(n) for n in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)
    ).otherwise(d.cast("int")))
    return F.pmod(F.aggregate(terms, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))), F.lit(10)) == 0


def passes(kind: Column, value: Column) -> Column:
    """The tests of the base kinds; proposals need none."""
    digits = only_digits(value)
    size = F.char_length(digits)
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    ip = F.forall(parts, lambda p: (F.char_length(p) <= 3) & (F.coalesce(F.when(F.char_length(p) <= 3, p.try_cast("int")), F.lit(0)) <= 255))
    return (
        F.when(kind == "ip", ip)
        .when(kind == "card", F.when(size.between(13, 19), passes_luhn(digits)).otherwise(False))
        .when(kind == "phone", size.between(9, 15)).otherwise(F.lit(True))
    )


def proposals_and_spans(docs: DataFrame) -> DataFrame:
    """All base spans that pass and all proposals; rows without any stay with null kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # A number needs a digit, an address its sign or the words for it; most texts have neither.
    has_digit, has_at = F.regexp_like(text, F.lit("[0-9]")), F.contains(text, F.lit("@"))
    found = F.concat(
        matches(text, EMAIL, "email", has_at), matches(text, IP, "ip", has_digit), matches(text, CARD, "card", has_digit),
        matches(text, PHONE, "phone", F.contains(text, F.lit("+"))), matches(text, DIGITS, "number", has_digit),
        matches(text, WRITTEN, "mail", F.regexp_like(text, F.lit(r"(?i)@|\bat\b|\[at\]"))),
    )
    return placed(docs.select("doc_id", text.alias("text")), found).withColumn(
        "kind", F.when(passes(F.col("kind"), F.col("value")), F.col("kind"))
    )


def with_features(found: DataFrame) -> DataFrame:
    """Format and context of each proposal as numbers."""
    value, left, right = F.col("value"), F.right("left", F.lit(1)), F.left("right", F.lit(1))

    def count(pattern: str) -> Column:
        return F.char_length(value) - F.char_length(F.regexp_replace(value, pattern, ""))

    groups = F.filter(F.split(value, "[^0-9A-Za-z]+"), lambda g: g != "")

    def is_a(side: Column, pattern: str) -> Column:
        return F.regexp_like(side, F.lit(pattern)).cast("int")

    made = {
        "length": F.char_length(value), "digits": count("[0-9]"), "letters": count("[A-Za-z]"), "groups": F.size(groups),
        "longest": F.array_max(F.transform(groups, F.char_length)), "spaces": count(" "), "hyphens": count("-"), "dots": count(r"\."),
        "parens": count("[()]"), "plus": is_a(value, r"^\+"), "at": count("@"),
        "left_space": is_a(left, r"^\s?$"), "left_letter": is_a(left, r"^\p{L}$"), "left_digit": is_a(left, "^[0-9]$"), "left_sign": is_a(left, r"^[^\s\p{L}0-9]$"),
        "right_space": is_a(right, r"^\s?$"), "right_letter": is_a(right, r"^\p{L}$"), "right_sign": is_a(right, r"^[^\s\p{L}0-9]$"),
        "mail": (F.col("kind") == "mail").cast("int"),
    }
    return found.withColumns({k: F.coalesce(c, F.lit(0)).cast("double") for k, c in made.items()})


def confirmed(found: DataFrame) -> DataFrame:
    """Proposals with `known`: whether a base span overlaps them."""
    spans = found.filter("kind IS NOT NULL")
    proposed = spans.filter(F.col("kind").isin(*PROPOSED))
    base = spans.filter(F.col("kind").isin(*BASE)).select(ROW, "start", "stop")
    hits = near(proposed.select(ROW, "kind", "start", "stop"), base, 64).filter("overlaps").select(ROW, "kind", "start", "stop").distinct()
    return proposed.join(hits.withColumn("known", F.lit(1)), [ROW, "kind", "start", "stop"], "left").withColumn("known", F.coalesce("known", F.lit(0)).cast("double"))


def added(found: DataFrame, precision: float = PRECISION) -> DataFrame | None:
    """Proposals that the trees take beside the base spans; None if there is nothing to learn."""
    place = F.xxhash64("kind", "start", "stop", *FEATURES, F.lit(SEED))
    half = F.pmod(place, F.lit(2)).cast("int").alias("_half")
    rows = durable(with_features(confirmed(found)).select(ROW, "kind", "start", "stop", "known", *FEATURES, half))
    seen = {(r["_half"], r["known"]) for r in rows.select("_half", "known").distinct().collect()}
    if len(seen) < 4:
        return None
    trees = GBTClassifier(labelCol="known", featuresCol="_x", maxIter=TREES, maxDepth=DEPTH, maxBins=16, seed=SEED)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_x")

    def scored(learned: DataFrame, proposals: DataFrame) -> DataFrame:
        model = trees.fit(vectors.transform(learned))
        return model.transform(vectors.transform(proposals)).withColumn("_score", vector_to_array("probability")[1])

    bins: dict[int, tuple[int, float]] = {}
    for part in (0, 1):
        counted = scored(rows.filter(F.col("_half") != part), rows.filter(F.col("_half") == part)).groupBy(
            F.floor(F.col("_score") * BINS).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("known").alias("good"))
        for r in counted.collect():
            n, good = bins.get(r["bin"], (0, 0.0))
            bins[r["bin"]] = n + r["n"], good + r["good"]
    # The lowest threshold from which on proposals are confirmed often enough.
    threshold, n, good = None, 0, 0.0
    for b in sorted(bins, reverse=True):
        n, good = n + bins[b][0], good + bins[b][1]
        if n >= LEAST_HELD and good >= precision * n:
            threshold = b / BINS
    if threshold is None:
        return None
    return scored(rows, rows.filter("known = 0")).filter(F.col("_score") >= threshold).select(ROW, "kind", "start", "stop")


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of `docs`: doc_id, base and spans, arrays of (rank, start, kind, stop)."""
    found = durable(proposals_and_spans(docs))
    order = {k: n for n, k in enumerate((*BASE, *PROPOSED))}
    every = found.select(ROW, "doc_id", F.when(F.col("kind").isin(*BASE), F.col("kind")).alias("kind"), "start", "stop")
    more = added(found)
    if more is not None:
        every = every.union(more.select(ROW, F.lit(None).cast("bigint").alias("doc_id"), "kind", "start", "stop"))
    span = F.struct(by_kind(order, F.col("kind")).alias("rank"), "start", "kind", "stop")
    # The spans of a row fit where its text did; the id comes from the rows that have it.
    return (
        every.groupBy(ROW)
        .agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("spans"))
        .withColumn("base", F.filter("spans", lambda s: s["kind"].isin(*BASE)))
        .select("doc_id", "base", "spans")
    )


def digest(docs: DataFrame) -> DataFrame:
    """Counts, checksum of the base spans and all spans, for each row."""
    return scan(docs).select(
        "doc_id", *[count_of("base", k) for k in BASE],
        F.sha2(joined_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"),
    )
