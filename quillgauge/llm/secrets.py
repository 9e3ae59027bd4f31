"""Secrets in texts: plain patterns, and multipart credentials linked by an interval join.

Base spans (assignments to a secret's name, access identifiers, long hexadecimal runs) are always
reported. Weak parts (login names, endpoints, values that only look random) are reported when
complementary parts of a credential lie within SCOPE characters of them in the same text: a value
next to an identifier or an endpoint, a name next to a secret, an endpoint next to both. Weak
parts that overlap a base span are that span already.

Spark functions only. Texts are read once, in the row; only matches are shuffled, keyed by row.
Null texts are empty. Rows without a match stay, with counts of 0 and empty spans. Repeated rows
are reported each. Cost grows with text and matches, so very long texts need no cut. Empty tables
give empty results; columns other than doc_id and text do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgauge.llm.spans import ROW, joined_spans, matches, near, placed
from quillgauge.operators.scale import broadcast_if_small, durable

SCOPE = 240
# Possessive forms of the given patterns: they match the same and never go back.
VALUE = r"[A-Za-z0-9+/_.=-]"
ASSIGN = rf"(?i:password|passwd|secret|token|api_?key)[\"']?+\x20*+[:=]\x20*+[\"']?+({VALUE}++)"
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
# Weak parts.
NAME = r"(?i:user(?:name)?|login|account|client_?id|key_?id)[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9@+/_.-]{3,}+"
ENDPOINT = r"(?i:[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]++|(?:host|endpoint|server|region|bucket)[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9:/_.-]{3,}+)"
RANDOM = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[^A-Z\s]*+[A-Z])(?=[^a-z\s]*+[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}"
BASE = ("assign", "access", "hex")
ROLES = {"assign": "secret", "hex": "secret", "random": "secret", "access": "id", "name": "id", "endpoint": "place"}


def by_kind(values: dict[str, object], kind: Column) -> Column:
    return reduce(lambda found, k: found.when(kind == k, F.lit(values[k])), values, F).otherwise(None)


def parts(docs: DataFrame) -> DataFrame:
    """All valid spans of both sorts, and a row with null kind for rows without a match."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(*[matches(text, p, k) for k, p in (
        ("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("name", NAME), ("endpoint", ENDPOINT), ("random", RANDOM))])
    valid = (
        F.when(F.col("kind") == "assign", F.char_length(F.regexp_extract("value", ASSIGN, 1)) >= 6)
        .when(F.col("kind") == "access", F.char_length("value") >= 20).otherwise(F.lit(True))
    )
    return placed(docs.select("doc_id", text.alias("text")), found).select(
        ROW, "doc_id", F.when(valid, F.col("kind")).alias("kind"), "value", "start", "stop"
    )


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts with what they need in their scope."""
    spans = found.filter("kind IS NOT NULL").select(ROW, "kind", "start", "stop")
    base = F.col("kind").isin(*BASE)
    role = by_kind(ROLES, F.col("kind"))
    pairs = near(spans.filter(~base).withColumn("role", role), spans.withColumn("role", role).withColumn("base", base), scope)

    def has(other: str) -> Column:
        return F.bool_or((F.col("o_role") == other) & ~F.col("overlaps"))

    seen = pairs.groupBy(ROW, "kind", "role", "start", "stop").agg(
        has("secret").alias("secret"), has("id").alias("id"), has("place").alias("place"),
        F.bool_or(F.col("o_base") & F.col("overlaps")).alias("known"),
    )
    complete = (
        F.when(F.col("role") == "secret", F.col("id") | F.col("place"))
        .when(F.col("role") == "id", F.col("secret")).otherwise(F.col("secret") & F.col("id"))
    )
    return seen.filter(complete & ~F.col("known")).select(ROW, "kind", "start", "stop")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """A row for each row of `docs`: doc_id, base and spans, arrays of (start, rank, kind, stop)."""
    found = durable(parts(docs))
    order = {k: n for n, k in enumerate((*BASE, "name", "endpoint", "random"))}
    base = found.withColumn("kind", F.when(F.col("kind").isin(*BASE), F.col("kind"))).select(ROW, "doc_id", "kind", "start", "stop")
    weak = linked(found, scope).select(ROW, F.lit(None).cast(found.schema["doc_id"].dataType).alias("doc_id"), "kind", "start", "stop")
    span = F.struct("start", by_kind(order, F.col("kind")).alias("rank"), "kind", "stop")
    # The spans of a row fit where its text did; the id comes from the rows that have it.
    return (
        base.union(weak).groupBy(ROW)
        .agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("spans"))
        .withColumn("base", F.filter("spans", lambda s: s["kind"].isin(*BASE)))
        .select("doc_id", "base", "spans")
    )


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def digest(docs: DataFrame) -> DataFrame:
    """Counts, checksum of the base spans and all spans, for each row."""
    found = scan(docs)
    return found.select(
        "doc_id", *[count_of("base", k) for k in BASE],
        F.sha2(joined_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, scope: int = SCOPE, mask: str = "[secret]") -> DataFrame:
    """The rows of `docs` with each reported span replaced by `mask`; `n_chars`, if there, follows.

    Spans that overlap are masked as one. Rows without spans stay as they are. The spans, a small
    part of the text, are joined by id and checksum of the text.
    """
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    found = scan(docs.select(key.alias("doc_id"), "text"), scope).filter(F.size("spans") > 0)
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def merge(done, s):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (s["start"] <= last["stop"])
        wider = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(
            F.concat(done, F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop")))))

    # At most as many spans as the row's text has room for.
    merged = F.when(F.size("spans") > 0, F.aggregate("spans", empty, merge))
    spans = durable(found.select(F.col("doc_id.id").alias("_id"), F.col("doc_id.hash").alias("_hash"), merged.alias("_spans")).dropDuplicates(["_id", "_hash"]))
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("_spans", lambda s: s["stop"]))
    ends = F.concat(F.transform("_spans", lambda s: s["start"]), F.array(F.char_length("text").cast("bigint")))
    pieces = F.zip_with(begins, ends, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    joined = docs.join(broadcast_if_small(spans), docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_hash")), "left")
    masked = joined.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.array_join(pieces, mask)))
    if "n_chars" in docs.columns:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        masked = masked.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(size))
    return masked.select(*docs.columns)
