"""Document fingerprints by consistent weighted sampling.

A document is its words with their counts as weights. For each of SAMPLES positions every word
has, from its hash alone, r and c of a gamma distribution with shape 2 and a uniform b. With weight
w it stands for t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1); the word with the smallest a
is the sample, told by word and t. Two documents agree in a sample with a probability equal to
their generalised Jaccard similarity, the sum of the smaller over the sum of the larger weights.

Spark functions only. Texts are shuffled once, to ranges of ids, where each meets the next one;
counts, samples, minima and what else is told of a document are made inside its range in one go, without
a further shuffle of texts or words. Each range also gets the first document of the next range, so no join is needed for it.

Null texts are empty. Texts without words have a fingerprint of their own, equal to each other's
and to no other. Rows with null ids come first; rows with equal ids are ordered by text; the order
of rows equal in both does not matter. An empty table gives an empty result. Columns other than
doc_id and text do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 32
RANGE_ROWS = 1_000
# A sample is one number: ln a in fixed point above TAG bits that tell word and t apart.
SHIFT, SCALE, TAG = 100.0, float(1 << 32), 23


def id_ranges(docs: DataFrame, rows: int = RANGE_ROWS) -> list[int]:
    """Smallest id of each range of about `rows` documents; ids only, ordered by Spark."""
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL")
    parts = max(ids.count() // rows, 1)
    firsts = ids.repartitionByRange(parts, "doc_id").groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("first"))
    return sorted(r["first"] for r in firsts.collect())


def range_of(doc_id: Column, firsts: list[int]) -> Column:
    """Number of the range that holds an id, by binary search; null ids are in range 0."""
    known = F.lit(firsts) if firsts else F.lit([0])
    steps = F.sequence(F.lit(1), F.lit(max(len(firsts), 1).bit_length() + 1))
    start = F.struct(F.lit(0).alias("low"), F.lit(max(len(firsts), 1)).alias("high"))

    def narrow(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        above = (at["low"] < at["high"] - 1) & (F.element_at(known, middle + 1) <= doc_id)
        below = (at["low"] < at["high"] - 1) & ~above
        return F.struct(F.when(above, middle).otherwise(at["low"]).alias("low"), F.when(below, middle).otherwise(at["high"]).alias("high"))

    return F.coalesce(F.aggregate(steps, start, narrow)["low"], F.lit(0))


def with_next(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """(range, nth, extra, doc_id, text, next): rows in order of id in their range, and the text after.

    `extra` marks the copies of a next range's first row.
    """
    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    firsts = id_ranges(texts, rows)
    number = max(len(firsts), 1)
    placed = texts.withColumn("range", range_of(F.col("doc_id"), firsts))
    # At most one id for each range: a small table by construction, checked by the join itself.
    heads = placed.filter(F.col("doc_id").isin(firsts) if number <= 200 else F.array_contains(F.lit(firsts), F.col("doc_id")))
    if texts.filter("doc_id IS NULL").limit(1).count():
        heads = heads.filter("range > 0").union(placed.filter("doc_id IS NULL"))
    earliest = heads.groupBy("range").agg(F.min(F.struct(F.col("doc_id"), F.col("text"))).alias("head"))
    copies = earliest.select("head.doc_id", "head.text", F.pmod(F.col("range") - 1, F.lit(number)).alias("range"))
    order = Window.partitionBy("range").orderBy("extra", F.col("doc_id").asc_nulls_first(), "text")
    rows = placed.withColumn("extra", F.lit(0)).unionByName(copies.withColumn("extra", F.lit(1)))
    if number > 1:
        # As many tasks as ranges: left to itself Spark merges many ranges into a task, whose words then fill its memory.
        rows = rows.repartition(number, "range")
    return rows.withColumn("nth", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))


def uniform(bits: Column, shift: int, width: int) -> Column:
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("double") + 0.5) / float(1 << width)


def with_draws(rows: DataFrame) -> DataFrame:
    """What a word has in each position, whatever its weight: r, ln c - r, b and bits of its own."""
    first, second = F.col("first"), F.col("second")
    drawn = rows.withColumn("first", F.xxhash64("h", "k")).withColumn("second", F.xxhash64("first"))
    r = -F.log(uniform(first, 0, 31) * uniform(first, 32, 31))
    return drawn.select(
        *rows.columns, "first", r.alias("r"), F.log(-F.log(uniform(second, 0, 22) * uniform(second, 22, 22))).alias("log_c"),
        uniform(second, 44, 20).alias("b"),
    )


def sample_of(log_weight: Column) -> Column:
    """One word's packed sample for the logarithm of its weight; null for no weight."""
    t = F.floor(log_weight / F.col("r") + F.col("b"))
    log_a = F.col("log_c") - F.col("r") * (t - F.col("b") + 1)
    # The tag follows from word, position and t; the factor is odd, so different t differ in it.
    tag = F.col("first").bitwiseXOR(t * F.lit(0x5BD1E995)).bitwiseAND(F.lit((1 << TAG) - 1))
    return F.shiftleft(((log_a + SHIFT) * SCALE).cast("bigint"), TAG) + tag


def fingerprints(rows: DataFrame, texts: dict[str, Column], facts: dict[str, Column], samples: int = SAMPLES) -> DataFrame:
    """(range, nth, `facts`, one array of samples for each of `texts`) for all rows; null for a text without words.

    The rows must be partitioned by `range`; then nothing here shuffles. What is to be known of a row beside
    its samples goes along as one more row of its words, without a word, so that the texts are read once.
    """
    names = list(texts)
    fact = F.struct(*[c.alias(n) for n, c in facts.items()])
    kind = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in rows.select(fact.alias("f")).schema["f"].dataType) + ">"
    # One kind of white space, so that a split needs no regular expression.
    plain = [F.translate(c, "\t\n\x0b\f\r", "     ") for c in texts.values()]
    parts = [F.struct(F.lit(k).alias("which"), c.alias("t"), F.lit(None).cast(kind).alias("fact")) for k, c in enumerate(plain)]
    own = F.struct(F.lit(-1).alias("which"), F.lit("").alias("t"), fact.alias("fact"))
    words = (
        rows.select("range", "nth", F.explode(F.array(*parts, own)).alias("v"))
        .select("range", "nth", "v.which", "v.fact", F.explode(F.split("v.t", " ")).alias("word"))
        .filter("word <> '' OR which < 0")
        .select("range", "nth", "fact", F.when(F.col("which") >= 0, F.xxhash64("word")).alias("h"), "which")
    )
    counts = words.groupBy("range", "nth", "h", "fact").agg(*[F.sum((F.col("which") == k).cast("int")).alias(f"w{k}") for k in range(len(names))])
    # The logarithm of a count is taken once, not in each position; of 0 it is null.
    logs = counts.select("range", "nth", "h", "fact", *[F.log(F.col(f"w{k}").cast("double")).alias(f"w{k}") for k in range(len(names))])
    places = F.when(F.col("h").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(samples - 1)))
    drawn = with_draws(logs.select("*", F.explode(places).alias("k")))
    least = drawn.groupBy("range", "nth", "k", "fact").agg(*[F.min(sample_of(F.col(f"w{n}"))).alias(name) for n, name in enumerate(names)])
    packed = least.groupBy("range", "nth").agg(F.array_sort(F.collect_list(F.struct("k", *names, "fact"))).alias("rows"))
    drawn_rows = F.slice("rows", 2, samples)
    return packed.select(
        "range", "nth", *[F.col("rows")[0]["fact"][n].alias(n) for n in facts],
        *[F.when(F.get("rows", F.lit(1))[name].isNotNull(), drawn_rows[name]).alias(name) for name in names],
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of samples in which two fingerprints agree; texts without words agree with each other."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda s: s)) / F.size(a)
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(same)


def as_text(samples: Column, number: int = SAMPLES) -> Column:
    """Six hexadecimal digits for each sample; zeros for a text without words."""
    digits = F.transform(samples, lambda s: F.lower(F.lpad(F.hex(F.xxhash64(s).bitwiseAND(F.lit((1 << 24) - 1))), 6, "0")))
    return F.coalesce(F.array_join(digits, ""), F.lit("0" * 6 * number))


def edited(text: Column, after: Column) -> Column:
    """`text` with its last quarter replaced by as many first characters of `after` (or all)."""
    size = F.char_length(text)
    cut = F.floor(size / 4).cast("int")
    return F.concat(F.left(text, size - cut), F.left(F.coalesce(after, F.lit("")), cut))


def digest(docs: DataFrame, samples: int = SAMPLES, rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of each row's text and edited text, and their likeness to each other and the next."""
    ordered = with_next(docs, rows).withColumn("edited", edited(F.col("text"), F.col("next")))
    facts = {
        "extra": F.col("extra"), "doc_id": F.col("doc_id"), "n_chars": F.char_length("text").cast("bigint"),
        "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256),
    }
    prints = fingerprints(ordered, {"print": F.col("text"), "edited_print": F.col("edited")}, facts, samples)
    order = Window.partitionBy("range").orderBy("nth")
    return (
        prints
        .withColumn("next_print", F.lead("print").over(order))
        .filter("extra = 0")
        .select(
            "doc_id", "n_chars", "edited_sha256", as_text(F.col("print"), samples).alias("fingerprint"), as_text(F.col("edited_print"), samples).alias("edited_fingerprint"),
            likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        )
    )
