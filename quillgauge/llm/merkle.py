"""Merkle manifest of a table, built by time-forward processing on Spark.

Time-forward processing evaluates a tree whose nodes are labelled in topological order: each node
sends its value, keyed by its parent's label, to an external priority queue, and a parent takes
its messages when its label comes up. Here the queue is Spark's sort-based shuffle: every level's
nodes emit (group, parent position, own position, digest); the shuffle delivers each parent's at
most FAN messages sorted by label, and the parent's digest is H of its children in order. Levels
shrink by FAN, so all levels together cost about one eighth more than the leaves.

The reversed sweep runs the same way downwards: each parent holds its run of children, and
delivers to each child (keyed by the child's label) the child's run and position followed by the
parent's own proof suffix. After the last level every leaf holds its full proof, leaf to root.

Leaf positions within a group come from one range-partitioned sort: the sorted rows are written
once (a lost executor cannot reorder them), each task's rows are counted per group, and prefix
sums of those counts (one row per task and group) give every row its rank. No group, however
large, is ranked by one task.

Defined results:
  * leaf = H(doc_id, source, lang, n_chars, text), each "-" if null, else its UTF-8 byte count,
    ":" and its value (integers in decimal); H is lowercase hex sha256 of the concatenation.
  * per lang (null is a lang of its own), leaves ascend by doc_id, nulls first; equal doc_ids by
    leaf. Repeated rows are leaves each. Subroots ascend by lang, null first, UTF-8 bytewise.
  * a lone leaf is its lang's subroot; one lang's subroot is the root; the proof of a single row
    is empty and proof_sha256 is H of the empty string.
  * tampering lower-cases A-Z of text where 3 divides crc32 of the decimal doc_id (null id or
    null text: unchanged). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgauge.operators.scale import durable

FAN = 8
LOW_BITS = 33  # monotonically_increasing_id: the task number above, the row within the task below

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PROOF = "array<struct<run:array<string>,idx:int>>"


def empty() -> Column:
    return F.array().cast(PROOF)


def H(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """'-' for null, else the UTF-8 byte count, ':' and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return H(F.concat(field(doc_id), field(source), field(lang), field(n_chars), field(text)))


def tampered(doc_id: Column, text: Column) -> Column:
    hit = (F.crc32(doc_id.cast("string").cast("binary")) % 3) == 0
    return F.when(hit, F.translate(text, UPPER, LOWER)).otherwise(text)


def positions(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """`df` with `pos`: 0-based rank within `group` by `order`, from one range-partitioned sort."""
    keys = [F.col(group).asc_nulls_first(), *order]
    ranked = durable(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                     .withColumn("__mid", F.monotonically_increasing_id()))
    ranked = (ranked.withColumn("__task", F.shiftright("__mid", LOW_BITS))
              .withColumn("__local", F.col("__mid").bitwiseAND(F.lit((1 << LOW_BITS) - 1))))
    counts = ranked.groupBy(group, "__task").agg(F.count("*").alias("__count"), F.min("__local").alias("__first"))
    before = Window.partitionBy(group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.coalesce(F.sum("__count").over(before), F.lit(0)))
    sizes = counts.groupBy(group).agg(F.sum("__count").alias("__n"))
    joined = ranked.join(offsets.select(group, "__task", "__offset", "__first"), ranked[group].eqNullSafe(offsets[group]) & (ranked["__task"] == offsets["__task"]))
    joined = joined.select(ranked["*"], "__offset", "__first")
    joined = joined.join(sizes, joined[group].eqNullSafe(sizes[group])).select(joined["*"], "__n")
    return joined.withColumn("pos", F.col("__offset") + F.col("__local") - F.col("__first")).drop("__mid", "__task", "__local", "__offset", "__first")


def _width(level: int) -> Column:
    """Nodes of a group at `level`: ceil(n / FAN^level), by integers."""
    span = FAN ** level
    return F.expr(f"(__n + {span - 1}) div {span}")


def tree(nodes: DataFrame, group: str, carry: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Levels of nodes (group, __n, pos, digest, children) and the tops (group, digest).

    `nodes` holds group, __n (the group's node count), pos and digest of the lowest level; the
    first parents also keep `members`: their children's pos, digest and `carry` columns.
    """
    levels = [nodes.withColumn("children", F.lit(None).cast("array<string>"))]
    tops = [levels[0].filter(_width(0) <= 1).select(group, "digest")]
    most = nodes.agg(F.max("__n")).first()[0] or 0
    level, width = 0, int(most)
    while width > 1:
        current = levels[-1].filter(_width(level) > 1)
        fields = ("pos", "digest", *carry) if level == 0 else ("pos", "digest")
        run = F.sort_array(F.collect_list(F.struct(*fields)))
        parents = current.groupBy(group, "__n", F.floor(F.col("pos") / FAN).alias("pos")).agg(run.alias("members"))
        parents = parents.withColumn("children", F.transform("members", lambda r: r["digest"]))
        if level > 0:
            parents = parents.drop("members")
        parents = durable(parents.withColumn("digest", H(F.array_join("children", ""))))
        level, width = level + 1, -(-width // FAN)
        levels.append(parents)
        tops.append(parents.filter(_width(level) <= 1).select(group, "digest"))
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    return levels, top


def _down(levels: list[DataFrame], group: str, top_proof: DataFrame, lowest: int) -> DataFrame | None:
    """Nodes of level `lowest` with `proof`: array of (run, idx) from their level up to the root.

    `top_proof` holds group and proof of each group's top node. Every level takes its proofs
    in one join: from its parents, or, for a group's top node, from `top_proof`.
    """
    carried = None
    tops = top_proof.select(F.col(group).alias("__g"), F.lit(-1).cast("long").alias("__ppos"),
                            F.lit(None).cast("array<string>").alias("__run"), F.col("proof").alias("__pproof"))
    for lvl in range(len(levels) - 1, lowest - 1, -1):
        nodes = levels[lvl].withColumn("__key", F.when(_width(lvl) <= 1, F.lit(-1)).otherwise(F.floor(F.col("pos") / FAN)).cast("long"))
        info = tops
        if carried is not None:
            info = carried.select(F.col(group).alias("__g"), F.col("pos").cast("long").alias("__ppos"),
                                  F.col("children").alias("__run"), F.col("proof").alias("__pproof")).unionByName(tops)
        here = nodes.join(info, nodes[group].eqNullSafe(info["__g"]) & (nodes["__key"] == info["__ppos"]), "left")
        step = F.array(F.struct(F.col("__run").alias("run"), (F.col("pos") % FAN).cast("int").alias("idx")))
        proof = F.when(F.col("__run").isNull(), F.col("__pproof")).otherwise(F.concat(step, F.col("__pproof")))
        here = here.select(*[c for c in levels[lvl].columns], proof.alias("proof"))
        carried = durable(here) if lvl > lowest else here
    return carried


# Subroots (one a lang) folded on the driver at most; more are folded by the same sweep on Spark.
TOP_ROWS = 100_000


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _top_on_driver(subroots: list[tuple[str | None, str]]) -> tuple[str, list[tuple[str | None, list[tuple[list[str], int]]]]]:
    """Root and each lang's proof above its subroot, for a bounded list of (lang, subroot)."""
    ordered = sorted(subroots, key=lambda r: (r[0] is not None, (r[0] or "").encode("utf-8")))
    levels = [[d for _, d in ordered]]
    while len(levels[-1]) > 1:
        nodes = levels[-1]
        levels.append([_sha("".join(nodes[i:i + FAN])) for i in range(0, len(nodes), FAN)])
    proofs = []
    for i, (lang, _) in enumerate(ordered):
        proof, at = [], i
        for nodes in levels[:-1]:
            start = at // FAN * FAN
            proof.append((nodes[start:start + FAN], at % FAN))
            at //= FAN
        proofs.append((lang, proof))
    return levels[-1][0], proofs


def _top(spark, subroots: DataFrame) -> tuple[str, DataFrame, bool]:
    """Root, each lang's proof above its subroot, and whether that table is small."""
    if subroots.count() <= TOP_ROWS:
        root, proofs = _top_on_driver([(r["lang"], r["digest"]) for r in subroots.collect()])
        return root, spark.createDataFrame(proofs, f"lang STRING, proof {PROOF}"), True
    top_nodes = positions(subroots.withColumn("__top", F.lit(0)), "__top", [F.col("lang").asc_nulls_first()])
    top_levels, root = tree(top_nodes.select("__top", "__n", "pos", "digest"), "__top")
    bottom = _down(top_levels, "__top", root.select("__top", empty().alias("proof")), 0)
    proofs = bottom.join(top_nodes.select("__top", "pos", "lang"), ["__top", "pos"]).select("lang", "proof")
    return root.first()["digest"], proofs, False


def _outputs(rows: DataFrame, root: str) -> DataFrame:
    proof = F.col("proof")
    siblings = F.flatten(F.transform(proof, lambda p: F.filter(p["run"], lambda _, i: i != p["idx"])))
    folded = F.aggregate(proof, F.col("tampered"),
                         lambda acc, p: H(F.array_join(F.transform(p["run"], lambda dg, i: F.when(i == p["idx"], acc).otherwise(dg)), "")))
    return rows.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"),
        H(F.array_join(siblings, "")).alias("proof_sha256"), folded.alias("folded_root"),
        (folded == F.lit(root)).alias("verified"), "lang")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and the lang of each row."""
    spark = docs.sparkSession
    schema = "doc_id LONG, leaf STRING, subroot STRING, root STRING, proof_sha256 STRING, folded_root STRING, verified BOOLEAN, lang STRING"
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                    F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"),
                    F.col("text").cast("string").alias("text"))
    d = d.select("doc_id", "lang", leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("digest"),
                 leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), tampered(F.col("doc_id"), F.col("text"))).alias("tampered"))
    if d.limit(1).count() == 0:
        return spark.createDataFrame([], schema)
    leaves = positions(d, "lang", [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()])
    levels, subroots = tree(leaves.select("lang", "__n", "pos", "digest", "tampered", "doc_id"), "lang", ("tampered", "doc_id"))
    subroots = durable(subroots)
    root, top_proof, small = _top(spark, subroots)
    side = F.broadcast if small else (lambda df: df)
    top_proof = side(top_proof)
    sub = side(subroots.select(F.col("lang").alias("__sl"), F.col("digest").alias("subroot")))
    # A lang of one row: its leaf is its subroot, its proof is the one above the subroot.
    alone = leaves.filter(F.col("__n") == 1).select("doc_id", "lang", "digest", "tampered")
    alone = alone.join(top_proof.withColumnRenamed("lang", "__g"), F.col("lang").eqNullSafe(F.col("__g"))).drop("__g")
    rows = alone
    if len(levels) > 1:
        firsts = _down(levels, "lang", top_proof, 1)
        members = firsts.select("lang", "children", "proof", F.explode("members").alias("m"))
        step = F.array(F.struct(F.col("children").alias("run"), (F.col("m.pos") % FAN).cast("int").alias("idx")))
        rows = members.select(F.col("m.doc_id").alias("doc_id"), "lang", F.col("m.digest").alias("digest"),
                              F.col("m.tampered").alias("tampered"), F.concat(step, "proof").alias("proof")).unionByName(alone)
    rows = rows.join(sub, F.col("lang").eqNullSafe(F.col("__sl")))
    return _outputs(rows, root)
