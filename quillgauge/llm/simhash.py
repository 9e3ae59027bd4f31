"""SimHash near-duplicates: BK-trees over shards of fingerprints.

A bit of a document's fingerprint is 1 if it is set in over half the hashes of its shingles.
Two fingerprints that differ in at most `radius` bits agree in at least one of radius + 1
blocks of bits, so every fingerprint joins one shard for each block, and each shard holds a
BK-tree: children are keyed by their Hamming distance to the parent, and a search follows only
edges whose key lies within the radius of the distance to the node. Shards stay where the
shuffle puts them and are searched by their own fingerprints alone; a broadcast of all trees
would grow with the corpus. A shard of more than SHARD_ROWS fingerprints is cut again by blocks
of its remaining bits, exactly, until it is small. Equal fingerprints are one node.

A tree gives the links that join what was apart, never all pairs of a group, so that classes
stay exact while rows stay in proportion to the documents.

Nulls and empty texts have fingerprint zero. Documents with a null id get the class of their
fingerprint like any other, but no class is named after them. Repeated rows stay repeated. An
empty table gives an empty result. Only doc_id and text are read; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgauge.llm.common import slices
from quillgauge.llm.connected import components
from quillgauge.operators.scale import broadcast_if_small, durable

BITS, SEED = 64, 42
SHARD_ROWS = 20_000
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit SimHash of the `words`-word shingles; A-Z count as a-z."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        tokens, words = [b" ".join(tokens)], 1
    size, ones = len(tokens) - words + 1, np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, size, CHUNK):
        piece = tokens[start : min(start + CHUNK, size) + words - 1]
        shingles = zip(*[piece[k:] for k in range(words)], strict=False)
        hashes = np.array([digest(b" ".join(s), SEED) for s in shingles], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > size, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is a signed 64-bit number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id BIGINT, fp BIGINT")


class BKTree:
    """Fingerprints of one shard; an edge is keyed by the distance to its parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.edges.append({})
        new, at = len(self.values) - 1, 0
        while new:
            distance = (value ^ self.values[at]).bit_count()
            if distance not in self.edges[at]:
                self.edges[at][distance] = new
                return
            at = self.edges[at][distance]

    def near(self, value: int, radius: int) -> list[int]:
        """Positions of all values within the radius, in order of insertion along a path."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius:
                found.append(at)
            for key, child in self.edges[at].items():
                if distance - radius <= key <= distance + radius:
                    todo.append(child)
        return found


class Classes:
    """Disjoint sets of positions."""

    def __init__(self) -> None:
        self.up: list[int] = []

    def add(self) -> None:
        self.up.append(len(self.up))

    def top(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def shard_links(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of the shards of one partition, whose rows come sorted by shard."""
    shard, tree, classes, mask = None, BKTree(), Classes(), (1 << BITS) - 1
    for batch in batches:
        left, right = [], []
        for part, fp, bits in zip(*[batch.column(c).to_pylist() for c in ("part", "fp", "mask")], strict=True):
            if (bits, part) != shard:
                shard, tree, classes = (bits, part), BKTree(), Classes()
            new = len(tree.values)
            classes.add()
            for hit in tree.near(fp & mask, radius):
                if classes.join(new, hit):
                    left.append(fp)
                    right.append(int(np.uint64(tree.values[hit]).astype(np.int64)))
            tree.add(fp & mask)
        yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


@lru_cache(maxsize=1 << 16)
def wider(mask: int, radius: int) -> tuple[int, ...]:
    """Masks that add one of radius + 1 blocks of the free bits to the bits of `mask` (signed)."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    made = [sum(1 << int(b) for b in piece) | mask % (1 << BITS) for piece in np.array_split(np.array(free), radius + 1)]
    return tuple(m - (1 << BITS) if m >> (BITS - 1) else m for m in dict.fromkeys(made))


def in_shards(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Each row once for every wider mask; its shard is the mask with the masked bits."""
    for batch in batches:
        masks, prints = [], []
        for mask, fp in zip(batch.column("mask").to_pylist(), batch.column("fp").to_pylist(), strict=True):
            for m in wider(mask, radius):
                masks.append(m)
                prints.append(fp)
        masks, prints = np.array(masks, np.int64), np.array(prints, np.int64)
        yield pa.RecordBatch.from_pydict({"mask": masks, "part": masks & prints, "fp": prints})


def linked(distinct: DataFrame, radius: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) that connect all fingerprints within the radius of each other."""

    def cut(rows: DataFrame) -> DataFrame:
        return rows.select("mask", "fp").mapInArrow(lambda b: in_shards(b, radius), "mask BIGINT, part BIGINT, fp BIGINT")

    rows, found = cut(distinct.select(F.lit(0).cast("bigint").alias("mask"), "fp")), None
    while True:
        # At most one shard in `shard_rows` rows can be that large; most corpora have none.
        hot = durable(rows.groupBy("mask", "part").agg(F.count("*").alias("n")).filter(F.col("n") > shard_rows).drop("n"))
        any_hot = bool(hot.limit(1).count())
        cold = rows.join(broadcast_if_small(hot), ["mask", "part"], "left_anti") if any_hot else rows
        made = (
            cold.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")
            .mapInArrow(lambda batches: shard_links(batches, radius), "a BIGINT, b BIGINT")
        )
        found = made if found is None else found.union(made)
        if not any_hot:
            return found
        rows = durable(cut(rows.join(broadcast_if_small(hot), ["mask", "part"], "left_semi")))


def near_groups(docs: DataFrame, words: int = 3, radius: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest id of the class."""
    prints = durable(fingerprints(docs, words))
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(linked(distinct, radius, shard_rows))
    classes = (
        distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "first", F.coalesce("label", "fp").alias("label"))
    )
    smallest = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    named = classes.join(smallest, "label").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
