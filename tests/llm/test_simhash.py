"""Fingerprints and classes against a direct calculation."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgauge.llm import neardup, simhash
from quillgauge.llm.connected import components
from quillgauge.llm.simhash import BKTree, fingerprint, linked, near_groups

TEXTS = [
    (1, "a b c d"), (2, "A B C D"), (3, ""), (4, None), (5, "one"), (6, "a b c d"), (6, "a b c d"), (None, "one"),
    (8, "x " * 70_000), (9, "Ä b\x0bc d e"), (10, " \t\n"), (None, "two words"),
]
SCHEMA = "doc_id BIGINT, text STRING, fp STRING, a INT, source STRING"


def plain(text, words=3):
    tokens = []
    for t in (text or "").translate({c: chr(c + 32) for c in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" "):
        if t:
            tokens.append(t)
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    value = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def classes_by_brute_force(ids, radius):
    top = {k: k for k in range(len(ids))}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for i in range(len(ids)):
        for j in range(i):
            if ((ids[i] ^ ids[j]) & (1 << 64) - 1).bit_count() <= radius:
                top[find(i)] = find(j)
    return [find(k) for k in range(len(ids))]


def test_fingerprints(spark):
    for _, text in TEXTS:
        assert fingerprint(text) == plain(text)
    jvm = spark.createDataFrame([("a b c",)], "t STRING").select(F.xxhash64("t")).first()[0]
    assert fingerprint("a b c") == jvm


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(5)]
    tree = BKTree()
    for v in values:
        tree.add(v)
    for v in values[::7]:
        for radius in (0, 2, 9):
            assert sorted(tree.near(v, radius)) == [k for k, w in enumerate(values) if (v ^ w).bit_count() <= radius]


def test_classes_match_brute_force_also_when_shards_are_cut(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(12)]
    values = {b ^ sum(1 << k for k in rng.sample(range(63), rng.randrange(4))) for b in base for _ in range(12)} | {0, 1, 3, 7, 15}
    values = sorted(values | set(rng.sample(range(1 << 18), 200)))
    df = spark.createDataFrame([(v,) for v in values], "fp BIGINT")
    want = classes_by_brute_force(values, 2)
    for rows in (20_000, 100):
        labels = {r["node"]: r["label"] for r in components(linked(df, 2, rows)).collect()}
        got = [labels.get(v, v) for v in values]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(900, 901), (901, 901)], "a BIGINT, b BIGINT")
    labels = {r["node"]: r["label"] for r in components(links).collect()}
    assert {labels[k] for k in range(201)} == {0} and labels[901] == labels[900] == 900 and len(labels) == 203


def test_edge_cases(spark):
    docs = spark.createDataFrame([(i, t, "x", 1, None) for i, t in TEXTS], SCHEMA)
    rows = near_groups(docs).collect()
    assert len(rows) == len(TEXTS)
    named = {(r["doc_id"], r["fp"]): r["component_id"] for r in rows}
    assert named[(2, plain("a b c d"))] == 1 and named[(6, plain("a b c d"))] == 1
    assert named[(4, 0)] == 3 and named[(10, 0)] == 3 and named[(None, plain("one"))] == 5
    assert named[(None, plain("two words"))] is None
    assert near_groups(docs.limit(0)).collect() == []


def test_query_against_brute_force(spark, sf):
    from quillgauge.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in QUERIES["op7_simhash"](spark, sf).collect()}
    assert rows.keys() == docs.keys()
    ids = sorted(docs)
    prints = [plain(docs[i]) for i in ids]
    tops = classes_by_brute_force(prints, 2)
    smallest = {}
    for i, t in zip(ids, tops):
        smallest[t] = min(i, smallest.get(t, i))
    for i, fp, t in zip(ids, prints, tops):
        assert int(rows[i]["fingerprint"], 16) == fp % (1 << 64) and len(rows[i]["fingerprint"]) == 16
        assert rows[i]["component_id"] == smallest[t]
    assert simhash.SEED == 42


def test_near_duplicate_shards_are_bits_of_fingerprints():
    rng = np.random.default_rng(2)
    hashes = [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(3)]
    bits, bands = neardup.shape_of(100, 0.8)
    prints = [neardup.long_simhash(h, -(-bits * bands // 64)) for h in (*hashes, hashes[0])]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3, 4]), "print": pa.array(prints, pa.binary())})
    rows = pa.Table.from_batches(list(neardup.in_shards([batch], bits, bands))).to_pylist()
    of = {d: [r["shard"] for r in rows if r["doc_id"] == d] for d in (1, 2, 3, 4)}
    flat = [int.from_bytes(p, "little") for p in prints]
    want = [(band << 40) + (flat[1] >> band * bits & (1 << bits) - 1) for band in range(bands)]
    assert of[2] == want and of[1] == of[4] and len(set(of[1]) & set(of[2])) < 3


def test_pairs_at_the_similarity_share_a_shard():
    assert (1 - neardup.agreement(0.8) ** 12) ** neardup.shape_of(1, 0.8)[1] <= 1e-4
    assert neardup.shape_of(50_000_000, 0.8)[0] > 12 and neardup.agreement(1.0) == 1
    rng = np.random.default_rng(6)
    for _ in range(40):
        every = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
        one, other = (np.frombuffer(neardup.long_simhash(np.unique(np.append(every[:400], every[a:b])), 12), np.uint64) for a, b in ((400, 450), (450, 500)))
        assert np.bitwise_count(one ^ other)[:4].sum() <= neardup.print_radius(0.8)


@pytest.mark.parametrize("rows", [1, 7, 500])
def test_links_of_a_shard_connect_what_is_near(monkeypatch, rows):
    rng = np.random.default_rng(rows)
    made = rng.integers(0, 1 << 63, (40, 4), dtype=np.uint64)
    prints = made[rng.integers(0, 40, 600)] ^ (np.uint64(1) << rng.integers(0, 64, (600, 4), dtype=np.uint64))
    shard = np.sort(rng.integers(0, 3, 600))
    shard[:60] = np.sort(rng.integers(-30, -5, 60))
    docs = rng.permutation(600)
    table = pa.table({"shard": shard, "doc_id": docs, **{f"p{k}": prints[:, k].view(np.int64) for k in range(4)}})
    got = pa.Table.from_batches(list(neardup.shard_links(table.to_batches(max_chunksize=rows), 9))).to_pylist()

    def classes(pairs):
        top = neardup.Classes()
        top.up = list(range(600))
        for a, b in pairs:
            top.join(a, b)
        return [top.top(k) for k in range(600)]

    near = [(a, b) for a in range(600) for b in range(a) if shard[a] == shard[b] and np.bitwise_count(prints[a] ^ prints[b]).sum() <= 9]
    assert classes([(docs[a], docs[b]) for a, b in near]) == classes([(r["a"], r["b"]) for r in got])
    assert len(got) == 600 - len(set(classes([(r["a"], r["b"]) for r in got])))


def test_short_pairs_at_the_similarity_are_all_found(spark):
    rng = np.random.default_rng(12)
    rows = []
    for k in range(2_500):
        words = [f"w{w}" for w in rng.integers(0, 10**9, 9)]
        rows += [(2 * k, " ".join(words[:8])), (2 * k + 1, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    for limit in (20_000, 25):
        got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs, shard_rows=limit).collect()}
        assert got == {i: i - i % 2 for i, _ in rows}


def test_least_shingles_of_a_pair_meet():
    rng = np.random.default_rng(13)
    for size in range(1, neardup.FEW + 1):
        for more in range(int(size / 0.8) - size + 1):
            every = rng.integers(0, 1 << 63, size + more, dtype=np.uint64)
            own = rng.integers(0, more + 1)
            one, other = np.unique(every[: size + own]), np.unique(np.append(every[:size], every[size + own :]))
            least = [neardup.least_shingles(s, 0.8) for s in (one, other)]
            assert len(np.intersect1d(*least)) and all(len(k) <= 0.2 * len(s) + 1 for k, s in zip(least, (one, other)))
    assert neardup.small_radius(0.8) > neardup.print_radius(0.8) and neardup.differing(4, 0, 1) == 0.1875


def test_shards_below_zero_take_the_wider_radius():
    prints = np.array([[0] * 4, [(1 << 12) - 1] * 4] * 2, np.uint64)
    table = pa.table({"shard": [-5, -5, 7, 7], "doc_id": [1, 2, 3, 4], **{f"p{k}": prints[:, k].view(np.int64) for k in range(4)}})
    got = [pa.Table.from_batches(list(neardup.shard_links(table.to_batches(), *radii))).to_pylist() for radii in ((47,), (47, 48), (48, 48))]
    assert got == [[], [{"a": 2, "b": 1}], [{"a": 2, "b": 1}, {"a": 4, "b": 3}]]


def test_many_links_are_thinned_and_connect_the_same(spark):
    from quillgauge.llm.connected import both_ways, thinned

    rng = np.random.default_rng(14)
    pairs = [(int(a), int(b)) for k in range(20) for a, b in 100 * k + rng.integers(0, 40, (600, 2))]
    links = spark.createDataFrame(pairs, "a BIGINT, b BIGINT")
    both = both_ways(links)
    fewer = thinned(both)
    assert 3 * both_ways(fewer).count() < both.count()
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {r["node"]: r["label"] for r in components(fewer).collect()}
    assert got == {n: n - n % 100 + min(m % 100 for p in pairs for m in p if m // 100 == n // 100) for p in pairs for n in p}
