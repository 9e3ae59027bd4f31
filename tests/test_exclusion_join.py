"""The gram join of exclusions against a plain check of every pair."""

from pyspark.sql import functions as F

from quillgauge.operators import gate

VIOLATION = "project STRING, path STRING, name STRING, block_line INT, metric STRING, value INT"


def _plain(violations, exclusions):
    kept = []
    for v in violations:
        full = f"{v[0]}/{v[1].replace(chr(92), '/')}"
        if not any(m == v[4] and b == v[2] and p is not None and p in full for m, p, b in exclusions):
            kept.append(v)
    return sorted(kept)


def test_gram_join_equals_every_pair(spark):
    violations = [("p", f"pkg\\mod{i}.py", f"f{i % 3}", i, ["cyclomatic", "cognitive"][i % 2], 20) for i in range(300)]
    violations += [("p", "a/b.py", None, 1, "cyclomatic", 30), ("q", "x.py", "f0", 2, None, 30), ("p", "mod7.py", "f1", 7, "cognitive", 12)]
    exclusions = [("cyclomatic", f"mod{i}.py", "f0") for i in range(0, 300, 3)]
    exclusions += [("cognitive", "od1", "f1"), ("cyclomatic", "", "f2"), ("cognitive", None, "f0"), ("cognitive", "pkg/mod2", "f2"),
                   ("cyclomatic", "mod3.py", "f0"), ("cyclomatic", "mod3.py", "f0"), ("cognitive", "p/pkg", "f1")]
    v = spark.createDataFrame(violations, VIOLATION)
    x = spark.createDataFrame(exclusions, "metric STRING, part STRING, block STRING")
    got = sorted(tuple(r) for r in gate.drop_excluded(v, x).collect())
    assert got == _plain(violations, exclusions)


def test_a_common_key_pairs_only_what_may_match(spark):
    # All 2,000 listed parts share one (metric, name) key with all 2,000 paths.
    violations = [("p", f"src/mod{i}.py", "f2", i, "cyclomatic", 20) for i in range(2000)]
    exclusions = [("cyclomatic", f"mod{i}.py", "f2") for i in range(0, 4000, 2)]
    v = spark.createDataFrame(violations, VIOLATION)
    x = spark.createDataFrame(exclusions, "metric STRING, part STRING, block STRING")
    pairs = gate.exclusion_candidates(v, x).count()
    assert pairs < 4 * len(violations)
    assert gate.drop_excluded(v, x).count() == len(_plain(violations, exclusions))
