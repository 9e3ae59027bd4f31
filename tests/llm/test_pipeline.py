"""The stages one after the other, each held against a plain version of what it decides."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from quillgauge.llm import quality
from quillgauge.llm.common import table

SECRET = re.compile(r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{6,})|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", re.I | re.A)


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()


def test_stages(spark, sf, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    start = table(spark, sf, "documents")
    docs, kept = start, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        if number < 4:
            assert docs.dtypes == start.dtypes
        kept.append({r["doc_id"]: r for r in docs.collect()})
    good, single, clean, masked, _ = kept

    model = quality.fit(start, table(spark, sf, "labels"), "quality")
    scores = {r["doc_id"]: r["score"] for r in quality.score(start, model).collect()}
    assert set(good) == {i for i, s in scores.items() if s >= 0.3}

    sets = {i: shingles(r["text"]) for i, r in good.items()}
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) and a & b
    dropped = set(good) - set(single)
    assert all(not near(sets[i], sets[j]) for i in single for j in single if i < j)
    assert all(any(i != j and near(sets[i], sets[j]) for j in good) for i in dropped)

    items = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in table(spark, sf, "benchmark").collect()]
    words = {i: " ".join(re.findall(r"\w+", (r["text"] or "").lower())) for i, r in single.items()}
    leaky = {i for i, w in words.items() if any(f" {item} " in f" {w} " for item in items)}
    assert not leaky & set(clean) and len(set(single) - set(clean) - leaky) <= 2

    assert set(masked) == set(clean)
    for i, row in masked.items():
        text = clean[i]["text"] or ""
        if not SECRET.search(text):
            assert (row["text"], row["n_chars"]) == (clean[i]["text"], clean[i]["n_chars"])
        else:
            assert "[secret]" in row["text"] and not re.search("[0-9a-f]{24,}", row["text"]) and row["n_chars"] == len(row["text"])

    taken = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("last")).collect()
    assert {r["doc_id"] for r in taken} <= set(masked) and all(1 <= r["n"] == r["last"] <= 2 for r in taken)
    size = {i: len(re.findall(r"[^ \t-\r]+", r["text"] or "")) for i, r in masked.items()}
    assert abs(sum(r["n"] * size[r["doc_id"]] for r in taken) - 1.5 * sum(size.values())) < 0.1 * sum(size.values())


def test_run_is_the_last_stage(spark, sf):
    found = corpus_pipeline.run(spark, sf)
    assert found.columns[-1] == "copy" and found.count() > 0


def test_empty_tables(spark, sf):
    empty = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, sf).count() == 0


def test_clashing_columns_are_kept_and_nothing_crashes(spark, sf, edge):
    rows = edge.withColumn("copy", F.lit("mine")).withColumn("copies", F.lit(7)).withColumn("target", F.lit("t"))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, sf)
        got = out.collect()
        if number < 4:
            assert out.columns == rows.columns
        else:
            assert out.columns == [*rows.columns, "_copy"]
        assert all((r["score"], r["size"], r["copy"], r["copies"], r["target"]) == (0.5, "x", "mine", 7, "t") for r in got)


def test_quality_stage_on_an_empty_table(spark, sf):
    empty = table(spark, sf, "documents").limit(0)
    assert corpus_pipeline.STAGES[0][1](spark, empty, sf).count() == 0
