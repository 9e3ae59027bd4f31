import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quillgauge.operators import code
from quillgauge.sources.changelog import parse_name_status, parse_numstat
from quillgauge.sources.exclusions import read_exclusions
from quillgauge.sources.layout import spread
from quillgauge.sources.report import render_report, write_report
from quillgauge.sources.tree import read_source_tree


@pytest.fixture(scope="module")
def tree():
    root = tempfile.mkdtemp(prefix="run-")
    texts = {"a.py": "x = 1\n", "__init__.py": "", ".hid/b.py": "y", "tests/t.py": "no", "deep/er/c.py": "z\r\n", "n.txt": "n"}
    for name, text in texts.items():
        path = os.path.join(root, "src", name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", newline="") as f:
            f.write(text)
    with open(os.path.join(root, "src", "bad.py"), "wb") as f:
        f.write(b"ok\xff")
    return root


@pytest.mark.parametrize("limits", [{}, {"folders": 1, "shards": 3}, {"folders": 3, "shards": 2}, {"per_task": 1}])
def test_tree_keeps_hidden_names_and_bad_bytes(spark, tree, limits):
    rows = read_source_tree(spark, tree, **limits).collect()
    got = {r["path"]: r["content"] for r in rows}
    assert len(rows) == len(got)
    expected = {"a.py": "x = 1\n", "__init__.py": "", ".hid/b.py": "y", "deep/er/c.py": "z\r\n", "bad.py": "ok�"}
    assert got == {f"src/{k}": x for k, x in expected.items()}


def test_tree_options(spark, tree):
    every = read_source_tree(spark, tree, subdir=None, ignore=[], glob="*").select("path").collect()
    assert len(every) == 7 and all(r["path"].startswith("src/") for r in every)
    assert read_source_tree(spark, tree, subdir="missing").count() == 0
    ordered = read_source_tree(spark, tree, project="me").orderBy("path").first()
    assert (ordered["project"], ordered["path"]) == ("me", "src/.hid/b.py")


def test_exclusions(spark, caplog):
    root = tempfile.mkdtemp(prefix="run-")

    def file(name, text):
        with open(os.path.join(root, name), "w") as f:
            f.write(text)
        return os.path.join(root, name)

    good = file("good.json", json.dumps({"cyclomatic": [["core/", "f"], ["x", "g"]], "cognitive": [["y", "h"]]}, indent=1))
    got = sorted(tuple(r) for r in read_exclusions(spark, good).collect())
    assert got == [("cognitive", "y", "h"), ("cyclomatic", "core/", "f"), ("cyclomatic", "x", "g")]
    part = file("part.json", json.dumps({"cognitive": [["y", "h"]]}))
    assert read_exclusions(spark, part).count() == 1
    assert read_exclusions(spark, os.path.join(root, "none.json")).count() == 0
    assert read_exclusions(spark, None).count() == 0
    assert read_exclusions(spark, file("bad.json", '{"cyclomatic": [[')).count() == 0
    assert "could not load exclusions" in caplog.text


def test_change_logs(spark):
    lines = ["1\t2\ta.py", "-\t-\tb.bin", "3\t\tc\td", "4\t5", "1\t1\t", "", "x\t1\te"]
    got = parse_numstat(spark.createDataFrame([(x,) for x in lines], "value STRING"))
    assert [tuple(r) for r in got.collect()] == [("a.py", 1, 2, False), ("b.bin", None, None, True), ("c\td", 3, 0, False), ("e", 0, 1, False)]
    lines = ["M\ta.py", "R100\told\tnew", "C75\told\tcopy", " D\t\tx ", "", "M"]
    got = parse_name_status(spark.createDataFrame([(x,) for x in lines], "value STRING"))
    assert [tuple(r) for r in got.collect()] == [("M", "a.py"), ("R100", "new"), ("C75", "copy"), ("D", "x")]


def test_reports(spark):
    files = spark.createDataFrame([("p", "b.py", "def f(x):\n    return x or 1\n"), ("p", "a.py", "a = 1\n")], "project STRING, path STRING, content STRING")
    line = lambda df, mode: [r["line"] for r in render_report(df, mode).orderBy("path").collect()]
    scores = code.cyclomatic(code.blocks(files))
    assert line(scores, "cc") == ["b.py:1 f (complexity=2)"]
    assert line(scores, "check") == ["  b.py:1 f (cyclomatic=2)"]
    assert line(code.raw_metrics(files), "raw")[0] == "a.py sloc=1 lloc=1 loc=1 comments=0 blank=0 multi=0"
    assert line(code.halstead(files), "halstead")[0] == "a.py volume=4.8 difficulty=0.5 effort=2.4 h1=1 h2=2 N1=1 N2=2"
    assert line(code.maintainability(files), "mi")[0].startswith("a.py mi=")
    with pytest.raises(ValueError):
        render_report(files, "other")
    out = os.path.join(tempfile.mkdtemp(prefix="run-"), "r")
    write_report(code.raw_metrics(files), "raw", out, "text")
    assert [r["value"][:4] for r in spark.read.text(out).collect()] == ["a.py", "b.py"]
    write_report(scores, "cc", out + "2")
    assert spark.read.parquet(out + "2").count() == 1


def test_spread_leaves_large_inputs_alone(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert "RoundRobin" in spread(df)._jdf.queryExecution().optimizedPlan().toString() or spread(df) is not df
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert spread(df) is df
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_functions_work_on_a_stream(spark, sf):
    """Column functions hold no state, so a streaming source can use them as they are."""
    from quillgauge.functions import text as t

    source = spark.read.parquet(f"{sf}/conversations.parquet")
    one = tempfile.mkdtemp(prefix="run-")
    source.write.mode("overwrite").parquet(one + "/in")
    stream = spark.readStream.schema(source.schema).parquet(one + "/in")
    done = stream.select(t.message_problem(t.normalize_message(F.col("text")), F.lit("r")).alias("problem"))
    query = done.writeStream.format("parquet").option("path", one + "/out").option("checkpointLocation", one + "/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.read.parquet(one + "/out").count() == source.count()


def test_tree_flat_and_deep_folders_are_listed_once(spark):
    from quillgauge.sources.tree import list_tree

    root = tempfile.mkdtemp(prefix="run-")
    flat = os.path.join(root, "src", "flat")
    os.makedirs(flat)
    for i in range(1200):
        with open(os.path.join(flat, f"m{i}.py"), "w") as f:
            f.write(f"x = {i}\n")
    deep = os.path.join(root, "src", *[f"d{k}" for k in range(15)])
    os.makedirs(deep)
    for k in range(16):
        with open(os.path.join(root, "src", *[f"d{j}" for j in range(k)], "leaf.py"), "w") as f:
            f.write(str(k))
    listing = list_tree(spark, os.path.join(root, "src"), "*.py", folders=2)
    rows = listing.select("folder", "path").collect()
    assert len(rows) == len({r["path"] for r in rows}) == 1216
    assert len({r["folder"] for r in rows}) == 17
    got = read_source_tree(spark, root, per_task=100)
    assert got.rdd.getNumPartitions() >= 12
    texts = {r["path"]: r["content"] for r in got.collect()}
    assert len(texts) == 1216 and texts["src/flat/m7.py"] == "x = 7\n" and texts["src/" + "/".join(f"d{j}" for j in range(15)) + "/leaf.py"] == "15"
