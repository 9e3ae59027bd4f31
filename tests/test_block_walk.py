"""The block scan walks the blanked text alone; what it is not asked for is not computed."""

from quillgauge.catalog import inputs
from quillgauge.catalog import queries as q
from quillgauge.operators import code, gate

TEXT = '''\
@deco
def f(x):
    if x and y or x:
        def g():
            return 1 if a and b else 2
    z = """doc

    tail if
    """
    return (x,
y) if x else \\

class K:
    def m(self): assert x
'''


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_of_odd_text(spark):
    rows = [("p", "a", TEXT), ("p", "b", None), ("p", "c", ""), ("p", "d", "def f():\n    pass \\\n\n\n")]
    files = spark.createDataFrame(rows, "project STRING, path STRING, content STRING")
    found = {r.path: r.blocks for r in code.with_blocks(files).select("path", "blocks").collect()}
    assert found["b"] is None and found["c"] == []
    assert [(*b,) for b in found["d"]] == [(1, 1, 2, "f", "def", None, None, 1, 1, 0)]
    assert [(*b,) for b in found["a"]] == [
        (2, 1, 11, "f", "def", None, None, 5, 8, 4),
        (4, 4, 5, "g", "def", 2, "def", 3, 3, 1),
        (13, 13, 14, "K", "class", None, None, 1, 2, 0),
        (14, 14, 14, "m", "def", 13, "class", 2, 2, 0),
    ]


def test_blocks_need_no_line_facts(spark, sf):
    assert "raw" not in plan(code.with_blocks(inputs.files(spark, sf)).select("path", "blocks")).replace("draw", "")


def test_reindent_copies_no_file_per_function(spark, sf):
    generate = next(x for x in plan(q.q_reindent(spark, sf)).splitlines() if "Generate" in x)
    assert "split(content" in generate  # the lines are cut in the generator, not passed along beside it


def test_quarantine_reads_the_lines_of_a_file_once(spark, sf):
    assert plan(q.q_quarantine_files(spark, sf)).count("regexp_extract_all(") <= plan(
        gate.tag_parsable(q.broken_files(spark, sf))).count("regexp_extract_all(")
