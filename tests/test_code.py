"""Code operators against Python's own parser, hand-made files and invariants."""

import ast
import glob
import io
import keyword
import math
import tokenize

from pyspark.sql import functions as F

from quillgauge.functions import fixed as v
from quillgauge.operators import code, gate

ROOT = __file__.rsplit("/tests/", 1)[0]

SAMPLE = '''\
"""Module text
with if and a ( bracket
"""
import os
from a import (  # note
    b,

    c,
)
LIMIT: int = 3
A = [
    1,
]
A += [2]
if x: y = 1

@deco(
    1
)
@other
class K(Base):
    """Doc."""
    kind = "if a and b"
    def __init__(self, a):
        self.a = a
        self.b == 3
        if a and b or c and d:
            self.c = 1

    @property
    async def p(self): return 1 if self.a else 2

    def m(
        self,
        z=")",
    ):
        for i in z:
            while i and j:
                if k:
                    pass
                elif l:
                    pass
            """text
at column 0 while
"""
        def inner():
            assert z
            try:
                pass
            except E:
                return \\
0
        return inner
# trailing comment

def after(): x = 1; y = """a
b""".strip(); return y
'''


def files(spark, *texts):
    return spark.createDataFrame([("p", f"f{i}.py", x) for i, x in enumerate(texts)], "project STRING, path STRING, content STRING")


def rows(df):
    return [r.asDict() for r in df.collect()]


def parsed_blocks(source):
    """(name, line, start, end, parent line) of every block, from Python's parser."""
    found = []

    def visit(node, parent):
        for child in ast.iter_child_nodes(node):
            inner = parent
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                start = min([d.lineno for d in child.decorator_list] + [child.lineno])
                found.append((child.name, child.lineno, start, child.end_lineno, parent))
                inner = child.lineno
            visit(child, inner)

    visit(ast.parse(source), None)
    return sorted(found, key=lambda x: x[1])


def decision_lines(source):
    """Line numbers of decision words outside strings, from Python's tokenizer."""
    found, formatted = [], 0
    for t in tokenize.generate_tokens(io.StringIO(source).readline):
        formatted += (t.type == tokenize.FSTRING_START) - (t.type == tokenize.FSTRING_END)
        if not formatted and t.type == tokenize.NAME and t.string in v.DECISION_WORDS:
            found.append(t.start[0])
    return found


def corpus():
    paths = sorted(glob.glob(f"{ROOT}/quillgauge/**/*.py", recursive=True) + glob.glob(f"{ROOT}/tests/*.py"))
    texts = [open(p, encoding="utf-8").read() for p in paths]
    # Nested f-strings and adjacent quotes are tokens of their own in the parser.
    return [x for x in texts if not any(m in x for m in ('f"""', "f'''"))] + [SAMPLE]


def test_blocks_match_the_parser(spark):
    texts = corpus()
    got = rows(code.blocks(files(spark, *texts)))
    assert len(texts) > 5
    for i, source in enumerate(texts):
        mine = sorted(
            (b["name"], b["block_line"], b["start_line"], b["end_line"], b["parent_line"])
            for b in got if b["path"] == f"f{i}.py"
        )
        assert sorted(mine, key=lambda x: x[1]) == parsed_blocks(source), i


def test_scores_match_a_token_count(spark):
    texts = corpus()
    got = rows(code.blocks(files(spark, *texts)))
    for i, source in enumerate(texts):
        lines, blocks = decision_lines(source), parsed_blocks(source)
        for b in (x for x in got if x["path"] == f"f{i}.py"):
            spans = [(p[1], p[3]) for p in blocks if b["block_line"] < p[1] <= b["end_line"]]
            inside = [n for n in lines if b["block_line"] <= n <= b["end_line"]]
            own = 1 + sum(not any(s <= n <= e for s, e in spans) for n in inside)
            total = 1 + len(inside) + len(spans)
            assert (b["own"], b["total"]) == (own, total - own if b["kind"] == "class" else total), (i, b)


def test_cognitive_by_hand(spark):
    scores = {b["name"]: b["cognitive"] for b in rows(code.blocks(files(spark, SAMPLE)))}
    # for 1 + while 2 (one run: 1) + if 3 + except 1; `elif`, `assert` and `try` cost nothing.
    assert scores["m"] == 1 + 2 + 1 + 3 + 1
    assert scores["__init__"] == 1 + 3  # one control line; runs: and, or, and
    assert scores["inner"] == 1 and scores["p"] == 0


def test_nesting_counts_from_the_function(spark):
    source = "if a:\n    def f():\n        if b:\n            if c:\n                pass\n        if d: pass\n"
    (block,) = rows(code.blocks(files(spark, source)))
    assert block["cognitive"] == 1 + 2 + 1


def test_raw_counts(spark):
    (m,) = rows(code.raw_metrics(files(spark, SAMPLE)))
    lines = SAMPLE.splitlines()
    assert m["loc"] == len(lines) and m["blank"] == sum(not x.strip() for x in lines)
    assert m["comment_only"] == 1 and m["comments"] == 2
    assert m["multi"] == 3 + 1 + 3
    assert m["sloc"] + m["comment_only"] + m["blank"] + m["multi"] == m["loc"]


def test_raw_parts_sum_to_loc(spark):
    texts = ["", "\n", "a", "a\r\nb\r", "#x\n\n  # y\nz = '#'\n", '"""\n\n"""\n', "'''a''' + b\n", "x\x0cy\n", "(\n#c\n)\n;"]
    got = rows(code.raw_metrics(files(spark, *texts)).orderBy("path"))
    for m, text in zip(got, texts, strict=True):
        assert m["loc"] == len(text.splitlines())
        assert m["sloc"] + m["comment_only"] + m["blank"] + m["multi"] == m["loc"]


def test_lines_and_tokens(spark):
    text = "a = 'if # x'  # c\n\n'''t\nu'''\n"
    got = rows(code.lines(files(spark, text)))
    assert [(r["line_no"], r["code"], r["is_blank"], r["is_comment"], r["is_multi"]) for r in got] == [
        (1, 'a = ""  #', False, False, False), (2, "", True, False, False), (3, "\x01", False, False, True), (4, "\x01", False, False, True)]
    toks = rows(code.tokens(files(spark, text), ["path"]).orderBy("pos"))
    assert [(x["token"], x["is_operand"]) for x in toks] == [("a", True), ("=", False), ("'if # x'", True), ("'''t\nu'''", True)]


def test_halstead_by_hand(spark):
    got = rows(code.halstead(files(spark, "a = b + a\nif a: pass\n", "")).orderBy("path"))
    # operators = + if : pass; operands a b, four in all
    assert [got[0][k] for k in ("h1", "h2", "N1", "N2")] == [5, 2, 5, 4]
    assert math.isclose(got[0]["volume"], 9 * math.log2(7)) and got[0]["difficulty"] == 5.0
    assert math.isclose(got[0]["effort"], got[0]["volume"] * 5)
    assert [got[1][k] for k in ("h1", "volume", "difficulty", "effort")] == [0, 0, 0, 0]
    assert set(v.KEYWORDS) == set(keyword.kwlist)


def test_maintainability(spark):
    got = rows(code.maintainability(files(spark, "", "a = 1\n# c\n", '"""\nx\n"""\na = 1\n')).orderBy("path"))
    plain = rows(code.maintainability(files(spark, '"""\nx\n"""\na = 1\n'), count_multi=False))
    assert got[0]["mi"] == 100.0 and 0 <= got[1]["mi"] <= 100
    assert got[2]["mi"] >= plain[0]["mi"]


def test_statements_and_caps(spark):
    def listed(op, text, **kw):
        return [r["raw"] for r in rows(op(files(spark, text), **kw).orderBy("pos"))]

    assert listed(code.imports, SAMPLE) == ["import os", "from a import (  # note", "    b,", "", "    c,", ")"]
    assert listed(code.constants, SAMPLE) == ["LIMIT: int = 3", "A = [", "    1,", "]"]
    many = "".join(f"import m{i}\n" for i in range(100)) + "BIG = [\n" + "  1,\n" * 500 + "]\n"
    assert len(listed(code.imports, many)) == 80 and len(listed(code.constants, many)) == 20
    assert listed(code.imports, many, limit=2) == ["import m0", "import m1"]
    assert listed(code.init_attributes, SAMPLE) == ["    def __init__(self, a):", "        self.a = a", "            self.c = 1"]


def test_context_of_a_method(spark):
    (hit,) = [r for r in rows(code.targets(files(spark, SAMPLE), 5)) if r["name"] == "m" and r["metric"] == "cyclomatic"]
    context = hit["context"]
    assert context.startswith(v.CONTEXT_TITLE + "\n\n## Imports\n```python\nimport os\n")
    assert "\n\n## Class context\nclass K(Base):\n\n### __init__ attributes\n    def __init__(self, a):\n" in context
    assert "### Other methods in the class\n    def __init__(self, a): ...\n    @property\n    async def p(self): return 1 if self.a else 2 ...\n\n## Module constants" in context
    lines = SAMPLE.splitlines(keepends=True)
    assert hit["source"] == "".join(lines[hit["start_line"] - 1 : hit["end_line"]])


def test_joins_agree_with_in_row_results(spark):
    df = files(spark, SAMPLE)
    blocks = code.blocks(df)
    found, missed = gate.locate(gate.over_limit(code.cyclomatic(blocks), 0), blocks)
    assert {r["name"] for r in rows(missed)} == {"K"}
    text = rows(gate.block_lines(found.filter("name = 'm'"), code.lines(df)).orderBy("line_no"))
    (target,) = [r for r in rows(code.targets(df, 5)) if r["name"] == "m" and r["metric"] == "cyclomatic"]
    assert "".join(r["raw"] + "\n" for r in text) == target["source"]
    sib = rows(gate.siblings(blocks, 1))
    assert {(r["name"], r["sibling"]) for r in sib} == {("__init__", "p"), ("p", "__init__"), ("m", "__init__")}
    classes = {r["name"]: r["class_name"] for r in rows(gate.with_class(blocks))}
    assert classes == {"__init__": "K", "p": "K", "m": "K", "inner": None, "after": None}


def test_closures_and_kinds(spark):
    blocks = code.blocks(files(spark, SAMPLE))
    assert "inner" not in {r["name"] for r in rows(code.cyclomatic(blocks))}
    assert {r["name"] for r in rows(code.cognitive(blocks))} == {"__init__", "m", "inner", "after"}
    assert "p" in {r["name"] for r in rows(code.cognitive(blocks, ("def", "async")))}


def test_large_file(spark):
    """A long generated file: one row, scanned in one pass."""
    text = "".join(f"def f{i}(x):\n    if x and {i}:\n        return [\n            1,\n        ]\n\n" for i in range(4000))
    got = code.blocks(files(spark, text)).agg(F.count("*"), F.sum("total"), F.max("end_line")).first()
    assert tuple(got) == (4000, 12000, 6 * 4000 - 1)


WRONG = {
    "def f(x]:\n  pass": "brackets do not close", "x = (1": "brackets do not close", ")(": "brackets do not close", "Sorry, no.": "not a statement",
    "I am 5 years": "not a statement", "Done.": "not a statement", "if x\n    y": "a header has no colon", 'x = "abc': "a quote is not closed",
    "for a in b:\n    c\n  d": "an indent fits no open block", "class A:\n": "a block is not indented", "x = 1\n  y = 2": "a line is indented without a block",
}
RIGHT = ["    def f(self):\n        return x\n", "match x:\n    case 1:\n        pass", "x = [\n  1,\n]\nprint(x if y else z)", 'class A:\n    """Text."""\n', ""]


def test_syntax_problems(spark):
    import pathlib

    from quillgauge.functions import code as columns

    own = [(str(p), p.read_text()) for p in pathlib.Path(__file__).parents[1].glob("quillgauge/**/*.py")]
    data = [("p", path, text) for path, text in [*own, *[(f"r{k}", x) for k, x in enumerate(RIGHT)], *[(x, x) for x in WRONG]]]
    found = code.with_blocks(spark.createDataFrame(data, "project STRING, path STRING, content STRING"))
    got = {r["path"]: r["problem"] for r in found.select("path", columns.syntax_problem(F.col("facts")).alias("problem")).collect()}
    assert {k: got[k] for k in WRONG} == WRONG
    assert {p: k for p, k in got.items() if p not in WRONG and k} == {}


def test_in_row_forms_equal_the_joins(spark):
    text = "class A:\n    def m(self):\n        return 1\n    @d\n    def n(self):\n        def q():\n            pass\ndef f():\n    pass\n"
    files = spark.createDataFrame([("p", "a.py", text), ("p", "b.py", "")], "project STRING, path STRING, content STRING")
    found = code.blocks(files)

    def listed(df):
        return sorted(str(tuple(r)) for r in df.collect())

    functions = found.filter("kind IN ('def', 'async')")
    assert listed(gate.block_lines(functions, code.lines(files)).select("name", "block_line", "line_no", "raw")) == listed(
        code.lines_of_blocks(files, lambda b: b["kind"].isin("def", "async")).select("name", "block_line", "line_no", "raw"))
    both = code.functions_in_classes(files, 3)
    assert listed(gate.with_class(found).select("name", "block_line", "class_name")) == listed(both.select("name", "block_line", "class_name"))
    assert listed(gate.siblings(found, 3).select("name", "block_line", "sibling_line", "sibling")) == listed(
        both.select("name", "block_line", F.inline(F.transform("siblings", lambda s: s))))
