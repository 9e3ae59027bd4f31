"""The token recogniser against Python's own parser, and rewrites judged with it."""

import ast
import glob
import os
import sys

from pyspark.sql import functions as F

from quillgauge.functions import grammar
from quillgauge.operators import gate

ROOT = __file__.rsplit("/tests/", 1)[0]

# Wrong answers a model may give, each refused by Python's parser.
WRONG = [
    "x = = 1", "return return", "else:\n    pass", "def :\n    pass", "def f(x) return x:\n    pass", "1 = x", "x = (1,,2)", "x = *",
    "return x +", "> quoted", "f(x +)", "a b", "print 'x'", "x = [1 2]", "def f(x):\n    return x x", "try\n    pass", "class A(B)\n    pass",
    "x.1", "lambda x 1", "while:\n    pass", "x = 1 2", "f(a,, b)", "x += += 1", "a.  = 3", "d = {1: }", "s = 'a' 'b' c", "x = 5 not 3",
    "pass x", "break 1", "def f(x)\n    pass", "elif x:\n    pass", "except:\n    pass", '"a" = 1', "x + 1 = 2", "return ,", "if x == :\n    pass",
    "for in y:\n    pass", "x = lambda: ", "import os as", "x = {1, 2,, 3}", "import", "from a import",
]
RIGHT = [
    "def f(x):\n    return x", "    def m(self, a, *, b=1, **kw) -> int:\n        return a[1:2] + b[::2]\n", "x = [\n  1,\n]\nprint(x if y else z)",
    "match x:\n    case 1:\n        pass", "async def f():\n    async with a as b:\n        await b\n    return [i async for i in c]",
    "try:\n    pass\nexcept (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass", "x: int = 5\ny: list[int] | None = None",
    "a, *b = c\n(d, e) = f\ng[1], h.i = 1, 2", "lambda: 0\nf = lambda x=1, *a: x\nsorted(k, key=lambda v: v[0])", "if (n := len(a)) > 10: print(n)",
    "from . import x\nfrom .a import (b,\n c)\nimport os.path as p\nglobal q", "x = yield\ny = yield from g()",
    "def f(a, /, b):\n    return a not in b and a is not None", "@dec(1)\nclass A(B, metaclass=M):\n    '''doc'''\n    x = 1; y = 2",
    "s = f'{x!r:>10}' 'b'\nu = rb'c'\nt = 0x1F + 1e-3 + .5 + 1_000j", "for i, (a, b) in enumerate(z):\n    continue\nelse:\n    pass", "x[:, 1] = y[1:, ::2]",
    "x = {**a, 'b': [*c, *d]}\nprint(*args, **kw)", "if a:\n    pass\nelif b:\n    pass\nelse:\n    pass", "del a[0], b.c\nassert x, 'm'",
    "type(x)\nmatch = 1\nx = a not in b", "x = (1,)\nreturn", "def f():\n    return 1,", "with open(p) as f, open(q) as g:\n    pass", "",
    'x = f"{d["a b"]}" + f\'{g(e, \'k\', repr)}\'', "name, = args\nx, = {p for p in q}", "class A[T](B):\n    def f[U](self, x: U) -> T:\n        pass",
]


def problems(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text STRING").withColumn("tk", grammar.tokens(F.col("text")))
    return {r["text"]: r["p"] for r in df.select("text", grammar.token_problem("tk").alias("p")).collect()}


def test_the_parser_agrees_with_the_lists():
    for text in WRONG:
        try:
            ast.parse(text)
        except SyntaxError:
            continue
        raise AssertionError(f"parsable: {text!r}")
    for text in RIGHT:
        ast.parse(text.replace("    def m", "def m", 1) if text.startswith("    def") else text)


def test_wrong_texts_are_refused_right_ones_pass(spark):
    got = problems(spark, WRONG + RIGHT)
    assert [t for t in WRONG if got[t] is None] == []
    assert {t: got[t] for t in RIGHT if got[t] is not None} == {}


def test_library_files_pass(spark):
    lib = os.path.dirname(os.__file__)
    paths = sorted(glob.glob(f"{ROOT}/**/*.py", recursive=True)) + sorted(glob.glob(f"{lib}/*.py"))[:300]
    texts = {}
    for path in paths:
        try:
            text = open(path, encoding="utf-8").read()
            ast.parse(text)
        except (SyntaxError, UnicodeDecodeError, ValueError):
            continue
        texts[path] = text
    df = spark.createDataFrame(list(texts.items()), "path STRING, text STRING").withColumn("tk", grammar.tokens(F.col("text")))
    refused = {r["path"]: r["p"] for r in df.select("path", grammar.token_problem("tk").alias("p")).collect() if r["p"]}
    assert len(texts) > 200 and refused == {}


def test_rewrites_that_are_no_code_or_lose_the_function_fail(spark):
    answers = ["No", "- first\n- second", "x = = 1", "return return", "def g(x):\n    return x", "def f(x) return x:\n    pass",
               "def f(x):\n    return x", "    def f(self):\n        return 1\n"]
    df = spark.createDataFrame([(i, "f", "cyclomatic", a) for i, a in enumerate(answers)], "id INT, name STRING, metric STRING, new_text STRING")
    got = {r["id"]: (r["ok"], r["error"]) for r in gate.revalidate(df, 5).collect()}
    assert all(not got[i][0] and got[i][1] for i in range(6)), got
    assert got[0][1] == "the function is not defined again" and got[4][1] == "the function is not defined again"
    assert got[6] == (True, None) and got[7] == (True, None)


if __name__ == "__main__":
    sys.exit(0)
