import re

import pytest
from pyspark.sql import functions as F

from quillgauge.functions import fixed as v
from quillgauge.functions import text as t

MARK = v.TRUNCATED


def one(spark, column, **values):
    """Value of a column over one row of string values."""
    schema = ", ".join(f"{k} {'INT' if isinstance(x, int) else 'STRING'}" for k, x in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def many(spark, column, values):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i INT, s STRING")
    return [r["x"] for r in df.orderBy("i").select(column(F.col("s")).alias("x")).collect()]




def test_strip_removes_what_python_strips(spark):
    texts = ["  a b ", "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0x\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000", "", "é "]
    assert many(spark, lambda S: t.strip(S), texts) == [x.strip() for x in texts]
    assert many(spark, lambda S: t.rstrip(S), texts) == [x.rstrip() for x in texts]


def test_split_keep_ends_is_splitlines(spark):
    texts = ["a\nb", "a\r\nb\rc\n", "\n\n", "x\x0by\x85z\u2028w\n", "", "\r\r\n"]
    got = many(spark, lambda S: t.split_keep_ends(S), texts)
    assert [[p for p in g if p] for g in got] == [x.splitlines(keepends=True) for x in texts]


def test_reasoning_and_fences(spark):
    texts = [
        "<think>a\nb</think> x <think>c</think>y ", "no", "<think>open", "Intro ```python\nx = 1\n``` outro",
        "```\nq\n```", "```text\r\nhi\r\n\r\nyou\r\n```", "```a```", "a\r\nb", "```\na\n```\nmid\n```",
    ]
    assert many(spark, lambda S: t.strip_reasoning(S), texts)[:3] == ["x y", "no", "<think>open"]
    assert many(spark, lambda S: t.first_fence(S), texts)[3:5] == ["x = 1\n", "q\n"]
    messages = many(spark, lambda S: t.normalize_message(S), texts)
    assert messages[4:9] == ["q", "hi\n\nyou", "```a```", "a\nb", "a\n```\nmid"]
    assert many(spark, lambda S: t.normalize_message(t.normalize_message(S)), texts) == messages


def test_truncate_counts_code_points(spark):
    assert many(spark, lambda S: t.truncate(S, 3), ["abc", "abcd", "😀😀😀😀", ""]) == ["abc", "abc" + MARK, "😀😀😀" + MARK, ""]


def test_summary_line_and_key(spark):
    texts = ["- Add x...  \nmore", " Fix. ", "-no", "```\n- Do it.\n```", ""]
    assert many(spark, lambda S: t.clean_summary_line(S), texts) == ["Add x", "Fix", "-no", "Do it", ""]
    assert many(spark, lambda S: t.collapse_key(S), [" A  B\n\tc "]) == ["a b c"]


def test_indentation(spark):
    assert many(spark, lambda S: t.detect_indent(S), ["\n  \n\t x\n y", "x", "", "   "]) == ["\t ", "", "", ""]
    source = "    def f():\n        return 1\n\n  odd\n"
    moved = one(spark, t.reindent(F.col("s"), F.lit("  ")), s=source)
    assert moved == "  def f():\n      return 1\n\n  odd\n"
    back = one(spark, t.reindent(F.col("s"), F.lit("    ")), s="  a\n   b\n")
    assert back == "    a\n     b\n"
    assert one(spark, t.reindent(F.col("s"), F.lit("    ")), s=source) == source


@pytest.mark.parametrize("start,end", [(1, 1), (2, 3), (4, 4), (1, 4)])
def test_splice(spark, start, end):
    content = "a\r\nb\nc\nd"
    got = one(spark, t.splice_lines(F.col("s"), F.col("a"), F.col("b"), F.lit("new")), s=content, a=start, b=end)
    lines = content.splitlines(keepends=True)
    assert got == "".join(lines[: start - 1] + ["new\n"] + lines[end:])


def test_paths(spark):
    paths = ["a", "a/b", "x/y/z.py", "/a", "a/b/", "./a", "a//b"]
    from pathlib import PurePosixPath

    assert many(spark, lambda S: t.parent_dir(S), paths) == [str(PurePosixPath(p).parent) for p in paths]
    assert many(spark, lambda S: t.top_dir(S), ["a", "a/b", "/x"]) == [None, "a", ""]
    assert many(spark, lambda S: t.norm_path(S), ["a\\b"]) == ["a/b"]
    names = ["a.py", "A.PY", "d/.py", ".md", "x.tar.gz", "n", "d.py/x", "a.YML"]
    assert many(spark, lambda S: t.is_text_path(S), names) == [PurePosixPath(p).suffix.lower() in v.TEXT_EXTENSIONS for p in names]


def test_weight(spark):
    df = spark.createDataFrame(
        [(1, 2, False, 9), (0, 0, False, 9), (None, None, True, 7), (None, None, True, None), (1, 1, True, 0)],
        "a INT, d INT, b BOOLEAN, s BIGINT",
    )
    w = t.change_weight(F.col("a"), F.col("d"), F.col("b"), F.col("s"))
    assert [r[0] for r in df.select(w).collect()] == [180, 1, 7, 1, 1]


def test_generic_subjects(spark):
    subjects = ["Update  repo", "update my.repo files", "MISC UPDATES", "modify other-repo", "adjust MY.repo", "adjust myxrepo", "update parser", "refactor repository now"]
    got = many(spark, lambda S: t.is_generic_subject(S, F.lit("My.Repo")), subjects)
    assert got == [True, True, True, True, True, False, False, False]


def test_path_dumps(spark):
    lines = ["src/a.py", "- a.py changed", "Fix parser.py", "lib\\x.md", "a/b/c (M)", "a/b c", "", "- ", "notes.pyx", "Use and/or"]
    assert many(spark, lambda S: t.is_path_dump(S), lines) == [True, True, False, True, True, False, False, False, False, False]


def test_message_rules_in_order(spark):
    say = v.MESSAGE_PROBLEMS
    cases = {
        " \n": say["empty"], "x" * 3201: say["long"], "- a": say["bullet_subject"], "y" * 121: say["long_subject"],
        "Update loader": say["generic"], "Here is it": say["chatty"], "Do\n\n" + "- p\n" * 7: say["bullets"],
        "Do\n\n- src/a.py\n- src/b.py": say["dump"], "Do\n\nsrc/a.py\nb/c.md": say["dump"],
        "Do\n\n 1. x": say["numbered"], "Do\n\n* **B** x": say["markdown"], "Do\n\nIn essence no": say["analysis"],
        "Do it\n\nWell.": None, "Do\n\n- src/a.py\n- fine": None, "\nbody": say["no_subject"],
        "## Head": say["chatty"], "Do\n\n" + "z" * 1300 + " in essence": None,
    }
    assert many(spark, lambda S: t.message_problem(S, F.lit("loader")), list(cases)) == list(cases.values())


def test_summary_rules_in_order(spark):
    cases = {"": "empty", "q" * 141: "too long", "update files": "generic", "src/a.py": "path dump", "Sure thing": "chat-style", "Add x": None}
    assert many(spark, lambda S: t.summary_problem(S, F.lit("r")), list(cases)) == list(cases.values())


def test_fallback_categories(spark):
    def both(text):
        args = [F.lit("repo"), F.col("s"), F.lit(""), F.lit(None).cast("string")]
        m = one(spark, t.fallback_message(*args), s=text)
        return m.split("\n")[0], one(spark, t.fallback_summary(*args, F.lit("lib")), s=text)

    assert both("M\tlatest.py") == ("Update tests", "Update tests")
    assert both("M\tREADME")[0] == "Update documentation"
    assert both("M\ta.yml")[1] == "Update configuration"
    assert both("M\ta.c") == ("Update repo", "Update lib")


def test_prompts(spark):
    null = F.lit(None).cast("string")
    assert one(spark, t.user_prompt(F.col("r"), F.lit("B"), null), r="x").startswith("Repository folder name: x\n\nMachine")
    retried = one(spark, t.user_prompt(F.col("r"), F.lit("B"), F.lit("bad")), r="x")
    assert "\n\nPrevious output was rejected because: bad.\nWrite a concrete" in retried
    assert retried.endswith("<<<GIT_OUTPUT>>>\nB\n<<<END_GIT_OUTPUT>>>\n")
    scores = F.array(F.struct(F.lit("f").alias("name"), F.lit(20).alias("value")), F.struct(F.lit("g").alias("name"), F.lit(3).alias("value")))
    told = one(spark, t.retry_feedback(F.col("m"), scores, 15, F.lit("oops")), m="cyclomatic").split("\n")
    assert told[0] == "Your previous attempt had a validation error: oops"
    assert told[1] == "Function `f` still has cyclomatic complexity 20 (must be <= 15)." and len(told) == 3
    assert one(spark, t.validation_log(F.col("m"), scores, 15, null), m="cyclomatic") == "  f: cyclomatic=20 (still > 15)"
    assert "test failures" in one(spark, t.check_feedback(F.col("e")), e="test_failure")
    assert "undefined names:\nF821 x\n\nIMPORTANT" in one(spark, t.check_feedback(F.col("e")), e="F821 x")
    ask = one(spark, t.rewrite_prompt(F.col("s"), F.lit("f"), F.lit("cognitive"), F.lit(20), 15, F.lit("CTX"), null), s="  def f():\n    pass\n")
    assert ask.startswith("Refactor the function `f` to reduce its cognitive complexity from 20 to at most 15.\n\nRequirements:")
    assert "base indentation (2 spaces)" in ask and "fence\n\nCTX\n\nFunction to refactor:\n```python\n  def f" in ask
    assert "Metric: cognitive complexity.\nCognitive" in one(spark, t.rewrite_system(F.col("m")), m="cognitive")


def test_envelopes(spark):
    rows = many(spark, lambda S: t.unwrap_response(S, "$.message.content"), ['{"message":{"content":"ok"}}', '{"message":{"content":""}}', "{}", "not json"])
    assert [tuple(r) for r in rows] == [("ok", None), (None, "no message.content field"), (None, "no message.content field"), (None, "non-JSON output")]


def test_long_strings_do_not_overflow_the_stack(spark):
    """Inputs that would make a recursive regular expression fail."""
    from quillgauge.functions import code as c

    texts = ['x = "' + "\\'" * 50_000 + '"', '"""' + '" ' * 50_000 + '"""', "(" * 50_000, "<think>" + "a\n" * 50_000 + "</think>b", "```\n" + "z\n" * 50_000 + "```"]
    assert [len(x) for x in many(spark, lambda S: c.tokens_of(S), texts[:2])] == [3, 1]
    assert many(spark, lambda S: t.strip_reasoning(S), texts[3:4]) == ["b"]
    assert len(many(spark, lambda S: t.first_fence(S), texts[4:])[0]) == 100_000
    assert len(many(spark, lambda S: t.normalize_message(S), texts[4:])[0]) == 99_999
    assert re.match("z", many(spark, lambda S: t.normalize_message(S), texts[4:])[0])
