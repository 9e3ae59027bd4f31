"""Generation plans against a one-by-one run of the same rules in plain Python."""

import re

import pytest
from quillgauge.functions import fixed as v
from quillgauge.operators import batching, budget, code, messages
from quillgauge.operators.scale import durable
from quillgauge.catalog.queries import stub
from quillgauge.plans.generate import generate, generate_with_escalation
from quillgauge.plans.route import commit_messages
from quillgauge.plans.rewrite import rewrite_corpus
from quillgauge.plans.summarize import batch_lines, reduce_lines, summarize_changes

CHANGE = "repo STRING, path STRING, status STRING, added INT, deleted INT, is_binary BOOLEAN, untracked BOOLEAN, size BIGINT, diff STRING"


def changes(spark, counts):
    data = [(repo, f"d{i % 3}/{repo}{i:03}.c", "M", 1, 1, False, False, 1, f"+{i}") for repo, n in counts.items() for i in range(n)]
    return spark.createDataFrame(data, CHANGE)


def test_generate_reports_failed_calls(spark):
    def fn(prompt, system):
        if prompt == "bad":
            raise ValueError("no")
        return {"none": None, "blank": " \n", "number": 7}.get(prompt, prompt.upper() + system)

    asked = [(1, "a", "!"), (2, "bad", ""), (3, None, ""), (4, "none", ""), (5, "blank", ""), (6, "number", "")]
    got = {r["i"]: (r["raw"], r["call_error"]) for r in generate(spark.createDataFrame(asked, "i INT, prompt STRING, system STRING"), fn).collect()}
    no_text = (None, "the answer holds no text")
    assert got == {1: ("A!", None), 2: (None, "ValueError: no"), 3: (None, "no prompt"), 4: no_text, 5: no_text, 6: no_text}


def test_generate_tasks_grow_with_prompts(spark):
    cores = spark.sparkContext.defaultParallelism
    few = spark.range(5).selectExpr("id", "CAST(id AS STRING) AS prompt", "'' AS system")
    many = spark.range(40 * cores).selectExpr("id", "CAST(id AS STRING) AS prompt", "'' AS system")
    assert generate(few, lambda p, s: p, prompts_per_task=4).rdd.getNumPartitions() == cores
    dealt = generate(many, lambda p, s: p, prompts_per_task=4)
    assert dealt.rdd.getNumPartitions() == 10 * cores
    rows = dealt.collect()
    assert sorted(r["id"] for r in rows) == list(range(40 * cores)) and all(r["raw"] == str(r["id"]) for r in rows)


@pytest.mark.parametrize("answer", ["", None, "Sorry, I cannot refactor this.", "return )x(", "def f(x):\nreturn x"])
def test_bad_answers_leave_files_unchanged(spark, answer):
    body = "".join(f"    if a{k}:\n        b()\n" for k in range(16))
    files = spark.createDataFrame([("p", "a.py", f"def f(x):\n{body}"), ("p", "b.py", "x = 1\n")], "project STRING, path STRING, content STRING")
    after, outcomes = rewrite_corpus(files, lambda p, s: answer, passes=1)
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, files.collect()))
    rows = outcomes.collect()
    assert len(rows) == 1 and not rows[0]["ok"] and rows[0]["reason"]


def test_escalation_levels(spark):
    """Each repository is answered well at another level, one never, one call fails."""

    def fn(prompt, system):
        repo = re.search("folder name: (.*)\n", prompt)[1]
        level = ("paths-only" if "path lists and stats only" in system else "lite" if "shortened" in system
                 else "repair-full" if "generic or path-only" in system else "full")
        if level != "full":
            assert "rejected because: subject is too generic" in prompt
        if repo == "broken":
            raise RuntimeError("down")
        if level == "lite":
            assert "-- short diff excerpt --" in prompt
        if level == "paths-only":
            assert "excerpt" not in prompt
        return f"Handle {level} input" if repo == level else "Update files"

    names = ["full", "repair-full", "lite", "paths-only", "never", "broken"]
    records = messages.bundles(budget.compact(changes(spark, dict.fromkeys(names, 2))), ["repo"])
    got = {r["repo"]: (r["level"], r["attempt_no"], r["message"], r["call_error"]) for r in generate_with_escalation(records, fn, ["repo"]).collect()}
    for i, name in enumerate(names[:4], 1):
        assert got[name] == (name, i, f"Handle {name} input", None)
    assert got["never"][:2] == ("fallback", None) and got["never"][2].startswith("Update never\n\nApply")
    assert got["broken"] == ("full", 1, None, "RuntimeError: down")


def test_escalation_stops_when_nothing_is_left(spark):
    records = messages.bundles(budget.compact(changes(spark, {"r": 2})), ["repo"])
    got = generate_with_escalation(records, lambda p, s: "Handle more input", ["repo"]).collect()
    assert [(r["level"], r["message"]) for r in got] == [("full", "Handle more input")]


def test_summaries_of_all_tiers(spark):
    """one: a single line; few: 2-6 lines; many: over 6; poor: rejected; down: failed call."""

    def fn(prompt, system):
        if system == "subject":
            return "Rework the readers" if "few" in prompt else "Update files"
        if system == "reduce":
            return "Rework everything\n\n- a theme" if "many" in prompt else "1. bad\n\n1. list"
        repo = re.search("folder name: (.*)\n", prompt)[1]
        first = re.search(r"\nM  (\S+)", prompt)[1]
        if repo == "down":
            raise RuntimeError("x")
        if repo in ("one", "half"):
            return "Same line." if repo == "one" else "update files"
        return f"- Handle {repo} {first.split('/')[1].removesuffix('.c')}."

    sizes = {"one": 30, "few": 45, "many": 120, "poor": 130, "half": 25, "down": 5, "worse": 40}
    df = changes(spark, sizes)
    got = {r["repo"]: r for r in summarize_changes(df, fn, {"subject": "subject", "reduce": "reduce"}, max_files=15, hot_rows=50).collect()}
    assert got["one"]["message"] == "Same line\n\n- Same line"
    assert got["few"]["message"].startswith("Rework the readers\n\n- Handle few few")
    assert got["few"]["message"].count("\n- ") == 3
    assert got["many"]["message"] == "Rework everything\n\n- a theme"
    assert got["poor"]["message"].startswith("Update poor: 130 files across 9 areas\n\n- Handle poor")
    assert got["worse"]["message"].startswith("Update worse across 3 areas\n\n- Handle worse")
    # every half falls back to its modal directory, and equal lines are told once
    assert set(got["half"]["message"].split("\n\n")[1].split("\n")) <= {"- Update d0", "- Update d1", "- Update d2"}
    assert got["down"]["message"] is None and got["down"]["call_error"] == "RuntimeError: x"
    assert {r: got[r]["n_files"] for r in sizes} == sizes


def test_failed_batch_is_halved_once(spark):
    def fn(prompt, system):
        return "Handle a part" if prompt.count("\nM  ") <= 10 else "update files"

    lines = batch_lines(changes(spark, {"r": 20, "s": 50}), fn, max_files=40).orderBy("repo", "seq").collect()
    assert [(x["repo"], x["seq"], x["line"]) for x in lines if x["repo"] == "r"] == [("r", 0, "Handle a part"), ("r", 1, "Handle a part")]
    assert [(x["seq"], x["line"]) for x in lines if x["repo"] == "s"][:2] == [(0, "Update d0"), (1, "Update d1")]


def test_no_lines_fall_back(spark):
    sizes = spark.createDataFrame([("r", 3)], "repo STRING, n_files BIGINT")
    none = spark.createDataFrame([], "repo STRING, seq BIGINT, line STRING, call_error STRING")
    (row,) = reduce_lines(none, sizes, lambda p, s: "x", {}).collect()
    assert row["message"] == "Update r\n\n" + v.FALLBACK_BODY


# --- rewriting --------------------------------------------------------------------------

BAD = "def {n}(x):\n" + "    if x and x:\n        pass\n" * 3
FILES = [
    ("p", "a.py", BAD.format(n="f") + "\n\n" + BAD.format(n="g") + "    if x: pass\n"),
    ("p", "b.py", "class K:\n    def m(self):\n" + "        if self or 1:\n            pass\n" * 4),
    ("p", "c.py", BAD.format(n="stuck")),
    ("p", "d.py", BAD.format(n="late")),
    ("p", "e.py", BAD.format(n="lost")),
    ("p", "ok.py", "def fine():\n    return 1\n"),
    ("p", "k.py", "class Wide:\n" + "    if a and b: c = 1\n" * 3),
]


def make_rewriter():
    """A local function, so that workers need not import this module."""

    def fn(prompt, system):
        name = re.search("function `(.*?)`", prompt)[1]
        if name == "lost":
            raise RuntimeError("down")
        if name == "stuck":
            return "```python\n" + BAD.format(n=name) + "```"
        if name == "late" and "IMPORTANT — Previous attempt feedback" not in prompt:
            return "def late(:"
        return f"<think>x</think>```python\ndef {name}(self):\n    return 0\n```"

    return fn


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame(FILES, "project STRING, path STRING, content STRING")


def test_rewrite_all(spark, corpus):
    after, history = rewrite_corpus(corpus, make_rewriter(), limit=5)
    texts = {r["path"]: r["content"] for r in after.collect()}
    assert texts["a.py"] == "def f(self):\n    return 0\n\n\ndef g(self):\n    return 0\n"
    assert texts["b.py"] == "class K:\n    def m(self):\n        return 0\n"
    assert texts["c.py"] == FILES[2][2] and texts["e.py"] == FILES[4][2] and texts["ok.py"] == FILES[5][2]
    assert texts["d.py"] == "def late(self):\n    return 0\n"
    told = {(r["pass"], r["name"]): (r["ok"], r["tries"], r["reason"]) for r in history.collect()}
    # g is worse than f: it is fixed first, f in the second pass on the new text
    assert told[(1, "g")] == (True, 1, None) and told[(2, "f")] == (True, 1, None) and (1, "f") not in told
    assert told[(1, "late")] == (True, 2, None)
    assert told[(1, "stuck")] == (False, 3, "still over the limit")
    assert told[(1, "lost")] == (False, 1, "RuntimeError: down")
    assert told[(1, "Wide")] == (False, 0, "not a function")
    left = code.blocks(after).filter("total > 5").select("name").collect()
    assert {r["name"] for r in left} == {"stuck", "lost"}


def test_rewrite_one(spark, corpus):
    ex = spark.createDataFrame([("cyclomatic", "b.py", "m"), ("cognitive", "b.py", "m")], "metric STRING, part STRING, block STRING")
    after, history = rewrite_corpus(corpus, make_rewriter(), limit=5, exclusions=ex, fix_all=False)
    assert [(r["name"], r["ok"]) for r in history.filter("ok").collect()] == [("g", True)]
    changed = after.join(corpus.withColumnRenamed("content", "old"), ["project", "path"]).filter("content <> old")
    assert [r["path"] for r in changed.collect()] == ["a.py"]


def test_checkpoints_go_to_the_named_folder(spark):
    where = spark.sparkContext.getCheckpointDir()
    assert spark.conf.get("spark.checkpoint.dir") in where
    assert durable(spark.range(3)).count() == 3
    assert spark.sparkContext.getCheckpointDir() == where


def test_batches_feed_escalation(spark):
    placed = durable(batching.assign_batches(budget.compact(changes(spark, {"r": 50})), 20))
    records = messages.bundles(placed, ["repo", "batch_id"])
    got = generate_with_escalation(records, lambda p, s: "Handle more input", ["repo", "batch_id"]).collect()
    assert sorted(r["batch_id"] for r in got) == [0, 1, 2]


def test_a_proposal_that_breaks_its_file_is_found(spark):
    from quillgauge.operators.rewrite import applied_problem

    text = "import os\n\ndef f(x):\n    return x\ny = 1\n"
    files = spark.createDataFrame([("p", n, text) for n in ("a.py", "b.py", "c.py", "d.py")], "project STRING, path STRING, content STRING")
    made = spark.createDataFrame([
        ("p", "a.py", 3, 4, "def f(x):\n    return x \\\n", True), ("p", "b.py", 3, 4, "def f(x):\n    return 2 * x + os.sep\n", True),
        ("p", "c.py", 3, 4, "def f(x):\n    return helper(x, Path(y))\n", True), ("p", "d.py", 3, 4, "def f(x):\n    return z\n", False),
    ], "project STRING, path STRING, start_line INT, end_line INT, new_text STRING, ok BOOLEAN")
    got = {r["path"]: r["applied"] for r in applied_problem(made, files).collect()}
    assert got == {"a.py": "the file would not parse: an operator is missing", "b.py": None, "c.py": "undefined names: Path, helper", "d.py": None}


@pytest.mark.parametrize("batching", [True, False])
def test_commit_messages_route_by_size(spark, batching):
    df = changes(spark, {"a": 2, "b": 7, "c": 3})
    got = {r["repo"]: r.asDict() for r in commit_messages(df, stub, max_files=3, batching=batching).collect()}
    assert sorted(got) == ["a", "b", "c"]
    routes = {k: r["route"] for k, r in got.items()}
    assert routes == ({"a": "bundle", "b": "batches", "c": "bundle"} if batching else dict.fromkeys("abc", "bundle"))
    assert {k: r["n_files"] for k, r in got.items()} == {"a": 2, "b": 7, "c": 3}
    small = [k for k, r in routes.items() if r == "bundle"]
    alone = generate_with_escalation(
        messages.bundles(batching_units(df.filter(df.repo.isin(small))), ["repo"]), stub, ["repo"]
    ).collect()
    assert {r["repo"]: (r["level"], r["attempt_no"], r["message"], r["call_error"]) for r in alone} == {
        k: (got[k]["level"], got[k]["attempt_no"], got[k]["message"], got[k]["call_error"]) for k in small
    }
    if batching:
        reduced = summarize_changes(df.filter("repo = 'b'"), stub, max_files=3).collect()[0]
        assert (got["b"]["message"], got["b"]["call_error"], got["b"]["n_items"]) == (
            reduced["message"], reduced["call_error"], reduced["n_items"]
        )


def batching_units(df):
    return batching.weighted(budget.compact(df))


def test_commit_messages_of_no_changes(spark):
    assert commit_messages(changes(spark, {}), stub, max_files=3).collect() == []


def test_each_route_writes_its_own_changes_only(spark, monkeypatch):
    from quillgauge.plans import route

    written, plain = [], route.durable
    monkeypatch.setattr(route, "durable", lambda df: written.append((df.columns, df.count())) or plain(df))
    rows = commit_messages(changes(spark, {"a": 2, "b": 7, "c": 3}), stub, max_files=3).collect()
    assert len(rows) == 3 and sum(n for columns, n in written if "diff_head" in columns) == 5


def test_listings_move_no_diffs(spark, monkeypatch):
    moved, plain = [], messages.position
    monkeypatch.setattr(messages, "position", lambda df, *a: moved.append(df.columns) or plain(df, *a))
    made = messages.bundle_runs(batching_units(changes(spark, {"a": 5})), ["repo"], run=2)
    assert made.count() == 3 and moved == [["repo", "path", "porcelain", "name_status", "diff_stat"]]
