"""Group-wise operators: brute force on small fixtures, and hot groups against plain ones."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillgauge.functions import fixed as v
from quillgauge.operators import batching, budget, gate, messages, rewrite, scale

CHANGE = "repo STRING, path STRING, status STRING, added INT, deleted INT, is_binary BOOLEAN, untracked BOOLEAN, size BIGINT, diff STRING"


def rows(df):
    return [tuple(r) for r in df.collect()]


def make_changes(spark, n, repos=2, seed=1, diff=lambda r: "d" * r.randint(0, 4000)):
    r = random.Random(seed)
    data = []
    for i in range(n):
        folder = r.choice(["", "src/", "Src/core/", "docs/", "a/b/c/"])
        path = f"{folder}f{i}{r.choice(['.py', '.PY', '.bin', ''])}"
        data.append((f"r{r.randint(0, repos - 1)}", path, r.choice("AMD"), r.randint(0, 50), r.randint(0, 9),
                     r.random() < 0.1, r.random() < 0.2, r.randint(0, 999), r.choice(["", "  \n", diff(r)])))
    return spark.createDataFrame(data, CHANGE), data


# --- positions and batches --------------------------------------------------------------


@pytest.mark.parametrize("hot_rows", [10**9, 7])
def test_position_is_the_same_for_hot_groups(spark, hot_rows):
    df, data = make_changes(spark, 300, 3)
    got = scale.position(df.select("repo", "path"), ["repo"], batching.directory_order(), "pos", hot_rows)

    def key(path):
        parent = path.rsplit("/", 1)[0] if "/" in path else "."
        return parent.lower(), path.lower(), path

    expected = []
    for repo in {d[0] for d in data}:
        ordered = sorted((d[1] for d in data if d[0] == repo), key=key)
        expected += [(repo, p, i) for i, p in enumerate(ordered, 1)]
    assert sorted(rows(got)) == sorted(expected)


@pytest.mark.parametrize("n,max_files", [(1, 40), (40, 40), (41, 40), (13, 1), (500, 40), (7, 3), (100, 1)])
def test_batches_are_bounded_and_contiguous(spark, n, max_files):
    df, _ = make_changes(spark, n, 1)
    got = batching.assign_batches(df, max_files, hot_rows=50)
    found = sorted(rows(got.select("batch_id", "batch_pos", "batch_n")))
    wanted = max(1, min(-(-n // max_files), v.MAX_BATCHES))
    size = -(-n // wanted)
    sizes = [min(size, n - i) for i in range(0, n, size)]
    assert found == [(b, p, k) for b, k in enumerate(sizes) for p in range(1, k + 1)]


def test_halves_scope_and_size(spark):
    df, data = make_changes(spark, 90, 1)
    halves = batching.halve(batching.assign_batches(df, 20))
    got = dict(rows(halves.groupBy("batch_id", "half").count().select(F.concat_ws("/", "batch_id", "half"), "count")))
    assert got == {f"{b}/{h}": 9 for b in range(5) for h in (0, 1)}
    one = batching.halve(batching.assign_batches(df.limit(1), 20))
    assert rows(one.select("half")) == [(0,)]
    paths = df.filter("repo = 'r0'").limit(5).select("repo", "path")
    assert batching.scope(df, paths).count() == 5
    large = batching.is_large(batching.weighted(df))
    weight = sum(max(1, d[7]) if d[5] or d[6] else max(1, 60 * (d[3] + d[4])) for d in data)
    assert rows(large) == [("r0", 90, weight, True)]
    assert rows(batching.is_large(batching.weighted(df), batching=False).select("large")) == [(False,)]


def test_modal_dir_takes_the_smallest_name_on_a_tie(spark):
    df = spark.createDataFrame([("r", p) for p in ["b/x", "a/x", "b/y", "a/y", "top", "c/z"]] + [("s", "bare")], "repo STRING, path STRING")
    assert rows(batching.modal_top_dir(df, ["repo"])) == [("r", "a")]


def test_union_and_distinct_paths(spark):
    tracked = spark.createDataFrame([("r", "a", 1, 1, False, 5), ("r", "b", None, None, True, 5)], "repo STRING, path STRING, added INT, deleted INT, is_binary BOOLEAN, size BIGINT")
    untracked = spark.createDataFrame([("r", "c", 9), ("r", "d", None)], "repo STRING, path STRING, size BIGINT")
    assert sorted(rows(batching.change_units(tracked, untracked))) == [("r", "a", 120, 0), ("r", "b", 5, 0), ("r", "c", 9, 1), ("r", "d", 1, 1)]
    seen = spark.createDataFrame([("r", "x", 3), ("r", "y", 1), ("r", "x", 0)], "repo STRING, path STRING, seq INT")
    assert sorted(rows(batching.distinct_paths(seen, ["repo"], "seq"))) == [("r", "x", 0), ("r", "y", 1)]


# --- budgets ----------------------------------------------------------------------------


def split_sample(sample):
    """Excerpts of a sample with the paths they name, and whether it ends by saying that files are missing."""
    head, said = sample.removesuffix(v.FILES_OMITTED), sample.endswith(v.FILES_OMITTED)
    pieces = re.split(r"(?:^|\n\n)--- diff for (\S+) ---\n", head.removesuffix("\n\n") if said else head)
    assert pieces[0] == ""
    return list(zip(pieces[1::2], pieces[2::2])), said


@pytest.mark.parametrize("seed", range(6))
def test_excerpts_keep_their_budget(spark, seed):
    df, data = make_changes(spark, 120, 6, seed, lambda r: "é" * r.choice([0, 1, 50, 1799, 1800, 1801, 5000, 12000]))
    chars = [45_000, 3000, 7000, 1, 20_000, 9000][seed]
    got = dict(rows(budget.pack_excerpts(budget.compact(df), ["repo"], chars)))
    for repo in {d[0] for d in data}:
        own = sorted((d[1], d[8]) for d in data if d[0] == repo)
        filled = [(path, diff) for path, diff in own if diff.strip()]
        excerpts, said = split_sample(got.get(repo, ""))
        # Files come in order from the first one on, none is left out in between.
        assert [path for path, _ in excerpts] == [path for path, _ in filled[: len(excerpts)]]
        most, spent = max(1800, min(9000, chars // len(own))), 0
        for (path, text), (_, diff) in zip(excerpts, filled):
            kept = text.removesuffix(v.TRUNCATED)
            assert diff.startswith(kept) and (text == diff or text == kept + v.TRUNCATED)
            # As much of a file as its share and what is left allow, and no more.
            assert len(kept) == min(len(diff), most, chars - spent)
            spent += len(f"--- diff for {path} ---\n{text}") + 2
        assert spent == 0 or spent - len(f"--- diff for {excerpts[-1][0]} ---\n{excerpts[-1][1]}") - 2 < chars
        assert len(excerpts) == len(filled) or spent >= chars
        last = own.index(next(x for x in own if x[0] == excerpts[-1][0])) if excerpts else -1
        assert said == (spent >= chars and last + 1 < len(own))


def test_excerpts_by_hand(spark):
    small = [("r", p, "M", 1, 1, False, False, 1, d) for p, d in (("a", "x" * 10), ("b", " "), ("c", "y" * 30), ("d", "z"))]
    got = rows(budget.pack_excerpts(budget.compact(spark.createDataFrame(small, CHANGE)), ["repo"], 50))
    first, second = "--- diff for a ---\n" + "x" * 10, "--- diff for c ---\n" + "y" * 19 + v.TRUNCATED
    assert got == [("r", f"{first}\n\n{second}\n\n{v.FILES_OMITTED}")]


def test_untracked_note(spark):
    data = [("r", f"u{i:03}{'.py' if i % 2 else ''}", "A", 0, 0, False, True, 1, f" text {i} " if i != 3 else "  ") for i in range(33)]
    data.append(("r", "u001.md", "A", 0, 0, False, True, 1, "x" * 3000))
    got = rows(budget.untracked_snippets(budget.compact(spark.createDataFrame(data, CHANGE)), ["repo"]))
    lines = ["", v.UNTRACKED_TITLE]
    for d in sorted(data, key=lambda x: x[1])[:30]:
        lines.append(d[1])
        text = d[8].strip()
        text = text if len(text) <= 2400 else text[:2400] + v.TRUNCATED
        if d[1].endswith((".py", ".md")) and text:
            lines += ["```", text, "```"]
    lines.append("[... 4 additional untracked paths omitted ...]")
    assert got[0][1] == "\n".join(lines) and got[0][3] == 34


@pytest.mark.parametrize("max_chars", [1, 10, 60, 2800])
def test_capped_lists(spark, max_chars):
    r = random.Random(max_chars)
    groups = {f"g{k}": ["x" * r.randint(0, 30) for _ in range(r.randint(1, 200))] for k in range(5)}
    df = spark.createDataFrame([(g, i, x) for g, xs in groups.items() for i, x in enumerate(xs)], "g STRING, i INT, x STRING")
    got = dict(rows(budget.cap_list(df, ["g"], "i", "x", max_chars)))
    arrays = df.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("xs"))
    assert dict(rows(arrays.select("g", budget.capped_array(F.col("xs"), max_chars)))) == got
    for g, xs in groups.items():
        shown = got[g].split("\n")
        rest = re.fullmatch(r"- \.\.\.and (\d+) more change areas", shown[-1])
        kept = shown[:-1] if rest else shown
        # A prefix of the items, with what is left over counted.
        assert kept == [f"- {x}" for x in xs[: len(kept)]] and len(xs) - len(kept) == (int(rest[1]) if rest else 0)
        size = sum(len(k) + 1 for k in kept)
        # Only the first item may be over the limit; the next would not have fitted.
        assert len(kept) == 1 or size <= max_chars
        assert not rest or size + len(f"- {xs[len(kept)]}") + 1 > max_chars


def test_capped_lists_by_hand(spark):
    df = spark.createDataFrame([("g", 1, "aa"), ("g", 2, "bb"), ("g", 3, "cc"), ("h", 1, "long item")], "g STRING, i INT, x STRING")
    assert dict(rows(budget.cap_list(df, ["g"], "i", "x", 10))) == {"g": "- aa\n- bb\n- ...and 1 more change areas", "h": "- long item"}


def test_caps_per_group(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id")
    assert sorted(rows(budget.cap_per_group(df, ["k"], ["id"], 2))) == [(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5)]


# --- messages ---------------------------------------------------------------------------


def test_first_acceptable(spark):
    df = spark.createDataFrame([(1, 2, "Second good"), (1, 1, "Update files"), (1, 3, "Third good"), (2, 1, "")], "item_id INT, attempt_no INT, raw STRING")
    got = messages.first_acceptable(messages.judged(df, F.lit("r")), "item_id", F.lit("fall"))
    assert sorted(rows(got)) == [(1, 2, "Second good"), (2, None, "fall")]


def test_dedupe_keeps_the_first_spelling(spark):
    df = spark.createDataFrame([("g", 1, "Add  X"), ("g", 2, "add x"), ("g", 0, " "), ("g", 3, "B"), ("h", 9, "ADD X")], "g STRING, s INT, l STRING")
    assert sorted(rows(messages.dedupe_keep_first(df, ["g"], "s", "l").select("g", "s", "l"))) == [("g", 1, "Add  X"), ("g", 3, "B"), ("h", 9, "ADD X")]


@pytest.mark.parametrize("hot_rows", [10**9, 5])
def test_bundle_text(spark, hot_rows):
    data = [("r", "a.py", "M", 1, 2, False, False, 1, "+x"), ("r", "b.bin", "A", None, None, True, False, 1, ""),
            ("r", "new.md", "A", 0, 0, False, True, 1, " hi ")] + [("s", f"p{i:02}", "M", 1, 0, False, False, 1, "") for i in range(12)]
    df = budget.compact(spark.createDataFrame(data, CHANGE))
    made = messages.bundles(df, ["repo"], hot_rows=hot_rows)
    got = {r["repo"]: r for r in made.select("repo", *[messages.render_bundle(x).alias(x) for x in ("full", "lite", "paths-only")]).collect()}
    head = "=== REPO: r (branch: main) ===\n-- git status --porcelain --\nM  a.py\nA  b.bin\n?? new.md\n-- git diff HEAD --name-status --\nM\ta.py\nA\tb.bin\n-- git diff HEAD --stat --\n a.py | 3\n b.bin | Bin\n"
    note = "\n\n-- untracked paths and snippets --\nnew.md\n```\nhi\n```"
    assert got["r"]["full"] == head + "-- balanced git diff excerpts --\n--- diff for a.py ---\n+x" + note
    assert got["r"]["lite"] == head + "-- short diff excerpt --\n--- diff for a.py ---\n+x" + note
    assert got["r"]["paths-only"] == head + "-- untracked paths --\nnew.md"
    assert got["s"]["full"].count("\nM  p") == 12 and got["s"]["full"].endswith("-- balanced git diff excerpts --\n")


def test_bundle_runs_are_whole_and_ordered(spark):
    df, data = make_changes(spark, 60, 1)
    runs = messages.bundle_runs(budget.compact(df), ["repo"], run=7).orderBy("run")
    lines = [x for r in runs.collect() for x in r["porcelain"].split("\n")]
    assert [x[3:] for x in lines] == sorted(d[1] for d in data)


# --- gate and rewriting -----------------------------------------------------------------

VIOLATION = "project STRING, path STRING, name STRING, block_line INT, kind STRING, value BIGINT, metric STRING"


def test_worst_per_block_and_order(spark):
    df = spark.createDataFrame([("p", "a", "f", 1, "def", 20, "cognitive"), ("p", "a", "f", 1, "def", 20, "cyclomatic"), ("p", "a", "g", 5, "def", 30, "cognitive"), ("p", "b", "f", 1, "def", 16, "cyclomatic")], VIOLATION)
    got = [(r["name"], r["path"], r["value"], r["metric"]) for r in gate.rank_worst(df).collect()]
    assert got == [("g", "a", 30, "cognitive"), ("f", "a", 20, "cyclomatic"), ("f", "b", 16, "cyclomatic")]
    assert gate.top_worst(df).first()["name"] == "g"


def test_exclusions_need_name_part_and_metric(spark):
    df = spark.createDataFrame([("p", "src\\core\\io.py", "f", 1, "def", 20, "cyclomatic"), ("p", "src/core/io.py", "g", 1, "def", 20, "cyclomatic"), ("p", "src/core/io.py", "f", 1, "def", 20, "cognitive")], VIOLATION)
    ex = spark.createDataFrame([("cyclomatic", "core/io", "f"), ("cyclomatic", "tests/", "g"), ("cognitive", "core/", "g")], "metric STRING, part STRING, block STRING")
    assert {(r["name"], r["metric"]) for r in gate.drop_excluded(df, ex).collect()} == {("g", "cyclomatic"), ("f", "cognitive")}


def test_path_filters(spark):
    df = spark.createDataFrame([(p,) for p in ["src/a.py", "tests/a.py", "a/test", "a/Tests/b", "x/core/y/io/z", "x/core/z", "a/.git/b"]], "path STRING")
    kept = [r[0] for r in gate.drop_if_all_segments(gate.drop_ignored(df), ["core", "io"]).collect()]
    assert kept == ["src/a.py", "a/Tests/b", "x/core/z"]
    assert gate.drop_if_all_segments(df, []).count() == 7 and gate.drop_ignored(df, []).count() == 7


def test_quarantine(spark):
    df = spark.createDataFrame([("a", "x = (1"), ("b", None), ("c", "x = '('")], "path STRING, content STRING")
    good, bad = gate.split_good_bad(df, gate.unreadable(F.col("content")))
    assert rows(good.select("path")) == [("c",)]
    assert sorted(rows(bad.select("path", "reason"))) == [("a", "brackets do not close"), ("b", "unreadable")]


def test_runs(spark):
    df = spark.createDataFrame([("a", "p1", 1, True), ("a", "p2", 2, False), ("a", "p3", 3, True), ("b", "p1", 1, True)], "run STRING, project STRING, seq INT, passed BOOLEAN")
    assert sorted(r["project"] for r in gate.stop_on_error(df).filter("run = 'a'").collect()) == ["p1", "p2"]
    assert sorted(rows(gate.unrun_counts(df))) == [("a", 1), ("b", 0)]
    assert sorted(rows(gate.project_rollup(df))) == [("a", 3, 2, 1, 1), ("b", 1, 1, 0, 0)]
    assert rows(gate.project_status(df))[:2] == [("a", "p1", "PASS"), ("a", "p2", "FAIL")]


def test_gate_summary_shows_zeros(spark):
    projects = spark.createDataFrame([("p",), ("q",), ("p",)], "project STRING")
    df = spark.createDataFrame([("p", "a", "f", 1, "def", 20, "cognitive")], VIOLATION)
    assert sorted(rows(gate.gate_summary(projects, df))) == [("p", "cognitive", 1, 1), ("p", "cyclomatic", 0, 1), ("q", "cognitive", 0, 0), ("q", "cyclomatic", 0, 0)]


def test_revalidate(spark):
    df = spark.createDataFrame([(1, "cyclomatic", "  def f():\n    if a and b: pass\n"), (2, "cognitive", "async def f():\n  if a: pass"), (3, "cyclomatic", "x = 1"), (4, "cyclomatic", "def f(:")], "id INT, metric STRING, new_text STRING")
    got = {r["id"]: (r["ok"], [tuple(s) for s in r["scores"]], r["error"]) for r in gate.revalidate(df, 1).collect()}
    assert got == {1: (False, [("f", 3)], None), 2: (True, [("f", 1)], None), 3: (True, [], None), 4: (False, [], "brackets do not close")}


def test_attempt_order(spark):
    df = spark.createDataFrame([("p", "a", 1, False), ("p", "a", 2, True), ("p", "a", 3, False), ("p", "b", 4, True), ("p", "c", 5, False)], "project STRING, path STRING, rank INT, ok BOOLEAN")
    assert sorted(r["rank"] for r in rewrite.until_success(df, ["path"]).collect()) == [1, 2, 4, 5]
    assert sorted(r["rank"] for r in rewrite.until_success(df, []).collect()) == [1, 2]
    assert rows(rewrite.rewrite_summary(df)) == [(2, 3, 0)]
    assert rows(rewrite.rewrite_summary(df.filter("NOT ok"))) == [(0, 3, 1)] and rows(rewrite.rewrite_summary(df.limit(0))) == [(0, 0, 0)]
    assert [r["path"] for r in rewrite.not_modified(df, df.filter("ok")).collect()] == ["c"]


def test_guard_and_splice(spark):
    files = spark.createDataFrame([("p", "a", "1\n2\n3\n"), ("p", "b", "x\n")], "project STRING, path STRING, content STRING")
    made = files.select("project", "path", F.sha2("content", 256).alias("base_sha"), F.lit(2).alias("start_line"), F.lit(2).alias("end_line"), F.lit("two").alias("new_text"))
    made = made.withColumn("base_sha", F.when(F.col("path") == "b", "stale").otherwise(F.col("base_sha")))
    good, bad = rewrite.guard(made, files)
    assert [r["reason"] for r in bad.collect()] == ["file_modified"]
    assert sorted(rows(rewrite.splice(files, good))) == [("p", "a", "1\ntwo\n3\n"), ("p", "b", "x\n")]


def test_first_n_beyond_the_window_limit_is_exact(spark):
    from quillgauge.operators.scale import first_n

    rows = [("a", i * 7 % 2600) for i in range(2600)] + [("b", i) for i in range(1500)] + [(None, i) for i in range(1200)] + [("c", 5)]
    df = spark.createDataFrame(rows, "g STRING, o INT")
    got = {(r["g"], r["o"], r["pos"]) for r in first_n(df, ["g"], [F.col("o")], 2144).collect()}
    want = set()
    for g in ("a", "b", None, "c"):
        ordered = sorted(o for k, o in rows if k == g)[:2144]
        want |= {(g, o, i + 1) for i, o in enumerate(ordered)}
    assert got == want
