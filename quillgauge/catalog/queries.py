"""Registered queries: one or more per operator, all over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgauge.catalog import inputs
from quillgauge.functions import text as t
from quillgauge.operators import batching, budget, code, gate, messages, rewrite
from quillgauge.operators.scale import durable, first_n
from quillgauge.plans import generate as gen
from quillgauge.plans import rewrite as rewriting
from quillgauge.plans import route
from quillgauge.plans import summarize
from quillgauge.sources import changelog, exclusions, report, tree

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ["project", "path"]


def _big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


# --- inputs made of other inputs --------------------------------------------------------


def listed_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    """Exclusion lists kept by the documents' owners: one list object per document."""
    docs = inputs.table(spark, sf, "documents")
    part = F.concat(F.lit("mod"), F.col("doc_id").cast("string"), F.lit(".py"))

    def pair(block: Column) -> Column:
        return F.array(part, block)

    low, high = F.concat(F.lit("f"), (F.col("doc_id") % 5).cast("string")), F.lit("f2")
    return exclusions.exclusion_rows(
        docs.select(
            F.array(pair(low), pair(high)).alias("cyclomatic"), F.array(pair(high)).alias("cognitive")
        )
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Gate runs: each file is a project of its own, in the order of its number."""
    files = inputs.files(spark, sf)
    found = gate.violations(files).select(*KEYS).distinct().withColumn("bad", F.lit(True))
    seq = F.regexp_extract("path", r"mod(\d+)", 1).cast("bigint")
    # Written: what reads the runs twice shall not scan the files twice.
    return durable(files.select(*KEYS).join(found, KEYS, "left").select(
        F.col("project").alias("run"), F.col("path").alias("project"), seq.alias("seq"),
        F.col("bad").isNull().alias("passed"),
    ))


def units(spark: SparkSession, sf: str) -> DataFrame:
    return batching.weighted(budget.compact(inputs.changes(spark, sf)))


def batches(spark: SparkSession, sf: str) -> DataFrame:
    return batching.assign_batches(units(spark, sf))


def log_text(spark: SparkSession, sf: str) -> DataFrame:
    """Change log lines as text, as a version-control tool prints them."""
    tab = F.lit("\t")
    shown = lambda n: F.when(F.col("is_binary"), "-").otherwise(F.col(n).cast("string"))
    moved = F.when(F.col("status").startswith("R"), F.concat(tab, F.lit("old/"), "path")).otherwise("")
    return inputs.changes(spark, sf).select(
        "repo", "path", "untracked", "size",
        F.concat(shown("added"), tab, shown("deleted"), tab, "path").alias("numstat"),
        F.concat(F.col("status"), moved, tab, "path").alias("name_status"),
    )


def judged(spark: SparkSession, sf: str) -> DataFrame:
    return messages.judged(inputs.attempts(spark, sf), F.lit("loader"))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """JSON envelopes of the attempts, some empty, foreign or broken."""
    text = F.concat(F.lit("item "), F.col("item_id").cast("string"))
    kind = (F.col("item_id") + F.col("attempt_no")) % 6
    quoted = lambda head, tail: F.concat(F.lit(head), text, F.lit(tail))
    json = (
        F.when(kind == 0, quoted('{"message":{"content":"', '"}}'))
        .when(kind == 1, quoted('{"response":"', '"}'))
        .when(kind == 2, quoted('{"result":"', '"}'))
        .when(kind == 3, '{"response":""}')
        .when(kind == 4, "{}")
        .otherwise(quoted("not json ", ""))
    )
    return inputs.attempts(spark, sf).select("item_id", "attempt_no", json.alias("json"))


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    """A replacement for every function; every fourth was made from other content."""
    files = inputs.files(spark, sf)
    sha = F.sha2("content", 256)
    wanted = F.filter("blocks", lambda b: b["kind"].isin("def", "async"))
    blocks = code.with_blocks(files.withColumn("sha", sha)).select(*KEYS, "sha", F.inline(wanted))
    indent = F.when(F.col("parent_line").isNull(), "").otherwise("    ")
    new = F.concat(
        F.lit("def helper(x):\n    if x and x:\n        return x\n\ndef "), F.col("name"),
        F.lit("(self):\n    return helper(self)"),
    )
    return blocks.select(
        *KEYS, "name", F.col("line").alias("block_line"), F.col("start").alias("start_line"),
        F.col("end").alias("end_line"),
        F.when(F.col("line") % 4 == 0, F.sha2(F.col("path"), 256)).otherwise(F.col("sha")).alias("base_sha"),
        t.reindent(new, indent).alias("new_text"),
        F.when(F.col("line") % 2 == 0, "cyclomatic").otherwise("cognitive").alias("metric"),
    )


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Rewrite outcomes of the violations, ranked worst first in their file."""
    worst = gate.worst_per_block(gate.violations(inputs.files(spark, sf)))
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("value").desc(), "block_line"))
    return durable(worst.select(
        *KEYS, "name", "block_line", "value", rank.cast("bigint").alias("rank"),
        (F.col("block_line") % 3 == 0).alias("ok"),
    ))


def stub(prompt: str, system: str) -> str:
    """A pure stand-in for a model: its answer depends on the prompt alone."""
    size = len(prompt)
    if "Function to refactor:" in prompt:
        return "```python\ndef small(self):\n    return self\n```" if size % 3 else "def open(:"
    if size % 7 == 0:
        raise RuntimeError("no answer")
    return ["Update files", f"Handle {size} cases in the reader\n\nThe reader now copes.", "- a/b.py"][size % 3]


# --- code -------------------------------------------------------------------------------


def q_tree_scan(spark, sf):
    found = tree.read_source_tree(spark, inputs.written_tree(spark, sf), project="written")
    return found.select("project", "path", F.sha2("content", 256).alias("sha"), "error").orderBy("path")


def q_raw_lines(spark, sf):
    docs = inputs.table(spark, sf, "documents")
    return code.raw_metrics(docs, ["doc_id"], "text")


def q_raw_files(spark, sf):
    return code.raw_metrics(inputs.files(spark, sf))


def q_lines(spark, sf):
    return code.lines(inputs.files(spark, sf)).withColumns(
        {"line_no": _big("line_no"), "indent": _big("indent")}
    )


def q_tokens(spark, sf):
    found = code.tokens(inputs.table(spark, sf, "documents"), ["doc_id"], "text")
    return found.groupBy("token", "is_operand").agg(F.count("*").alias("n"), F.max("pos").cast("bigint").alias("last_pos"))


def q_halstead(spark, sf):
    docs = inputs.table(spark, sf, "documents")
    return _rounded(code.halstead(docs, ["doc_id"], "text"), ["doc_id"])


def q_halstead_files(spark, sf):
    return _rounded(code.halstead(inputs.files(spark, sf)), KEYS)


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(
        *keys, "h1", "h2", F.col("N1").alias("n1_total"), F.col("N2").alias("n2_total"),
        F.round("volume", 3).alias("volume"), F.round("difficulty", 3).alias("difficulty"),
        F.round("effort", 1).alias("effort"),
    )


def q_maintainability(spark, sf):
    return code.maintainability_inputs(inputs.files(spark, sf)).select(
        *KEYS, "score", F.col("raw.sloc").alias("sloc"), F.round("hal.volume", 3).alias("volume"),
        F.round(code.maintainability_index(), 4).alias("mi"),
        F.round(code.maintainability_index(False), 4).alias("mi_plain"),
    )


def q_blocks(spark, sf):
    return code.blocks(inputs.files(spark, sf))


def q_cyclomatic(spark, sf):
    return code.cyclomatic(code.blocks(inputs.files(spark, sf)))


def q_cognitive(spark, sf):
    return code.cognitive(code.blocks(inputs.files(spark, sf)))


def q_gate(spark, sf):
    return gate.rank_worst(gate.violations(inputs.files(spark, sf)))


def q_union(spark, sf):
    # Both metrics and the sort read the functions' scores, which are written once.
    blocks = durable(gate.kinds(code.blocks(inputs.files(spark, sf)), "def", "async"))
    both = gate.union_metrics(code.cyclomatic(blocks), code.cognitive(blocks, ("def", "async")))
    return gate.report_order(gate.over_limit(both, 20))


def q_top_worst(spark, sf):
    return gate.top_worst(gate.violations(inputs.files(spark, sf)), 25)


def q_exclusions(spark, sf):
    return gate.violations(inputs.files(spark, sf), listed_exclusions(spark, sf))


def q_path_filters(spark, sf):
    files = inputs.files(spark, sf).select(*KEYS)
    kept = gate.drop_if_all_segments(gate.drop_ignored(files), ["core", "io"])
    return kept.select(
        *KEYS, t.top_dir(F.col("path")).alias("top"), t.parent_dir(F.col("path")).alias("parent"),
        F.size(t.segments(t.norm_path(F.col("path")))).cast("bigint").alias("depth"),
    )


def q_text_paths(spark, sf):
    rows = inputs.changes(spark, sf).select("repo", "path")
    return gate.text_files(rows).select(
        "repo", "path", t.parent_dir(F.col("path")).alias("parent"), t.top_dir(F.col("path")).alias("top")
    )


def q_located(spark, sf):
    # Read on both sides of the join: the blocks, not the files, are written.
    blocks = durable(code.blocks(inputs.files(spark, sf)))
    return gate.located(gate.over_limit(code.cyclomatic(blocks), 3), blocks).select(*gate.BLOCK_KEY, "value", "located")


def q_block_lines(spark, sf):
    return code.lines_of_blocks(
        inputs.files(spark, sf), lambda b: b["kind"].isin("def", "async") & (b["total"] > 15)
    )


def q_with_class(spark, sf):
    return code.functions_in_classes(inputs.files(spark, sf))


def q_siblings(spark, sf):
    found = code.functions_in_classes(inputs.files(spark, sf), 5)
    return found.select(*gate.BLOCK_KEY, F.inline(F.transform("siblings", lambda s: s)))


def q_statements(spark, sf):
    """Imports, constants and init attributes: three parts from one scan of the files."""
    return code.statements(inputs.files(spark, sf)).select(*KEYS, "part", _big("pos"), "raw")


def q_context(spark, sf):
    found = code.targets(inputs.files(spark, sf)).filter(F.col("kind") != "class")
    return found.select(
        *gate.BLOCK_KEY, "metric", "value", F.sha2("source", 256).alias("source_sha"), "context"
    )


def q_gate_summary(spark, sf):
    files = inputs.files(spark, sf)
    return gate.gate_summary(files, gate.violations(files, limit=28))


def q_rollup(spark, sf):
    return gate.project_rollup(runs(spark, sf))


def q_project_status(spark, sf):
    return gate.project_status(runs(spark, sf))


def q_stop_on_error(spark, sf):
    return gate.stop_on_error(runs(spark, sf))


def q_unrun(spark, sf):
    return gate.unrun_counts(runs(spark, sf))


def q_report(spark, sf):
    # Scores and line counts come from one scan; what it found is written, for the sort reads it twice.
    measured = durable(code.measured(inputs.files(spark, sf)))
    listed = F.when(F.col("metric") == "cyclomatic", report.report_line("cc"))
    failed = F.when(F.col("value") > 15, report.report_line("check"))
    # Both reports of a block come from its one row.
    blocks = gate.scores_of(code.block_rows(measured)).select("path", F.explode(F.array_compact(F.array(listed, failed))).alias("line"))
    raw = report.render_report(measured.select(*KEYS, "raw.*"), "raw").select("path", "line")
    return blocks.unionByName(raw).orderBy("path", "line")


def q_quarantine(spark, sf):
    text = t.unwrap_response(F.col("json"), "$.response")
    _, bad = gate.split_good_bad(responses(spark, sf), text["error"])
    return bad.select("item_id", "attempt_no", "reason")


def broken_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files, of which three in ten were spoilt in one of three ways."""
    number = F.regexp_extract("path", r"mod(\d+)", 1).cast("bigint") % 10
    spoilt = (
        F.when(number == 0, F.concat("content", F.lit("\n)\n")))
        .when(number == 1, F.concat(F.lit("Sorry, this file was removed\n"), "content"))
        .when(number == 2, F.concat("content", F.lit("\nx = 'open\n"))).otherwise(F.col("content"))
    )
    return inputs.files(spark, sf).withColumn("content", spoilt)


def q_quarantine_files(spark, sf):
    """One pass: each file is checked once and tagged; a skipped file keeps its row with a reason and no metrics."""
    tagged = gate.tag_parsable(broken_files(spark, sf), facts="facts")
    measured = code.raw_metrics(tagged, [*KEYS, "reason"], facts="facts")
    return measured.select(*KEYS, "reason", F.when(F.col("reason").isNull(), F.col("loc")).alias("loc"))


# --- changes ----------------------------------------------------------------------------


def q_changes(spark, sf):
    lines = log_text(spark, sf)
    tracked = changelog.parse_numstat(
        lines.filter(~F.col("untracked")).select("repo", "size", F.col("numstat").alias("value"))
    )
    untracked = lines.filter("untracked").select("repo", "path", "size")
    return batching.change_units(tracked, untracked)


def q_name_status(spark, sf):
    lines = log_text(spark, sf).filter(~F.col("untracked"))
    parsed = changelog.parse_name_status(
        lines.select("repo", "size", F.col("name_status").alias("value"))
    )
    return batching.distinct_paths(parsed, ["repo", "status"], "size").select("repo", "status", "path", "size")


def q_large(spark, sf):
    return batching.is_large(units(spark, sf))


def q_batches(spark, sf):
    return batches(spark, sf).select("repo", "path", "weight", "batch_id", _big("batch_pos"), _big("batch_n"))


def q_halves(spark, sf):
    return batching.halve(batches(spark, sf)).select("repo", "path", "batch_id", _big("half"))


def q_scope(spark, sf):
    rows = batches(spark, sf)
    one = rows.filter(F.col("batch_id") == 1).select("repo", "path")
    return batching.scope(inputs.changes(spark, sf), one).select("repo", "path", "status")


def q_modal_dir(spark, sf):
    return batching.modal_top_dir(inputs.changes(spark, sf), ["repo"])


def q_excerpts(spark, sf):
    rows = batches(spark, sf).filter(~F.col("untracked"))
    return budget.pack_excerpts(rows, ["repo", "batch_id"])


def q_untracked(spark, sf):
    rows = budget.compact(inputs.changes(spark, sf).filter("untracked"))
    return budget.untracked_snippets(rows, ["repo"]).select("repo", "untracked_note", "n_untracked")


def q_capped_paths(spark, sf):
    return budget.cap_per_group(inputs.changes(spark, sf), ["repo"], ["path"], 30).select("repo", "path")


def q_capped_body(spark, sf):
    lines = inputs.changes(spark, sf).select(
        "repo", "path", F.concat(F.lit("Handle "), "path", F.lit(" again")).alias("item")
    )
    return budget.cap_list(lines, ["repo"], "path", "item")


def _bundles(spark, sf):
    return messages.bundles(durable(batches(spark, sf)), ["repo", "batch_id"])


def q_bundle(spark, sf):
    return _bundles(spark, sf).select(
        "repo", "batch_id", *[
            messages.render_bundle(level).alias(level.replace("-", "_"))
            for level in ("full", "lite", "paths-only")
        ],
    )


def q_fallbacks(spark, sf):
    args = [F.col(c) for c in ("repo", "name_status", "diff_stat", "untracked_note")]
    plain = [F.col("repo"), F.regexp_replace("name_status", r"\.[A-Za-z]+", ""), F.lit(""), F.lit("")]
    return _bundles(spark, sf).select(
        "repo", "batch_id", t.fallback_message(*args).alias("message"),
        t.fallback_summary(*args, F.col("modal_dir")).alias("summary"),
        t.fallback_summary(*plain, F.col("modal_dir")).alias("plain_summary"),
    )


def q_prompts(spark, sf):
    bundle = messages.render_bundle("lite")
    none = F.lit(None).cast("string")
    prompts = {
        "user": t.user_prompt(F.col("repo"), bundle, none),
        "repair": t.user_prompt(F.col("repo"), bundle, F.lit("subject is too generic")),
        "summary": t.summary_prompt(F.col("repo"), bundle),
    }
    return _bundles(spark, sf).select(
        "repo", "batch_id", *[F.sha2(c, 256).alias(n) for n, c in prompts.items()]
    )


# --- messages ---------------------------------------------------------------------------


def q_clean(spark, sf):
    raw = F.col("raw")
    return inputs.attempts(spark, sf).select(
        "item_id", "attempt_no", t.strip_reasoning(raw).alias("spoken"),
        t.normalize_message(raw).alias("message"),
        t.first_line(t.normalize_message(raw)).alias("subject"),
        t.truncate(raw, 120).alias("cut"),
    )


def q_summary_clean(spark, sf):
    lines = inputs.attempts(spark, sf).withColumn("line", t.clean_summary_line(F.col("raw")))
    return lines.select(
        "item_id", "attempt_no", "line",
        t.summary_problem(F.col("line"), F.lit("loader")).alias("problem"),
    )


def q_fence(spark, sf):
    return inputs.attempts(spark, sf).select("item_id", "attempt_no", t.first_fence(F.col("raw")).alias("code"))


def q_dedupe(spark, sf):
    lines = inputs.attempts(spark, sf).select(
        (F.col("item_id") % 50).alias("scope"), (F.col("item_id") * 100 + F.col("attempt_no")).alias("seq"),
        t.first_line(F.col("raw")).alias("line"),
    )
    return messages.dedupe_keep_first(lines, ["scope"], "seq", "line").select("scope", "seq", "line")


def q_quality(spark, sf):
    return judged(spark, sf).select(
        "item_id", "attempt_no", "problem",
        t.is_generic_subject(t.first_line(F.col("message")), F.lit("loader")).alias("generic"),
        t.is_path_dump(t.first_line(F.col("raw"))).alias("dump"),
    )


def q_first_acceptable(spark, sf):
    fallback = t.fallback_message(F.lit("loader"), F.lit("M\tsrc/a.py"), F.lit(""), F.lit(""))
    return messages.first_acceptable(judged(spark, sf), "item_id", fallback)


def q_envelope(spark, sf):
    rows = responses(spark, sf)
    parts = {"content": "$.message.content", "response": "$.response", "result": "$.result"}
    columns = []
    for name, path in parts.items():
        both = t.unwrap_response(F.col("json"), path)
        columns += [both["text"].alias(f"{name}_text"), both["error"].alias(f"{name}_error")]
    return rows.select("item_id", "attempt_no", *columns)


def q_requests(spark, sf):
    rows = inputs.attempts(spark, sf)
    chat = t.chat_request("m", F.lit("be brief"), F.col("raw"), 0.3, 32768)
    plain = t.completion_request("m", F.lit("be brief"), F.col("raw"), 0.2, 896)
    both = rows.select("item_id", "attempt_no", chat.alias("chat"), plain.alias("plain"))
    got = lambda c, p: F.get_json_object(c, p)
    return both.select(
        "item_id", "attempt_no",
        got("chat", "$.messages[1].content").alias("chat_prompt"),
        got("chat", "$.messages[0].role").alias("chat_role"),
        got("chat", "$.options.num_predict").cast("bigint").alias("chat_tokens"),
        got("plain", "$.prompt").alias("plain_prompt"),
        got("plain", "$.stream").alias("plain_stream"),
        got("plain", "$.options.temperature").cast("double").alias("plain_temperature"),
    )


# --- rewriting --------------------------------------------------------------------------


def q_rewrite_prompts(spark, sf):
    found = code.targets(inputs.files(spark, sf)).filter(F.col("kind") != "class")
    scores = F.array(F.struct(F.col("name"), F.col("value")), F.struct(F.lit("ok").alias("name"), F.lit(1).cast("bigint").alias("value")))
    feedback = t.retry_feedback(F.col("metric"), scores, 15, F.lit(None).cast("string"))
    prompt = t.rewrite_prompt(
        F.col("source"), F.col("name"), F.col("metric"), F.col("value"), 15, F.col("context"), feedback
    )
    log = t.validation_log(F.col("metric"), scores, 15, F.lit(None).cast("string"))
    return found.select(
        *gate.BLOCK_KEY, "metric", feedback.alias("feedback"), log.alias("log"),
        F.sha2(prompt, 256).alias("prompt_sha"), F.sha2(t.rewrite_system(F.col("metric")), 256).alias("system_sha"),
    )


def q_reindent(spark, sf):
    """Every function's own text, moved to an indent of two."""
    files = inputs.files(spark, sf)
    wanted = F.filter("blocks", lambda b: b["kind"].isin("def", "async"))
    # The text is cut inside the file's row: beside each function, the file's lines would be copied as often.
    parts = t.bound(F.split("content", "\n"), lambda lines: F.transform(wanted, lambda b: F.struct(
        b["name"].alias("name"), b["line"].alias("block_line"),
        F.array_join(F.slice(lines, b["start"], b["end"] - b["start"] + 1), "\n").alias("part"))))
    return code.with_blocks(files).select(*KEYS, F.inline(parts)).select(
        *KEYS, "name", "block_line", F.length(t.detect_indent(F.col("part"))).cast("bigint").alias("indent"),
        F.sha2(t.reindent(F.col("part"), F.lit("  ")), 256).alias("sha"),
    )


def q_splice(spark, sf):
    files = inputs.files(spark, sf)
    one = first_n(proposals(spark, sf), KEYS, [F.col("block_line")], 1)
    return rewrite.splice(files, one).select(*KEYS, t.content_hash(F.col("content")).alias("sha"))


def q_hash_guard(spark, sf):
    accepted, rejected = rewrite.guard(proposals(spark, sf), inputs.files(spark, sf))
    columns = [*gate.BLOCK_KEY, "reason"]
    return accepted.withColumn("reason", F.lit(None).cast("string")).select(*columns).unionByName(
        rejected.select(*columns)
    )


WRONG_TEXTS = (
    "Sorry, I cannot refactor this.", " ", "return )x(", "def f(x]:\n    return x", "def f(x):\nreturn x", "def f(x):\n    return 'x",
    "def f(x):\n    y = 1\n      z = 2\n    return y",
)


def q_revalidate(spark, sf):
    made = proposals(spark, sf).withColumn(
        "new_text", reduce(
            lambda text, wrong: text.when(F.col("block_line") % 12 == wrong[0], wrong[1]),
            enumerate(WRONG_TEXTS, 1), F.when(F.col("block_line") % 12 == 0, F.concat("new_text", F.lit("("))),
        ).otherwise(F.col("new_text"))
    )
    done = gate.revalidate(made, 2)
    return done.select(
        *gate.BLOCK_KEY, "metric", "ok", "error",
        F.array_join(F.transform("scores", lambda s: F.concat(s["name"], F.lit("="), s["value"].cast("string"))), ",").alias("scores"),
    )


def q_unknown_names(spark, sf):
    """Every proposal judged as applied to its file: parse of the whole file, then unknown names."""
    made = proposals(spark, sf).withColumn("ok", F.lit(True))
    judged = rewrite.applied_problem(made, inputs.files(spark, sf))
    return judged.select(*gate.BLOCK_KEY, "applied", t.check_feedback(F.col("applied")).alias("feedback"))


def q_attempt_order(spark, sf):
    return rewrite.until_success(outcomes(spark, sf), KEYS)


def q_attempt_order_global(spark, sf):
    order = F.struct(-F.col("value"), F.col("path"), F.col("block_line"))
    return rewrite.until_success(outcomes(spark, sf), [], order)


def q_not_modified(spark, sf):
    rows = outcomes(spark, sf)
    return rewrite.not_modified(rows, rows.filter("ok").select(*KEYS).distinct())


def q_rewrite_summary(spark, sf):
    return rewrite.rewrite_summary(rewrite.until_success(outcomes(spark, sf), KEYS), ["project"])


# --- plans (no SQL counterpart) ---------------------------------------------------------


def q_generate(spark, sf):
    prompts = inputs.attempts(spark, sf).select(
        "item_id", "attempt_no", F.col("raw").alias("prompt"), F.lit("").alias("system")
    )
    return gen.generate(prompts, stub).drop("prompt", "system")


def q_escalate(spark, sf):
    return gen.generate_with_escalation(_bundles(spark, sf), stub, ["repo", "batch_id"])


def q_summarize(spark, sf):
    return summarize.summarize_changes(inputs.changes(spark, sf), stub)


def q_messages(spark, sf):
    """One message per repository of all changes, by bundle or by batches as its size says."""
    return route.commit_messages(inputs.changes(spark, sf), stub)


def q_rewrite(spark, sf):
    files, history = rewriting.rewrite_corpus(inputs.files(spark, sf), stub)
    return history


QUERIES: dict[str, Query] = {n: f for n, f in globals().items() if n.startswith("q_")}
