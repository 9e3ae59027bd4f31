"""Gate operators: path filters, limits, exclusions, ranking and summaries of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgauge.functions import code as c
from quillgauge.functions import fixed as v
from quillgauge.functions import grammar
from quillgauge.functions import text as t
from quillgauge.operators import code as ops
from quillgauge.operators.scale import durable, first_n

BLOCK_KEY = ["project", "path", "name", "block_line"]


# --- filters ----------------------------------------------------------------------------


def drop_ignored(files: DataFrame, names: list[str] | None = None, path: str = "path") -> DataFrame:
    """Drop a file when any segment of its path, its name included, is listed."""
    ignored = F.array(*[F.lit(n) for n in (names if names is not None else v.IGNORED_SEGMENTS)])
    return files.filter(~F.arrays_overlap(t.segments(F.col(path)), ignored.cast("array<string>")))


def drop_if_all_segments(files: DataFrame, names: list[str], path: str = "path") -> DataFrame:
    """Drop a file when every listed segment is in its path; no names, no filter."""
    if not names:
        return files
    listed = F.array(*[F.lit(n) for n in names])
    return files.filter(F.size(F.array_except(listed, t.segments(F.col(path)))) > 0)


def text_files(files: DataFrame, path: str = "path") -> DataFrame:
    return files.filter(t.is_text_path(F.col(path)))


def over_limit(scores: DataFrame, limit: int = v.MAX_SCORE) -> DataFrame:
    return scores.filter(F.col("value") > limit)


def block_score() -> Column:
    """A class counts by its own code, anything else by its total if it has one."""
    return F.when(F.col("kind") == "class", F.col("own")).otherwise(
        F.coalesce(F.col("total"), F.col("own"))
    )


def kinds(scores: DataFrame, *wanted: str) -> DataFrame:
    return scores.filter(F.col("kind").isin(*wanted))


def split_good_bad(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and the rest with its reason; bad rows are never fatal."""
    marked = df.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(
        F.col("reason").isNotNull()
    )


def unreadable(content: Column) -> Column:
    """Reason a file cannot be scored, or NULL: no text, or text that cannot be code.

    Indents are left out: blocks are measured by them, whatever they are.
    """
    text = c.normalize_breaks(content)
    # A one-element array binds the facts to a name, so that they are computed once.
    facts = F.array(c.line_facts(text, c.blank_text(text)))
    problem = F.element_at(F.transform(facts, lambda f: c.syntax_problem(f, indents=False)), 1)
    return F.when(content.isNull(), "unreadable").otherwise(problem)


def tag_parsable(files: DataFrame, facts: str | None = None) -> DataFrame:
    """The files with `reason`: NULL for those that can be measured, else why not; one check a file, one pass.

    The line facts that the check reads are kept in the column `facts`, if it is named, for what measures the files next.
    """
    if facts is None:
        return files.withColumn("reason", unreadable(F.col("content")))
    content = F.col("content")
    read = files.withColumn("__text", c.normalize_breaks(content)).withColumn(facts, c.line_facts(F.col("__text"), c.blank_text(F.col("__text"))))
    problem = c.syntax_problem(F.col(facts), indents=False)
    return read.withColumn("reason", F.when(content.isNull(), "unreadable").otherwise(problem)).drop("__text")


def split_parsable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that can be measured, and the skipped ones with the reason: one check for every metric."""
    return split_good_bad(files, unreadable(F.col("content")))


# --- violations -------------------------------------------------------------------------


def scores(files: DataFrame, cognitive_kinds: tuple[str, ...] = ("def",)) -> DataFrame:
    """Both metrics of every block from one pass over the files.

    The two rows of a block are an exploded pair, so the corpus is neither read nor scanned
    a second time for the second metric.
    """
    return scores_of(ops.blocks(files), cognitive_kinds)


def scores_of(blocks: DataFrame, cognitive_kinds: tuple[str, ...] = ("def",)) -> DataFrame:
    """Both metrics of each of the rows that `code.blocks` gives."""
    closure = F.coalesce(F.col("parent_kind").isin("def", "async"), F.lit(False))

    def pair(metric: str, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), value.alias("value"))

    both = F.array(
        pair("cyclomatic", F.when(~closure, block_score())),
        pair("cognitive", F.when(F.col("kind").isin(*cognitive_kinds), F.col("cognitive"))),
    )
    reported = F.filter(both, lambda s: s["value"].isNotNull())
    return blocks.select(*BLOCK_KEY, "kind", F.inline(reported))


def union_metrics(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second)


# Length of the grams by which a listed path part meets the paths that may hold it.
GRAM = 4


def _substrings(text: Column, lengths: list[int]) -> Column:
    """Every substring of `text` of each of the given lengths (0 gives the empty one)."""
    n = F.length(text)

    def of(size: int) -> Column:
        if size == 0:
            return F.array(F.lit(""))
        starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: text.substr(i, F.lit(size)))

    return F.array_distinct(F.flatten(F.array(*[of(size) for size in lengths])))


def drop_excluded(violations: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Remove listed blocks: same metric, same name, and the full path holds the listed part.

    A substring index join: a part of GRAM characters or more meets a path only through its
    rarest gram (counted over the paths), a shorter part through itself; each path offers all
    its grams and all its shorter substrings. Only the pairs that share a key are verified with
    `contains`, so no (metric, name) key, however common, pairs all its rows. The violations are
    read three times and written first, so the files they come from are scanned once.
    """
    keys = [*BLOCK_KEY, "metric"]
    violations = durable(violations)
    met = exclusion_candidates(violations, exclusions)
    hit = met.filter(F.contains(F.col("__full"), F.col("part"))).select(*keys).distinct()
    return violations.join(hit, [violations[k].eqNullSafe(hit[k]) for k in keys], "left_anti")


def exclusion_candidates(violations: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Pairs of a violation and a listed part that share (metric, name, gram), before `contains`."""
    full = F.concat_ws("/", F.col("project"), t.norm_path(F.col("path")))
    keys = [*BLOCK_KEY, "metric"]
    paths = violations.select(*keys, full.alias("__full"))
    offered = paths.select("*", F.explode(_substrings(F.col("__full"), list(range(GRAM + 1)))).alias("__gram"))
    listed = exclusions.filter(F.col("part").isNotNull() & F.col("metric").isNotNull() & F.col("block").isNotNull())
    listed = listed.select("metric", "block", "part").distinct()
    seen = paths.select(F.explode(_substrings(F.col("__full"), [GRAM])).alias("__gram")).groupBy("__gram").count()
    long = listed.filter(F.length("part") >= GRAM)
    choices = long.select("*", F.posexplode(_substrings(F.col("part"), [GRAM])).alias("__at", "__gram"))
    choices = choices.join(seen, "__gram", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rarest = choices.groupBy("metric", "block", "part").agg(F.min_by("__gram", F.struct("count", "__at")).alias("__gram"))
    keyed = rarest.unionByName(listed.filter(F.length("part") < GRAM).withColumn("__gram", F.col("part")))
    return offered.join(keyed.withColumnRenamed("block", "name"), ["metric", "name", "__gram"])


def violations(
    files: DataFrame, exclusions: DataFrame | None = None, limit: int = v.MAX_SCORE
) -> DataFrame:
    found = over_limit(scores(files), limit)
    return drop_excluded(found, exclusions) if exclusions is not None else found


def _metric_rank() -> Column:
    return F.when(F.col("metric") == "cyclomatic", 0).otherwise(1)


def worst_first() -> list[Column]:
    return [F.col("value").desc(), _metric_rank(), F.col("project"), F.col("path"), F.col("block_line")]


def worst_per_block(violations: DataFrame) -> DataFrame:
    """One row per block: its highest value, cyclomatic on a tie.

    An aggregation, not a window: the best row is kept map-side, and a block has at most one
    row per metric anyway.
    """
    best = F.max(F.struct(F.col("value"), (-_metric_rank()).alias("r"), F.col("metric")))
    return violations.groupBy(*BLOCK_KEY).agg(best.alias("b")).select(
        *BLOCK_KEY, "b.value", "b.metric"
    )


def rank_worst(violations: DataFrame) -> DataFrame:
    return worst_per_block(violations).orderBy(*worst_first())


def top_worst(violations: DataFrame, n: int = 1) -> DataFrame:
    """The first `n` of the worst-first order, as a top-k instead of a full sort."""
    return worst_per_block(violations).orderBy(*worst_first()).limit(n)


def report_order(violations: DataFrame) -> DataFrame:
    return violations.orderBy("path", "block_line")


# --- joins on blocks --------------------------------------------------------------------


def locate(violations: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Violations with the place of their function, and those that name no function."""
    functions = blocks.filter(F.col("kind").isin("def", "async")).select(
        *BLOCK_KEY, "start_line", "end_line", "parent_line"
    )
    found = violations.join(functions, BLOCK_KEY)
    return found, violations.join(functions, BLOCK_KEY, "left_anti")


def located(violations: DataFrame, blocks: DataFrame) -> DataFrame:
    """All violations with the place of their function, `located` false where they name none: one join."""
    functions = blocks.filter(F.col("kind").isin("def", "async")).select(
        *BLOCK_KEY, "start_line", "end_line", "parent_line", F.lit(True).alias("located")
    )
    return violations.join(functions, BLOCK_KEY, "left").withColumn("located", F.coalesce("located", F.lit(False)))


def block_lines(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines of each block, from its first decorator on.

    Each block is expanded to its line numbers, which makes the interval an equality on
    (path, line): the join spreads over lines and never pairs all lines of a path with all
    of its blocks.
    """
    numbers = blocks.select(
        "project", "path", "name", "block_line",
        F.explode(F.sequence("start_line", "end_line")).alias("line_no"),
    )
    return numbers.join(
        lines.select("project", "path", "line_no", "raw"), ["project", "path", "line_no"]
    )


def with_class(blocks: DataFrame) -> DataFrame:
    """Each function with its class, NULL outside one; only direct members count."""
    classes = blocks.filter(F.col("kind") == "class").select(
        "project", "path", F.col("block_line").alias("parent_line"),
        F.col("name").alias("class_name"),
    )
    functions = blocks.filter(F.col("kind").isin("def", "async"))
    return functions.join(classes, ["project", "path", "parent_line"], "left")


def siblings(blocks: DataFrame, limit: int = v.MAX_SIBLINGS) -> DataFrame:
    """For each method, the first `limit` other methods of its class.

    The first `limit` + 1 members of a class hold every method's answer, so only those are
    joined back and a class of many methods is not paired with itself.
    """
    of_class = ["project", "path", "parent_line"]
    methods = blocks.filter(
        F.col("kind").isin("def", "async") & (F.col("parent_kind") == "class")
    ).select(*of_class, "name", "block_line")
    heads = (
        first_n(methods, of_class, [F.col("block_line")], limit + 1)
        .groupBy(*of_class)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(F.col("block_line").alias("line"), F.col("name").alias("sibling"))
                )
            ).alias("members")
        )
    )
    others = F.slice(
        F.filter("members", lambda m: m["line"] != F.col("block_line")), 1, limit
    )
    return methods.join(heads, of_class).select(
        *of_class, "name", "block_line", F.inline(others)
    ).withColumnRenamed("line", "sibling_line")


# --- re-measuring -----------------------------------------------------------------------


def revalidate(
    proposals: DataFrame, limit: int = v.MAX_SCORE, text: str = "new_text", metric: str = "metric"
) -> DataFrame:
    """Adds `scores` of every block in the new text and `ok`: all of them within the limit.

    Each proposal is measured by the metric it names. A text without code, and one that
    cannot be code, fails with the reason in `error`: first the line checks of
    `code.syntax_problem`, then the token recogniser of `grammar`, then, where proposals
    carry the function's `name`, the text must define that function at its lowest level.
    """
    by_metric = {
        "cyclomatic": (
            lambda b: ~F.coalesce(b["parent_kind"].isin("def", "async"), F.lit(False)),
            lambda b: F.when(b["kind"] == "class", b["own"]).otherwise(b["total"]),
        ),
        "cognitive": (lambda b: b["kind"].isin("def", "async"), lambda b: b["cognitive"]),
    }

    def scored(name: str) -> Column:
        wanted, value = by_metric[name]
        return F.transform(
            F.filter("blocks", wanted),
            lambda b: F.struct(b["name"].alias("name"), value(b).alias("value")),
        )

    kept = [F.col(x) for x in proposals.columns if x not in ("scores", "ok", "error", "content")]
    measured = ops.with_blocks(proposals.select(*kept, F.col(text).alias("content")))
    measured = measured.withColumn("__tokens", grammar.tokens(F.col("content")))
    found = F.when(F.col(metric) == "cyclomatic", scored("cyclomatic")).otherwise(scored("cognitive"))
    coded = F.exists("facts", lambda x: x["kind"] == "code")
    defined = F.lit(None).cast("string")
    if "name" in proposals.columns:
        again = F.exists("blocks", lambda b: (b["name"] == F.col("name")) & b["kind"].isin("def", "async") & b["parent_line"].isNull())
        defined = F.when(F.col("name").isNotNull() & ~again, F.lit("the function is not defined again"))
    problem = F.when(
        F.coalesce(coded, F.lit(False)),
        F.coalesce(c.syntax_problem(F.col("facts")), grammar.token_problem("__tokens"), defined),
    ).otherwise("no code")
    rows = measured.select(*kept, found.alias("scores"), problem.alias("error"))
    parsed = F.col("error").isNull()
    return rows.select(
        *kept,
        F.when(parsed, F.col("scores")).otherwise(F.slice("scores", 1, 0)).alias("scores"),
        (parsed & F.coalesce(F.forall("scores", lambda s: s["value"] <= limit), F.lit(False))).alias("ok"),
        "error",
    )


# --- summaries --------------------------------------------------------------------------


def gate_summary(projects: DataFrame, violations: DataFrame) -> DataFrame:
    """Violations per project and metric, zeros shown, with the project's exit status.

    Both counts come from one aggregation, so the violations are derived once.
    """
    names = ("cyclomatic", "cognitive")
    counts = violations.groupBy("project").agg(
        *[F.count_if(F.col("metric") == n).alias(n) for n in names]
    )
    every = projects.select("project").distinct().join(counts, "project", "left")
    shown = F.array(*[
        F.struct(F.lit(n).alias("metric"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n_violations"))
        for n in names
    ])
    failed = sum((F.coalesce(n, F.lit(0)) for n in names), F.lit(0)) > 0
    return every.select(
        "project", F.when(failed, 1).otherwise(0).alias("exit_status"), F.inline(shown)
    ).select("project", "metric", "n_violations", "exit_status")


def project_status(runs: DataFrame) -> DataFrame:
    """PASS or FAIL per project in name order; a project that failed once has failed."""
    return (
        runs.groupBy("run", "project")
        .agg(F.bool_and("passed").alias("passed"))
        .select("run", "project", F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("status"))
        .orderBy("run", "project")
    )


def project_rollup(runs: DataFrame) -> DataFrame:
    """Totals and the exit status of each run over many projects."""
    return (
        runs.groupBy("run", "project")
        .agg(F.bool_and("passed").alias("passed"))
        .groupBy("run")
        .agg(
            F.count("*").alias("total"),
            F.count_if("passed").alias("passed"),
            F.count_if(~F.col("passed")).alias("failed"),
        )
        .withColumn("exit_status", F.when(F.col("failed") > 0, 1).otherwise(0))
    )


def stop_on_error(runs: DataFrame) -> DataFrame:
    """Rows up to and including the run's first failure, and how many were not run.

    The first failure is a minimum kept map-side; no run is sorted or held by one task, and
    the join back is re-planned at run time (broadcast when small, split when skewed).
    """
    failed = F.when(~F.col("passed"), F.col("seq"))
    first = runs.groupBy("run").agg(F.min(failed).alias("first_failed"))
    ran = runs.join(first, "run").filter(
        F.col("first_failed").isNull() | (F.col("seq") <= F.col("first_failed"))
    )
    return ran.drop("first_failed")


def unrun_counts(runs: DataFrame) -> DataFrame:
    """Per run, how many projects a stop at the first failure leaves out."""
    first = runs.groupBy("run").agg(
        F.min(F.when(~F.col("passed"), F.col("seq"))).alias("first_failed")
    )
    late = F.col("first_failed").isNotNull() & (F.col("seq") > F.col("first_failed"))
    return runs.join(first, "run").groupBy("run").agg(
        F.count_if(late).alias("unrun")
    )
