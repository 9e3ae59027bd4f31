"""Line, token, block and metric tables of a corpus of source files.

Input is `files(project, path, content)`. A file is one row and is measured inside it, so all
operators here are narrow: a scan, expressions, and at most a generator that turns an array
into rows. There is no shuffle and no group that could grow with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgauge.functions import code as c
from quillgauge.functions import fixed as v

KEYS = ["project", "path"]


def with_facts(files: DataFrame) -> DataFrame:
    """Adds `text`, `code` (blanked) and `facts` (one struct per line)."""
    return (
        files.withColumn("text", c.normalize_breaks(F.col("content")))
        .withColumn("code", c.blank_text(F.col("text")))
        .withColumn("facts", c.line_facts(F.col("text"), F.col("code")))
    )


def with_blocks(files: DataFrame) -> DataFrame:
    """Adds `facts` and `blocks` (scored, in line order); the blocks need the blanked text alone."""
    return with_facts(files).withColumn("blocks", c.block_scan("code"))


def lines(files: DataFrame) -> DataFrame:
    """One row per line: number, raw text, blanked code, indent and line flags."""
    shown = F.transform(
        "facts",
        lambda x: F.struct(
            x["ln"].alias("line_no"), x["raw"].alias("raw"), x["code"].alias("code"),
            x["indent"].alias("indent"),
            *[(x["kind"] == k).alias(f"is_{k}") for k in ("blank", "comment", "multi")],
        ),
    )
    return with_facts(files).select(*KEYS, F.inline(shown))


def tokens(texts: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """One row per token with its position and whether it is an operand."""
    rows = texts.select(
        *keys, F.posexplode(c.tokens_of(c.normalize_breaks(F.col(text)))).alias("pos", "token")
    )
    return rows.withColumn("is_operand", c.is_operand(F.col("token")))


def raw_metrics(texts: DataFrame, keys: list[str] = KEYS, text: str = "content", facts: str | None = None) -> DataFrame:
    """Line counts of each text; of its line facts, where a column of the texts (`facts`) has them already."""
    rows = texts if facts else with_facts(texts.select(*keys, F.col(text).alias("content")))
    return rows.select(*keys, c.raw_counts(F.col(facts or "facts")).alias("m")).select(*keys, "m.*")


def halstead(texts: DataFrame, keys: list[str] = KEYS, text: str = "content") -> DataFrame:
    rows = texts.select(*keys, c.tokens_of(c.normalize_breaks(F.col(text))).alias("tokens"))
    return rows.select(*keys, c.halstead_of(F.col("tokens")).alias("m")).select(*keys, "m.*")


def maintainability_inputs(files: DataFrame) -> DataFrame:
    """Line counts (`raw`), Halstead measures (`hal`) and summed block score of each file."""
    return (
        with_facts(files)
        .withColumn("found", c.block_scan("code"))
        .withColumn("tokens", c.tokens_of(F.col("text")))
        .select(
            *KEYS,
            c.raw_counts(F.col("facts")).alias("raw"),
            c.halstead_of(F.col("tokens")).alias("hal"),
            F.aggregate(
                "found", F.lit(0).cast("bigint"), lambda n, b: n + b["own"]
            ).alias("score"),
        )
    )


def maintainability_index(count_multi: bool = True) -> Column:
    """Score over `maintainability_inputs`; `count_multi` counts triple-quoted lines as remarks."""
    remarks = F.col("raw.comments") + (F.col("raw.multi") if count_multi else F.lit(0))
    return c.maintainability_of(
        F.col("hal.volume"), F.col("score"), F.col("raw.sloc"), F.col("raw.loc"), remarks
    )


def maintainability(files: DataFrame, count_multi: bool = True) -> DataFrame:
    """One score per file; its three parts are taken from the file's row, without a join."""
    return maintainability_inputs(files).select(
        *KEYS, F.col("hal.volume").alias("volume"), "score", F.col("raw.sloc").alias("sloc"),
        maintainability_index(count_multi).alias("mi"),
    )


def lines_of_blocks(files: DataFrame, wanted) -> DataFrame:
    """The lines of each block that `wanted` keeps, from its first decorator on.

    A file's row has both its blocks and its lines: a block's lines are a slice, so only
    they are exploded, and nothing is joined or shuffled.
    """
    kept = F.transform(
        F.filter("blocks", wanted),
        lambda b: F.struct(
            b["name"].alias("name"), b["line"].alias("block_line"),
            F.transform(
                F.slice("facts", b["start"], b["end"] - b["start"] + 1),
                lambda x: F.struct(x["ln"].alias("line_no"), x["raw"].alias("raw")),
            ).alias("own_lines"),
        ),
    )
    found = with_blocks(files).select(*KEYS, F.inline(kept))
    return found.select(*KEYS, "name", "block_line", F.inline("own_lines"))


def functions_in_classes(files: DataFrame, siblings: int = 0) -> DataFrame:
    """Each function with the class it is a direct member of (NULL outside one), from its file's row.

    `siblings` names how many other functions of that class to list, in line order.
    """
    functions = F.filter("blocks", lambda b: b["kind"].isin("def", "async"))
    classes = F.filter("blocks", lambda b: b["kind"] == "class")

    def others(b):
        same = F.filter(
            functions,
            lambda o: (o["parent_line"] == b["parent_line"]) & (b["parent_kind"] == "class") & (o["line"] != b["line"]),
        )
        named = F.transform(same, lambda o: F.struct(o["line"].alias("sibling_line"), o["name"].alias("sibling")))
        return F.slice(F.array_sort(named), 1, siblings)

    shown = F.transform(functions, lambda b: F.struct(
        b["name"].alias("name"), b["line"].alias("block_line"),
        F.get(F.transform(F.filter(classes, lambda c: c["line"] == b["parent_line"]), lambda c: c["name"]), F.lit(0)).alias("class_name"),
        *([others(b).alias("siblings")] if siblings else []),
    ))
    return with_blocks(files).select(*KEYS, F.inline(shown))


def blocks(files: DataFrame) -> DataFrame:
    """One row per function and class: place, parent and its own, total and cognitive scores."""
    return block_rows(with_blocks(files))


def measured(files: DataFrame) -> DataFrame:
    """A row per file with its `blocks` and line counts (`raw`), from one scan: what reports of both kinds need."""
    return with_blocks(files).select(*KEYS, "blocks", c.raw_counts(F.col("facts")).alias("raw"))


def block_rows(found: DataFrame) -> DataFrame:
    """The rows of `blocks` from files that have their `blocks` already.

    The generator takes an expression, not the bare array column: for a column Spark would
    add a filter on its size, push it below, and run the whole block scan once more for it.
    """
    shown = F.transform(
        "blocks",
        lambda b: F.struct(
            b["name"].alias("name"), b["kind"].alias("kind"), b["line"].alias("block_line"),
            b["start"].alias("start_line"), b["end"].alias("end_line"),
            *[b[x].alias(x) for x in ("parent_line", "parent_kind", "own", "total", "cognitive")],
        ),
    )
    return found.select(*KEYS, F.inline(shown))


def cyclomatic(blocks: DataFrame) -> DataFrame:
    """Score per reported block: classes by their own code, functions by their total.

    A function inside a function counts in the outer one's total and is no block of its own.
    """
    from quillgauge.operators.gate import block_score

    reported = ~F.coalesce(F.col("parent_kind").isin("def", "async"), F.lit(False))
    return blocks.filter(reported).select(
        *KEYS, "name", "kind", "block_line", block_score().alias("value"),
        F.lit("cyclomatic").alias("metric"),
    )


def cognitive(blocks: DataFrame, kinds: tuple[str, ...] = ("def",)) -> DataFrame:
    """Nesting score per function; the gate takes plain functions, re-measuring async too."""
    return blocks.filter(F.col("kind").isin(*kinds)).select(
        *KEYS, "name", "kind", "block_line", F.col("cognitive").alias("value"),
        F.lit("cognitive").alias("metric"),
    )


def imports(files: DataFrame, limit: int = v.MAX_IMPORT_LINES) -> DataFrame:
    return _statements(files, "import", limit)


def constants(files: DataFrame, limit: int = v.MAX_CONSTANT_LINES) -> DataFrame:
    return _statements(files, "constant", limit)


def _statements(files: DataFrame, kind: str, limit: int) -> DataFrame:
    found = c.top_statements(F.col("facts"), kind, limit)
    return with_facts(files).select(*KEYS, F.posexplode(found).alias("pos", "raw"))


def _init_attributes(limit: int) -> Column:
    """Per class of a file (`facts`, `blocks`): its line, name and the lines of its `__init__`."""
    classes = F.filter("blocks", lambda b: b["kind"] == "class")
    return F.transform(
        classes,
        lambda k: F.struct(
            k["line"].alias("class_line"), k["name"].alias("class_name"),
            c.init_lines(F.col("facts"), F.col("blocks"), k, limit).alias("attrs"),
        ),
    )


def init_attributes(files: DataFrame, limit: int = v.MAX_INIT_LINES) -> DataFrame:
    """Header and attribute lines of each class's `__init__`."""
    rows = with_blocks(files).select(*KEYS, F.inline(_init_attributes(limit)))
    return rows.select(*KEYS, "class_line", "class_name", F.posexplode("attrs").alias("pos", "raw"))


def statements(
    files: DataFrame, imports: int = v.MAX_IMPORT_LINES, constants: int = v.MAX_CONSTANT_LINES, inits: int = v.MAX_INIT_LINES
) -> DataFrame:
    """The lines of `imports`, `constants` and `init_attributes` with their `part`, from one scan of the files."""

    def rows(part: str, lines: Column) -> Column:
        return F.transform(
            F.coalesce(lines, F.array().cast("array<string>")),
            lambda raw, i: F.struct(F.lit(part).alias("part"), i.alias("pos"), raw.alias("raw")))

    found = F.concat(
        rows("import", c.top_statements(F.col("facts"), "import", imports)),
        rows("constant", c.top_statements(F.col("facts"), "constant", constants)),
        F.flatten(F.transform(
            F.coalesce(_init_attributes(inits), F.array().cast("array<struct<class_line:int,class_name:string,attrs:array<string>>>")),
            lambda k: rows("init", k["attrs"]))),
    )
    return with_blocks(files).select(*KEYS, F.inline(found))


def targets(files: DataFrame, limit: int = v.MAX_SCORE) -> DataFrame:
    """Blocks over the limit, per metric; functions come with their text and file context.

    The context is built inside the file's row and only for the functions kept, so file
    texts are neither shuffled nor copied per block. Classes have no text: only functions
    can be rewritten.
    """
    closure = lambda b: F.coalesce(b["parent_kind"].isin("def", "async"), F.lit(False))
    over = {
        "cyclomatic": lambda b: ~closure(b) & (score["cyclomatic"](b) > limit),
        "cognitive": lambda b: (b["kind"] == "def") & (score["cognitive"](b) > limit),
    }
    score = {
        "cyclomatic": lambda b: F.when(b["kind"] == "class", b["own"]).otherwise(b["total"]),
        "cognitive": lambda b: b["cognitive"],
    }

    def chosen(metric: str) -> Column:
        return F.transform(
            F.filter("blocks", over[metric]),
            lambda b: F.struct(
                b["name"].alias("name"), b["kind"].alias("kind"), b["line"].alias("block_line"),
                b["start"].alias("start_line"), b["end"].alias("end_line"),
                b["line"].alias("line"), b["parent_line"].alias("parent_line"),
                score[metric](b).alias("value"), F.lit(metric).alias("metric"),
            ),
        )

    def statements(kind: str, most: int) -> Column:
        return F.when(F.size("chosen") > 0, c.top_statements(F.col("facts"), kind, most))

    staged = (
        with_blocks(files)
        .withColumn("chosen", F.concat(chosen("cyclomatic"), chosen("cognitive")))
        .withColumn("imports", statements("import", v.MAX_IMPORT_LINES))
        .withColumn("constants", statements("constant", v.MAX_CONSTANT_LINES))
    )
    found = F.transform(
        "chosen",
        lambda b: F.struct(
            *[b[x].alias(x) for x in ("name", "kind", "block_line", "start_line", "end_line", "value", "metric")],
            F.when(
                b["kind"] != "class", c.block_text(F.col("facts"), b["start_line"], b["end_line"])
            ).alias("source"),
            F.when(
                b["kind"] != "class",
                c.file_context(F.col("facts"), F.col("blocks"), b, F.col("imports"), F.col("constants")),
            ).alias("context"),
        ),
    )
    return staged.select(*KEYS, F.sha2("content", 256).alias("base_sha"), F.inline(found))
