"""Inputs of the registered queries, derived from the given tables.

Each recipe is one SELECT that both Spark and DuckDB run; only the spelling of a few
functions differs (`Dialect`). The recipes work row by row: a document gives one source file
or one changed path, a conversation turn one generated message. No recipe groups, so the
inputs grow with the tables and stay as spread out as they are.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from quillgauge.operators.scale import ensure_checkpoint_dir
from quillgauge.sources.layout import spread


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def regex(self, pattern: str) -> str:
        return f"r'{pattern}'" if self.spark else f"'{pattern}'"

    def replace(self, text: str, pattern: str, by: str) -> str:
        if self.spark:
            return f"regexp_replace({text}, {self.regex(pattern)}, {by})"
        return f"regexp_replace({text}, {self.regex(pattern)}, {by}, 'g')"

    def div(self, a: str, b: int) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"

    def map_split(self, text: str, pattern: str, body: str) -> str:
        """Map `body` (over `u` and the 0-based `i`) over the pieces of a split text."""
        if self.spark:
            return f"transform(split({text}, {self.regex(pattern)}), (u, i) -> {body})"
        return (
            f"list_transform(string_split_regex({text}, {self.regex(pattern)}),"
            f" lambda u, k: {body})"
        )

    @property
    def i(self) -> str:
        return "i" if self.spark else "(k - 1)"

    def join(self, array: str) -> str:
        fn = "array_join" if self.spark else "array_to_string"
        return f"{fn}({array}, chr(10))"


SPARK, DUCK = Dialect(True), Dialect(False)
TRIPLE = '"' * 3


def files_sql(d: Dialect) -> str:
    """One Python-like source file per document: each sentence becomes a line of code.

    Every eleventh sentence opens a function (plain, async, decorated, with a signature over
    three lines, or nested); the others become control lines, assignments, strings, comments,
    multi-line text or blank lines by their length.
    """
    i = d.i
    words = d.replace("lower(trim(u))", ", *", "'&'")
    words = d.replace(words, r"[^\p{L}& ]", "''")
    words = d.replace(words, " +", "'_'")
    expr = d.replace(words, "&_*", "CASE WHEN length(u) % 2 = 0 THEN ' and ' ELSE ' or ' END")
    text = "translate(trim(u), concat('\"', chr(39), chr(92)), '')"
    block = d.div(i, 11)
    base = "(CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 0 END)"
    head = f"({base} + CASE WHEN {block} % 8 = 3 THEN 4 ELSE 0 END)"
    depth = f"({head} + 4 + 4 * least({i} % 11 - 1, {d.div('length(u)', 8)} % 5))"
    pad_h, pad = f"repeat(' ', CAST({head} AS INT))", f"repeat(' ', CAST({depth} AS INT))"
    header = f"""concat(
      CASE WHEN {block} % 5 = 0 THEN concat({pad_h}, '@deco', chr(10)) ELSE '' END, {pad_h},
      CASE WHEN {block} % 4 = 3 THEN 'async def ' ELSE 'def ' END,
      CASE WHEN doc_id % 3 = 0 AND {block} = 1 THEN '__init__' ELSE concat('f', CAST({block} AS STRING)) END,
      CASE WHEN {block} % 6 = 1 THEN concat('(', chr(10), '    self,', chr(10), '):') ELSE '(self):' END)"""
    body = f"""CASE
      WHEN {i} % 11 = 0 THEN {header}
      WHEN length(trim(u)) = 0 THEN ''
      WHEN length(u) % 16 = 12 THEN concat({pad}, '# ', {text})
      WHEN length(u) % 8 = 0 THEN concat({pad}, 'if x', {expr}, ':')
      WHEN length(u) % 8 = 1 THEN concat({pad}, 'for y in x', {expr}, ':')
      WHEN length(u) % 8 = 2 THEN concat({pad}, 'while x', {expr}, ' or done:')
      WHEN length(u) % 8 = 3 THEN concat({pad}, 'self.a', CAST({i} AS STRING), ' = x', {expr})
      WHEN length(u) % 8 = 4 THEN concat({pad}, 'return "', {text}, '"  # if note')
      WHEN length(u) % 8 = 5 THEN concat({pad}, 'call("#if ', chr(92), '"and", ', chr(39), 'or', chr(39),
        ', (x,', chr(10), 'y))')
      WHEN length(u) % 8 = 6 THEN concat({pad}, 'except E: pass; y = 1')
      ELSE concat({pad}, 'z = {TRIPLE}', {text}, chr(10), '  tail if', chr(10), chr(10), '{TRIPLE}.strip()') END"""
    made = d.join(d.map_split("text", "[.\n]", body))
    prefix = f"""concat('import os', chr(10), 'from a import (', chr(10), '    b,', chr(10), '    c,', chr(10), ')',
      chr(10), 'LIMIT_', CAST(doc_id AS STRING), ' = [', chr(10), '    3, 4', chr(10), ']', chr(10), chr(10),
      CASE WHEN doc_id % 3 = 0 THEN concat('class K', CAST(doc_id AS STRING), ':', chr(10), '    {TRIPLE}Doc', chr(10), chr(10),
        '    if text', chr(10), '    {TRIPLE}', chr(10)) ELSE '' END)"""
    return f"""SELECT concat('p', CAST(doc_id % 25 AS STRING)) AS project,
      concat('src/', CASE doc_id % 10 WHEN 0 THEN 'tests/' WHEN 1 THEN 'core/' WHEN 2 THEN 'core/io/'
        ELSE concat(source, '/') END, 'mod', CAST(doc_id AS STRING), '.py') AS path,
      concat({prefix}, {made}, chr(10)) AS content
    FROM documents"""


def changes_sql(d: Dialect) -> str:
    """One changed path per document, in repositories of up to 2000 paths."""
    return f"""SELECT concat(lang, '-', CAST({d.div('doc_id', 2000)} AS STRING)) AS repo,
      concat(CASE WHEN doc_id % 9 = 0 THEN '' ELSE concat(source, '/') END, 'f', CAST(doc_id AS STRING),
        CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.json' WHEN 3 THEN '.PY'
          WHEN 4 THEN '.bin' ELSE '' END) AS path,
      CASE doc_id % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'D' WHEN 2 THEN 'R100' ELSE 'M' END AS status,
      CAST(n_chars % 97 AS INT) AS added, CAST(n_chars % 13 AS INT) AS deleted,
      doc_id % 17 = 0 AS is_binary, doc_id % 11 = 0 AS untracked, n_chars AS size,
      CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END AS diff
    FROM documents"""


def attempts_sql(d: Dialect) -> str:
    """One generated message per conversation turn, in sixteen shapes."""
    subj = "concat('Handle ', CAST(turn AS STRING), ' retries in loader')"
    b = "text"
    nl = "chr(10)"
    return f"""SELECT conv_id AS item_id, turn + 1 AS attempt_no,
      CASE (conv_id * 3 + turn) % 16
        WHEN 0 THEN ''
        WHEN 1 THEN concat({subj}, {nl}, {nl}, repeat('long body ', 400))
        WHEN 2 THEN concat('- ', {subj})
        WHEN 3 THEN repeat('wide ', 30)
        WHEN 4 THEN 'Update files'
        WHEN 5 THEN concat('Here is ', {subj})
        WHEN 6 THEN concat({subj}, {nl}, {nl}, repeat(concat('- one point', {nl}), 7))
        WHEN 7 THEN concat({subj}, {nl}, {nl}, '- src/a.py', {nl}, '- src/b.py')
        WHEN 8 THEN concat({subj}, {nl}, {nl}, 'src/a.py', {nl}, 'src/b.py')
        WHEN 9 THEN concat({subj}, {nl}, {nl}, '1. first')
        WHEN 10 THEN concat({subj}, {nl}, {nl}, '- **Bold** point')
        WHEN 11 THEN concat({subj}, {nl}, {nl}, 'In essence the git output shows more')
        WHEN 12 THEN concat('<think>', {b}, '</think>', {subj}, {nl}, {nl}, {b})
        WHEN 13 THEN concat('```text', {nl}, {subj}, chr(13), {nl}, chr(13), {nl}, {b}, {nl}, '```')
        WHEN 14 THEN concat('  ', {subj}, '.  ', {nl}, {nl}, {b})
        ELSE concat('Intro ```python', {nl}, 'x = 1', {nl}, '``` outro') END AS raw
    FROM conversations"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _derived(spark: SparkSession, sf_dir: str, source: str, sql: str) -> DataFrame:
    return spark.sql(
        sql.replace(f"FROM {source}", "FROM {source}").replace(r"\p{L}", r"\p{{L}}"),
        source=table(spark, sf_dir, source),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "documents", files_sql(SPARK))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "documents", changes_sql(SPARK))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "conversations", attempts_sql(SPARK))


def written_tree(spark: SparkSession, sf_dir: str) -> str:
    """The source files written as real files, by the tasks, below the shared folder."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/tree-{uuid.uuid4().hex}"

    def write(batches):
        system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                system.create_dir(f"{base}/{path}".rsplit("/", 1)[0])
                with system.open_output_stream(f"{base}/{path}") as out:
                    out.write(content.encode())
            yield batch[["path"]]

    written = files(spark, sf_dir).select("path", "content").mapInPandas(write, "path STRING")
    written.write.format("noop").mode("overwrite").save()
    return root
