"""Source-text columns: lexing a file's text and scoring its blocks inside one row.

A file is one row, so everything below is an expression over that row: one regular
expression cuts the text into strings, comments and code, arrays of lines are derived from
it, and one left-to-right walk over the blanked lines, a small Arrow function, finds the blocks.
Nothing is exploded or shuffled to measure a file, whatever the number of files.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgauge.functions import fixed as v
from quillgauge.functions.text import LINE_BREAK, lstrip, rstrip

TEXT_MARK = "\x01"  # stands for triple-quoted text in blanked code

# The loops are possessive or over one character class: Java runs those without recursion,
# so a very long string or line cannot overflow a task's stack.
_TRIPLE = (
    r'"""(?:[^"\\]++|\\[\s\S]|"{1,2}+(?:[^"\\]|\\[\s\S]))*+"""' + "|"
    + r"'''(?:[^'\\]++|\\[\s\S]|'{1,2}+(?:[^'\\]|\\[\s\S]))*+'''"
)
_QUOTED = r'"(?:[^"\\\n]++|\\[\s\S])*+"' + "|" + r"'(?:[^'\\\n]++|\\[\s\S])*+'"
_SEGMENT = "|".join([_TRIPLE, _QUOTED, r"#[^\n]*", r"""[^"'#]+""", r"""["']"""])
_TOKEN = "|".join(
    [_TRIPLE, _QUOTED, r"#[^\n]*", r"[\p{L}_][\p{L}\p{N}_]*", r"\p{N}+", r"[^\s\p{L}\p{N}_]"]
)
NAME = r"[\p{L}_][\p{L}\p{N}_]*"


def normalize_breaks(content: Column) -> Column:
    return F.regexp_replace(content, LINE_BREAK, "\n")


def blank_text(text: Column) -> Column:
    """Strings and comments blanked, line structure kept.

    A quoted string becomes an empty one and a comment its mark. Every line of a string over
    several lines becomes TEXT_MARK, and a line continued by a backslash starts with one.
    """

    def blank(s: Column) -> Column:
        quoted = s.startswith('"') | s.startswith("'")
        long = s.startswith('"""') | s.startswith("'''") | F.contains(s, F.lit("\n"))
        return (
            F.when(quoted & long, F.regexp_replace(s, r"[^\n]+", TEXT_MARK))
            .when(quoted & (F.length(s) > 1), '""')
            .when(s.startswith("#"), "#")
            .otherwise(s)
        )

    segments = F.regexp_extract_all(text, F.lit(_SEGMENT), F.lit(0))
    code = F.array_join(F.transform(segments, blank), "")
    return F.replace(code, F.lit("\\\n"), F.lit("\\\n" + TEXT_MARK))


def raw_lines(text: Column) -> Column:
    """Lines without ends; a final line break opens no further line."""
    parts = F.split(text, "\n")
    n = F.size(parts)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), n - 1)).otherwise(parts)


def _word(options: list[str]) -> str:
    """One of the words, not as a part of a longer name; the first letter is tested first."""
    first = "".join(sorted({w[0] for w in options}))
    return rf"(?=[{first}])(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(options)})(?![\p{{L}}\p{{N}}_])"


_DECISION = _word(v.DECISION_WORDS)
_MARK = r"[(\[{}\]);#]|" + _DECISION


def line_facts(text: Column, code: Column) -> Column:
    """ARRAY<STRUCT> with one element per line.

    `kind` is blank, comment, multi or code; `cont` marks a line that starts inside
    triple-quoted text; `delta` is opened minus closed brackets; `semis` counts `;`;
    `decisions` are the line's decision words in order.
    """
    raws = raw_lines(text)
    # Both texts have the same line breaks; a final one opens no further line.
    paired = F.filter(
        F.arrays_zip(raws.alias("raw"), F.split(code, "\n").alias("code")),
        lambda x: x["raw"].isNotNull(),
    )

    def stage(x: Column, i: Column) -> Column:
        return F.struct(
            (i + 1).alias("ln"), x["raw"].alias("raw"), x["code"].alias("code"),
            lstrip(x["raw"]).alias("lead"), lstrip(x["code"]).alias("body"),
            F.regexp_extract_all(x["code"], F.lit(_MARK), F.lit(0)).alias("marks"),
        )

    def fact(x: Column) -> Column:
        kind = (
            F.when(x["lead"] == "", "blank")
            .when(x["body"].startswith("#"), "comment")
            .when(x["body"].startswith(TEXT_MARK) & (rstrip(x["body"]) == TEXT_MARK), "multi")
            .otherwise("code")
        )

        def n(*marks: str) -> Column:
            return F.when(F.size(x["marks"]) == 0, 0).otherwise(F.size(F.filter(x["marks"], lambda m: m.isin(*marks))))

        return F.struct(
            x["ln"].alias("ln"), x["raw"].alias("raw"), x["code"].alias("code"),
            (F.length(x["raw"]) - F.length(x["lead"])).alias("indent"), kind.alias("kind"),
            x["body"].startswith(TEXT_MARK).alias("cont"),
            (n("(", "[", "{") - n(")", "]", "}")).alias("delta"), n(";").alias("semis"),
            (n("#") > 0).alias("noted"),
            F.filter(x["marks"], lambda m: m.isin(v.DECISION_WORDS)).alias("decisions"),
        )

    return F.transform(F.transform(paired, stage), fact)


def raw_counts(facts: Column) -> Column:
    """STRUCT of the line counts of one file; sloc + comment-only + blank + multi = loc."""

    def n(kind: str) -> Column:
        return F.size(F.filter(facts, lambda x: x["kind"] == kind)).cast("bigint")

    logical = F.aggregate(
        F.filter(facts, lambda x: x["kind"] == "code"),
        F.struct(F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("n")),
        lambda s, x: F.struct(
            (s["depth"] + x["delta"]).alias("depth"),
            (
                s["n"] + F.when((s["depth"] <= 0) & ~x["cont"], 1).otherwise(0) + x["semis"]
            ).cast("bigint").alias("n"),
        ),
        lambda s: s["n"],
    )
    return F.struct(
        F.size(facts).cast("bigint").alias("loc"),
        logical.alias("lloc"),
        n("code").alias("sloc"),
        F.size(F.filter(facts, lambda x: x["noted"])).cast("bigint").alias("comments"),
        n("comment").alias("comment_only"),
        n("blank").alias("blank"),
        n("multi").alias("multi"),
    )


def tokens_of(text: Column) -> Column:
    """Tokens in order; comments are dropped, a string is one token."""
    found = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.startswith("#"))


def is_operand(token: Column) -> Column:
    """Names, numbers and strings; keywords and punctuation are operators."""
    named = token.rlike(r"^[\p{L}\p{N}_]") & ~token.isin(v.KEYWORDS)
    return named | ((token.startswith('"') | token.startswith("'")) & (F.length(token) > 1))


def halstead_of(tokens: Column) -> Column:
    """STRUCT of Halstead's counts and measures; 0 where a divisor or the vocabulary is 0."""
    operands = F.filter(tokens, is_operand)
    h2, n2 = F.size(F.array_distinct(operands)), F.size(operands)
    h1 = F.size(F.array_distinct(tokens)) - h2
    n1 = F.size(tokens) - n2
    counts = F.struct(
        *[c.cast("bigint").alias(n) for c, n in [(h1, "h1"), (h2, "h2"), (n1, "N1"), (n2, "N2")]]
    )
    # A one-element array binds the counts to a name, so that they are computed once.
    return F.element_at(F.transform(F.array(counts), _halstead_measures), 1)


def _halstead_measures(c: Column) -> Column:
    volume = F.when(
        c["h1"] + c["h2"] > 0, (c["N1"] + c["N2"]) * F.log2((c["h1"] + c["h2"]).cast("double"))
    ).otherwise(F.lit(0.0))
    difficulty = F.when(
        c["h2"] > 0, (c["h1"] / 2.0) * (c["N2"].cast("double") / c["h2"])
    ).otherwise(F.lit(0.0))
    return F.struct(
        c["h1"].alias("h1"), c["h2"].alias("h2"), c["N1"].alias("N1"), c["N2"].alias("N2"),
        volume.alias("volume"), difficulty.alias("difficulty"),
        (volume * difficulty).alias("effort"),
    )


def maintainability_of(
    volume: Column, score: Column, sloc: Column, loc: Column, remarks: Column
) -> Column:
    """0..100 from volume, summed block score, code lines and the share of remark lines."""
    share = F.when(loc > 0, remarks / loc).otherwise(F.lit(0.0))
    value = (
        171.0 - 5.2 * F.log(volume) - 0.23 * score - 16.2 * F.log(sloc.cast("double"))
        + 50.0 * F.sin(F.sqrt(2.4 * share))
    ) * (100.0 / 171.0)
    return F.when((volume <= 0) | (sloc <= 0), F.lit(100.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))
    )


# --- blocks -----------------------------------------------------------------------------


BLOCK = (
    "STRUCT<line INT, start INT, end INT, name STRING, kind STRING, parent_line INT,"
    " parent_kind STRING, own BIGINT, total BIGINT, cognitive BIGINT>"
)
_BLOCK_TYPES = {
    "line": pa.int32(), "start": pa.int32(), "end": pa.int32(), "name": pa.string(), "kind": pa.string(), "parent_line": pa.int32(),
    "parent_kind": pa.string(), "own": pa.int64(), "total": pa.int64(), "cognitive": pa.int64(),
}
# Python's `\w` is `[\p{L}\p{N}_]`; white space is that of the expressions above.
_BLANK = r"[ \t\x0b\f\r]"
_LINE_START = re.compile(rf"{_BLANK}*(?:@|(?:{'|'.join([*v.CONTROL_WORDS, 'def', 'class', 'async'])})(?!\w))")
_HEADED = re.compile(rf"{_BLANK}*(async{_BLANK}+def|def|class){_BLANK}+(\w+)")
_LINE_MARK = re.compile(rf"[()\[\]{{}}]|(?<!\w)(?:{'|'.join(v.DECISION_WORDS)})(?!\w)")


def _scan_blocks(code: str) -> list[tuple]:
    """The blocks of one blanked text, in line order: one walk over its lines with a stack of open blocks.

    A block stores the running counts at its header, so its totals are differences; its own
    decisions are those since its header but for those of the blocks inside it.
    """
    done, blocks, controls = [], [], []  # finished and open blocks, indents of open control lines
    depth = last = decisions = heads = control_sum = runs = control_n = 0
    deco, deco_indent, before = None, 0, ""

    def close(b: list) -> None:
        line, start, _, name, kind, parent, inside, dec0, heads0, nest, sum0, n0, runs0 = b
        own = 1 + decisions - dec0 - inside
        total = 1 + decisions - dec0 + heads - heads0 - (own if kind == "class" else 0)
        cognitive = control_sum - sum0 - nest * (control_n - n0) + runs - runs0
        done.append((line, start, last, name, kind, parent and parent[0], parent and parent[4], own, total, cognitive))
        if parent:
            parent[6] += decisions - dec0

    for ln, x in enumerate(code.split("\n"), 1):
        body, continued, before = x.lstrip(), before.endswith("\\"), x
        # A blank line after a backslash holds the mark alone.
        if not body or body[0] == "#" or (continued and not body[1:].strip()):
            continue
        cont = body[0] == TEXT_MARK
        marks = _LINE_MARK.findall(x)
        if not (cont or depth > 0):
            indent = len(x) - len(body)
            while blocks and blocks[-1][2] >= indent:
                close(blocks.pop())
            while controls and controls[-1] >= indent:
                controls.pop()
            leading = _LINE_START.match(x)
            word = leading.group().strip() if leading else ""
            if word in ("def", "class", "async"):
                header = _HEADED.match(x)
                if header and (header[2][0] == "_" or header[2][0].isalpha()):
                    heads += 1
                    start = deco if deco is not None and deco_indent == indent else ln
                    blocks.append([
                        ln, start, indent, header[2], word, blocks[-1] if blocks else None, 0, decisions, heads,
                        len(controls), control_sum, control_n, runs,
                    ])
            elif word in v.CONTROL_WORDS:
                controls.append(indent)
                control_sum, control_n = control_sum + len(controls), control_n + 1
            if word == "@":
                deco, deco_indent = deco if deco is not None and deco_indent == indent else ln, indent
            else:
                deco = None
        last, joined = ln, ""
        for m in marks:
            if m in "([{":
                depth += 1
            elif m in ")]}":
                depth -= 1
            else:
                decisions += 1
                # A word that differs from the one before it starts a new run, and so does the first.
                if m in v.BOOLEAN_WORDS and m != joined:
                    runs, joined = runs + 1, m
    while blocks:
        close(blocks.pop())
    return sorted(done)


def _blocks_of(code: pa.Array) -> pa.Array:
    offsets, rows = [0], []
    found = [None if t is None else _scan_blocks(t) for t in code.to_pylist()]
    for blocks in found:
        rows.extend(blocks or [])
        offsets.append(len(rows))
    columns = list(zip(*rows, strict=True)) or [[] for _ in _BLOCK_TYPES]
    fields = [pa.array(c, kind) for c, kind in zip(columns, _BLOCK_TYPES.values(), strict=True)]
    gone = pa.array([blocks is None for blocks in found], pa.bool_())
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, names=list(_BLOCK_TYPES)), mask=gone)


def block_scan(code: str) -> Column:
    """ARRAY<BLOCK> of a file from its column of blanked text (`blank_text`), in line order.

    A block ends before the next logical line that is not indented deeper than its header;
    trailing blank and comment lines belong to no block.
    """
    return F.arrow_udf(_blocks_of, f"ARRAY<{BLOCK}>")(F.col(code))


_OPERATORS = "and|or|not|in|is|if|else|for|as|import|from|async|await|lambda|with"
_FIRST = rf"(?:{'|'.join([*v.KEYWORDS, 'match', 'case', 'type', 'print'])})"
# Two names, or a name and a number, side by side, none of which is a word of the language.
_PROSE = (
    rf"(?<![\p{{L}}\p{{N}}_.])(?!{_FIRST}(?![\p{{L}}\p{{N}}_])){NAME}[ \t]+"
    rf"(?!(?:{_OPERATORS})(?![\p{{L}}\p{{N}}_]))[\p{{L}}\p{{N}}_]"
)
_NEEDS_COLON = r"^\s*(?:(?:async\s+)?(?:def|for|with)|class|if|elif|else|while|try|except|finally)(?![\p{L}\p{N}_])"


def _brackets(facts: Column) -> Column:
    """Brackets left open at the end, in order; `!` after a bracket that closes no open one of its kind."""
    marks = F.regexp_extract_all(F.array_join(F.transform(facts, lambda x: x["code"]), " "), F.lit(r"[()\[\]{}]"), F.lit(0))

    def step(s: Column, m: Column) -> Column:
        return (
            F.when(s.startswith("!"), s).when(m.isin("(", "[", "{"), F.concat(s, m))
            .when(F.concat(F.right(s, F.lit(1)), m).isin("()", "[]", "{}"), F.left(s, F.length(s) - 1)).otherwise("!")
        )

    return F.aggregate(marks, F.lit(""), step)


def _indents(facts: Column) -> Column:
    """First problem of the indents of logical lines; NULL if there is none.

    A line after a header must be indented deeper than it, no other line may be, and a line
    that is indented less must have the indent of a line that is still open. Text over several
    lines may be the whole block (`due` 2: the next line may be deeper or not).
    """
    state = "named_struct('depth', 0, 'stack', CAST(array() AS ARRAY<INT>), 'due', 0, 'bad', CAST(NULL AS STRING))"

    def step(s: Column, x: Column) -> Column:
        starts = (s["depth"] <= 0) & ~x["cont"]
        depth = F.when(x["kind"] == "code", s["depth"] + x["delta"]).otherwise(s["depth"]).cast("int")
        kept = F.filter(s["stack"], lambda i: i <= x["indent"])
        more = rstrip(x["code"]).endswith("\\")
        top, first = F.element_at(s["stack"], F.lit(-1)), F.size(s["stack"]) == 0
        deeper = ~first & (x["indent"] > top)
        bad = (
            F.when((s["due"] == 1) & ~deeper, "a block is not indented").when((s["due"] == 0) & deeper, "a line is indented without a block")
            .when(F.regexp_like(x["code"], F.lit(_NEEDS_COLON)) & (x["delta"] == 0) & ~F.contains(x["code"], F.lit(":")) & ~more, "a header has no colon")
            .when(~first & ~deeper & (F.coalesce(F.element_at(kept, F.lit(-1)), F.lit(-1)) != x["indent"]), "an indent fits no open block")
        )
        stack = F.when(first | deeper, F.concat(s["stack"], F.array(x["indent"]))).otherwise(kept)
        ends = rstrip(F.regexp_replace(x["code"], "#.*$", "")).endswith(":") & (depth <= 0)
        coded, told = x["kind"] == "code", (x["kind"] == "multi") & (s["due"] == 1)
        return F.struct(
            depth.alias("depth"), F.when(coded & starts, stack).otherwise(s["stack"]).alias("stack"),
            F.when(coded, ends.cast("int")).when(told, 2).otherwise(s["due"]).alias("due"), F.coalesce(s["bad"], F.when(coded & starts, bad)).alias("bad"),
        )

    return F.aggregate(
        facts, F.expr(state), step,
        lambda s: F.coalesce(s["bad"], F.when(s["due"] == 1, "a block is not indented")),
    )


def syntax_problem(facts: Column, indents: bool = True) -> Column:
    """Why a text cannot be a piece of code, or NULL: a check inside the row, not a parser.

    Brackets of each kind must close in order, quotes must close, indents must follow headers,
    headers need their colon, and no line may hold two words side by side as prose does. A
    text may start at any indent, as a method does. Without `indents` headers and indents
    are not looked at.
    """
    brackets = _brackets(facts)
    coded = F.filter(facts, lambda x: x["kind"] == "code")
    quote = F.exists(facts, lambda x: F.regexp_like(F.regexp_replace(F.regexp_replace(x["code"], "#.*$", ""), r'""', ""), F.lit("[\"']")))
    prose = F.exists(coded, lambda x: F.regexp_like(x["code"], F.lit(_PROSE)) | F.regexp_like(rstrip(x["code"]), F.lit(r"[\p{L}_\])]\.$")))
    return (
        F.when(brackets != "", "brackets do not close").when(quote, "a quote is not closed")
        .when(prose, "not a statement").otherwise(_indents(facts) if indents else F.lit(None).cast("string"))
    )


# --- statements and block text ----------------------------------------------------------

_IMPORT = r"^(?:import|from)\s"
_TARGET = rf"{NAME}(?:\.{NAME}|\[[^\]]*\])*"
_ASSIGN = rf"^(?:{_TARGET}(?:\s*,\s*{_TARGET})*\s*(?::[^=]+)?=(?:[^=]|$)|{NAME}\s*:\s*[^\s=])"
SELF_ASSIGN = rf"^\s*self\.{NAME}\s*=(?:[^=]|$)"


def top_statements(facts: Column, kind: str, limit: int) -> Column:
    """First `limit` raw lines of the file's top-level imports or assignments.

    A statement runs on while a bracket or triple-quoted text is open. The result is cut
    during the scan, so a huge literal costs no more than its first lines.
    """
    pattern = {"import": _IMPORT, "constant": _ASSIGN}[kind]

    def opens(x: Column) -> Column:
        hit = x["code"].rlike(pattern)
        if kind == "constant":
            hit = hit & ~F.regexp_extract(x["code"], rf"^({NAME})", 1).isin(v.KEYWORDS)
        return hit

    def step(s: Column, x: Column) -> Column:
        text = x["kind"].isin("code", "multi")
        inside = (s["depth"] > 0) | x["cont"]
        active = F.when(inside, s["active"]).when(text, opens(x)).otherwise(F.lit(False))
        keep = active & (F.size(s["out"]) < limit)
        return F.struct(
            (s["depth"] + x["delta"]).alias("depth"),
            active.alias("active"),
            F.when(keep, F.concat(s["out"], F.array(rstrip(x["raw"])))).otherwise(s["out"]).alias("out"),
        )

    start = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("active"),
        F.array().cast("array<string>").alias("out"),
    )
    return F.aggregate(facts, start, step, lambda s: s["out"])


def raw_slice(facts: Column, start: Column, end: Column) -> Column:
    return F.transform(F.slice(facts, start, end - start + 1), lambda x: x["raw"])


def block_text(facts: Column, start: Column, end: Column) -> Column:
    """Raw lines start..end, each with its line end."""
    return F.concat(F.array_join(raw_slice(facts, start, end), "\n"), F.lit("\n"))


def _line_at(facts: Column, ln: Column) -> Column:
    return rstrip(F.get(facts, ln - 1)["raw"])


def is_member(b: Column, klass: Column) -> Column:
    return (b["parent_line"] == klass["line"]) & b["kind"].isin("def", "async")


def init_lines(facts: Column, blocks: Column, klass: Column, limit: int) -> Column:
    """The class's `__init__` header and its `self.x = ...` lines, in line order."""
    inits = F.filter(
        blocks, lambda b: is_member(b, klass) & (b["kind"] == "def") & (b["name"] == "__init__")
    )

    def of(b: Column) -> Column:
        body = F.slice(facts, b["line"] + 1, b["end"] - b["line"])
        found = F.filter(body, lambda x: x["code"].rlike(SELF_ASSIGN))
        return F.concat(
            F.array(_line_at(facts, b["line"])),
            F.transform(F.slice(found, 1, limit - 1), lambda x: rstrip(x["raw"])),
        )

    return F.get(F.transform(F.slice(inits, 1, 1), of), F.lit(0))


def sibling_lines(facts: Column, blocks: Column, klass: Column, target: Column, limit: int) -> Column:
    """Signatures of the class's other methods, each below its first decorator line."""
    others = F.filter(
        blocks,
        lambda b: is_member(b, klass) & ~((b["name"] == target["name"]) & (b["line"] == target["line"])),
    )

    def of(b: Column) -> Column:
        signature = F.concat(_line_at(facts, b["line"]), F.lit(" ..."))
        return F.when(
            b["start"] < b["line"], F.array(_line_at(facts, b["start"]), signature)
        ).otherwise(F.array(signature))

    return F.flatten(F.transform(F.slice(others, 1, limit), of))


def class_context(facts: Column, blocks: Column, target: Column) -> Column:
    """Header, init attributes and sibling signatures of the target's class; NULL outside one."""
    classes = F.filter(
        blocks, lambda b: (b["line"] == target["parent_line"]) & (b["kind"] == "class")
    )

    def section(name: str, lines: Column) -> Column:
        return F.concat(F.lit(v.CONTEXT_SECTIONS[name] + "\n"), F.nullif(F.array_join(lines, "\n"), F.lit("")))

    def of(c: Column) -> Column:
        return F.concat_ws(
            "\n\n",
            F.concat(F.lit(v.CONTEXT_SECTIONS["class"] + "\n"), _line_at(facts, c["line"])),
            section("init", init_lines(facts, blocks, c, v.MAX_INIT_LINES)),
            section("siblings", sibling_lines(facts, blocks, c, target, v.MAX_SIBLINGS)),
        )

    return F.get(F.transform(classes, of), F.lit(0))


def file_context(
    facts: Column, blocks: Column, target: Column, imports: Column, constants: Column
) -> Column:
    """Context text of one block: imports, class context and constants, empty parts left out."""

    def fenced(name: str, lines: Column) -> Column:
        return F.concat(
            F.lit(f"{v.CONTEXT_SECTIONS[name]}\n```python\n"), F.nullif(F.array_join(lines, "\n"), F.lit("")),
            F.lit("\n```"),
        )

    return F.concat_ws(
        "\n\n", F.lit(v.CONTEXT_TITLE), fenced("imports", imports),
        class_context(facts, blocks, target), fenced("constants", constants),
    )
