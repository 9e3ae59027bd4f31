"""Text columns: cleaning, cutting, paths, message verdicts, fallbacks and prompts.

Every function takes and returns Columns, holds no state and needs no shuffle, so it can be
used in a batch query, in SQL through a view, or on a streaming DataFrame alike.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgauge.functions import fixed as v

# Characters Python's str.strip() removes; Spark's trim() removes the blank only.
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_ODD_BREAK = r"[\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
# Zero-width cut behind a line break: pieces keep their line ends.
_AFTER_BREAK = r"(?<=[\n\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}])|(?<=\r)(?!\n)"


# Blanks go first: Spark drops those in one pass, and looks up each other character in the list.


def strip(s: Column) -> Column:
    return F.btrim(F.btrim(s), F.lit(WHITE))


def rstrip(s: Column) -> Column:
    return F.rtrim(F.rtrim(s), F.lit(WHITE))


def lstrip(s: Column) -> Column:
    return F.ltrim(F.ltrim(s), F.lit(WHITE))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_keep_ends(s: Column) -> Column:
    """Lines with their ends; joining them with '' gives the text back."""
    plain = bound(F.split(s, "\n"), lambda lines: F.transform(
        lines, lambda line, i: F.when(i < F.size(lines) - 1, F.concat(line, F.lit("\n"))).otherwise(line)))
    return F.when(F.regexp_like(s, F.lit(_ODD_BREAK)), F.split(s, _AFTER_BREAK)).otherwise(plain)


# --- cleaning and cutting ---------------------------------------------------------------


def strip_reasoning(s: Column) -> Column:
    return strip(F.regexp_replace(s, r"(?s)<think>.*?</think>", ""))


def first_fence(s: Column) -> Column:
    """Body of the first bare or `python` fence anywhere, else the whole cleaned text."""
    pattern = r"(?sU)```(?:python)?\s*\n(.*?)```"
    text = strip_reasoning(s)
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)


def normalize_message(s: Column) -> Column:
    """Reasoning removed; unwrapped only if the whole text is one fence; LF line ends."""
    pattern = r"(?sU)\A```(?:\w+)?\s*\n(.*?)\n?```\z"
    text = strip_reasoning(s)
    text = F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1))).otherwise(text)
    return strip(F.replace(text, F.lit("\r\n"), F.lit("\n")))


def truncate(s: Column, limit: int | Column) -> Column:
    n = F.lit(limit) if isinstance(limit, int) else limit
    return F.when(F.length(s) > n, F.concat(F.substring(s, F.lit(1), n), F.lit(v.TRUNCATED))).otherwise(s)


def first_line(s: Column) -> Column:
    return strip(F.substring_index(s, "\n", 1))


def _drop_bullet(s: Column) -> Column:
    return F.when(s.startswith("- "), strip(F.substring(s, 3, 2**31 - 1))).otherwise(s)


def clean_summary_line(s: Column) -> Column:
    return strip(F.rtrim(strip(_drop_bullet(first_line(normalize_message(s)))), F.lit(".")))


def collapse_key(s: Column) -> Column:
    return F.regexp_replace(F.lower(strip(s)), _SPACE + "+", " ")


# --- indentation and splicing -----------------------------------------------------------


def detect_indent(s: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(s, LINE_BREAK, "\n"), r"(?m)^([^\S\n]*)\S", 1)


def reindent(s: Column, indent: Column) -> Column:
    """Swap the base indentation; blank lines and lines without it are left as they are."""

    def moved(p: Column) -> Column:
        text, current = p["text"], p["current"]

        def swap(line: Column) -> Column:
            end = F.concat(indent, F.substring(line, F.length(current) + 1, F.length(line)))
            return F.when(F.startswith(line, current) & (strip(line) != ""), end).otherwise(line)

        return F.when(current == indent, text).otherwise(F.array_join(F.transform(split_keep_ends(text), swap), ""))

    # The indent of the text is looked for once, not for each of its lines.
    return bound(F.struct(s.alias("text"), detect_indent(s).alias("current")), moved)


def end_with_newline(s: Column) -> Column:
    return F.when(s.endswith("\n"), s).otherwise(F.concat(s, F.lit("\n")))


def splice_lines(content: Column, start: Column, end: Column, new: Column) -> Column:
    """Put `new` in the place of lines start..end (1-based, inclusive)."""

    def put(lines: Column) -> Column:
        rest = F.greatest(F.size(lines) - end, F.lit(0))
        return F.concat(
            F.array_join(F.slice(lines, F.lit(1), start - 1), ""),
            end_with_newline(new),
            F.array_join(F.slice(lines, end + 1, rest), ""),
        )

    return bound(split_keep_ends(content), put)


def content_hash(s: Column) -> Column:
    return F.sha2(s, 256)


# --- paths ------------------------------------------------------------------------------


def norm_path(p: Column) -> Column:
    return F.translate(p, "\\", "/")


def segments(p: Column) -> Column:
    return F.split(p, "/")


def top_dir(p: Column) -> Column:
    return F.when(F.contains(p, F.lit("/")), F.substring_index(p, "/", 1))


def parent_dir(p: Column) -> Column:
    """Directory part, `.` for a bare name and `/` for a name directly under the root."""
    clean = F.regexp_replace(F.regexp_replace(p, "/+", "/"), r"(?<=.)/$|^\./", "")
    cut = F.regexp_replace(clean, "/[^/]*$", "")
    return F.when(~F.contains(clean, F.lit("/")), ".").when(cut == "", "/").otherwise(cut)


def is_text_path(p: Column) -> Column:
    suffix = F.regexp_extract(p, r"[^/](\.[^./]+)$", 1)
    return F.lower(suffix).isin(v.TEXT_EXTENSIONS)


def change_weight(added: Column, deleted: Column, is_binary: Column, size: Column) -> Column:
    lines = sum((F.coalesce(n, F.lit(0)).cast("bigint") for n in (added, deleted)), F.lit(0))
    return F.when(is_binary, F.greatest(F.lit(1), F.coalesce(size, F.lit(1)))).otherwise(
        F.greatest(F.lit(1), lines * v.WEIGHT_PER_LINE)
    ).cast("bigint")


# --- verdicts ---------------------------------------------------------------------------


def _starts_with_any(s: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [s.startswith(p) for p in prefixes])


def _contains_any(s: Column, tokens: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(s, F.lit(t)) for t in tokens])


def is_generic_subject(subject: Column, repo: Column) -> Column:
    """Exact stock phrase, or a stock verb followed by nothing but the repository."""
    text, name = collapse_key(subject), F.lower(repo)
    pattern = rf"^(?:{v.GENERIC_VERBS}) (.*)$"
    what = F.regexp_extract(text, pattern, 1)
    repo_like = (what == name) | what.rlike(r"(?U)^(?:[\w.-]+-repo|repo|repository)$")
    exact = text.isin(v.GENERIC_SUBJECTS) | text.isin(
        F.concat(F.lit("update "), name), F.concat(F.lit("update "), name, F.lit(" files"))
    )
    return exact | (text.rlike(pattern) & repo_like)


def is_path_dump(line: Column) -> Column:
    """The line holds a file name at its start or after a slash, or is a bare path."""
    text = _drop_bullet(strip(line))
    named = text.rlike(rf"(?U)(^|[/\\])[\w.-]+\.({v.DUMPED_EXTENSIONS})\b")
    bare = text.rlike(r"(?U)^[\w.-]+[/\\][\w./\\-]+(?:\s+\([A-Z?]+\))?$")
    return (text != "") & (named | bare)


def message_problem(text: Column, repo: Column) -> Column:
    """First failing rule of the message gate, or NULL when the message is accepted."""
    say = v.MESSAGE_PROBLEMS
    lines = F.transform(F.split(text, LINE_BREAK), rstrip)
    bullets = F.filter(lines, lambda x: lstrip(x).startswith("- "))
    body = F.filter(F.slice(lines, 2, F.size(lines)), lambda x: strip(x) != "")
    subject = first_line(text)
    lowered = F.lower(strip(text))

    def mostly_dumps(group: Column) -> Column:
        floor = F.greatest(F.lit(2), F.floor(F.size(group) / 2).cast("int"))
        return F.size(F.filter(group, is_path_dump)) >= floor

    return (
        F.when(strip(text) == "", say["empty"])
        .when(F.length(text) > v.MAX_MESSAGE_CHARS, say["long"])
        .when(subject == "", say["no_subject"])
        .when(subject.startswith("- "), say["bullet_subject"])
        .when(F.length(subject) > v.MAX_SUBJECT_CHARS, say["long_subject"])
        .when(is_generic_subject(subject, repo), say["generic"])
        .when(_starts_with_any(lowered, v.CHATTY_PREFIXES), say["chatty"])
        .when(F.size(bullets) > v.MAX_BULLETS, say["bullets"])
        .when(mostly_dumps(bullets), say["dump"])
        .when(mostly_dumps(body), say["dump"])
        .when(F.exists(lines, lambda x: x.rlike(r"(?U)^\s*\d+\.\s+")), say["numbered"])
        .when(F.exists(lines, lambda x: x.rlike(r"(?U)^\s*[*-]\s+\*\*")), say["markdown"])
        .when(
            F.substring(lowered, 1, v.ANALYSIS_HEAD_CHARS).rlike(v.ANALYSIS_PHRASES),
            say["analysis"],
        )
    )


def summary_problem(line: Column, repo: Column) -> Column:
    text, say = strip(line), v.SUMMARY_PROBLEMS
    return (
        F.when(text == "", say["empty"])
        .when(F.length(text) > v.MAX_SUMMARY_CHARS, say["long"])
        .when(is_generic_subject(text, repo), say["generic"])
        .when(is_path_dump(text), say["dump"])
        .when(_starts_with_any(F.lower(text), v.SUMMARY_PREFIXES), say["chatty"])
    )


# --- fallbacks --------------------------------------------------------------------------


def _category(name_status: Column, diff_stat: Column, note: Column) -> Column:
    text = F.lower(F.concat_ws("\n", name_status, diff_stat, note))
    return (
        F.when(_contains_any(text, v.TEST_TOKENS), v.UPDATE_TESTS)
        .when(_contains_any(text, v.DOC_TOKENS), v.UPDATE_DOCS)
        .when(_contains_any(text, v.CONFIG_TOKENS), v.UPDATE_CONFIG)
    )


def fallback_message(repo: Column, name_status: Column, diff_stat: Column, note: Column) -> Column:
    subject = F.coalesce(
        _category(name_status, diff_stat, note), F.concat(F.lit(v.UPDATE), repo)
    )
    return F.concat(subject, F.lit("\n\n" + v.FALLBACK_BODY))


def fallback_summary(
    repo: Column, name_status: Column, diff_stat: Column, note: Column, modal_dir: Column
) -> Column:
    return F.coalesce(
        _category(name_status, diff_stat, note),
        F.concat(F.lit(v.UPDATE), F.coalesce(modal_dir, repo)),
    )


# --- prompts ----------------------------------------------------------------------------


def _data_block(bundle: Column) -> Column:
    return F.concat(F.lit(v.DATA_OPEN + "\n"), bundle, F.lit("\n" + v.DATA_CLOSE + "\n"))


def user_prompt(repo: Column, bundle: Column, reason: Column) -> Column:
    retry = F.coalesce(
        F.concat(
            F.lit(v.PROMPT_REJECTED),
            F.nullif(reason, F.lit("")),
            F.lit(f".\n{v.REPAIR_NOTE}\n"),
        ),
        F.lit(""),
    )
    return F.concat(
        F.lit(v.PROMPT_REPO), repo, F.lit("\n"), retry,
        F.lit(f"\n{v.MESSAGE_PROMPT_NOTE}\n\n"), _data_block(bundle),
    )


def summary_prompt(repo: Column, bundle: Column) -> Column:
    return F.concat(
        F.lit(v.PROMPT_REPO), repo,
        F.lit(f"\n\n{v.SUMMARY_PROMPT_NOTE}\n\n"), _data_block(bundle),
    )


def subject_prompt(items: Column) -> Column:
    return F.concat(
        F.lit(v.SUBJECT_PROMPT_HEAD + "\n"), items, F.lit("\n\n" + v.SUBJECT_PROMPT_TAIL)
    )


def reduce_prompt(items: Column, n_files: Column, n_items: Column) -> Column:
    return F.concat(
        n_files.cast("string"), F.lit(v.REDUCE_PROMPT_HEAD[0]), n_items.cast("string"),
        F.lit(v.REDUCE_PROMPT_HEAD[1]), items,
        F.lit("\n\n" + v.REDUCE_PROMPT_TAIL),
    )


def rewrite_system(metric: Column) -> Column:
    note = F.when(metric == "cyclomatic", v.METRIC_NOTES["cyclomatic"]).otherwise(
        v.METRIC_NOTES["cognitive"]
    )
    return F.concat(
        F.lit(v.REWRITE_ROLE + "\n\nMetric: "), metric, F.lit(" complexity.\n"), note,
        F.lit("\n\n" + v.REWRITE_RULES),
    )


def rewrite_prompt(
    source: Column, name: Column, metric: Column, value: Column, limit: int,
    context: Column, feedback: Column,
) -> Column:
    first, second, third, last = v.REWRITE_ASK
    ask = F.concat(
        F.lit(first), name, F.lit(second), metric, F.lit(third), value.cast("string"),
        F.lit(f"{last}{limit}.\n"),
    )
    told = F.concat(F.lit(v.REWRITE_TOLD), F.nullif(feedback, F.lit("")), F.lit("\n"))
    needs = F.concat(
        F.lit(v.REWRITE_NEEDS_HEAD), F.length(detect_indent(source)).cast("string"),
        F.lit(v.REWRITE_NEEDS_TAIL),
    )
    code = F.concat(F.lit(v.REWRITE_CODE[0]), source, F.lit(v.REWRITE_CODE[1]))
    return F.concat_ws(
        "\n", ask, told, needs, F.concat(F.lit("\n"), F.nullif(context, F.lit(""))), code
    )


def retry_feedback(metric: Column, scores: Column, limit: int, error: Column) -> Column:
    """One sentence per block still over the limit; `scores` is ARRAY<STRUCT<name, value>>."""
    first, second, third, last = v.RETRY_OVER
    over = F.transform(
        F.filter(scores, lambda x: x["value"] > limit),
        lambda x: F.concat(
            F.lit(first), x["name"], F.lit(second), metric, F.lit(third),
            x["value"].cast("string"), F.lit(f"{last}{limit})."),
        ),
    )
    failed = F.concat(F.lit(v.RETRY_ERROR), F.nullif(error, F.lit("")))
    return F.concat_ws(
        "\n", failed, F.nullif(F.array_join(over, "\n"), F.lit("")), F.lit(v.RETRY_ADVICE)
    )


def check_feedback(error: Column) -> Column:
    """Feedback after a check on the applied text failed (tests, or undefined names)."""
    return F.when(error == "test_failure", v.TEST_FAILURE_ADVICE).otherwise(
        F.concat(F.lit(v.NAME_ERROR_HEAD), error, F.lit("\n\n" + v.NAME_ERROR_ADVICE))
    )


def validation_log(metric: Column, scores: Column, limit: int, error: Column) -> Column:
    """Log text of a rejected proposal: the error, or one line per block over the limit."""
    over = F.transform(
        F.filter(scores, lambda x: x["value"] > limit),
        lambda x: F.concat(
            F.lit("  "), x["name"], F.lit(": "), metric, F.lit("="), x["value"].cast("string"),
            F.lit(f" (still > {limit})"),
        ),
    )
    failed = F.concat(F.lit(v.LOG_FAILED), F.nullif(error, F.lit("")))
    return F.coalesce(failed, F.array_join(over, "\n"))


# --- JSON envelopes ---------------------------------------------------------------------

ENVELOPE_PATHS = ("$.message.content", "$.response", "$.result")


def unwrap_response(json: Column, path: str) -> Column:
    """STRUCT<text, error>: text at `path`; a missing or empty text gives a reason instead."""
    text = F.nullif(F.get_json_object(json, path), F.lit(""))
    error = F.when(F.try_parse_json(json).isNull(), "non-JSON output").when(
        text.isNull(), f"no {path.removeprefix('$.')} field"
    )
    return F.struct(text.alias("text"), error.alias("error"))


def chat_request(
    model: str, system: Column, prompt: Column, temperature: float, max_tokens: int
) -> Column:
    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            F.array(turn("system", system), turn("user", prompt)).alias("messages"),
            F.lit(False).alias("stream"),
            _options(temperature, max_tokens),
        )
    )


def completion_request(
    model: str, system: Column, prompt: Column, temperature: float, max_tokens: int
) -> Column:
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"), prompt.alias("prompt"), system.alias("system"),
            F.lit(False).alias("stream"), _options(temperature, max_tokens),
        )
    )


def _options(temperature: float, max_tokens: int) -> Column:
    return F.struct(
        F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("num_predict")
    ).alias("options")
