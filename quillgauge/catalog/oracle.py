"""DuckDB statements for the registered queries, over the same tables."""

from __future__ import annotations

from quillgauge.catalog.inputs import DUCK, attempts_sql, changes_sql
from quillgauge.catalog.oracle_code import (
    FILE_BLOCKS, FILE_FACTS, FILE_SCORES, FILES, NAME, facts_cte, q, raw_select, strip, texts_cte,
    tokens_cte, words,
)
from quillgauge.functions import fixed as v

NL = "chr(10)"
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}]"


# --- scalar pieces ----------------------------------------------------------------------


def sub(x: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {by}, 'g')"


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def spoken(x: str) -> str:
    return strip(sub(x, r"(?s)<think>.*?</think>"))


def normalized(x: str) -> str:
    pattern = r"(?s)\A```(?:\w+)?\s*\n(.*?)\n?```\z"
    s = spoken(x)
    body = f"CASE WHEN {rx(s, pattern)} THEN {strip(f'regexp_extract({s}, {q(pattern)}, 1)')} ELSE {s} END"
    return strip(f"replace({body}, concat(chr(13), {NL}), {NL})")


def fenced(x: str) -> str:
    pattern = r"(?s)```(?:python)?\s*\n(.*?)```"
    s = spoken(x)
    return f"CASE WHEN {rx(s, pattern)} THEN regexp_extract({s}, {q(pattern)}, 1) ELSE {s} END"


def truncated(x: str, n: str) -> str:
    return (
        f"CASE WHEN length({x}) > {n} THEN concat(substring({x}, 1, {n}), {NL}, "
        f"{q(v.TRUNCATED.strip())}) ELSE {x} END"
    )


def first_line(x: str) -> str:
    return strip(f"split_part({x}, {NL}, 1)")


def key_of(x: str) -> str:
    return sub(f"lower({strip(x)})", SPACE + "+", "' '")


def generic(subject: str, repo: str) -> str:
    text = key_of(subject)
    exact = words(v.GENERIC_SUBJECTS)
    return f"""({text} IN {exact} OR {text} IN (concat('update ', lower({repo})), concat('update ', lower({repo}), ' files'))
      OR ({rx(text, f'^(?:{v.GENERIC_VERBS}) ')} AND (substring({text}, strpos({text}, ' ') + 1) = lower({repo})
        OR {rx(f"substring({text}, strpos({text}, ' ') + 1)", r'^(?:[\w.-]+-repo|repo|repository)$')})))"""


def unbullet(x: str) -> str:
    return f"CASE WHEN starts_with({x}, '- ') THEN {strip(f'substring({x}, 3)')} ELSE {x} END"


def dump(x: str) -> str:
    s = f"({unbullet(strip(x))})"
    named = rx(s, rf"(^|[/\\])[\w.-]+\.({v.DUMPED_EXTENSIONS})\b")
    bare = rx(s, r"^[\w.-]+[/\\][\w./\\-]+(?:\s+\([A-Z?]+\))?$")
    return f"({s} <> '' AND ({named} OR {bare}))"


def starts_any(x: str, prefixes: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(p)})" for p in prefixes) + ")"


def has_any(x: str, tokens: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in tokens) + ")"


def problem(x: str, repo: str) -> str:
    say = {k: q(m) for k, m in v.MESSAGE_PROBLEMS.items()}
    lines = f"list_transform(string_split({x}, {NL}), lambda l: rtrim(l, concat(' ', chr(9), chr(13))))"
    bullets = f"list_filter({lines}, lambda l: starts_with(ltrim(l), '- '))"
    body = f"list_filter({lines}[2:], lambda l: {strip('l')} <> '')"
    low = f"lower({strip(x)})"

    def mostly(group: str) -> str:
        return f"len(list_filter({group}, lambda l: {dump('l')})) >= greatest(2, len({group}) // 2)"

    return f"""CASE WHEN {strip(x)} = '' THEN {say['empty']} WHEN length({x}) > {v.MAX_MESSAGE_CHARS} THEN {say['long']}
      WHEN {first_line(x)} = '' THEN {say['no_subject']} WHEN starts_with({first_line(x)}, '- ') THEN {say['bullet_subject']}
      WHEN length({first_line(x)}) > {v.MAX_SUBJECT_CHARS} THEN {say['long_subject']}
      WHEN {generic(first_line(x), repo)} THEN {say['generic']} WHEN {starts_any(low, v.CHATTY_PREFIXES)} THEN {say['chatty']}
      WHEN len({bullets}) > {v.MAX_BULLETS} THEN {say['bullets']} WHEN {mostly(bullets)} THEN {say['dump']}
      WHEN {mostly(body)} THEN {say['dump']}
      WHEN len(list_filter({lines}, lambda l: {rx('l', r'^\s*[0-9]+\.\s+')})) > 0 THEN {say['numbered']}
      WHEN len(list_filter({lines}, lambda l: {rx('l', r'^\s*[*-]\s+\*\*')})) > 0 THEN {say['markdown']}
      WHEN {rx(f'substring({low}, 1, {v.ANALYSIS_HEAD_CHARS})', v.ANALYSIS_PHRASES)} THEN {say['analysis']} END"""


def summary_problem(x: str, repo: str) -> str:
    s = strip(x)
    return f"""CASE WHEN {s} = '' THEN 'empty' WHEN length({s}) > {v.MAX_SUMMARY_CHARS} THEN 'too long'
      WHEN {generic(s, repo)} THEN 'generic' WHEN {dump(s)} THEN 'path dump'
      WHEN {starts_any(f'lower({s})', v.SUMMARY_PREFIXES)} THEN 'chat-style' END"""


def top(p: str) -> str:
    return f"CASE WHEN contains({p}, '/') THEN split_part({p}, '/', 1) END"


def parent(p: str) -> str:
    return f"CASE WHEN contains({p}, '/') THEN {sub(p, '/[^/]*$')} ELSE '.' END"


def category(text: str) -> str:
    return f"""CASE WHEN {has_any(text, v.TEST_TOKENS)} THEN 'Update tests' WHEN {has_any(text, v.DOC_TOKENS)} THEN 'Update documentation'
      WHEN {has_any(text, v.CONFIG_TOKENS)} THEN 'Update configuration' END"""


def text_path(p: str) -> str:
    return f"lower(regexp_extract({p}, {q(r'[^/](\.[^./]+)$')}, 1)) IN {words(v.TEXT_EXTENSIONS)}"


# --- shared tables ----------------------------------------------------------------------

EXCLUSIONS = """owners AS (SELECT doc_id, concat('mod', CAST(doc_id AS STRING), '.py') AS part FROM documents),
exclusions AS (SELECT 'cyclomatic' AS metric, part, concat('f', CAST(doc_id % 5 AS STRING)) AS block FROM owners
  UNION ALL SELECT 'cyclomatic', part, 'f2' FROM owners UNION ALL SELECT 'cognitive', part, 'f2' FROM owners)"""

VIOLATIONS = f"{FILE_SCORES},\nfound AS (SELECT * FROM scored WHERE value > {v.MAX_SCORE})"
WORST = """worst AS (SELECT project, path, name, block_line, value, metric FROM found QUALIFY row_number() OVER (
    PARTITION BY project, path, name, block_line ORDER BY value DESC, CASE metric WHEN 'cyclomatic' THEN 0 ELSE 1 END) = 1)"""
RUNS = f"""{VIOLATIONS},
runs AS (SELECT f.project AS run, f.path AS project, CAST(regexp_extract(f.path, 'mod([0-9]+)', 1) AS BIGINT) AS seq,
    NOT EXISTS (SELECT 1 FROM found x WHERE x.path = f.path) AS passed FROM files f)"""
OUTCOMES = f"""{VIOLATIONS}, {WORST},
outcomes AS (SELECT project, path, name, block_line, value,
    row_number() OVER (PARTITION BY project, path ORDER BY value DESC, block_line) AS rank, block_line % 3 = 0 AS ok FROM worst),
tried AS (SELECT o.* FROM outcomes o WHERE NOT EXISTS (SELECT 1 FROM outcomes e WHERE e.path = o.path AND e.ok AND e.rank < o.rank))"""
PROPOSALS = f"""{FILE_BLOCKS},
proposals AS (SELECT b.project, b.path, b.name, b.block_line, b.start_line, b.end_line,
    CASE WHEN b.block_line % 4 = 0 THEN sha256(b.path) ELSE sha256(f.content) END AS base_sha, sha256(f.content) AS now_sha, f.content,
    CASE WHEN b.parent_line IS NULL THEN '' ELSE '    ' END AS pad,
    CASE WHEN b.block_line % 2 = 0 THEN 'cyclomatic' ELSE 'cognitive' END AS metric
  FROM blocks b JOIN files f USING (path) WHERE b.kind <> 'class'),
worded AS (SELECT *, concat(pad, 'def helper(x):', {NL}, pad, '    if x and x:', {NL}, pad, '        return x', {NL}, {NL},
    pad, 'def ', name, '(self):', {NL}, pad, '    return helper(self)') AS new_text FROM proposals)"""

CHANGES = f"changes AS ({changes_sql(DUCK)})"
WEIGHTED = f"""{CHANGES},
weighted AS (SELECT *, CASE WHEN is_binary OR untracked THEN greatest(1, size) ELSE greatest(1, (added + deleted) * {v.WEIGHT_PER_LINE}) END AS weight
  FROM changes)"""
BATCHES = f"""{WEIGHTED},
sized AS (SELECT *, count(*) OVER (PARTITION BY repo) AS n,
    row_number() OVER (PARTITION BY repo ORDER BY lower({parent('path')}), lower(path), path) AS rn FROM weighted),
sized2 AS (SELECT *, greatest(1, least((n + {v.MAX_BATCH_FILES - 1}) // {v.MAX_BATCH_FILES}, {v.MAX_BATCHES})) AS wanted FROM sized),
sized3 AS (SELECT *, (n + wanted - 1) // wanted AS width FROM sized2),
batched AS (SELECT *, (rn - 1) // width AS batch_id FROM sized3),
batches AS (SELECT *, row_number() OVER (PARTITION BY repo, batch_id ORDER BY rn) AS batch_pos,
    count(*) OVER (PARTITION BY repo, batch_id) AS batch_n FROM batched)"""


def excerpts(source: str, keys: str, out: str) -> str:
    fixed_chars = len("--- diff for  ---") + 1
    return f"""ex_paths AS (SELECT {keys}, count(*) AS paths, max(path) AS last_path FROM {source} GROUP BY {keys}),
ex_rows AS (SELECT {keys}, path, diff, greatest({v.MIN_FILE_CHARS}, least({v.MAX_FILE_CHARS}, {v.MAX_DIFF_CHARS} // paths)) AS per, last_path
  FROM {source} JOIN ex_paths USING ({keys}) WHERE {strip('diff')} <> ''),
ex_cost AS (SELECT *, {fixed_chars} + length(path) + 2 + CASE WHEN length(diff) > per THEN per + {len(v.TRUNCATED)} ELSE length(diff) END AS cost
  FROM ex_rows),
ex_left AS (SELECT *, {v.MAX_DIFF_CHARS} - coalesce(sum(cost) OVER (PARTITION BY {keys} ORDER BY path
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM ex_cost),
ex_kept AS (SELECT *, concat('--- diff for ', path, ' ---', {NL}, {truncated('diff', 'CAST(least(per, remaining) AS INT)')}) AS section FROM ex_left WHERE remaining > 0),
{out} AS (SELECT {keys}, concat(string_agg(section, concat({NL}, {NL}) ORDER BY path),
    CASE WHEN min(path) FILTER (WHERE remaining - cost <= 0) < any_value(last_path) THEN concat({NL}, {NL}, {q(v.FILES_OMITTED)}) ELSE '' END) AS diff_sample
  FROM ex_kept GROUP BY {keys})"""


def notes(source: str, keys: str, out: str) -> str:
    cut = truncated(strip("diff"), str(v.MAX_SNIPPET_CHARS))
    return f"""nt_rows AS (SELECT {keys}, path, row_number() OVER (PARTITION BY {keys} ORDER BY path) AS rn, count(*) OVER (PARTITION BY {keys}) AS n,
    CASE WHEN {text_path('path')} AND {strip('diff')} <> '' THEN {cut} END AS snippet FROM {source} WHERE untracked),
{out} AS (SELECT {keys}, concat({NL}, {q(v.UNTRACKED_TITLE)}, {NL}, string_agg(CASE WHEN snippet IS NULL THEN path
      ELSE concat(path, {NL}, '```', {NL}, snippet, {NL}, '```') END, {NL} ORDER BY rn),
    CASE WHEN any_value(n) > {v.MAX_UNTRACKED} THEN concat({NL}, '[... ', CAST(any_value(n) - {v.MAX_UNTRACKED} AS STRING),
      ' additional untracked paths omitted ...]') ELSE '' END) AS untracked_note, any_value(n) AS n_untracked,
    string_agg(path, {NL} ORDER BY rn) AS untracked_paths
  FROM nt_rows WHERE rn <= {v.MAX_UNTRACKED} GROUP BY {keys})"""


def modal(source: str, keys: str, out: str) -> str:
    return f"""md_counts AS (SELECT {keys}, {top('path')} AS dir, count(*) AS n FROM {source} WHERE contains(path, '/') GROUP BY ALL),
{out} AS (SELECT {keys}, dir AS modal_dir FROM md_counts QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, dir) = 1)"""


BUNDLES = f"""{BATCHES},
listed AS (SELECT *, CASE WHEN untracked THEN concat('?? ', path) ELSE concat(substring(status, 1, 1), '  ', path) END AS p_line,
    CASE WHEN NOT untracked THEN concat(status, chr(9), path) END AS n_line,
    CASE WHEN NOT untracked THEN concat(' ', path, ' | ', CASE WHEN is_binary THEN 'Bin' ELSE CAST(added + deleted AS STRING) END) END AS s_line
  FROM batches),
listings AS (SELECT repo, batch_id, string_agg(p_line, {NL} ORDER BY path) AS porcelain,
    coalesce(string_agg(n_line, {NL} ORDER BY path), '') AS name_status, coalesce(string_agg(s_line, {NL} ORDER BY path), '') AS diff_stat
  FROM listed GROUP BY repo, batch_id),
tracked AS (SELECT * FROM batches WHERE NOT untracked),
{excerpts('tracked', 'repo, batch_id', 'samples')},
{notes('batches', 'repo, batch_id', 'noted')},
{modal('tracked', 'repo, batch_id', 'modals')},
bundles AS (SELECT repo, batch_id, porcelain, name_status, diff_stat, {strip("concat('.', coalesce(diff_sample, ''))")}[2:] AS diff_sample,
    coalesce(untracked_note, '') AS untracked_note, untracked_paths, modal_dir
  FROM listings LEFT JOIN samples USING (repo, batch_id) LEFT JOIN noted USING (repo, batch_id) LEFT JOIN modals USING (repo, batch_id)),
heads AS (SELECT *, concat('=== REPO: ', repo, ' (branch: main) ===', {NL}, '-- git status --porcelain --', {NL}, porcelain, {NL},
    '-- git diff HEAD --name-status --', {NL}, name_status, {NL}, '-- git diff HEAD --stat --', {NL}, diff_stat) AS head FROM bundles),
rendered AS (SELECT repo, batch_id,
    concat(head, {NL}, '-- balanced git diff excerpts --', {NL}, diff_sample, CASE WHEN untracked_note = '' THEN '' ELSE concat({NL}, untracked_note) END) AS "full",
    concat(head, {NL}, '-- short diff excerpt --', {NL}, {truncated('diff_sample', str(v.LITE_EXCERPT_CHARS))},
      CASE WHEN untracked_note = '' THEN '' ELSE concat({NL}, {truncated('untracked_note', str(v.LITE_NOTE_CHARS))}) END) AS lite,
    concat(head, CASE WHEN untracked_paths IS NULL THEN '' ELSE concat({NL}, '-- untracked paths --', {NL}, untracked_paths) END) AS paths_only
  FROM heads)"""

ATTEMPTS = f"attempts AS ({attempts_sql(DUCK)})"
RESPONSES = f"""{ATTEMPTS},
responses AS (SELECT item_id, attempt_no, CASE (item_id + attempt_no) % 6
    WHEN 0 THEN concat('{{"message":{{"content":"item ', CAST(item_id AS STRING), '"}}}}')
    WHEN 1 THEN concat('{{"response":"item ', CAST(item_id AS STRING), '"}}')
    WHEN 2 THEN concat('{{"result":"item ', CAST(item_id AS STRING), '"}}')
    WHEN 3 THEN '{{"response":""}}' WHEN 4 THEN '{{}}' ELSE concat('not json item ', CAST(item_id AS STRING)) END AS json FROM attempts)"""


def envelope(name: str, path: str) -> str:
    text = f"CASE WHEN json_valid(json) THEN nullif(json_extract_string(CASE WHEN json_valid(json) THEN json ELSE '{{}}' END, '{path}'), '') END"
    field = path.removeprefix("$.")
    return f"""{text} AS {name}_text, CASE WHEN NOT json_valid(json) THEN 'non-JSON output'
      WHEN {text} IS NULL THEN 'no {field} field' END AS {name}_error"""


# Each line's statement is the last logical line at or before it, while it goes on.
STATEMENTS = f"""stmts AS (SELECT *, max(CASE WHEN kind = 'code' AND depth <= 0 AND NOT cont THEN ln END) OVER (PARTITION BY path ORDER BY ln) AS stmt,
    (kind IN ('code', 'multi') AND depth <= 0 AND NOT cont) OR depth > 0 OR cont AS inside FROM deep),
stmt_lines AS (SELECT s.project, s.path, s.ln, s.raw, h.code AS head FROM stmts s JOIN stmts h ON h.path = s.path AND h.ln = s.stmt WHERE s.inside),
import_rows AS (SELECT project, path, ln, rtrim(raw) AS raw, row_number() OVER (PARTITION BY path ORDER BY ln) - 1 AS pos FROM stmt_lines
  WHERE {rx('head', r'^(?:import|from)\s')} QUALIFY pos < {v.MAX_IMPORT_LINES}),
constant_rows AS (SELECT project, path, ln, rtrim(raw) AS raw, row_number() OVER (PARTITION BY path ORDER BY ln) - 1 AS pos FROM stmt_lines
  WHERE {rx('head', rf'^(?:{NAME}(?:\.{NAME}|\[[^\]]*\])*(?:\s*,\s*{NAME}(?:\.{NAME}|\[[^\]]*\])*)*\s*(?::[^=]+)?=(?:[^=]|$)|{NAME}\s*:\s*[^\s=])')}
    AND regexp_extract(head, {q('^(' + NAME + ')')}, 1) NOT IN {words(v.KEYWORDS)} QUALIFY pos < {v.MAX_CONSTANT_LINES}),
init_of AS (SELECT b.project, b.path, k.block_line AS class_line, min(b.block_line) AS init_line FROM blocks b
    JOIN blocks k ON k.path = b.path AND k.block_line = b.parent_line AND k.kind = 'class' WHERE b.kind = 'def' AND b.name = '__init__' GROUP BY ALL),
init_all AS (SELECT i.project, i.path, i.class_line, d.ln, rtrim(d.raw) AS raw, row_number() OVER (PARTITION BY i.path, i.class_line ORDER BY d.ln) - 1 AS pos
  FROM init_of i JOIN blocks b ON b.path = i.path AND b.block_line = i.init_line JOIN deep d ON d.path = i.path AND d.ln >= i.init_line AND d.ln <= b.end_line
  WHERE d.ln = i.init_line OR {rx('d.code', rf'^\s*self\.{NAME}\s*=(?:[^=]|$)')}),
init_rows AS (SELECT * FROM init_all WHERE pos < {v.MAX_INIT_LINES})"""

TARGETS = f"""{FILE_BLOCKS}, {STATEMENTS},
targets AS (SELECT *, 'cyclomatic' AS metric, total AS value FROM blocks WHERE kind <> 'class' AND coalesce(parent_kind, 'class') = 'class' AND total > {v.MAX_SCORE}
  UNION ALL SELECT *, 'cognitive', cognitive FROM blocks WHERE kind = 'def' AND cognitive > {v.MAX_SCORE}),
sources AS (SELECT b.path, b.block_line, concat(string_agg(d.raw, {NL} ORDER BY d.ln), {NL}) AS source FROM (SELECT DISTINCT path, block_line, start_line, end_line FROM targets) b
  JOIN deep d ON d.path = b.path AND d.ln BETWEEN b.start_line AND b.end_line GROUP BY b.path, b.block_line),
method_rows AS (SELECT m.path, m.parent_line, m.block_line, concat(CASE WHEN m.start_line < m.block_line THEN concat(rtrim(s.raw), {NL}) ELSE '' END, rtrim(h.raw), ' ...') AS sig
  FROM blocks m JOIN deep h ON h.path = m.path AND h.ln = m.block_line JOIN deep s ON s.path = m.path AND s.ln = m.start_line
  WHERE m.kind <> 'class' AND m.parent_kind = 'class'),
sibling_rows AS (SELECT t.path, t.block_line, m.sig, m.block_line AS mline, row_number() OVER (PARTITION BY t.path, t.block_line ORDER BY m.block_line) AS rn
  FROM (SELECT DISTINCT path, block_line, parent_line FROM targets) t JOIN method_rows m ON m.path = t.path AND m.parent_line = t.parent_line AND m.block_line <> t.block_line),
sibling_text AS (SELECT path, block_line, string_agg(sig, {NL} ORDER BY mline) AS sigs FROM sibling_rows WHERE rn <= {v.MAX_SIBLINGS} GROUP BY ALL),
init_text AS (SELECT path, class_line, string_agg(raw, {NL} ORDER BY pos) AS attrs FROM init_rows GROUP BY ALL),
import_text AS (SELECT path, string_agg(raw, {NL} ORDER BY pos) AS imports FROM import_rows GROUP BY ALL),
constant_text AS (SELECT path, string_agg(raw, {NL} ORDER BY pos) AS constants FROM constant_rows GROUP BY ALL),
contexts AS (SELECT t.project, t.path, t.name, t.block_line, t.metric, t.value, s.source,
    concat({q(v.CONTEXT_TITLE)}, CASE WHEN i.imports IS NULL THEN '' ELSE concat({NL}, {NL}, '## Imports', {NL}, '```python', {NL}, i.imports, {NL}, '```') END,
      CASE WHEN coalesce(t.parent_kind, '') <> 'class' THEN '' ELSE concat({NL}, {NL}, '## Class context', {NL}, rtrim(k.raw),
        CASE WHEN a.attrs IS NULL THEN '' ELSE concat({NL}, {NL}, '### __init__ attributes', {NL}, a.attrs) END,
        CASE WHEN b.sigs IS NULL THEN '' ELSE concat({NL}, {NL}, '### Other methods in the class', {NL}, b.sigs) END) END,
      CASE WHEN c.constants IS NULL THEN '' ELSE concat({NL}, {NL}, '## Module constants', {NL}, '```python', {NL}, c.constants, {NL}, '```') END) AS context
  FROM targets t JOIN sources s USING (path, block_line) LEFT JOIN import_text i USING (path) LEFT JOIN constant_text c USING (path)
  LEFT JOIN deep k ON k.path = t.path AND k.ln = t.parent_line LEFT JOIN init_text a ON a.path = t.path AND a.class_line = t.parent_line
  LEFT JOIN sibling_text b ON b.path = t.path AND b.block_line = t.block_line)"""

DOCS = f"{texts_cte('documents', 'doc_id', 'text')},\n{facts_cte('doc_id')}"
DOC_TOKENS = f"{texts_cte('documents', 'doc_id', 'text')},\n{tokens_cte('doc_id')}"
FILE_TOKENS = f"{FILES},\n{texts_cte('files', 'project, path', 'content')},\n{tokens_cte('project, path')}"
HAL = """h1, h2, N1x AS n1_total, N2x AS n2_total, round(volume, 3) AS volume, round(difficulty, 3) AS difficulty,
  round(volume * difficulty, 1) AS effort"""


def mi(remarks: str) -> str:
    return f"""round(CASE WHEN volume <= 0 OR sloc <= 0 THEN 100.0 ELSE greatest(0.0, least(100.0, (171.0 - 5.2 * ln(CASE WHEN volume > 0 THEN volume ELSE 1 END)
      - 0.23 * score - 16.2 * ln(CASE WHEN sloc > 0 THEN sloc ELSE 1 END) + 50.0 * sin(sqrt(2.4 * CASE WHEN loc > 0 THEN ({remarks}) / loc ELSE 0 END)))
      * (100.0 / 171.0))) END, 4)"""


def numbered_prompt(reason: str) -> str:
    retry = "''" if not reason else (
        f"concat({NL}, 'Previous output was rejected because: ', {q(reason)}, '.', {NL}, {q(v.REPAIR_NOTE)}, {NL})"
    )
    return f"""concat('Repository folder name: ', repo, {NL}, {retry}, {NL}, {q(v.MESSAGE_PROMPT_NOTE)}, {NL}, {NL},
      {q(v.DATA_OPEN)}, {NL}, lite, {NL}, {q(v.DATA_CLOSE)}, {NL})"""


METRIC_TEXT = f"CASE metric WHEN 'cyclomatic' THEN {q(v.METRIC_NOTES['cyclomatic'])} ELSE {q(v.METRIC_NOTES['cognitive'])} END"
FEEDBACK = f"""concat('Function `', name, '` still has ', metric, ' complexity ', CAST(value AS STRING), ' (must be <= 15).', {NL}, {q(v.RETRY_ADVICE)})"""
SUMMARY_LINE = strip(f"rtrim({strip(unbullet(first_line('(' + normalized('raw') + ')')))}, '.')")

ORACLE: dict[str, str] = {
    "q_tree_scan": f"""WITH {FILES} SELECT 'written' AS project, path, sha256(content) AS sha, CAST(NULL AS STRING) AS error FROM files
      WHERE NOT list_has_any(string_split(path, '/'), {list(v.IGNORED_SEGMENTS)!r})""",
    "q_raw_lines": f"WITH {DOCS}, {raw_select('doc_id')} SELECT * FROM raw_counts",
    "q_raw_files": f"WITH {FILE_FACTS}, {raw_select('project, path')} SELECT * FROM raw_counts",
    "q_lines": f"""WITH {FILE_FACTS} SELECT project, path, CAST(ln AS BIGINT) AS line_no, raw, code, indent, kind = 'blank' AS is_blank,
      kind = 'comment' AS is_comment, kind = 'multi' AS is_multi FROM deep""",
    "q_tokens": f"WITH {DOC_TOKENS} SELECT token, is_operand, count(*) AS n, max(pos) AS last_pos FROM typed GROUP BY token, is_operand",
    "q_halstead": f"WITH {DOC_TOKENS} SELECT doc_id, {HAL} FROM hal",
    "q_halstead_files": f"WITH {FILE_TOKENS} SELECT project, path, {HAL} FROM hal",
    "q_maintainability": f"""WITH {FILE_BLOCKS}, {raw_select('project, path')}, {tokens_cte('project, path')},
      sums AS (SELECT f.project, f.path, CAST(coalesce(sum(own), 0) AS BIGINT) AS score FROM files f LEFT JOIN blocks b ON b.path = f.path GROUP BY ALL)
      SELECT project, path, score, sloc, round(volume, 3) AS volume, {mi('comments + multi')} AS mi, {mi('comments')} AS mi_plain
      FROM raw_counts JOIN hal USING (project, path) JOIN sums USING (project, path)""",
    "q_blocks": f"WITH {FILE_BLOCKS} SELECT * FROM blocks",
    "q_cyclomatic": f"WITH {FILE_SCORES} SELECT * FROM scored WHERE metric = 'cyclomatic'",
    "q_cognitive": f"WITH {FILE_SCORES} SELECT * FROM scored WHERE metric = 'cognitive'",
    "q_gate": f"WITH {VIOLATIONS}, {WORST} SELECT * FROM worst",
    "q_union": f"""WITH {FILE_SCORES} SELECT * FROM scored WHERE value > 20 AND kind IN ('def', 'async')
      UNION ALL SELECT project, path, name, kind, block_line, cognitive, 'cognitive' FROM blocks WHERE kind = 'async' AND cognitive > 20""",
    "q_top_worst": f"""WITH {VIOLATIONS}, {WORST} SELECT * FROM worst ORDER BY value DESC, CASE metric WHEN 'cyclomatic' THEN 0 ELSE 1 END,
      project, path, block_line LIMIT 25""",
    "q_exclusions": f"""WITH {VIOLATIONS}, {EXCLUSIONS} SELECT f.* FROM found f WHERE NOT EXISTS (SELECT 1 FROM exclusions x
      WHERE x.metric = f.metric AND x.block = f.name AND contains(f.path, x.part))""",
    "q_path_filters": f"""WITH {FILES} SELECT project, path, {top('path')} AS top, {parent('path')} AS parent, len(string_split(path, '/')) AS depth FROM files
      WHERE NOT list_has_any(string_split(path, '/'), {list(v.IGNORED_SEGMENTS)!r}) AND NOT list_has_all(string_split(path, '/'), ['core', 'io'])""",
    "q_text_paths": f"WITH {CHANGES} SELECT repo, path, {parent('path')} AS parent, {top('path')} AS top FROM changes WHERE {text_path('path')}",
    "q_located": f"""WITH {FILE_SCORES} SELECT project, path, name, block_line, value, kind <> 'class' AS located FROM scored
      WHERE metric = 'cyclomatic' AND value > 3""",
    "q_block_lines": f"""WITH {FILE_BLOCKS} SELECT b.project, b.path, b.name, b.block_line, d.ln AS line_no, d.raw FROM blocks b
      JOIN deep d ON d.path = b.path AND d.ln BETWEEN b.start_line AND b.end_line WHERE b.total > {v.MAX_SCORE} AND b.kind <> 'class'""",
    "q_with_class": f"""WITH {FILE_BLOCKS} SELECT b.project, b.path, b.name, b.block_line, k.name AS class_name FROM blocks b
      LEFT JOIN blocks k ON k.path = b.path AND k.block_line = b.parent_line AND k.kind = 'class' WHERE b.kind <> 'class'""",
    "q_siblings": f"""WITH {FILE_BLOCKS}, m AS (SELECT * FROM blocks WHERE kind <> 'class' AND parent_kind = 'class')
      SELECT a.project, a.path, a.name, a.block_line, b.block_line AS sibling_line, b.name AS sibling FROM m a JOIN m b
      ON b.path = a.path AND b.parent_line = a.parent_line AND b.block_line <> a.block_line
      QUALIFY row_number() OVER (PARTITION BY a.path, a.block_line ORDER BY b.block_line) <= 5""",
    "q_statements": f"""WITH {FILE_BLOCKS}, {STATEMENTS} SELECT project, path, 'import' AS part, pos, raw FROM import_rows
      UNION ALL SELECT project, path, 'constant', pos, raw FROM constant_rows UNION ALL SELECT project, path, 'init', pos, raw FROM init_rows""",
    "q_context": f"WITH {TARGETS} SELECT project, path, name, block_line, metric, value, sha256(source) AS source_sha, context FROM contexts",
    "q_gate_summary": f"""WITH {FILE_SCORES}, over AS (SELECT * FROM scored WHERE value > 28),
      pairs AS (SELECT DISTINCT project, unnest(['cyclomatic', 'cognitive']) AS metric FROM files)
      SELECT p.project, p.metric, count(o.name) AS n_violations, CAST(p.project IN (SELECT project FROM over) AS INT) AS exit_status
      FROM pairs p LEFT JOIN over o ON o.project = p.project AND o.metric = p.metric GROUP BY p.project, p.metric""",
    "q_rollup": f"""WITH {RUNS} SELECT run, count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed,
      CASE WHEN bool_and(passed) THEN 0 ELSE 1 END AS exit_status FROM runs GROUP BY run""",
    "q_project_status": f"WITH {RUNS} SELECT run, project, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status FROM runs",
    "q_stop_on_error": f"""WITH {RUNS} SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs e WHERE e.run = r.run AND NOT e.passed AND e.seq < r.seq)""",
    "q_unrun": f"""WITH {RUNS} SELECT run, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM runs e WHERE e.run = r.run AND NOT e.passed AND e.seq < r.seq)) AS unrun
      FROM runs r GROUP BY run""",
    "q_report": f"""WITH {FILE_SCORES}, {raw_select('project, path')}
      SELECT path, concat(path, ':', CAST(block_line AS STRING), ' ', name, ' (complexity=', CAST(CAST(value AS BIGINT) AS STRING), ')') AS line FROM scored WHERE metric = 'cyclomatic'
      UNION ALL SELECT path, concat(path, ' sloc=', CAST(sloc AS STRING), ' lloc=', CAST(CAST(lloc AS BIGINT) AS STRING), ' loc=', CAST(loc AS STRING),
        ' comments=', CAST(comments AS STRING), ' blank=', CAST(blank AS STRING), ' multi=', CAST(multi AS STRING)) FROM raw_counts
      UNION ALL SELECT path, concat('  ', path, ':', CAST(block_line AS STRING), ' ', name, ' (', metric, '=', CAST(CAST(value AS BIGINT) AS STRING), ')') FROM scored
        WHERE value > {v.MAX_SCORE}""",
    "q_quarantine": f"""WITH {RESPONSES}, e AS (SELECT item_id, attempt_no, {envelope('r', '$.response')} FROM responses)
      SELECT item_id, attempt_no, r_error AS reason FROM e WHERE r_error IS NOT NULL""",
    "q_quarantine_files": f"""WITH {FILES}, numbered AS (SELECT *, CAST(regexp_extract(path, 'mod(\\d+)', 1) AS BIGINT) % 10 AS n FROM files)
      SELECT project, path, CASE n WHEN 0 THEN 'brackets do not close' WHEN 1 THEN 'not a statement' WHEN 2 THEN 'a quote is not closed' END AS reason,
        CASE WHEN n > 2 THEN CAST(len(string_split(content, {NL})) - CASE WHEN ends_with(content, {NL}) THEN 1 ELSE 0 END AS BIGINT) END AS loc FROM numbered""",
    "q_changes": f"""WITH {CHANGES} SELECT repo, path, CASE WHEN is_binary THEN greatest(1, size) ELSE greatest(1, (added + deleted) * {v.WEIGHT_PER_LINE}) END AS weight,
        0 AS source FROM changes WHERE NOT untracked
      UNION ALL SELECT repo, path, greatest(1, size), 1 FROM changes WHERE untracked""",
    "q_name_status": f"WITH {CHANGES} SELECT repo, status, path, min(size) AS size FROM changes WHERE NOT untracked GROUP BY ALL",
    "q_large": f"""WITH {WEIGHTED} SELECT repo, count(*) AS n_files, CAST(sum(weight) AS BIGINT) AS weight,
      count(*) > {v.MAX_BATCH_FILES} OR sum(weight) > {v.MAX_BATCH_CHARS} AS large FROM weighted GROUP BY repo""",
    "q_batches": f"WITH {BATCHES} SELECT repo, path, weight, batch_id, batch_pos, batch_n FROM batches",
    "q_halves": f"WITH {BATCHES} SELECT repo, path, batch_id, CAST(CASE WHEN batch_pos <= greatest(1, batch_n // 2) THEN 0 ELSE 1 END AS BIGINT) AS half FROM batches",
    "q_scope": f"WITH {BATCHES} SELECT repo, path, status FROM batches WHERE batch_id = 1",
    "q_modal_dir": f"WITH {CHANGES}, {modal('changes', 'repo', 'modals')} SELECT * FROM modals",
    "q_excerpts": f"WITH {BATCHES}, tracked AS (SELECT * FROM batches WHERE NOT untracked), {excerpts('tracked', 'repo, batch_id', 'samples')} SELECT * FROM samples",
    "q_untracked": f"WITH {CHANGES}, {notes('changes', 'repo', 'noted')} SELECT repo, untracked_note, n_untracked FROM noted",
    "q_capped_paths": f"WITH {CHANGES} SELECT repo, path FROM changes QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path) <= 30",
    "q_capped_body": f"""WITH {CHANGES}, items AS (SELECT repo, path, concat('- Handle ', path, ' again') AS entry FROM changes),
      spent AS (SELECT *, sum(length(entry) + 1) OVER (PARTITION BY repo ORDER BY path) AS used, row_number() OVER (PARTITION BY repo ORDER BY path) AS rn,
        count(*) OVER (PARTITION BY repo) AS n FROM items)
      SELECT repo, concat(string_agg(entry, {NL} ORDER BY path), CASE WHEN any_value(n) > count(*) THEN
        concat({NL}, '- ...and ', CAST(any_value(n) - count(*) AS STRING), ' more change areas') ELSE '' END) AS body
      FROM spent WHERE rn = 1 OR used <= {v.MAX_BODY_CHARS} GROUP BY repo""",
    "q_bundle": f'WITH {BUNDLES} SELECT repo, batch_id, "full", lite, paths_only FROM rendered',
    "q_fallbacks": f"""WITH {BUNDLES}, low AS (SELECT *, lower(concat(name_status, {NL}, diff_stat, {NL}, untracked_note)) AS t,
        lower({sub('name_status', '[.][A-Za-z]+')}) AS p FROM bundles)
      SELECT repo, batch_id, concat(coalesce({category('t')}, concat('Update ', repo)), {NL}, {NL}, {q(v.FALLBACK_BODY)}) AS message,
        coalesce({category('t')}, concat('Update ', coalesce(modal_dir, repo))) AS summary,
        coalesce({category('p')}, concat('Update ', coalesce(modal_dir, repo))) AS plain_summary FROM low""",
    "q_prompts": f"""WITH {BUNDLES} SELECT repo, batch_id, sha256({numbered_prompt('')}) AS "user", sha256({numbered_prompt('subject is too generic')}) AS repair,
      sha256(concat('Repository folder name: ', repo, {NL}, {NL}, {q(v.SUMMARY_PROMPT_NOTE)}, {NL}, {NL}, {q(v.DATA_OPEN)}, {NL}, lite, {NL}, {q(v.DATA_CLOSE)}, {NL})) AS summary
      FROM rendered""",
    "q_clean": f"""WITH {ATTEMPTS} SELECT item_id, attempt_no, {spoken('raw')} AS spoken, {normalized('raw')} AS message,
      {first_line('(' + normalized('raw') + ')')} AS subject, {truncated('raw', '120')} AS cut FROM attempts""",
    "q_summary_clean": f"""WITH {ATTEMPTS}, l AS (SELECT item_id, attempt_no, {SUMMARY_LINE} AS line FROM attempts)
      SELECT item_id, attempt_no, line, {summary_problem('line', "'loader'")} AS problem FROM l""",
    "q_fence": f"WITH {ATTEMPTS} SELECT item_id, attempt_no, {fenced('raw')} AS code FROM attempts",
    "q_dedupe": f"""WITH {ATTEMPTS}, l AS (SELECT item_id % 50 AS scope, item_id * 100 + attempt_no AS seq, {first_line('raw')} AS line FROM attempts)
      SELECT scope, seq, line FROM l WHERE {key_of('line')} <> '' QUALIFY row_number() OVER (PARTITION BY scope, {key_of('line')} ORDER BY seq) = 1""",
    "q_quality": f"""WITH {ATTEMPTS}, m AS (SELECT *, {normalized('raw')} AS message FROM attempts)
      SELECT item_id, attempt_no, {problem('message', "'loader'")} AS problem, {generic(first_line('message'), "'loader'")} AS generic,
        {dump(first_line('raw'))} AS dump FROM m""",
    "q_first_acceptable": f"""WITH {ATTEMPTS}, m AS (SELECT *, {normalized('raw')} AS message FROM attempts),
      j AS (SELECT *, {problem('message', "'loader'")} AS problem FROM m),
      best AS (SELECT item_id, attempt_no, message FROM j WHERE problem IS NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY attempt_no) = 1)
      SELECT i.item_id, b.attempt_no, coalesce(b.message, concat('Update loader', {NL}, {NL}, {q(v.FALLBACK_BODY)})) AS message
      FROM (SELECT DISTINCT item_id FROM attempts) i LEFT JOIN best b USING (item_id)""",
    "q_envelope": f"""WITH {RESPONSES} SELECT item_id, attempt_no, {envelope('content', '$.message.content')}, {envelope('response', '$.response')},
      {envelope('result', '$.result')} FROM responses""",
    "q_requests": f"""WITH {ATTEMPTS} SELECT item_id, attempt_no, raw AS chat_prompt, 'system' AS chat_role, CAST(32768 AS BIGINT) AS chat_tokens,
      raw AS plain_prompt, 'false' AS plain_stream, CAST(0.2 AS DOUBLE) AS plain_temperature FROM attempts""",
    "q_rewrite_prompts": f"""WITH {TARGETS}, fb AS (SELECT *, {FEEDBACK} AS feedback FROM contexts)
      SELECT project, path, name, block_line, metric, feedback, concat('  ', name, ': ', metric, '=', CAST(value AS STRING), ' (still > 15)') AS log,
        sha256(concat('Refactor the function `', name, '` to reduce its ', metric, ' complexity from ', CAST(value AS STRING), ' to at most 15.', {NL}, {NL},
          'IMPORTANT — Previous attempt feedback:', {NL}, feedback, {NL}, {NL}, {q(v.REWRITE_NEEDS_HEAD)},
          CAST(length(regexp_extract(source, '^( *)', 1)) AS STRING), {q(v.REWRITE_NEEDS_TAIL)}, {NL}, {NL}, context, {NL}, {NL},
          'Function to refactor:', {NL}, '```python', {NL}, source, '```')) AS prompt_sha,
        sha256(concat({q(v.REWRITE_ROLE)}, {NL}, {NL}, 'Metric: ', metric, ' complexity.', {NL}, {METRIC_TEXT}, {NL}, {NL}, {q(v.REWRITE_RULES)})) AS system_sha FROM fb""",
    "q_reindent": f"""WITH {FILE_BLOCKS}, tails AS (SELECT b.project, b.path, b.name, b.block_line,
        array_to_string(string_split(f.content, {NL})[b.start_line:b.end_line], {NL}) AS tail FROM blocks b JOIN files f USING (path) WHERE b.kind <> 'class'),
      led AS (SELECT *, list_filter(string_split(tail, {NL}), lambda l: {strip('l')} <> '')[1] AS lead FROM tails),
      based AS (SELECT *, coalesce(length(lead) - length(ltrim(lead)), 0) AS indent FROM led)
      SELECT project, path, name, block_line, indent, sha256(array_to_string(list_transform(string_split(tail, {NL}), lambda l: CASE WHEN {strip('l')} <> '' AND
        starts_with(l, repeat(' ', indent)) THEN concat('  ', substring(l, indent + 1)) ELSE l END), {NL})) AS sha FROM based""",
    "q_splice": f"""WITH {PROPOSALS}, one AS (SELECT * FROM worded QUALIFY row_number() OVER (PARTITION BY path ORDER BY block_line) = 1),
      pairs AS (SELECT f.project, f.path, f.content, string_split(f.content, {NL}) AS l, o.start_line, o.end_line, o.new_text FROM files f LEFT JOIN one o USING (path))
      SELECT project, path, sha256(CASE WHEN new_text IS NULL THEN content ELSE concat(CASE WHEN start_line > 1 THEN
        concat(array_to_string(l[1:start_line - 1], {NL}), {NL}) ELSE '' END, new_text, {NL}, array_to_string(l[end_line + 1:], {NL})) END) AS sha FROM pairs""",
    "q_hash_guard": f"""WITH {PROPOSALS} SELECT project, path, name, block_line, CASE WHEN base_sha <> now_sha THEN 'file_modified' END AS reason FROM proposals""",
    "q_revalidate": f"""WITH {PROPOSALS}, judged AS (SELECT *, CASE block_line % 12 WHEN 0 THEN 'brackets do not close' WHEN 1 THEN 'not a statement'
        WHEN 2 THEN 'no code' WHEN 3 THEN 'brackets do not close' WHEN 4 THEN 'brackets do not close' WHEN 5 THEN 'a block is not indented'
        WHEN 6 THEN 'a quote is not closed' WHEN 7 THEN 'a line is indented without a block' END AS error FROM proposals)
      SELECT project, path, name, block_line, metric, error IS NULL AND metric = 'cognitive' AS ok, error,
      CASE WHEN error IS NOT NULL THEN '' WHEN metric = 'cyclomatic' THEN concat('helper=3,', name, '=1') ELSE concat('helper=2,', name, '=0') END AS scores FROM judged""",
    "q_attempt_order": f"WITH {OUTCOMES} SELECT * FROM tried",
    "q_attempt_order_global": f"""WITH {OUTCOMES}, line_up AS (SELECT *, row_number() OVER (ORDER BY value DESC, path, block_line) AS place FROM outcomes)
      SELECT project, path, name, block_line, value, rank, ok FROM line_up WHERE place <= coalesce((SELECT min(place) FROM line_up WHERE ok), place)""",
    "q_not_modified": f"WITH {OUTCOMES} SELECT * FROM outcomes o WHERE NOT EXISTS (SELECT 1 FROM outcomes e WHERE e.path = o.path AND e.ok)",
    "q_rewrite_summary": f"""WITH {OUTCOMES} SELECT project, count(*) FILTER (WHERE ok) AS fixed, count(*) FILTER (WHERE NOT ok) AS failed,
      CASE WHEN count(*) FILTER (WHERE ok) > 0 OR count(*) FILTER (WHERE NOT ok) = 0 THEN 0 ELSE 1 END AS exit_status FROM tried GROUP BY project""",
}
