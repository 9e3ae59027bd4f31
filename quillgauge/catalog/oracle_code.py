"""DuckDB statements for the code queries: lines, tokens, blocks and scores as tables.

They state the same definitions by joins and windows over exploded lines, while the Spark
operators scan each file inside its row, so the two sides share no method.
"""

from __future__ import annotations

from quillgauge.catalog.inputs import DUCK, files_sql
from quillgauge.functions import fixed as v


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(items: list[str]) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


BREAKS = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
WHITE = "concat(chr(9), chr(10), chr(11), chr(12), chr(13), chr(28), chr(29), chr(30), chr(31), ' ', chr(133), chr(160))"
TRIPLE = (
    r'"""(?:[^"\\]|\\[\s\S]|"{1,2}(?:[^"\\]|\\[\s\S]))*"""' + "|"
    + r"'''(?:[^'\\]|\\[\s\S]|'{1,2}(?:[^'\\]|\\[\s\S]))*'''"
)
QUOTED = r'"(?:[^"\\\n]|\\[\s\S])*"' + "|" + r"'(?:[^'\\\n]|\\[\s\S])*'"
SEGMENT = "|".join([TRIPLE, QUOTED, r"#[^\n]*", r"""[^"'#]+""", r"""["']"""])
TOKEN = "|".join(
    [TRIPLE, QUOTED, r"#[^\n]*", r"[\p{L}_][\p{L}\p{N}_]*", r"\p{N}+", r"[^\s\p{L}\p{N}_]"]
)
NAME = r"[\p{L}_][\p{L}\p{N}_]*"


def strip(x: str) -> str:
    return f"trim({x}, {WHITE})"


def count_of(x: str, chars: str) -> str:
    return f"(length({x}) - length(translate({x}, {q(chars)}, '')))"


def texts_cte(source: str, keys: str, text: str) -> str:
    quoted = f"(s LIKE {q(chr(34) + '%')} OR s LIKE {q(chr(39) + '%')})"
    long = f"(s LIKE {q(chr(34) * 3 + '%')} OR s LIKE {q(chr(39) * 3 + '%')} OR contains(s, chr(10)))"
    return f"""texts AS (SELECT {keys}, regexp_replace({text}, {q(BREAKS)}, chr(10), 'g') AS text FROM {source}),
blanked AS (SELECT *, replace(array_to_string(list_transform(regexp_extract_all(text, {q(SEGMENT)}), lambda s: CASE
    WHEN {quoted} AND {long} THEN regexp_replace(s, '[^\\n]+', chr(1), 'g')
    WHEN {quoted} AND length(s) > 1 THEN {q('""')}
    WHEN s LIKE '#%' THEN '#' ELSE s END), ''), concat(chr(92), chr(10)), concat(chr(92), chr(10), chr(1))) AS code FROM texts)"""


def facts_cte(keys: str) -> str:
    return f"""split AS (SELECT {keys}, string_split(text, chr(10)) AS raws, string_split(code, chr(10)) AS codes FROM blanked),
numbered AS (SELECT {keys}, raws, codes, unnest(range(1, 1 + len(raws) - CASE WHEN raws[-1] = '' THEN 1 ELSE 0 END)) AS ln FROM split),
plain AS (SELECT {keys}, CAST(ln AS INT) AS ln, raws[ln] AS raw, codes[ln] AS code FROM numbered),
facts AS (SELECT *, length(raw) - length(ltrim(raw, {WHITE})) AS indent,
    CASE WHEN {strip('raw')} = '' THEN 'blank' WHEN {strip('code')} LIKE '#%' THEN 'comment'
      WHEN {strip('code')} = chr(1) THEN 'multi' ELSE 'code' END AS kind,
    starts_with({strip('code')}, chr(1)) AS cont,
    {count_of('code', '([{')} - {count_of('code', ')]}')} AS delta FROM plain),
deep AS (SELECT *, coalesce(sum(CASE WHEN kind IN ('code', 'multi') THEN delta ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY ln
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM facts)"""


def raw_select(keys: str) -> str:
    return f"""raw_counts AS (SELECT {keys}, count(ln) AS loc,
    CAST(coalesce(sum(CASE WHEN kind = 'code' THEN CASE WHEN depth <= 0 AND NOT cont THEN 1 ELSE 0 END
      + {count_of('code', ';')} ELSE 0 END), 0) AS BIGINT) AS lloc,
    count(*) FILTER (WHERE kind = 'code') AS sloc, count(*) FILTER (WHERE contains(code, '#')) AS comments,
    count(*) FILTER (WHERE kind = 'comment') AS comment_only, count(*) FILTER (WHERE kind = 'blank') AS blank,
    count(*) FILTER (WHERE kind = 'multi') AS multi
  FROM texts LEFT JOIN deep USING ({keys}) GROUP BY {keys})"""


def tokens_cte(keys: str) -> str:
    return f"""toks AS (SELECT {keys}, unnest(list_filter(regexp_extract_all(text, {q(TOKEN)}), lambda t: t NOT LIKE '#%')) AS token,
    generate_subscripts(list_filter(regexp_extract_all(text, {q(TOKEN)}), lambda t: t NOT LIKE '#%'), 1) - 1 AS pos FROM texts),
typed AS (SELECT *, (regexp_matches(token, '^[\\p{{L}}\\p{{N}}_]') AND token NOT IN {words(v.KEYWORDS)})
    OR ((token LIKE {q('"%')} OR token LIKE {q("'%")}) AND length(token) > 1) AS is_operand FROM toks),
hal0 AS (SELECT {keys}, count(DISTINCT token) FILTER (WHERE NOT is_operand) AS h1, count(DISTINCT token) FILTER (WHERE is_operand) AS h2,
    count(token) FILTER (WHERE NOT is_operand) AS N1x, count(token) FILTER (WHERE is_operand) AS N2x
  FROM texts LEFT JOIN typed USING ({keys}) GROUP BY {keys}),
hal AS (SELECT {keys}, h1, h2, N1x, N2x,
    CASE WHEN h1 + h2 > 0 THEN (N1x + N2x) * log2(h1 + h2) ELSE 0 END AS volume,
    CASE WHEN h2 > 0 THEN (h1 / 2.0) * (CAST(N2x AS DOUBLE) / h2) ELSE 0 END AS difficulty FROM hal0)"""


BLOCKS_CTE = f"""logical AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ln) AS rn FROM deep
    WHERE kind = 'code' AND depth <= 0 AND NOT cont),
content AS (SELECT *, len(list_filter(regexp_extract_all(code, {q(NAME)}), lambda t: t IN {words(v.DECISION_WORDS)})) AS dec,
    list_filter(regexp_extract_all(code, {q(NAME)}), lambda t: t IN {words(v.BOOLEAN_WORDS)}) AS joins
  FROM deep WHERE kind IN ('code', 'multi')),
run_counts AS (SELECT path, ln, len(list_filter(range(1, len(joins) + 1), lambda i: i = 1 OR joins[i] <> joins[i - 1])) AS runs
  FROM content),
header_rx AS (SELECT *, regexp_extract(code, {q(r'^\s*(async\s+def|def|class)\s+(' + NAME + ')')}, 1) AS head,
    regexp_extract(code, {q(r'^\s*(async\s+def|def|class)\s+(' + NAME + ')')}, 2) AS name FROM logical),
heads0 AS (SELECT *, CASE WHEN head = 'class' THEN 'class' WHEN head = 'def' THEN 'def' ELSE 'async' END AS bkind
  FROM header_rx WHERE head <> ''),
closers AS (SELECT h.path, h.ln, min(r.ln) AS closer FROM heads0 h LEFT JOIN logical r
    ON r.path = h.path AND r.ln > h.ln AND r.indent <= h.indent GROUP BY h.path, h.ln),
spans AS (SELECT h.*, coalesce(c.closer, 1000000000) AS closer FROM heads0 h JOIN closers c USING (path, ln)),
ends AS (SELECT s.path, s.ln, max(x.ln) AS end_line FROM spans s JOIN content x ON x.path = s.path AND x.ln >= s.ln AND x.ln < s.closer
    GROUP BY s.path, s.ln),
undecorated AS (SELECT h.path, h.ln, coalesce(max(r.rn), 0) AS rn FROM heads0 h LEFT JOIN logical r ON r.path = h.path AND r.rn < h.rn
    AND NOT ({strip('r.code')} LIKE '@%' AND r.indent = h.indent) GROUP BY h.path, h.ln),
starts AS (SELECT u.path, u.ln, r.ln AS start_line FROM undecorated u JOIN logical r ON r.path = u.path AND r.rn = u.rn + 1),
parents AS (SELECT s.path, s.ln, max(p.ln) AS parent_line FROM spans s LEFT JOIN spans p ON p.path = s.path AND p.ln < s.ln AND p.closer > s.ln
    GROUP BY s.path, s.ln),
inner_of AS (SELECT x.path, x.ln, max(s.ln) AS inner_line, any_value(x.dec) AS dec FROM content x JOIN spans s
    ON s.path = x.path AND s.ln <= x.ln AND x.ln < s.closer GROUP BY x.path, x.ln),
owns AS (SELECT path, inner_line AS ln, 1 + sum(dec) AS own FROM inner_of GROUP BY path, inner_line),
totals AS (SELECT s.path, s.ln, coalesce(sum(o.own) FILTER (WHERE s.bkind <> 'class' OR o.ln <> s.ln), 0) AS total
  FROM spans s JOIN owns o ON o.path = s.path AND o.ln >= s.ln AND o.ln < s.closer GROUP BY s.path, s.ln),
controls0 AS (SELECT path, ln, indent FROM logical
  WHERE regexp_extract({strip('code')}, {q('^(' + NAME + ')')}, 1) IN {words(v.CONTROL_WORDS)}),
controls AS (SELECT c.path, c.ln, coalesce(min(r.ln), 1000000000) AS closer FROM controls0 c LEFT JOIN logical r
    ON r.path = c.path AND r.ln > c.ln AND r.indent <= c.indent GROUP BY c.path, c.ln),
ctl AS (SELECT s.path, s.ln, count(*) AS n FROM spans s JOIN controls c ON c.path = s.path AND c.ln >= s.ln AND c.ln < s.closer
    GROUP BY s.path, s.ln),
nested AS (SELECT s.path, s.ln, count(*) AS n FROM spans s JOIN controls c ON c.path = s.path AND c.ln >= s.ln AND c.ln < s.closer
    JOIN controls o ON o.path = s.path AND o.ln >= s.ln AND o.ln < c.ln AND o.closer > c.ln GROUP BY s.path, s.ln),
bool_runs AS (SELECT s.path, s.ln, sum(r.runs) AS n FROM spans s JOIN run_counts r ON r.path = s.path AND r.ln >= s.ln AND r.ln < s.closer
    GROUP BY s.path, s.ln),
blocks AS MATERIALIZED (SELECT s.project, s.path, s.name, s.bkind AS kind, s.ln AS block_line, st.start_line, e.end_line, p.parent_line,
    pk.bkind AS parent_kind, CAST(o.own AS BIGINT) AS own, CAST(t.total AS BIGINT) AS total,
    CAST(coalesce(c.n, 0) + coalesce(n.n, 0) + coalesce(b.n, 0) AS BIGINT) AS cognitive
  FROM spans s JOIN ends e USING (path, ln) JOIN starts st USING (path, ln) JOIN parents p USING (path, ln)
  LEFT JOIN heads0 pk ON pk.path = s.path AND pk.ln = p.parent_line
  JOIN owns o ON o.path = s.path AND o.ln = s.ln JOIN totals t ON t.path = s.path AND t.ln = s.ln
  LEFT JOIN ctl c ON c.path = s.path AND c.ln = s.ln LEFT JOIN nested n ON n.path = s.path AND n.ln = s.ln
  LEFT JOIN bool_runs b ON b.path = s.path AND b.ln = s.ln)"""

FILES = f"files AS ({files_sql(DUCK)})"
FILE_FACTS = f"{FILES},\n{texts_cte('files', 'project, path', 'content')},\n{facts_cte('project, path')}"
FILE_BLOCKS = f"{FILE_FACTS},\n{BLOCKS_CTE}"
SCORES = """scored AS (SELECT project, path, name, kind, block_line, CASE WHEN kind = 'class' THEN own ELSE total END AS value,
    'cyclomatic' AS metric FROM blocks WHERE coalesce(parent_kind, 'class') = 'class'
  UNION ALL SELECT project, path, name, kind, block_line, cognitive, 'cognitive' FROM blocks WHERE kind = 'def')"""
FILE_SCORES = f"{FILE_BLOCKS},\n{SCORES}"
