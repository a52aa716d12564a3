"""DuckDB twins of the bound views, written independently in SQL.

`sql(views, body)` prefixes a query body with the CTEs it needs (in
dependency order), so every oracle string is self-contained and reads only
the driver's pre-registered tables.
"""

from __future__ import annotations

NL = "chr(10)"
SPLIT = r"string_split_regex({x}, '\r\n|\r|\n')"

_LICENSE_CASE = """CASE CAST(substr(source, 4) AS INTEGER) % 7
    WHEN 0 THEN 'MIT License' WHEN 1 THEN 'Apache License 2.0' WHEN 2 THEN 'BSD License'
    WHEN 3 THEN 'GNU General Public License v3.0'
    WHEN 4 THEN 'BSD 3-Clause "New" or "Revised" License'
    WHEN 5 THEN NULL WHEN 6 THEN 'CC BY-NC 4.0' END"""

# code-line fold (strip, triple-quote toggle, comment skip)
_STRIP = r"regexp_replace(l, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"
_OCC_DQ = """((length(l) - length(replace(l, '\"\"\"', ''))) // 3)"""
Q3SQ = "'" + "''" * 3 + "'"  # SQL literal of three single quotes
_OCC_SQ = "((length(l) - length(replace(l, " + Q3SQ + ", ''))) // 3)"
CODE_LINES = (
    "list_reduce(list_transform(" + SPLIT.format(x="{x}") + ", lambda l: " + _STRIP + "), "
    "lambda acc, l: CASE WHEN l = '' THEN acc "
    "WHEN (contains(l, '\"\"\"') OR contains(l, " + Q3SQ + ")) AND (" + _OCC_DQ + " = 2 OR " + _OCC_SQ + " = 2) THEN acc "
    "WHEN (contains(l, '\"\"\"') OR contains(l, " + Q3SQ + ")) THEN {{'blk': NOT acc.blk, 'n': acc.n}} "
    "WHEN acc.blk THEN acc WHEN starts_with(l, '#') THEN acc "
    "ELSE {{'blk': acc.blk, 'n': acc.n + 1}} END, {{'blk': false, 'n': 0::BIGINT}}).n"
)


def code_lines(x: str) -> str:
    return "CAST(" + CODE_LINES.format(x=x) + " AS BIGINT)"


def line_count(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL OR {x} = '' THEN 0 ELSE len({SPLIT.format(x=x)}) - "
            f"(CASE WHEN regexp_matches({x}, '(\\r|\\n)\\z') THEN 1 ELSE 0 END) END)")


def lint_weighted(x: str, max_len: int, max_lines: int = 1000) -> str:
    raw = SPLIT.format(x=x)
    return (f"(len(list_filter({raw}, lambda l: length(l) > {max_len}))"
            f" + len(list_filter({raw}, lambda l: regexp_matches(l, '[ \\t]\\z')))"
            f" + (CASE WHEN {x} <> '' AND NOT regexp_matches({x}, '(\\r|\\n)\\z') THEN 1 ELSE 0 END)"
            f" + (CASE WHEN regexp_matches({x}, '(\\r\\n|\\r|\\n)[ \\t]*(\\r\\n|\\r|\\n)[ \\t\\r\\n]*\\z') THEN 1 ELSE 0 END)"
            f" + (CASE WHEN {line_count(x)} > {max_lines} THEN 1 ELSE 0 END)"
            f" + len(list_filter({raw}, lambda l: regexp_matches(l, '#.*\\b(FIXME|TODO|XXX)\\b'))))")


def license_ok(col: str, allowed=None) -> str:
    from quarry.schema import ALLOWED_LICENSES
    allowed = allowed or ALLOWED_LICENSES
    lits = ", ".join("'" + a.replace("'", "''") + "'" for a in allowed)
    contains = " OR ".join(f"contains({col}, '" + a.replace("'", "''") + "')" for a in allowed)
    return f"({col} IS NULL OR {col} IN ({lits}) OR {contains})"


def py_fixed1(x: str) -> str:
    """DuckDB printf formats the exact binary value half-to-even, as Python."""
    return f"printf('%.1f', CAST({x} AS DOUBLE))"


# Flagship / bound thresholds (mirror quarry.plans.bind.BIND_THRESHOLDS)
MIN_Q, MIN_L, MAX_L, LONG = 6.0, 3, 20, 400

# Thresholds of the generated modules (mirror quarry.plans.bind.PY_THRESHOLDS)
PY_MIN_Q, PY_MIN_L, PY_MAX_L, PY_LONG = 7.0, 20, 400, 20


def _sql_text(x: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in x.split("\n"))


_COMMAS = "(length(l) - length(replace(l, ',', '')))"
_IF = "        if x:\n            x = x - 1\n"
_FOR = "        for y in x:\n            x = y\n"
_WHILE = "        while x:\n            break\n"
_COND = "        x = 1 if x else 0\n"
#: the module of a document: a class with a method per line and a branch per comma
PY_MODULE = (
    "'class Doc' || CAST(doc_id AS VARCHAR) || ':' || chr(10) || array_to_string(list_transform(" + SPLIT.format(x="text")
    + ", lambda l, i: '    def m' || CAST(i - 1 AS VARCHAR) || '(self, x):' || chr(10) || repeat(" + _sql_text(_FOR + _WHILE + _COND + _IF)
    + ", " + _COMMAS + " // 4) || CASE " + _COMMAS + " % 4 WHEN 1 THEN " + _sql_text(_FOR) + " WHEN 2 THEN " + _sql_text(_FOR + _WHILE)
    + " WHEN 3 THEN " + _sql_text(_FOR + _WHILE + _COND) + " ELSE '' END || '        return x' || chr(10)), '')")
#: complexity figures of that module from the commas of each line
PY_COMPLEXITY = f"""
SELECT doc_id AS file_id, CAST(n + 1 AS BIGINT) AS function_count, (sm + cls) / (n + 1) AS complexity_avg,
       CAST(greatest(mx, cls) AS BIGINT) AS complexity_max
FROM (SELECT *, CAST(floor((1 + sm) / n) AS BIGINT) + CASE WHEN n > 1 THEN 1 ELSE 0 END AS cls
      FROM (SELECT doc_id, len(ks) AS n, list_sum(list_transform(ks, lambda k: 1 + k)) AS sm,
                   list_max(list_transform(ks, lambda k: 1 + k)) AS mx
            FROM (SELECT doc_id, list_transform({SPLIT.format(x='text')}, lambda l: {_COMMAS}) AS ks FROM documents)))"""

VIEWS: dict[str, tuple[str, list[str]]] = {}


def _view(name, deps, body):
    VIEWS[name] = (body, deps)


_view("b_repos", [], f"""
SELECT source AS name, source || '/' || lang AS full_name,
       'https://github.com/' || source || '/' || lang AS url,
       'Documents in ' || lang || ' from ' || source AS description,
       CAST(100 * count(*) AS BIGINT) AS stars,
       CAST(sum(n_chars) % 997 AS BIGINT) AS forks,
       TIMESTAMP '2024-01-01 00:00:00' + to_hours(min(doc_id)) AS created_at,
       TIMESTAMP '2024-01-01 00:00:00' + to_hours(max(doc_id)) AS updated_at,
       {_LICENSE_CASE} AS license
FROM documents GROUP BY source, lang""")

_view("b_files_core", [], f"""
SELECT doc_id AS file_id, source AS repo_name, source || '/' || lang AS repo_full_name,
       'https://github.com/' || source || '/' || lang AS repo_url,
       {_LICENSE_CASE} AS repo_license,
       'doc_' || CAST(doc_id AS VARCHAR) || '.py' AS file_name,
       lang || '/doc_' || CAST(doc_id AS VARCHAR) || '.py' AS file_path,
       'https://github.com/' || source || '/' || lang || '/blob/master/' || lang || '/doc_' || CAST(doc_id AS VARCHAR) || '.py' AS file_url,
       'out/' || source || '_' || lang || '/' || lang || '/doc_' || CAST(doc_id AS VARCHAR) || '.py' AS local_path,
       array_to_string(list_transform({SPLIT.format(x='text')}, lambda l, i:
           CASE WHEN (i - 1) % 11 IN (3, 8) THEN '\"\"\"' WHEN (i - 1) % 5 = 0 THEN '# ' || l ELSE l END), {NL}) AS content,
       list_transform({SPLIT.format(x='text')}, lambda p: CAST(1 + length(p) - length(replace(p, ',', '')) AS BIGINT)) AS block_complexities,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%S') AS downloaded_at,
       lang
FROM documents""")

_view("b_files", ["b_files_core", "b_repos"], """
SELECT f.*, r.stars AS repo_stars FROM b_files_core f LEFT JOIN b_repos r ON f.repo_full_name = r.full_name""")

_view("b_sig", ["b_files_core"], f"""
SELECT *, CASE WHEN code_lines > 0 THEN greatest(0.0::DOUBLE, 10.0::DOUBLE - (lint_w * 10) / code_lines) ELSE 0.0::DOUBLE END AS quality_score_raw
FROM (SELECT *, {code_lines('content')} AS code_lines, CAST({lint_weighted('content', LONG)} AS BIGINT) AS lint_w FROM b_files_core)""")

_view("b_verdict", ["b_sig"], f"""
SELECT *, round(quality_score_raw, 2) AS quality_score,
  CASE WHEN content IS NULL THEN 'missing_file'
       WHEN NOT {license_ok('repo_license')} THEN 'license'
       WHEN code_lines < {MIN_L} THEN 'too_few_lines'
       WHEN code_lines > {MAX_L} THEN 'too_many_lines'
       WHEN coalesce(quality_score_raw, 0.0) < {MIN_Q} THEN 'low_quality'
       ELSE 'ok' END AS reason_code
FROM b_sig""")

_view("b_scored", ["b_verdict", "b_repos"], f"""
SELECT v.*, r.stars AS repo_stars, reason_code = 'ok' AS is_suitable,
  CASE reason_code
    WHEN 'missing_file' THEN '파일이 존재하지 않음'
    WHEN 'license' THEN '라이센스 호환성 문제 (' || coalesce(repo_license, 'None') || ')'
    WHEN 'too_few_lines' THEN '코드 라인 수 부족 (' || CAST(code_lines AS VARCHAR) || ' < {MIN_L})'
    WHEN 'too_many_lines' THEN '코드 라인 수 초과 (' || CAST(code_lines AS VARCHAR) || ' > {MAX_L})'
    WHEN 'low_quality' THEN '품질 점수 미달 (' || {py_fixed1('coalesce(quality_score_raw, 0.0)')} || ' < {MIN_Q!r})'
  END AS unsuitable_reason,
  CASE WHEN len(block_complexities) > 0 THEN list_sum(block_complexities) / len(block_complexities) ELSE 0.0 END AS complexity_avg,
  CAST(coalesce(list_max(block_complexities), 0) AS BIGINT) AS complexity_max,
  CAST(len(block_complexities) AS BIGINT) AS function_count
FROM b_verdict v LEFT JOIN b_repos r ON v.repo_full_name = r.full_name""")

_LCOLS = ("repo_name, repo_full_name, repo_url, repo_stars, repo_license, file_name, file_path, file_url, "
          "local_path, quality_score, downloaded_at, code_lines, complexity_avg, complexity_max, function_count, "
          "is_suitable, unsuitable_reason, file_id, lang")
_view("b_landing", ["b_scored"], f"""
SELECT {_LCOLS}, file_id AS seq FROM b_scored
UNION ALL
SELECT repo_name, repo_full_name, repo_url, repo_stars, repo_license, file_name, file_path, file_url,
       local_path, round(quality_score / 2, 2), downloaded_at, code_lines, complexity_avg, complexity_max, function_count,
       is_suitable, unsuitable_reason, file_id, lang, 1 * 72057594037927936 + file_id FROM b_scored WHERE file_id % 10 = 0
UNION ALL
SELECT repo_name, NULL, repo_url, repo_stars, repo_license, file_name, file_path, file_url,
       local_path, quality_score, downloaded_at, code_lines, complexity_avg, complexity_max, function_count,
       is_suitable, unsuitable_reason, file_id, lang, 2 * 72057594037927936 + file_id FROM b_scored WHERE file_id % 25 = 3
UNION ALL
SELECT repo_name, repo_full_name, repo_url, repo_stars, repo_license, file_name || '.bak', file_path || '.bak', file_url,
       NULL, quality_score, downloaded_at, code_lines, complexity_avg, complexity_max, function_count,
       is_suitable, unsuitable_reason, file_id, lang, 3 * 72057594037927936 + file_id FROM b_scored WHERE file_id % 40 = 11""")

# catalogue: first row wins per repository / per (repository, path)
_view("c_repos", ["b_landing"], """
SELECT name, full_name, url, CAST(coalesce(stars, 0) AS BIGINT) AS stars, license FROM (
  SELECT repo_name AS name, repo_full_name AS full_name, repo_url AS url, repo_stars AS stars,
         repo_license AS license,
         row_number() OVER (PARTITION BY repo_full_name ORDER BY seq) AS rn
  FROM b_landing WHERE repo_full_name IS NOT NULL AND repo_full_name <> '') WHERE rn = 1""")

_view("c_files", ["b_landing"], """
SELECT file_id AS id, repo_full_name, file_name AS name, file_path AS path, file_url AS url, local_path,
       quality_score, code_lines, coalesce(is_suitable, false) AS is_suitable, unsuitable_reason,
       complexity_avg, complexity_max, function_count,
       CAST(replace(downloaded_at, 'T', ' ') AS TIMESTAMP) AS downloaded_at FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_full_name, file_path ORDER BY seq) AS rn
  FROM b_landing
  WHERE repo_full_name IS NOT NULL AND repo_full_name <> ''
    AND file_name IS NOT NULL AND file_path IS NOT NULL AND file_url IS NOT NULL AND local_path IS NOT NULL)
WHERE rn = 1""")

_view("b_tag_ops", [], """
SELECT doc_id AS file_id, lang AS tag, 'add' AS action, CAST(doc_id * 3 AS BIGINT) AS seq FROM documents
UNION ALL SELECT doc_id, 'quality', 'add', CAST(doc_id * 3 + 1 AS BIGINT) FROM labels WHERE quality = 1
UNION ALL SELECT doc_id, 'toxic', 'add', CAST(doc_id * 3 + 2 AS BIGINT) FROM labels WHERE toxic = 1
UNION ALL SELECT CAST(user_id AS BIGINT), event_type, CASE WHEN event_id % 3 = 0 THEN 'remove' ELSE 'add' END,
                 CAST(1152921504606846976 + event_id AS BIGINT) FROM events""")

_view("c_file_tags", ["b_tag_ops"], """
SELECT file_id, tag FROM b_tag_ops GROUP BY file_id, tag HAVING arg_max(action, seq) = 'add'""")

_view("c_tags", ["b_tag_ops"], """
SELECT DISTINCT tag AS name FROM b_tag_ops WHERE action = 'add'""")

_view("c_file_tag_lists", ["c_file_tags"], """
SELECT file_id, array_to_string(list_sort(list(tag)), ', ') AS tags FROM c_file_tags GROUP BY file_id""")

_view("c_catalog", ["c_files", "c_repos"], """
SELECT f.*, r.name AS repo_name, r.url AS repo_url, r.stars AS repo_stars, r.license AS repo_license
FROM c_files f JOIN c_repos r ON f.repo_full_name = r.full_name""")

_view("b_listing", [], """
SELECT source || '/' || lang AS repo_full_name,
       'doc_' || CAST(doc_id AS VARCHAR) || CASE WHEN n_chars % 5 = 0 THEN '.md' ELSE '.py' END AS name,
       lang || '/' || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'pkg/' ELSE 'pkg/sub/' END
            || 'doc_' || CAST(doc_id AS VARCHAR) || CASE WHEN n_chars % 5 = 0 THEN '.md' ELSE '.py' END AS path,
       md5(text) AS sha, CAST(n_chars AS BIGINT) AS size
FROM documents""")

_view("b_bodies", [], """
SELECT source || '/' || lang AS repo_full_name,
       lang || '/' || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'pkg/' ELSE 'pkg/sub/' END
            || 'doc_' || CAST(doc_id AS VARCHAR) || CASE WHEN n_chars % 5 = 0 THEN '.md' ELSE '.py' END AS path,
       'doc_' || CAST(doc_id AS VARCHAR) || CASE WHEN n_chars % 5 = 0 THEN '.md' ELSE '.py' END AS name,
       """ + PY_MODULE + """ AS content, """ + _LICENSE_CASE + """ AS repo_license,
       c.function_count, c.complexity_avg, c.complexity_max
FROM documents JOIN (""" + PY_COMPLEXITY + """) c ON c.file_id = doc_id""")

_view("b_modules", [], f"""
SELECT doc_id AS file_id, {_LICENSE_CASE} AS repo_license,
       'out/' || source || '_' || lang || '/' || lang || '/doc_' || CAST(doc_id AS VARCHAR) || '.py' AS local_path,
       {PY_MODULE} AS content, c.function_count, c.complexity_avg, c.complexity_max
FROM documents JOIN ({PY_COMPLEXITY}) c ON c.file_id = doc_id""")

_view("b_job_events", [], """
SELECT CAST(user_id AS BIGINT) AS job_id, CAST(event_id AS BIGINT) AS seq, ts,
       'user:' || CAST(user_id AS VARCHAR) AS query,
       CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'completed'
            ELSE 'in_progress' END AS status,
       CAST(floor(value) AS BIGINT) AS files_downloaded,
       CASE WHEN event_type = 'error' THEN props END AS error
FROM events""")

_view("c_jobs", ["b_job_events"], """
SELECT job_id AS id, min(ts) AS start_time, arg_min(query, seq) AS query, arg_max(status, seq) AS status,
       arg_max_null(files_downloaded, seq) AS files_downloaded,
       CASE WHEN arg_max(status, seq) IN ('completed', 'failed') THEN arg_max(ts, seq) END AS end_time,
       arg_max_null(error, seq) AS error, min(seq) AS first_seq, max(seq) AS last_seq,
       CAST(count(*) AS BIGINT) AS n_events
FROM b_job_events GROUP BY job_id""")


def sql(views: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """`body` prefixed with the CTEs of `views` (dependencies first) and then
    the query-specific `extra` CTEs, in order."""
    order: list[str] = []

    def visit(v):
        if v in order:
            return
        for d in VIEWS[v][1]:
            visit(d)
        order.append(v)

    for v in views:
        visit(v)
    parts = [(v, VIEWS[v][0]) for v in order] + list(extra or [])
    if not parts:
        return body.strip()
    ctes = ",\n".join(f"{name} AS ({text.strip()})" for name, text in parts)
    return f"WITH {ctes}\n{body.strip()}"
