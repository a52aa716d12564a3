"""Registered queries: signals, verdict, listing, text helpers (A4, A6, B1-B6,
B13-B15, C1-C11, E7, E8, E13, G5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import schema
from quarry.functions.lines import code_line_count
from quarry.functions.signals import complexity_summary, extract_rating, format_rating_report, license_ok
from quarry.functions.text import basename, dirname, landing_path, parse_iso, parse_repo_url, preview
from quarry.operators.jobs import progress
from quarry.operators.report import required_field_gaps
from quarry.operators.repos import list_source_files, python_files
from quarry.operators.suitability import add_signals, reason_breakdown, suitable, unsuitable, verdict_counts
from quarry.plans import bind as B
from quarry.plans import oracle as O
from quarry.plans.registry import query
from quarry.schema import Thresholds

URL_HOST = "blog.tionsh.example.net"
LICENSE_LINE_RE = r"[^\r\n]*(?i:licen)[^\r\n]*"
# Same leftmost match, but only tried at line starts (Java lookbehind), which
# keeps the scan linear in the text length.
LICENSE_LINE_RE_ANCHORED = r"(?<![^\r\n])[^\r\n]*(?i:licen)[^\r\n]*"


# --- flagship --------------------------------------------------------------

@query("e13_reason_breakdown", O.sql(["b_verdict"], """
SELECT reason_code, CAST(count(*) AS BIGINT) AS files FROM b_verdict GROUP BY reason_code"""))
def e13_reason_breakdown(spark, sf):
    """Files per verdict reason over the whole bound corpus (flagship)."""
    return reason_breakdown(B.b_judged_core(spark, sf))


# --- C1 / C2 / C4 --------------------------------------------------------------

@query("c1_code_lines", O.sql(["b_sig"], "SELECT file_id, code_lines FROM b_sig"))
def c1_code_lines(spark, sf):
    """Code lines of every bound source (array fold, no shuffle)."""
    f = B.b_files_core(spark, sf)
    return f.select("file_id", code_line_count("content").alias("code_lines"))


@query("c1_code_lines_raw_text", O.sql([], f"""
SELECT doc_id, {O.code_lines('text')} AS code_lines FROM documents"""))
def c1_code_lines_raw_text(spark, sf):
    """Code-line rule on the unmodified document text."""
    d = B.read_table(spark, sf, "documents")
    return d.select("doc_id", code_line_count("text").alias("code_lines"))


@query("c2_lint_score", O.sql(["b_sig"], """
SELECT file_id, lint_w AS findings, round(quality_score_raw, 2) AS quality_score FROM b_sig"""))
def c2_lint_score(spark, sf):
    """Native lint findings (weighted) and score of every bound source."""
    s = add_signals(B.b_files_core(spark, sf), "content", B.BIND_THRESHOLDS)
    lf = F.col("lint_findings")
    w = (lf["error"] * 5 + lf["warning"] + lf["refactor"] + lf["convention"]).cast("bigint")
    return s.select("file_id", w.alias("findings"), "quality_score")


@query("c2_lint_score_default_rules", O.sql(["b_files_core"], f"""
SELECT file_id, CASE WHEN cl > 0 THEN round(greatest(0.0::DOUBLE, 10.0::DOUBLE - (w * 10) / cl), 2) ELSE 0.0 END AS quality_score
FROM (SELECT file_id, {O.code_lines('content')} AS cl, CAST({O.lint_weighted('content', 100)} AS BIGINT) AS w FROM b_files_core)"""))
def c2_lint_score_default_rules(spark, sf):
    """Native lint score with the default line-length rule (100)."""
    s = add_signals(B.b_files_core(spark, sf), "content", Thresholds())
    return s.select("file_id", "quality_score")


@query("c4_extract_rating", O.sql(["b_sig"], r"""
SELECT file_id, report, coalesce(greatest(0.0::DOUBLE, TRY_CAST(nullif(regexp_extract(report, 'Your code has been rated at ([-\d.]+)/10', 1), '') AS DOUBLE)), 0.0::DOUBLE) AS rating
FROM (SELECT file_id,
        CASE WHEN code_lines > 0 THEN
          'Your code has been rated at ' || (CASE WHEN h < 0 THEN '-' ELSE '' END) || CAST(abs(h) // 100 AS VARCHAR)
          || '.' || lpad(CAST(abs(h) % 100 AS VARCHAR), 2, '0') || '/10'
        ELSE 'No statements to rate' END AS report
      FROM (SELECT file_id, code_lines,
              CAST(round((10.0::DOUBLE - (lint_w * 10) / greatest(code_lines, 1)) * 100) AS BIGINT) AS h FROM b_sig))"""))
def c4_extract_rating(spark, sf):
    """Lint report lines (unclamped rating, can be negative) parsed back to a rating."""
    s = add_signals(B.b_files_core(spark, sf), "content", B.BIND_THRESHOLDS)
    lf = F.col("lint_findings")
    w = lf["error"] * 5 + lf["warning"] + lf["refactor"] + lf["convention"]
    h = F.round((F.lit(10.0) - (w * 10) / F.greatest(F.col("code_lines"), F.lit(1))) * 100).cast("bigint")
    report = F.when(F.col("code_lines") > 0, format_rating_report(h)).otherwise(F.lit("No statements to rate"))
    r = s.select("file_id", report.alias("report"))
    return r.withColumn("rating", extract_rating("report"))


# --- B2 / B3 / B4 / B5 / B6 / E7 ----------------------------------------------

@query("b2_license_repos", O.sql(["b_repos"], f"""
SELECT full_name, license, {O.license_ok('license')} AS license_ok FROM b_repos"""))
def b2_license_repos(spark, sf):
    """Licence rule on every repository licence."""
    r = B.b_repos(spark, sf)
    return r.select("full_name", "license", license_ok("license").alias("license_ok"))


@query("b2_license_text", O.sql([], f"""
SELECT doc_id, lic AS license_text, {O.license_ok('lic')} AS license_ok
FROM (SELECT doc_id, nullif(regexp_extract(text, '{LICENSE_LINE_RE}', 0), '') AS lic FROM documents)"""))
def b2_license_text(spark, sf):
    """Licence line found in each document's text, checked by the licence rule."""
    d = B.read_table(spark, sf, "documents")
    lic = F.regexp_extract("text", LICENSE_LINE_RE_ANCHORED, 0)
    t = d.select("doc_id", F.when(lic == "", None).otherwise(lic).alias("license_text"))
    return t.withColumn("license_ok", license_ok("license_text"))


@query("b3_verdict", O.sql(["b_scored"], """
SELECT file_id, code_lines, quality_score, reason_code, is_suitable, unsuitable_reason FROM b_scored"""))
def b3_verdict(spark, sf):
    """Verdict and reason text of every bound file (first failing rule wins)."""
    v = B.b_judged_core(spark, sf)
    return v.select("file_id", "code_lines", "quality_score", "reason_code", "is_suitable", "unsuitable_reason")


def _verdict_sql(min_q, min_l, max_l, long_len):
    return _verdict_body("b_files_core", min_q, min_l, max_l, long_len)


def _verdict_body(source, min_q, min_l, max_l, long_len):
    return f"""
SELECT *, CASE WHEN content IS NULL THEN 'missing_file'
       WHEN NOT {O.license_ok('repo_license')} THEN 'license'
       WHEN code_lines < {min_l} THEN 'too_few_lines'
       WHEN code_lines > {max_l} THEN 'too_many_lines'
       WHEN coalesce(q, 0.0) < {min_q} THEN 'low_quality' ELSE 'ok' END AS reason_code
FROM (SELECT *, CASE WHEN code_lines > 0 THEN greatest(0.0::DOUBLE, 10.0::DOUBLE - (w * 10) / code_lines) ELSE 0.0::DOUBLE END AS q
      FROM (SELECT *, {O.code_lines('content')} AS code_lines, CAST({O.lint_weighted('content', long_len)} AS BIGINT) AS w
            FROM {source}))"""


@query("b5_default_thresholds", O.sql(["b_files_core"], f"""
SELECT reason_code, CAST(count(*) AS BIGINT) AS files FROM ({_verdict_sql(6.0, 10, 1000, 100)}) GROUP BY reason_code"""))
def b5_default_thresholds(spark, sf):
    """Reason breakdown under the original default thresholds (10..1000 lines, 6.0, 100 chars)."""
    return reason_breakdown(B.b_judged_core(spark, sf, Thresholds()))


@query("b5_threshold_override", O.sql(["b_files_core"], f"""
SELECT reason_code, CAST(count(*) AS BIGINT) AS files FROM ({_verdict_sql(4.5, 5, 30, 250)}) GROUP BY reason_code"""))
def b5_threshold_override(spark, sf):
    """Reason breakdown with overridden thresholds (min score 4.5, lines 5..30, long line 250)."""
    th = Thresholds(min_quality=4.5, min_lines=5, max_lines=30, lint=B.LintRules(max_line_length=250))
    return reason_breakdown(B.b_judged_core(spark, sf, th))


_PY = (O.PY_MIN_Q, O.PY_MIN_L, O.PY_MAX_L, O.PY_LONG)


def reason_case(lic, lines, q, min_q, min_l, max_l):
    """The reason texts of `quarry.schema` in SQL."""
    def fill(template, *values):
        parts = [f"'{p}'" for p in template.split("{}")]
        return " || ".join(x for pair in zip(parts, [*values, ""]) for x in pair if x)
    none = "'None'"
    return (f"CASE reason_code WHEN 'ok' THEN NULL "
            f"WHEN 'license' THEN {fill(schema.REASON_LICENSE, f'coalesce({lic}, {none})')} "
            f"WHEN 'too_few_lines' THEN {fill(schema.REASON_TOO_SHORT, f'CAST({lines} AS VARCHAR)', repr(str(min_l)))} "
            f"WHEN 'too_many_lines' THEN {fill(schema.REASON_TOO_LONG, f'CAST({lines} AS VARCHAR)', repr(str(max_l)))} "
            f"WHEN 'low_quality' THEN {fill(schema.REASON_LOW_QUALITY, O.py_fixed1(f'coalesce({q}, 0.0)'), repr(repr(min_q)))} "
            f"ELSE '{schema.REASON_MISSING}' END")


_B4_SQL = O.sql(["b_landing", "b_modules"], f"""
SELECT l.seq, l.file_id, s.code_lines, round(s.q, 2) AS quality_score, s.reason_code = 'ok' AS is_suitable,
       {reason_case('l.repo_license', 's.code_lines', 's.q', *_PY[:3])} AS unsuitable_reason,
       s.function_count, s.complexity_avg, s.complexity_max
FROM b_landing l
LEFT JOIN ({_verdict_body("b_modules", *_PY)}) s ON l.local_path = s.local_path
WHERE l.local_path IS NOT NULL AND l.local_path <> ''""")


def _b4(spark, sf):
    from quarry.operators.suitability import filter_landing
    return filter_landing(B.b_landing(spark, sf), B.b_modules(spark, sf), B.PY_THRESHOLDS)


@query("b4_apply_verdict", _B4_SQL)
def b4_apply_verdict(spark, sf):
    """Re-judge every landing row that has a local path from its stored module."""
    c = F.col("complexity")
    return _b4(spark, sf).select("seq", "file_id", "code_lines", "quality_score", "is_suitable", "unsuitable_reason",
                                 c["function_count"].alias("function_count"), c["avg_complexity"].alias("complexity_avg"),
                                 c["max_complexity"].alias("complexity_max"))


@query("e7_verdict_counts", f"""
SELECT CAST(count_if(coalesce(is_suitable, false)) AS BIGINT) AS suitable,
       CAST(count_if(NOT coalesce(is_suitable, false)) AS BIGINT) AS unsuitable FROM ({_B4_SQL}) t""")
def e7_verdict_counts(spark, sf):
    """Suitable / unsuitable counters of the landing re-judgement."""
    return verdict_counts(_b4(spark, sf))


@query("b6_suitable", O.sql(["b_landing"], "SELECT seq, file_id FROM b_landing WHERE coalesce(is_suitable, false)"))
def b6_suitable(spark, sf):
    """Landing rows judged suitable."""
    return suitable(B.b_landing(spark, sf)).select("seq", "file_id")


@query("b6_unsuitable", O.sql(["b_landing"], "SELECT seq, file_id, unsuitable_reason FROM b_landing WHERE NOT coalesce(is_suitable, false)"))
def b6_unsuitable(spark, sf):
    """Landing rows judged unsuitable (null verdict counts as unsuitable)."""
    return unsuitable(B.b_landing(spark, sf)).select("seq", "file_id", "unsuitable_reason")


# --- E8 / C5 ------------------------------------------------------------------

@query("e8_block_complexity", O.sql(["b_scored"], """
SELECT file_id, complexity_avg, complexity_max, function_count FROM b_scored"""))
def e8_block_complexity(spark, sf):
    """avg / max / count of block complexities per file (zeros when empty)."""
    f = B.b_files_core(spark, sf)
    c = complexity_summary(F.col("block_complexities"))
    return f.select("file_id", c["avg_complexity"].alias("complexity_avg"),
                    c["max_complexity"].alias("complexity_max"), c["function_count"].alias("function_count"))


@query("c5_nest_unnest", O.sql(["b_scored"], """
SELECT file_id, complexity_avg AS avg_complexity, complexity_max AS max_complexity, function_count FROM b_scored"""))
def c5_nest_unnest(spark, sf):
    """Complexity nested into a struct on the landing, then un-nested to columns."""
    l = B.b_scored_files(spark, sf)
    return l.select("file_id", "complexity.avg_complexity", "complexity.max_complexity", "complexity.function_count")


# --- listing: A4 / A6 / B1 / G5 / C9 ----------------------------------------

@query("b1_py_suffix", O.sql(["b_listing"], "SELECT repo_full_name, name, path FROM b_listing WHERE suffix(name, '.py')"))
def b1_py_suffix(spark, sf):
    """Listing entries whose name ends with .py."""
    return python_files(B.b_listing(spark, sf)).select("repo_full_name", "name", "path")


_DEPTH = "CAST(length(path) - length(replace(path, '/', '')) AS BIGINT)"


@query("a4_list_source_files", O.sql(["b_listing"], f"""
SELECT repo_full_name, name, path, sha, size, {_DEPTH} AS depth FROM b_listing WHERE suffix(name, '.py')"""))
def a4_list_source_files(spark, sf):
    """All .py files of every repository with their depth (no cap)."""
    return list_source_files(B.b_listing(spark, sf), None).select("repo_full_name", "name", "path", "sha", "size", "depth")


@query("g5_first_files_per_repo", O.sql(["b_listing"], f"""
SELECT repo_full_name, path, depth, rank FROM (
  SELECT repo_full_name, path, {_DEPTH} AS depth,
         CAST(row_number() OVER (PARTITION BY repo_full_name ORDER BY {_DEPTH}, path) AS INTEGER) AS rank
  FROM b_listing WHERE suffix(name, '.py')) WHERE rank <= 5"""))
def g5_first_files_per_repo(spark, sf):
    """First 5 .py files per repository in breadth-first order."""
    return list_source_files(B.b_listing(spark, sf), 5).select("repo_full_name", "path", "depth", "rank")


@query("a6_landing_path", O.sql(["b_listing"], """
SELECT repo_full_name, path, 'out/' || replace(repo_full_name, '/', '_') || '/' || path AS local_path FROM b_listing"""))
def a6_landing_path(spark, sf):
    """Landing path out/<owner>_<repo>/<path> of every listed file."""
    l = B.b_listing(spark, sf)
    return l.select("repo_full_name", "path", landing_path("out", F.col("repo_full_name"), F.col("path")).alias("local_path"))


@query("c9_basename_dirname", O.sql(["b_listing"], r"""
SELECT path, string_split(path, '/')[-1] AS base_name, regexp_replace(path, '/?[^/]*$', '') AS dir_name FROM b_listing"""))
def c9_basename_dirname(spark, sf):
    """basename / dirname of every listed path."""
    l = B.b_listing(spark, sf)
    return l.select("path", basename("path").alias("base_name"), dirname("path").alias("dir_name"))


# --- B13 / B14 / B15 / C10 / C11 ---------------------------------------------

@query("b13_preview", O.sql([], """
SELECT doc_id, substring(text, 1, 1000) || CASE WHEN length(text) > 1000 THEN '...' ELSE '' END AS preview FROM documents"""))
def b13_preview(spark, sf):
    """First 1000 characters of every text plus '...' when longer."""
    d = B.read_table(spark, sf, "documents")
    return d.select("doc_id", preview("text", 1000).alias("preview"))


@query("b14_url_parse", O.sql([], f"""
SELECT page_id, parts[3] AS host,
       CASE WHEN ok THEN parts[4] END AS owner, CASE WHEN ok THEN parts[5] END AS repo, ok AS is_valid
FROM (SELECT page_id, parts, coalesce(len(parts) >= 5 AND parts[3] = '{URL_HOST}', false) AS ok
      FROM (SELECT page_id, string_split(regexp_replace(url, '^/+|/+$', '', 'g'), '/') AS parts FROM pages))"""))
def b14_url_parse(spark, sf):
    """Repository URL split (host, owner, repo, valid) of every page URL."""
    p = B.read_table(spark, sf, "pages")
    u = parse_repo_url(F.col("url"), URL_HOST)
    return p.select("page_id", u["host"].alias("host"), u["owner"].alias("owner"), u["repo"].alias("repo"),
                    u["is_valid"].alias("is_valid"))


_REQ = ["repo_name", "repo_full_name", "repo_url", "file_name", "file_path", "file_url", "local_path", "downloaded_at"]


@query("b15_required_fields", O.sql(["b_landing"], "SELECT " + ", ".join(
    f"CAST(count_if({c} IS NULL OR CAST({c} AS VARCHAR) = '') AS BIGINT) AS missing_{c}" for c in _REQ)
    + ", CAST(count(*) AS BIGINT) AS rows FROM b_landing"))
def b15_required_fields(spark, sf):
    """Rows missing each required landing field (null or empty)."""
    return required_field_gaps(B.b_landing(spark, sf), _REQ)


@query("c10_timestamp_parse", O.sql(["b_landing"], """
SELECT seq, CAST(replace(downloaded_at, 'T', ' ') AS TIMESTAMP) AS downloaded_ts,
       strftime(CAST(replace(downloaded_at, 'T', ' ') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS display FROM b_landing"""))
def c10_timestamp_parse(spark, sf):
    """ISO text -> timestamp and back to the job display format, per landing row."""
    l = B.b_landing(spark, sf)
    ts = parse_iso(F.col("downloaded_at"))
    return l.select("seq", ts.alias("downloaded_ts"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("display"))


@query("c11_progress_pct", O.sql(["b_job_events"], """
SELECT job_id, seq, CAST(row_number() OVER (PARTITION BY job_id ORDER BY seq) AS INTEGER) AS step,
       CAST(count(*) OVER (PARTITION BY job_id) AS BIGINT) AS total,
       row_number() OVER (PARTITION BY job_id ORDER BY seq) / count(*) OVER (PARTITION BY job_id) * 100 AS percent
FROM b_job_events"""))
def c11_progress_pct(spark, sf):
    """Progress percentage (i+1)/total*100 of every job event."""
    return progress(B.b_job_events(spark, sf))


# --- C3 AST pass -------------------------------------------------------------------

_C3_SQL = O.sql([], f"""
SELECT file_id, CAST(n + 1 AS BIGINT) AS function_count, (sm + cls) / (n + 1) AS complexity_avg,
       CAST(greatest(mx, cls) AS BIGINT) AS complexity_max, CAST(1 + st AS BIGINT) AS statements, true AS parse_ok
FROM (SELECT file_id, n, sm, mx, st, CAST(floor((1 + sm) / n) AS BIGINT) + CASE WHEN n > 1 THEN 1 ELSE 0 END AS cls
      FROM (SELECT doc_id AS file_id, len(ks) AS n,
                   list_sum(list_transform(ks, lambda k: 1 + k)) AS sm,
                   list_max(list_transform(ks, lambda k: 1 + k)) AS mx,
                   list_sum(list_transform(ks, lambda k: 2 + 2 * k - (k + 1) // 4)) AS st
            FROM (SELECT doc_id, list_transform({O.SPLIT.format(x='text')},
                                 lambda p: length(p) - length(replace(p, ',', ''))) AS ks FROM documents)))""")


@query("c3_ast_complexity", _C3_SQL)
def c3_ast_complexity(spark, sf):
    """Cyclomatic complexity of every block of the generated Python modules
    (Arrow mapInPandas AST pass), summarised per file."""
    from quarry.operators.complexity import analyze_ast, with_complexity
    a = with_complexity(analyze_ast(B.b_pysource(spark, sf), ["file_id"]))
    c = F.col("complexity")
    return a.select("file_id", c["function_count"].alias("function_count"), c["avg_complexity"].alias("complexity_avg"),
                    c["max_complexity"].alias("complexity_max"), "statements", "parse_ok")


_C2AST_SQL = O.sql([], """
SELECT file_id, CAST(r AS BIGINT) AS refactors, CAST(1 + st AS BIGINT) AS statements,
       round(greatest(0.0::DOUBLE, 10.0::DOUBLE - (r * 10) / (1 + st)), 2) AS quality_score
FROM (SELECT doc_id AS file_id,
             list_sum(list_transform(ks, lambda k: 2 + 2 * k - (k + 1) // 4)) AS st,
             list_sum(list_transform(ks, lambda k:
                 (CASE WHEN k - (k + 1) // 4 > 12 THEN 1 ELSE 0 END)
               + (CASE WHEN 1 + 2 * k - (k + 1) // 4 > 50 THEN 1 ELSE 0 END))) AS r
      FROM (SELECT doc_id, list_transform(""" + O.SPLIT.format(x="text") + """,
                              lambda p: length(p) - length(replace(p, ',', ''))) AS ks FROM documents))""")


@query("c2_lint_score_ast", _C2AST_SQL)
def c2_lint_score_ast(spark, sf):
    """Lint score of the generated Python modules with native and AST rules
    (too many branches / statements per method), over AST statements."""
    from quarry.operators.suitability import add_signals_with_ast
    s = add_signals_with_ast(B.b_pysource(spark, sf), "content", Thresholds())
    return s.select("file_id", F.col("lint_findings")["refactor"].alias("refactors"), "statements", "quality_score")
