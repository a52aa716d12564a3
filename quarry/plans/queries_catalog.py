"""Registered queries: catalogue import/export, tags, search, statistics,
repositories, jobs (A8-A16, B7-B12, D1-D8, E1-E6, E9-E12, G1-G6, H1-H11, J2, K3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.signals import round2
from quarry.functions.text import bool_to_int, or_unknown
from quarry.operators import catalog as C
from quarry.operators import jobs as J
from quarry.operators import report as R
from quarry.operators import repos as RP
from quarry.operators import search as S
from quarry.operators import stats as ST
from quarry.operators import tags as TG
from quarry.plans import bind as B
from quarry.plans import oracle as O
from quarry.plans.queries_signals import _B4_SQL, _PY, _verdict_body, reason_case
from quarry.plans.registry import query
from quarry.sources.tables import stored


# --- shared Spark-side catalogue ------------------------------------------------

@B.session_cached
def catalog(spark, sf):
    """The imported catalogue (repositories, files) as stored tables: built
    once per session from the stored landing and kept as Parquet in the shared
    folder, as a catalogue would be persisted."""
    repos, files, _, _ = C.import_landing(B.b_landing(spark, sf))
    return stored(repos, "repositories"), stored(files, "files")


def tag_log(spark, sf):
    return B.b_tag_ops(spark, sf)


@B.session_cached
def links(spark, sf):
    """Current tag links (folded log), stored like the catalogue."""
    return stored(TG.fold_links(tag_log(spark, sf)), "links")


def tag_list_col(col="tags"):
    return F.array_join(F.sort_array(F.col(col)), ", ").alias(col)


_FILE_COLS_SQL = ("id, repo_full_name, name, path, url, local_path, quality_score, code_lines, is_suitable, "
                  "unsuitable_reason, complexity_avg, complexity_max, function_count, downloaded_at")


# --- H1 / H2 / D8 / E10 / D6 / D1 ------------------------------------------------

@query("h1_import_repos", O.sql(["c_repos"], "SELECT name, full_name, url, stars, license FROM c_repos"))
def h1_import_repos(spark, sf):
    """Repositories imported from the landing (first row per full_name wins)."""
    repos, _ = catalog(spark, sf)
    return repos.select("name", "full_name", "url", "stars", "license")


@query("h2_import_files", O.sql(["c_files"], f"SELECT {_FILE_COLS_SQL} FROM c_files"))
def h2_import_files(spark, sf):
    """Files imported from the landing (first row per (repo, path) wins; rows
    without key or required columns are rejected)."""
    _, files = catalog(spark, sf)
    return files.select(*[c.strip() for c in _FILE_COLS_SQL.split(",")])


def _two_batch_import(spark, sf):
    landing = B.b_landing(spark, sf)
    first = landing.filter(F.col("lang").isin("de", "en"))
    r1, f1, _, _ = C.import_landing(first)
    return C.import_landing(landing, r1, f1)


_BATCH1 = [
    ("b1_landing", "SELECT * FROM b_landing WHERE lang IN ('de', 'en')"),
    ("b1_repos", "SELECT DISTINCT repo_full_name AS full_name FROM b1_landing "
                 "WHERE repo_full_name IS NOT NULL AND repo_full_name <> ''"),
    ("b1_files", "SELECT DISTINCT repo_full_name, file_path AS path FROM b1_landing "
                 "WHERE repo_full_name IS NOT NULL AND repo_full_name <> '' AND file_name IS NOT NULL "
                 "AND file_path IS NOT NULL AND file_url IS NOT NULL AND local_path IS NOT NULL"),
]


def _with_batch1(views, body):
    return O.sql(views, body, extra=_BATCH1)


@query("d8_new_rows_anti", _with_batch1(["b_landing", "c_files"], """
SELECT f.repo_full_name, f.path, f.id FROM c_files f ANTI JOIN b1_files b USING (repo_full_name, path)"""))
def d8_new_rows_anti(spark, sf):
    """Files of a second landing batch that the first import did not have."""
    _, _, _, new_f = _two_batch_import(spark, sf)
    return new_f.select("repo_full_name", "path", "id")


@query("e10_import_counts", _with_batch1(["b_landing", "c_files", "c_repos"], """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM c_repos r ANTI JOIN b1_repos b USING (full_name)) AS new_repositories,
       (SELECT CAST(count(*) AS BIGINT) FROM c_files f ANTI JOIN b1_files b USING (repo_full_name, path)) AS new_files"""))
def e10_import_counts(spark, sf):
    """Numbers of newly inserted repositories and files of the second batch."""
    _, _, new_r, new_f = _two_batch_import(spark, sf)
    return C.import_counts(new_r, new_f)


@query("d6_key_to_id", O.sql(["b_landing", "c_files"], """
SELECT DISTINCT l.repo_full_name, l.file_path AS path, f.id
FROM b_landing l JOIN c_files f ON l.repo_full_name = f.repo_full_name AND l.file_path = f.path"""))
def d6_key_to_id(spark, sf):
    """Natural key (repository, path) of every landing row -> catalogue id."""
    _, files = catalog(spark, sf)
    keys = B.b_landing(spark, sf).select("repo_full_name", F.col("file_path").alias("path")).distinct()
    return C.ids_for_keys(keys, files)


@query("d1_files_repos", O.sql(["c_catalog"], """
SELECT id, name, path, repo_name, repo_full_name, repo_stars, repo_license FROM c_catalog"""))
def d1_files_repos(spark, sf):
    """Files joined to their repositories."""
    repos, files = catalog(spark, sf)
    return C.files_with_repos(files, repos).select("id", "name", "path", "repo_name", "repo_full_name",
                                                   "repo_stars", "repo_license")


# --- exports / flat table: A8 A9 A10 A15 A16 E9 H10 ----------------------------------

@query("a8_scan_catalogue", O.sql(["c_catalog"], """
SELECT repo_full_name, CAST(count(*) AS BIGINT) AS files, CAST(sum(code_lines) AS BIGINT) AS code_lines
FROM c_catalog GROUP BY repo_full_name"""))
def a8_scan_catalogue(spark, sf):
    """Catalogue written to Parquet in the shared checkpoint folder, scanned back
    (pruned to three columns) and summarised per repository."""
    from quarry.sources.tables import read_catalog, write_catalog
    repos, files = catalog(spark, sf)
    root = write_catalog(spark, {"repositories": repos, "files": files})
    cat = read_catalog(spark, root)
    j = C.files_with_repos(cat["files"].select("repo_full_name", "code_lines"), cat["repositories"])
    return j.groupBy("repo_full_name").agg(
        F.count(F.lit(1)).cast("bigint").alias("files"), F.sum("code_lines").cast("bigint").alias("code_lines"))


_EXPORT_SQL = ("repo_name, repo_full_name, repo_url, repo_stars, repo_license, name AS file_name, path AS file_path, "
               "url AS file_url, local_path, quality_score, code_lines, CAST(coalesce(is_suitable, false) AS INTEGER) AS is_suitable, "
               "unsuitable_reason, complexity_avg, complexity_max, function_count, downloaded_at")


@query("a9_export_flat", O.sql(["c_catalog"], f"SELECT {_EXPORT_SQL} FROM c_catalog"))
def a9_export_flat(spark, sf):
    """Flat 17-column export rows (verdict as 0/1)."""
    repos, files = catalog(spark, sf)
    return R.flat_export(files, repos)


_NESTED_SQL = ("repo_name, repo_full_name, repo_url, repo_stars, repo_license, name AS file_name, path AS file_path, "
               "url AS file_url, local_path, quality_score, code_lines, coalesce(is_suitable, false) AS is_suitable, "
               "unsuitable_reason, strftime(downloaded_at, '%Y-%m-%dT%H:%M:%S') AS downloaded_at, "
               "complexity_avg AS avg_complexity, complexity_max AS max_complexity, function_count")


@query("a10_export_nested", O.sql(["c_catalog"], f"SELECT {_NESTED_SQL} FROM c_catalog"))
def a10_export_nested(spark, sf):
    """Landing-shaped export with complexity re-nested (shown un-nested for comparison)."""
    repos, files = catalog(spark, sf)
    n = R.nested_export(files, repos)
    return n.select(*[c for c in n.columns if c not in ("complexity", "file_id")],
                    "complexity.avg_complexity", "complexity.max_complexity", "complexity.function_count")


@query("h10_sync_roundtrip", O.sql(["c_files"], f"SELECT {_FILE_COLS_SQL} FROM c_files"))
def h10_sync_roundtrip(spark, sf):
    """Import, export back to landing shape, import again: the catalogue is a fixed point."""
    repos, files = catalog(spark, sf)
    exported = R.nested_export(files, repos).withColumn("seq", F.col("file_id"))
    _, files2, _, _ = C.import_landing(exported)
    return files2.select(*[c.strip() for c in _FILE_COLS_SQL.split(",")])


_FLAT_SQL = ("flat", "SELECT seq AS id, repo_name, file_name, file_path, local_path, file_url, quality_score, "
                     "CAST(replace(downloaded_at, 'T', ' ') AS TIMESTAMP) AS downloaded_at FROM b_landing")


def _flat_sql(body):
    return O.sql(["b_landing"], body, extra=[_FLAT_SQL])


@query("a15_import_flat", _flat_sql("SELECT * FROM flat"))
def a15_import_flat(spark, sf):
    """Landing -> flat table (every row, timestamps parsed)."""
    return R.flat_table(B.b_landing(spark, sf), id_col="seq")


@query("a16_dump_flat", _flat_sql("SELECT repo_name, file_name, downloaded_at FROM flat"))
def a16_dump_flat(spark, sf):
    """The three listed columns of every flat row."""
    return R.flat_dump(R.flat_table(B.b_landing(spark, sf)))


@query("e9_flat_stats", _flat_sql("""
SELECT CAST((SELECT count(*) FROM (SELECT DISTINCT repo_name FROM flat)) AS BIGINT) AS total_repos,
       CAST(count(*) AS BIGINT) AS total_files, CAST(count_if(quality_score >= 6) AS BIGINT) AS suitable_files,
       sum(CAST(round(quality_score * 100) AS BIGINT)) / count(quality_score) / 100.0::DOUBLE AS avg_quality FROM flat"""))
def e9_flat_stats(spark, sf):
    """Flat-table statistics: distinct repo names (null counted), rows, score >= 6, average score."""
    return ST.flat_stats(R.flat_table(B.b_landing(spark, sf)))


# --- statistics E1-E6, E11, E12, D4, D5, C6-C8 ---------------------------------------

@query("e1_table_counts", O.sql(["c_repos", "c_files", "c_tags"], """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM c_repos) AS repository_count,
       (SELECT CAST(count(*) AS BIGINT) FROM c_files) AS file_count,
       (SELECT CAST(count_if(is_suitable) AS BIGINT) FROM c_files) AS suitable_file_count,
       (SELECT CAST(count(*) AS BIGINT) FROM c_tags) AS tag_count"""))
def e1_table_counts(spark, sf):
    """Repositories, files, suitable files, tags."""
    repos, files = catalog(spark, sf)
    return ST.table_counts(repos, files, TG.tag_table(tag_log(spark, sf)))


_AVG_Q = "sum(CAST(round(quality_score * 100) AS BIGINT)) / count(quality_score) / 100.0::DOUBLE"


@query("e2_avg_score_lines", O.sql(["c_files"], f"""
SELECT coalesce(round({_AVG_Q}, 2), 0.0) AS average_quality_score,
       coalesce(round(sum(code_lines) / count(code_lines), 2), 0.0) AS average_code_lines FROM c_files"""))
def e2_avg_score_lines(spark, sf):
    """Average score and code lines, rounded to 2 places."""
    _, files = catalog(spark, sf)
    return ST.score_and_lines(files, rounded=True)


@query("e3_license_distribution", O.sql(["c_repos"], """
SELECT CASE WHEN license IS NULL OR license = '' THEN 'Unknown' ELSE license END AS license,
       CAST(count(*) AS BIGINT) AS count FROM c_repos GROUP BY 1"""))
def e3_license_distribution(spark, sf):
    """Repositories per licence (null / '' -> Unknown)."""
    repos, _ = catalog(spark, sf)
    return ST.license_distribution(repos)


@query("d4_repo_file_counts", O.sql(["c_repos", "c_files"], """
SELECT r.name, r.full_name, CAST(count(f.id) AS BIGINT) AS file_count
FROM c_repos r JOIN c_files f ON r.full_name = f.repo_full_name GROUP BY r.name, r.full_name"""))
def d4_repo_file_counts(spark, sf):
    """Files per repository (repositories without files drop out)."""
    repos, files = catalog(spark, sf)
    return ST.repo_file_counts(files, repos).select("name", "full_name", "file_count")


@query("e4_top_repos", O.sql(["c_repos", "c_files"], """
SELECT r.name, r.full_name, CAST(count(f.id) AS BIGINT) AS file_count
FROM c_repos r JOIN c_files f ON r.full_name = f.repo_full_name GROUP BY r.name, r.full_name
ORDER BY file_count DESC, r.full_name LIMIT 10"""))
def e4_top_repos(spark, sf):
    """Top-10 repositories by file count."""
    repos, files = catalog(spark, sf)
    return ST.top_repositories(files, repos)


_BIN = ("CASE WHEN quality_score < 2 THEN 0 WHEN quality_score < 4 THEN 1 WHEN quality_score < 6 THEN 2 "
        "WHEN quality_score < 8 THEN 3 ELSE 4 END")


@query("e5_score_histogram", O.sql(["c_files"], f"""
SELECT CAST(b.bin AS INTEGER) AS bin, CAST(coalesce(c.count, 0) AS BIGINT) AS count
FROM range(5) b(bin) LEFT JOIN (SELECT {_BIN} AS bin, count(*) AS count FROM c_files
                              WHERE quality_score IS NOT NULL GROUP BY 1) c ON b.bin = c.bin"""))
def e5_score_histogram(spark, sf):
    """Score histogram, five bins always present."""
    _, files = catalog(spark, sf)
    return ST.score_histogram(spark, files)


@query("d5_tag_counts", O.sql(["c_file_tags"], """
SELECT tag AS name, CAST(count(file_id) AS BIGINT) AS count FROM c_file_tags GROUP BY tag"""))
def d5_tag_counts(spark, sf):
    """Files per tag (links to unknown files count)."""
    return TG.tag_counts(links(spark, sf))


@query("e6_top_tags", O.sql(["c_file_tags"], """
SELECT tag AS name, CAST(count(file_id) AS BIGINT) AS count FROM c_file_tags GROUP BY tag
ORDER BY count DESC, name LIMIT 10"""))
def e6_top_tags(spark, sf):
    """Top-10 tags by file count."""
    return TG.top_tags(links(spark, sf))


@query("e11_statistics", O.sql(["c_repos", "c_files", "c_tags"], f"""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM c_repos) AS repository_count,
       (SELECT CAST(count(*) AS BIGINT) FROM c_files) AS file_count,
       (SELECT CAST(count_if(is_suitable) AS BIGINT) FROM c_files) AS suitable_file_count,
       (SELECT CAST(count(*) AS BIGINT) FROM c_tags) AS tag_count,
       (SELECT coalesce(round({_AVG_Q}, 2), 0.0) FROM c_files) AS average_quality_score,
       (SELECT coalesce(round(sum(code_lines) / count(code_lines), 2), 0.0) FROM c_files) AS average_code_lines,
       (SELECT string_agg(license || '=' || CAST(n AS VARCHAR), '; ' ORDER BY license)
          FROM (SELECT CASE WHEN license IS NULL OR license = '' THEN 'Unknown' ELSE license END AS license,
                       count(*) AS n FROM c_repos GROUP BY 1)) AS license_distribution"""))
def e11_statistics(spark, sf):
    """Statistics bundle: counts, rounded averages, licence distribution (map shown as sorted text)."""
    repos, files = catalog(spark, sf)
    st = ST.statistics(repos, files, TG.tag_table(tag_log(spark, sf)))
    m = F.col("license_distribution")
    as_text = F.array_join(F.transform(F.array_sort(F.map_entries(m)),
                                       lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "; ")
    return st.withColumn("license_distribution", as_text)


@query("e12_dashboard", O.sql(["c_repos", "c_files"], f"""
SELECT (SELECT CAST(count(DISTINCT full_name) AS BIGINT) FROM c_repos) AS repository_count,
       CAST(count(*) AS BIGINT) AS file_count, CAST(count_if(is_suitable) AS BIGINT) AS suitable_file_count,
       coalesce({_AVG_Q}, 0.0) AS average_quality_score,
       {", ".join(f"CAST(count_if(quality_score IS NOT NULL AND {_BIN} = {i}) AS BIGINT) AS q{i}" for i in range(5))}
FROM c_files"""))
def e12_dashboard(spark, sf):
    """Dashboard scalars: counts, raw average score, the five histogram bins."""
    repos, files = catalog(spark, sf)
    return ST.dashboard(spark, repos, files, links(spark, sf))["scalars"]


@query("c6_bool_int", O.sql(["c_files"], "SELECT id, CAST(coalesce(is_suitable, false) AS INTEGER) AS suitable_flag FROM c_files"))
def c6_bool_int(spark, sf):
    """Verdict as 0/1 (falsy -> 0)."""
    _, files = catalog(spark, sf)
    return files.select("id", bool_to_int("is_suitable").alias("suitable_flag"))


@query("c7_repo_avg_round2", O.sql(["c_files"], f"""
SELECT repo_full_name, round({_AVG_Q}, 2) AS avg_score FROM c_files GROUP BY repo_full_name"""))
def c7_repo_avg_round2(spark, sf):
    """Average score per repository rounded half-up to 2 places."""
    _, files = catalog(spark, sf)
    return files.groupBy("repo_full_name").agg(round2(ST.exact_avg_score(F.col("quality_score"))).alias("avg_score"))


@query("c8_unknown_default", O.sql(["c_repos"], """
SELECT full_name, CASE WHEN license IS NULL OR license = '' THEN 'Unknown' ELSE license END AS license_label FROM c_repos"""))
def c8_unknown_default(spark, sf):
    """Licence label with null / '' shown as Unknown."""
    repos, _ = catalog(spark, sf)
    return repos.select("full_name", or_unknown(F.col("license")).alias("license_label"))


@query("b10_repo_key_required", O.sql(["b_landing"], """
SELECT CAST(count_if(repo_full_name IS NOT NULL AND repo_full_name <> '') AS BIGINT) AS kept,
       CAST(count_if(repo_full_name IS NULL OR repo_full_name = '') AS BIGINT) AS skipped FROM b_landing"""))
def b10_repo_key_required(spark, sf):
    """Landing rows kept / skipped for lack of a repository key."""
    l = B.b_landing(spark, sf)
    has_key = F.col("repo_full_name").isNotNull() & (F.col("repo_full_name") != "")
    return l.agg(F.count_if(has_key).cast("bigint").alias("kept"),
                 F.count_if(~F.coalesce(has_key, F.lit(False))).cast("bigint").alias("skipped"))


# --- tags: H3 H4 H6 H11 D2 D3 ----------------------------------------------------------

@query("h3_tag_fold", O.sql(["c_file_tags"], "SELECT file_id, tag FROM c_file_tags"))
def h3_tag_fold(spark, sf):
    """Current (file, tag) links after folding the whole add/remove log."""
    return links(spark, sf)


@query("h4_removed_links", O.sql(["b_tag_ops"], """
SELECT file_id, tag FROM b_tag_ops GROUP BY file_id, tag
HAVING count_if(action = 'add') > 0 AND arg_max(action, seq) = 'remove'"""))
def h4_removed_links(spark, sf):
    """Links that were added at some point and are removed now."""
    ops = tag_log(spark, sf)
    g = ops.groupBy("file_id", "tag").agg(F.count_if(F.col("action") == "add").alias("adds"),
                                         F.max_by("action", "seq").alias("last"))
    return g.filter((F.col("adds") > 0) & (F.col("last") == "remove")).select("file_id", "tag")


@query("h6_batch_tag", O.sql(["c_file_tags"], """
SELECT CAST(l.doc_id AS BIGINT) AS file_id, 'toxic' AS tag, 'remove' AS action, true AS success,
       (t.file_id IS NOT NULL) AS changed
FROM (SELECT DISTINCT doc_id FROM labels) l LEFT JOIN c_file_tags t ON t.file_id = l.doc_id AND t.tag = 'toxic'"""))
def h6_batch_tag(spark, sf):
    """Batch removal of tag 'toxic' from every labelled file, with per-id status."""
    ops = tag_log(spark, sf)
    ids = B.read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    batch = TG.batch_ops(ids, "toxic", "remove", seq_base=10 ** 12)
    return TG.batch_status(ops, batch)


@query("d2_any_tag_filter", O.sql(["c_files", "c_file_tags"], """
SELECT id, name FROM c_files WHERE id IN (SELECT file_id FROM c_file_tags WHERE tag IN ('quality', 'toxic'))"""))
def d2_any_tag_filter(spark, sf):
    """Files carrying any of the tags quality / toxic (semi-join)."""
    _, files = catalog(spark, sf)
    return TG.any_tag_files(files.select("id", "name"), links(spark, sf), ["quality", "toxic"])


@query("d3_attach_tags", O.sql(["c_files", "c_file_tag_lists"], """
SELECT f.id, coalesce(t.tags, '') AS tags FROM c_files f LEFT JOIN c_file_tag_lists t ON f.id = t.file_id"""))
def d3_attach_tags(spark, sf):
    """Every file with its sorted tag list (empty when untagged)."""
    _, files = catalog(spark, sf)
    out = TG.attach_tags(files.select("id"), links(spark, sf))
    return out.select("id", tag_list_col())


# --- search: G1 G6 B7 B8 B9 B11 B12 A11 H11 ------------------------------------------

def _search_sql(where: list[str], limit: int | None, tags: list[str] | None = None, cols=None):
    conds = list(where)
    if tags:
        lits = ", ".join(f"'{t}'" for t in tags)
        conds.append(f"c.id IN (SELECT file_id FROM c_file_tags WHERE tag IN ({lits}))")
    w = ("WHERE " + " AND ".join(conds)) if conds else ""
    lim = f"LIMIT {limit}" if limit is not None else ""
    cols = cols or ("s.id, s.name, s.path, s.local_path, s.quality_score, s.code_lines, s.is_suitable, "
                    "s.repo_name, coalesce(t.tags, '') AS tags")
    return O.sql(["c_catalog", "c_file_tag_lists", "c_file_tags"], f"""
SELECT {cols} FROM (
  SELECT c.id, c.name, c.path, c.local_path, c.quality_score, c.code_lines, c.is_suitable, c.repo_full_name AS repo_name
  FROM c_catalog c {w} ORDER BY c.quality_score DESC NULLS LAST, c.id {lim}) s
LEFT JOIN c_file_tag_lists t ON s.id = t.file_id""")


def _text_sql(q: str) -> str:
    p = "'%" + q.replace("'", "''") + "%'"
    return f"(c.name ILIKE {p} OR c.path ILIKE {p} OR c.repo_name ILIKE {p} OR c.repo_full_name ILIKE {p})"


def _search(spark, sf, **kw):
    repos, files = catalog(spark, sf)
    res = S.search(files, repos, links(spark, sf), **kw)
    return res.withColumn("tags", tag_list_col())


@query("g1_search", _search_sql([_text_sql("src1")], 100))
def g1_search(spark, sf):
    """Search 'src1' (name / path / repository), best 100 by score, with tags."""
    return _search(spark, sf, query="src1", limit=100)


@query("g1_search_tags", _search_sql(["c.quality_score >= 2.0"], 50, ["quality", "toxic"]))
def g1_search_tags(spark, sf):
    """Search by tags quality / toxic with score >= 2, best 50."""
    return _search(spark, sf, tags=["quality", "toxic"], min_quality=2.0, limit=50)


@query("g6_top5", _search_sql([], 5))
def g6_top5(spark, sf):
    """Dashboard list: top 5 by score."""
    return _search(spark, sf, limit=5)


@query("b7_text_search", _search_sql([_text_sql("doc_1")], None, cols="s.id, s.name, s.repo_name"))
def b7_text_search(spark, sf):
    """Unlimited text search 'doc_1' ('_' is a wildcard)."""
    return _search(spark, sf, query="doc_1", limit=None).select("id", "name", "repo_name")


@query("b8_min_quality", _search_sql(["c.quality_score >= 0"], None, cols="s.id, s.quality_score"))
def b8_min_quality(spark, sf):
    """Unlimited search with min_quality 0 (null scores drop out)."""
    return _search(spark, sf, min_quality=0, limit=None).select("id", "quality_score")


@query("b9_suitable_only", _search_sql(["c.is_suitable"], None, cols="s.id, s.repo_name"))
def b9_suitable_only(spark, sf):
    """Unlimited search of suitable files only."""
    return _search(spark, sf, suitable_only=True, limit=None).select("id", "repo_name")


_DISPLAY_COLS = ("s.id, s.name, s.repo_name, CASE WHEN s.quality_score IS NULL OR s.quality_score = 0 THEN 'N/A' "
                 "ELSE printf('%.1f', s.quality_score) END AS score_text, s.code_lines, "
                 "CASE WHEN coalesce(s.is_suitable, false) THEN 'Yes' ELSE 'No' END AS suitable, "
                 "coalesce(t.tags, '') AS tags, s.local_path")


@query("b11_display_rows", _search_sql([_text_sql("src2")], 100, cols=_DISPLAY_COLS))
def b11_display_rows(spark, sf):
    """Display projection of a search: N/A or one-decimal score, Yes/No, joined tags."""
    repos, files = catalog(spark, sf)
    res = S.search(files, repos, links(spark, sf), query="src2", limit=100)
    return R.display_rows(res)


_REPORT_COLS = ("s.id, s.name, s.repo_name, s.quality_score, coalesce(s.code_lines, 0) AS code_lines, "
                "CASE WHEN coalesce(s.is_suitable, false) THEN 'Yes' ELSE 'No' END AS suitable, "
                "coalesce(t.tags, '') AS tags, s.local_path")


@query("a11_report_export", _search_sql([], 1000, cols=_REPORT_COLS))
def a11_report_export(spark, sf):
    """Filtered report export rows (search limited to 1000)."""
    repos, files = catalog(spark, sf)
    res = S.search(files, repos, links(spark, sf), query="", limit=1000)
    return R.report_rows(res)


@query("h11_batch_selection", O.sql(["c_catalog", "c_file_tags"], f"""
SELECT s.id AS file_id, 'selected' AS tag, 'add' AS action, true AS success, true AS changed FROM (
  SELECT c.id FROM c_catalog c WHERE {_text_sql('src3')} ORDER BY c.quality_score DESC NULLS LAST, c.id LIMIT 20) s"""))
def h11_batch_selection(spark, sf):
    """Search results (top 20 for 'src3') piped into a batch tag operation."""
    repos, files = catalog(spark, sf)
    ids = S.search(files, repos, None, query="src3", limit=20, with_tags=False).select("id")
    batch = TG.batch_ops(ids, "selected", "add", seq_base=10 ** 12)
    return TG.batch_status(tag_log(spark, sf), batch)


@query("b12_point_lookup", O.sql(["c_files", "b_files_core"], """
SELECT f.id, f.name, f.path, md5(b.content) AS digest, CAST(length(b.content) AS BIGINT) AS n_chars
FROM c_files f JOIN b_files_core b ON f.id = b.file_id
WHERE f.id IN (SELECT doc_id FROM labels WHERE quality = 1)"""))
def b12_point_lookup(spark, sf):
    """Lookup of the ids listed as quality in labels, with the whole content."""
    _, files = catalog(spark, sf)
    ids = B.read_table(spark, sf, "labels").filter(F.col("quality") == 1).select(F.col("doc_id").alias("id"))
    found = S.lookup(files.select("id", "name", "path"), ids, B.b_contents(spark, sf), preview_chars=None)
    return found.select("id", "name", "path", F.md5("content").alias("digest"), F.length("content").cast("bigint").alias("n_chars"))


# --- deletion / content: H7 H8 H9 --------------------------------------------------

def _deletes(spark, sf):
    lab = B.read_table(spark, sf, "labels")
    known = lab.filter(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    unknown = lab.filter((F.col("toxic") == 0) & (F.col("quality") == 0)).select((F.col("doc_id") + 1000000).alias("id"))
    return known.unionByName(unknown)


_DEL_IDS = "(SELECT doc_id AS id FROM labels WHERE toxic = 1 UNION SELECT doc_id + 1000000 FROM labels WHERE toxic = 0 AND quality = 0)"


@query("h7_delete_files", O.sql(["c_files"], f"SELECT id, name FROM c_files WHERE id NOT IN {_DEL_IDS}"))
def h7_delete_files(spark, sf):
    """Files remaining after deleting the toxic-labelled ids."""
    _, files = catalog(spark, sf)
    out = C.delete_files(_deletes(spark, sf), files, links(spark, sf))
    return out["files"].select("id", "name")


@query("h7_delete_tag_links", O.sql(["c_files", "c_file_tags"], f"""
SELECT file_id, tag FROM c_file_tags
WHERE file_id NOT IN (SELECT id FROM c_files WHERE id IN {_DEL_IDS})"""))
def h7_delete_tag_links(spark, sf):
    """Tag links remaining after the deletion (links of deleted files go)."""
    _, files = catalog(spark, sf)
    out = C.delete_files(_deletes(spark, sf), files, links(spark, sf))
    return out["file_tags"]


@query("h8_batch_delete_status", O.sql(["c_files"], f"""
SELECT CAST(d.id AS BIGINT) AS id, CASE WHEN f.id IS NOT NULL THEN 'deleted' ELSE 'not_found' END AS status
FROM {_DEL_IDS} d LEFT JOIN c_files f ON d.id = f.id"""))
def h8_batch_delete_status(spark, sf):
    """Per-id status of a batch delete (known and unknown ids)."""
    _, files = catalog(spark, sf)
    return C.delete_files(_deletes(spark, sf), files, links(spark, sf))["status"]


@query("h9_replace_content", O.sql(["b_files_core"], """
SELECT c.file_id AS id, u.content IS NOT NULL AS changed,
       CAST(length(coalesce(u.content, c.content)) AS BIGINT) AS n_chars, md5(coalesce(u.content, c.content)) AS digest
FROM b_files_core c LEFT JOIN (SELECT conv_id AS id, arg_max(text, turn) AS content FROM conversations GROUP BY conv_id) u
  ON c.file_id = u.id"""))
def h9_replace_content(spark, sf):
    """Contents after applying conversation turns as replacements (last turn wins)."""
    merged = C.replace_contents(B.b_contents(spark, sf), B.b_content_updates(spark, sf))
    return merged.select("id", "changed", F.length("content").cast("bigint").alias("n_chars"),
                         F.md5("content").alias("digest"))


# --- repositories: A13 A14 D7 -------------------------------------------------------

@query("a13_select_repos", O.sql(["b_repos"], """
SELECT name, full_name, stars, forks, license FROM b_repos WHERE stars > 1000
ORDER BY stars DESC, full_name LIMIT 10"""))
def a13_select_repos(spark, sf):
    """Ten repositories with most stars among those with more than 1000."""
    return RP.select_repositories(B.b_repos(spark, sf), min_stars=1000, sort="stars", max_results=10) \
        .select("name", "full_name", "stars", "forks", "license")


@query("a13_select_repos_updated", O.sql(["b_repos"], """
SELECT name, full_name, updated_at, license FROM b_repos WHERE license = 'MIT License'
ORDER BY updated_at DESC, full_name LIMIT 5"""))
def a13_select_repos_updated(spark, sf):
    """Five most recently updated MIT-licensed repositories."""
    return RP.select_repositories(B.b_repos(spark, sf), license="MIT License", sort="updated", max_results=5) \
        .select("name", "full_name", "updated_at", "license")


@query("a14_repo_lookup", O.sql(["b_repos"], """
SELECT q.full_name,
       CASE WHEN r.full_name IS NOT NULL THEN r.name ELSE string_split(q.full_name, '/')[-1] END AS name,
       CASE WHEN r.full_name IS NOT NULL THEN r.url ELSE 'https://github.com/' || q.full_name END AS url,
       CASE WHEN r.full_name IS NOT NULL THEN r.description ELSE '' END AS description,
       CAST(CASE WHEN r.full_name IS NOT NULL THEN r.stars ELSE 0 END AS BIGINT) AS stars,
       CAST(CASE WHEN r.full_name IS NOT NULL THEN r.forks ELSE 0 END AS BIGINT) AS forks,
       r.license AS license, r.full_name IS NOT NULL AS found
FROM (SELECT DISTINCT full_name FROM b_repos) q LEFT JOIN (SELECT * FROM b_repos WHERE full_name NOT LIKE '%/de') r
  ON q.full_name = r.full_name"""))
def a14_repo_lookup(spark, sf):
    """Every repository looked up in a listing that misses the 'de' ones (fallback record)."""
    reps = B.b_repos(spark, sf)
    listing = reps.filter(~F.col("full_name").endswith("/de"))
    out = RP.lookup_repositories(reps.select("full_name"), listing)
    return out.drop("created_at", "updated_at")


@query("d7_repo_defaults", O.sql(["b_repos"], """
SELECT q.full_name, r.full_name IS NOT NULL AS found,
       CAST(CASE WHEN r.full_name IS NOT NULL THEN r.stars ELSE 0 END AS BIGINT) AS stars
FROM (SELECT full_name FROM b_repos UNION SELECT name || '/xx' FROM b_repos) q
LEFT JOIN b_repos r ON q.full_name = r.full_name"""))
def d7_repo_defaults(spark, sf):
    """Requested repositories (real ones plus an unknown '/xx' per source) left-joined with defaults."""
    reps = B.b_repos(spark, sf)
    req = reps.select("full_name").unionByName(reps.select(F.concat("name", F.lit("/xx")).alias("full_name")))
    return RP.lookup_repositories(req, reps).select("full_name", "found", "stars")


# --- jobs: J2 G4 K3 ------------------------------------------------------------------

_JOB_COLS = "id, start_time, query, status, files_downloaded, end_time, error, n_events"


@query("j2_job_status", O.sql(["c_jobs"], f"SELECT {_JOB_COLS} FROM c_jobs"))
def j2_job_status(spark, sf):
    """Latest state of every job from its event log."""
    return J.job_states(B.b_job_events(spark, sf)).select(*[c.strip() for c in _JOB_COLS.split(",")])


@query("j2_status_counts", O.sql(["c_jobs"], "SELECT status, CAST(count(*) AS BIGINT) AS jobs FROM c_jobs GROUP BY status"))
def j2_status_counts(spark, sf):
    """Jobs per current state."""
    return J.status_counts(J.job_states(B.b_job_events(spark, sf)))


@query("g4_last_jobs", O.sql(["c_jobs"], f"SELECT {_JOB_COLS} FROM c_jobs ORDER BY first_seq DESC LIMIT 10"))
def g4_last_jobs(spark, sf):
    """The last 10 jobs in insertion order."""
    return J.last_jobs(J.job_states(B.b_job_events(spark, sf))).select(*[c.strip() for c in _JOB_COLS.split(",")])


@query("j2_current_job", O.sql(["c_jobs"], f"""
SELECT {_JOB_COLS} FROM c_jobs WHERE status = 'in_progress' ORDER BY last_seq DESC, id DESC LIMIT 1"""))
def j2_current_job(spark, sf):
    """The in-progress job with the latest activity."""
    return J.current_job(J.job_states(B.b_job_events(spark, sf))).select(*[c.strip() for c in _JOB_COLS.split(",")])


@query("k3_curate_job", f"""
SELECT 1::BIGINT AS id, 'bound corpus' AS query, CAST(count(*) AS BIGINT) AS files_downloaded,
       CAST(count_if(coalesce(is_suitable, false)) AS BIGINT) AS suitable_files,
       CAST(count_if(NOT coalesce(is_suitable, false)) AS BIGINT) AS unsuitable_files, 'completed' AS status
FROM ({_B4_SQL}) t""")
def k3_curate_job(spark, sf):
    """Job record of a curation run: landing re-judged, counts of the verdicts."""
    from quarry.plans.curate import curate
    res = curate(spark, B.b_landing(spark, sf), B.b_modules(spark, sf), B.PY_THRESHOLDS, job_id=1, query="bound corpus")
    return res["job"]


# --- streaming: J1 J3 -------------------------------------------------------------------

_STREAM_COLS = ("repo_full_name, name, path, url, local_path, quality_score, code_lines, is_suitable, "
                "unsuitable_reason, complexity_avg, complexity_max, function_count, downloaded_at")


def _landing_batches(landing):
    v = F.floor(F.col("seq") / F.lit(B.COPY_SEQ))
    return [landing.filter(v == 0), landing.filter(v == 1), landing.filter(v >= 2)]


@query("j1_incremental_ingest", O.sql(["c_files"], f"SELECT {_STREAM_COLS} FROM c_files"))
def j1_incremental_ingest(spark, sf):
    """Landing arriving in three file batches, ingested by an available-now
    stream resumed from one checkpoint; equals the batch import."""
    from quarry.streaming.ingest import replay_landing_batches
    files = replay_landing_batches(spark, _landing_batches(B.b_landing(spark, sf)))
    return files.select(*[c.strip() for c in _STREAM_COLS.split(",")])


@query("j3_incremental_scoring", O.sql(["c_files", "b_modules"], f"""
SELECT f.repo_full_name, f.name, f.path, f.url, f.local_path, round(s.q, 2) AS quality_score, s.code_lines,
       s.reason_code = 'ok' AS is_suitable, {reason_case('s.repo_license', 's.code_lines', 's.q', *_PY[:3])} AS unsuitable_reason,
       s.complexity_avg, s.complexity_max, s.function_count, f.downloaded_at
FROM c_files f JOIN ({_verdict_body("b_modules", *_PY)}) s ON f.id = s.file_id"""))
def j3_incremental_scoring(spark, sf):
    """Unscored landing batches judged inside the stream (only new rows are
    scored) before the insert-if-absent append."""
    from quarry.streaming.ingest import replay_landing_batches
    landing = B.b_landing(spark, sf)
    for c in ("quality_score", "code_lines", "complexity", "is_suitable", "unsuitable_reason"):
        landing = landing.withColumn(c, F.lit(None).cast(landing.schema[c].dataType))
    files = replay_landing_batches(spark, _landing_batches(landing), B.b_module_store(spark, sf), B.PY_THRESHOLDS)
    return files.select(*[c.strip() for c in _STREAM_COLS.split(",")])


@query("j2_job_status_stream", O.sql(["c_jobs"], f"SELECT {_JOB_COLS} FROM c_jobs"))
def j2_job_status_stream(spark, sf):
    """Job states maintained by a streaming aggregation over two event batches;
    equals the batch fold."""
    from quarry.streaming.jobs import replay_job_events
    ev = B.b_job_events(spark, sf)
    half = ev.agg(F.percentile_approx("seq", 0.5).alias("m")).first()["m"]  # one scalar, split point only
    states = replay_job_events(spark, [ev.filter(F.col("seq") <= half), ev.filter(F.col("seq") > half)])
    return states.select(*[c.strip() for c in _JOB_COLS.split(",")])


# --- composed collection jobs: K1 K2 ---------------------------------------------

_K_COLS = ["repo_full_name", "file_path", "local_path", "code_lines", "quality_score", "is_suitable", "unsuitable_reason"]


def _k_rows(landed):
    c = F.col("complexity")
    return landed.select(*_K_COLS, c["function_count"].alias("function_count"), c["avg_complexity"].alias("complexity_avg"),
                         c["max_complexity"].alias("complexity_max"))


def _k_sql(where_repos: str, cap: int | None) -> str:
    capped = f"WHERE rank <= {cap}" if cap is not None else ""
    extra = [
        ("picked", f"SELECT full_name FROM b_repos {where_repos}"),
        ("listed", f"""SELECT * FROM (
      SELECT b.*, row_number() OVER (PARTITION BY b.repo_full_name
                                     ORDER BY length(b.path) - length(replace(b.path, '/', '')), b.path) AS rank
      FROM b_bodies b JOIN picked p ON b.repo_full_name = p.full_name WHERE suffix(b.name, '.py')) {capped}"""),
        ("judged", _verdict_body("listed", *_PY)),
    ]
    return O.sql(["b_repos", "b_bodies"], f"""
SELECT repo_full_name, path AS file_path,
       'collected_code/' || replace(repo_full_name, '/', '_') || '/' || path AS local_path,
       code_lines, round(q, 2) AS quality_score, reason_code = 'ok' AS is_suitable,
       {reason_case('repo_license', 'code_lines', 'q', *_PY[:3])} AS unsuitable_reason,
       function_count, complexity_avg, complexity_max
FROM judged""", extra=extra)


@query("k1_collect_by_query", _k_sql("WHERE stars > 1000 ORDER BY stars DESC, full_name LIMIT 5", 3))
def k1_collect_by_query(spark, sf):
    """Collect by query: 5 repositories with most stars (> 1000), first 3 .py
    files of each breadth-first, bodies decoded, scored and judged."""
    from quarry.plans.curate import collect_by_query
    out = collect_by_query(B.b_repos(spark, sf), B.b_listing(spark, sf), B.b_file_bodies(spark, sf),
                           B.PY_THRESHOLDS, max_repos=5, max_files_per_repo=3, min_stars=1000)
    return _k_rows(out)


@query("k2_collect_repository", _k_sql("WHERE full_name = 'src3/en'", None))
def k2_collect_repository(spark, sf):
    """Collect one repository given by URL (all its .py files), with the
    repository record defaulted when the listing lacks it."""
    from quarry.plans.curate import collect_repository
    out = collect_repository(spark, "https://github.com/src3/en", B.b_repos(spark, sf), B.b_listing(spark, sf),
                             B.b_file_bodies(spark, sf), B.PY_THRESHOLDS)
    return _k_rows(out)


@query("h9_update_status", O.sql([], """
SELECT u.id, CASE WHEN d.doc_id IS NOT NULL THEN 'updated' ELSE 'not_found' END AS status
FROM (SELECT DISTINCT CAST(conv_id AS BIGINT) AS id FROM conversations) u
LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d ON u.id = d.doc_id"""))
def h9_update_status(spark, sf):
    """Per-id result of the content replacements: updated, or not found."""
    return C.update_status(B.b_contents(spark, sf), B.b_content_updates(spark, sf))
