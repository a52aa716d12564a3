"""Registered queries: landing files, parameters, committed changes, failures and the
command line (A1-A3, A5, A7, A12, B16, G5, H2, H5-H7, H9, K2-K4)."""

from __future__ import annotations

import contextlib
import io
import uuid

from pyspark.sql import functions as F

from quarry.operators import catalog as C
from quarry.operators import jobs as J
from quarry.operators import repos as RP
from quarry.operators import search as S
from quarry.operators import tags as TG
from quarry.plans import bind as B
from quarry.plans import oracle as O
from quarry.plans.queries_catalog import _DEL_IDS, _STREAM_COLS, _deletes, catalog, links, tag_log
from quarry.plans.queries_signals import _DEPTH
from quarry.plans.registry import query
from quarry.session import scratch_path
from quarry.sources import tables as T
from quarry.sources.landing import append_landing, decode_contents, landing_rejects, read_landing, write_landing


def _fresh(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


# --- bodies and listing: A5 A7 G5 --------------------------------------------------------

@query("a5_decode_content", O.sql([], """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(text) END AS digest FROM documents WHERE text <> ''"""))
def a5_decode_content(spark, sf):
    """Base64 bodies: one in three holds bytes that are no UTF-8, one in three is no base64; these have no text."""
    docs = B.b_docs(spark, sf).select("doc_id", "text").filter("text <> ''")
    kind = F.pmod("doc_id", F.lit(3))
    raw = F.base64(F.encode("text", "UTF-8"))
    body = F.when(kind == 0, raw).when(kind == 1, F.base64(F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF"))))) \
        .otherwise(F.concat(F.lit("!"), raw))
    decoded = decode_contents(docs.select("doc_id", body.alias("content_b64"))).select("doc_id", F.md5("content").alias("digest"))
    return docs.select("doc_id").join(decoded, "doc_id", "left")


@query("a7_lenient_text", O.sql([], "SELECT doc_id, md5(text || chr(65533)) AS digest FROM documents"))
def a7_lenient_text(spark, sf):
    """Texts with invalid bytes around and a genuine replacement character at the end, read leniently."""
    from quarry.functions.text import lenient_text
    raw = F.concat(F.unhex(F.lit("C3")), F.encode(F.col("text"), "UTF-8"), F.unhex(F.lit("FFFE")), F.encode(F.lit("\ufffd"), "UTF-8"))
    return B.b_docs(spark, sf).select("doc_id", F.md5(lenient_text(raw)).alias("digest"))


@query("g5_first_files_large_cap", O.sql(["b_listing"], f"""
SELECT repo_full_name, path, depth, rank FROM (
  SELECT repo_full_name, path, {_DEPTH} AS depth,
         CAST(row_number() OVER (PARTITION BY repo_full_name ORDER BY {_DEPTH}, path) AS INTEGER) AS rank
  FROM (SELECT repo_full_name, path FROM b_listing
        UNION ALL SELECT repo_full_name, path FROM b_listing WHERE suffix(path, '0.py')
        UNION ALL SELECT NULL, path FROM b_listing WHERE suffix(path, '1.py'))) WHERE rank <= 5000"""))
def g5_first_files_large_cap(spark, sf):
    """A cap of 5000 per repository over a listing with repeated paths and rows without a repository."""
    rows = B.b_listing(spark, sf).select("repo_full_name", "path")
    more = rows.filter(F.col("path").endswith("0.py")).unionByName(
        rows.filter(F.col("path").endswith("1.py")).withColumn("repo_full_name", F.lit(None).cast("string")))
    return RP.first_files_per_repo(rows.unionByName(more), 5000).select("repo_full_name", "path", "depth", "rank")


# --- landing files: A1 A2 A3 H2 A12 K4 --------------------------------------------------------

def _landing_files(spark, sf, name):
    """The landing without `seq` as JSON Lines in the shared folder, the later variants in later files."""
    root = _fresh(spark, name)
    rows = B.b_landing(spark, sf)
    v = F.floor(F.col("seq") / F.lit(B.COPY_SEQ))
    for k in range(4):
        append_landing(rows.filter(v == k).drop("seq"), root)
    return root


@query("a1_reject_count", O.sql([], """
SELECT CAST(count(*) AS BIGINT) AS records, CAST(count_if(doc_id % 3 = 0) AS BIGINT) AS rejects,
       CAST(count_if(doc_id % 3 > 0) AS BIGINT) AS named FROM documents"""))
def a1_reject_count(spark, sf):
    """A landing in which one record in three is cut off: its records and the malformed ones."""
    root = _fresh(spark, "rejects")
    line = F.to_json(F.struct(F.col("source").alias("repo_name"), F.col("text").alias("file_name")))
    cut = F.substring(line, F.lit(1), F.length(line) - 1)
    B.b_docs(spark, sf).select(F.when(F.pmod("doc_id", F.lit(3)) == 0, cut).otherwise(line).alias("value")).write.text(root)
    return landing_rejects(spark, root, array=False)


@query("a2_write_landing", O.sql(["b_landing"], """
SELECT seq, repo_full_name, file_path, local_path, quality_score, complexity_avg, is_suitable, unsuitable_reason FROM b_landing"""))
def a2_write_landing(spark, sf):
    """The landing written as JSON Lines (null keys kept) and read back."""
    root = _fresh(spark, "written")
    write_landing(B.b_landing(spark, sf), root)
    return read_landing(spark, root).select("seq", "repo_full_name", "file_path", "local_path", "quality_score",
                                            F.col("complexity.avg_complexity").alias("complexity_avg"), "is_suitable", "unsuitable_reason")


@query("a3_append_landing", O.sql(["b_landing"], """
SELECT repo_full_name, CAST(count(*) AS BIGINT) AS files FROM b_landing GROUP BY repo_full_name"""))
def a3_append_landing(spark, sf):
    """Rows per repository of a landing made of four appends."""
    return read_landing(spark, _landing_files(spark, sf, "appends")).groupBy("repo_full_name").agg(F.count(F.lit(1)).alias("files"))


_NO_SEQ_COLS = "repo_full_name, name, path, url, local_path, quality_score, code_lines, is_suitable, complexity_avg, downloaded_at"


@query("h2_import_no_seq", O.sql(["c_files"], f"SELECT {_NO_SEQ_COLS} FROM c_files"))
def h2_import_no_seq(spark, sf):
    """A landing of JSON Lines without `seq`, read back and imported: arrival decides which row is first."""
    _, files, _, _ = C.import_landing(read_landing(spark, _landing_files(spark, sf, "no-seq")))
    return files.select(*_NO_SEQ_COLS.split(", "))


@query("a12_snapshot", O.sql(["c_repos", "c_files", "b_landing"], """
SELECT 'repositories' AS "table", CAST(count(*) AS BIGINT) AS "rows" FROM c_repos
UNION ALL SELECT 'files', count(*) FROM c_files UNION ALL SELECT 'landing', count(*) FROM b_landing"""))
def a12_snapshot(spark, sf):
    """Row counts of a snapshot of the catalogue and the landing, counted in the copy."""
    repos, files = catalog(spark, sf)
    tables = {"repositories": repos, "files": files, "landing": B.b_landing(spark, sf)}
    return T.snapshot(spark, tables, _fresh(spark, "snapshot"))[1]


@query("k4_cli_import", O.sql(["c_files"], f"SELECT {_STREAM_COLS} FROM c_files"))
def k4_cli_import(spark, sf):
    """The catalogue that the command line makes of landing files."""
    from quarry import cli
    root = _fresh(spark, "cli")
    with contextlib.redirect_stdout(io.StringIO()):
        cli.main(["import", "--landing", _landing_files(spark, sf, "cli-landing"), "--catalog", root], spark)
    return spark.read.parquet(f"{root}/files").select(*[c.strip() for c in _STREAM_COLS.split(",")])


# --- parameters and tags: B16 H5 H6 --------------------------------------------------------

@query("b16_parameters", O.sql([], """
SELECT text, CASE WHEN trim(text) = '' THEN 100 WHEN CAST(nullif(trim(text), '') AS BIGINT) < 0 THEN NULL ELSE CAST(nullif(trim(text), '') AS BIGINT) END AS "limit"
FROM (SELECT DISTINCT CASE WHEN turn % 3 = 0 THEN ' ' WHEN turn % 3 = 1 THEN '-1' ELSE CAST(turn AS VARCHAR) END AS text FROM conversations)"""))
def b16_parameters(spark, sf):
    """Request texts (blank, negative, numbers) as limits."""
    turn = F.col("turn")
    text = F.when(turn % 3 == 0, F.lit(" ")).when(turn % 3 == 1, F.lit("-1")).otherwise(turn.cast("string"))
    seen = B.read_table(spark, sf, "conversations").select(text.alias("text")).distinct()
    return seen.withColumn("limit", S.limit_column(F.col("text")))


@query("h5_tag_actions", O.sql(["b_tag_ops"], """
SELECT action, CAST(count(*) AS BIGINT) AS ops FROM b_tag_ops GROUP BY action"""))
def h5_tag_actions(spark, sf):
    """The log's operations by action, each action validated."""
    valid = [TG.validate_action(a) for a in TG.ACTIONS]
    return tag_log(spark, sf).filter(F.col("action").isin(valid)).groupBy("action").agg(F.count(F.lit(1)).alias("ops"))


@query("h6_batch_tag_hash_ids", O.sql([], """
SELECT 9223372036854775807 - doc_id AS file_id, 'keep' AS tag FROM documents WHERE doc_id % 2 = 0"""))
def h6_batch_tag_hash_ids(spark, sf):
    """Ids near the largest 64-bit number, tagged in one batch and untagged (the odd ones) in a later one."""
    ids = B.read_table(spark, sf, "documents").select((F.lit((1 << 63) - 1) - F.col("doc_id")).alias("id"), "doc_id")
    now = 1_700_000_000_000_000_000
    log = TG.batch_ops(ids, "keep", "add", now).unionByName(
        TG.batch_ops(ids.filter(F.pmod("doc_id", F.lit(2)) == 1), "keep", "remove", now + 1))
    return TG.fold_links(log)


# --- committed changes: H7 H9 --------------------------------------------------------------

def _committed(spark, sf):
    """A catalogue with texts in the shared folder, and its changes as logs."""
    _, files = catalog(spark, sf)
    root = T.write_catalog(spark, {"files": files, "contents": B.b_contents(spark, sf)}, _fresh(spark, "committed"))
    status = C.delete_files(_deletes(spark, sf), files, links(spark, sf))["status"]
    T.commit_deletes(status.filter("status = 'deleted'").select("id"), root, 1)
    for v, half in enumerate((F.col("seq") % 2 == 1, F.col("seq") % 2 == 0)):      # even turns are committed last
        T.commit_contents(B.b_content_updates(spark, sf).filter(half), root, 2 + v)
    return root


@query("h7_delete_committed", O.sql(["c_files"], f"SELECT id, name FROM c_files WHERE id NOT IN {_DEL_IDS}"))
def h7_delete_committed(spark, sf):
    """Files read back from a stored catalogue after a committed delete."""
    root = _committed(spark, sf)
    return T.without_deleted(spark, root, T.read_catalog(spark, root, ["files"])["files"]).select("id", "name")


@query("h9_replace_committed", O.sql(["b_files_core", "c_files"], f"""
SELECT c.file_id AS id, CAST(length(coalesce(u.content, c.content)) AS BIGINT) AS n_chars, md5(coalesce(u.content, c.content)) AS digest
FROM b_files_core c LEFT JOIN (
  SELECT conv_id AS id, arg_max(text, (CASE WHEN turn % 2 = 0 THEN 1000000 ELSE 0 END) + turn) AS content
  FROM conversations GROUP BY conv_id) u ON c.file_id = u.id
WHERE c.file_id NOT IN (SELECT id FROM c_files WHERE id IN {_DEL_IDS})"""))
def h9_replace_committed(spark, sf):
    """Texts read back from a stored catalogue after committed replacements and deletes."""
    got = T.current_contents(spark, _committed(spark, sf))
    return got.select("id", F.length("content").cast("bigint").alias("n_chars"), F.md5("content").alias("digest"))


# --- failures: K2 K3 ----------------------------------------------------------------------

@query("k2_collect_failures", O.sql(["b_bodies"], r"""
SELECT repo_full_name, path,
       CASE WHEN n % 4 = 1 THEN 'no body' WHEN n % 4 = 2 THEN 'empty body' ELSE 'not base64 of UTF-8 text' END AS error
FROM (SELECT repo_full_name, path, CAST(regexp_extract(path, 'doc_([0-9]+)', 1) AS BIGINT) AS n FROM b_bodies WHERE suffix(name, '.py'))
WHERE n % 4 > 0"""))
def k2_collect_failures(spark, sf):
    """Listed files whose body is missing, empty or damaged, with the reason."""
    from quarry.plans.curate import collect_failures
    n = F.pmod(F.regexp_extract("path", r"doc_([0-9]+)", 1).cast("bigint"), F.lit(4))
    body = F.when(n == 2, F.lit("")).when(n == 3, F.lit("!!")).otherwise(F.col("content_b64"))
    bodies = B.b_file_bodies(spark, sf).filter(n != 1).withColumn("content_b64", body)
    listed = RP.list_source_files(B.b_listing(spark, sf)).withColumn("seq", F.lit(0))
    return collect_failures(listed, bodies)


@query("k3_failed_job", O.sql(["b_landing"], """
SELECT 2::BIGINT AS id, 'failed' AS status, 2::BIGINT AS n_events,
       'landing batch rejected: repository ' || chr(39) || min(repo_full_name) || chr(39) || ' has no name or url' AS error
FROM b_landing WHERE repo_full_name <> '' AND local_path IS NOT NULL"""))
def k3_failed_job(spark, sf):
    """Job record of a run whose landing lacks repository names: in progress, then failed with the error."""
    from quarry.plans.curate import curate, run_job
    landing = B.b_landing(spark, sf).withColumn("repo_name", F.lit(None).cast("string"))
    log = run_job(spark, _fresh(spark, "job-log"), 2, "unnamed",
                  lambda: curate(spark, landing, B.b_modules(spark, sf), B.PY_THRESHOLDS)["landing"])
    return J.job_states(log).select("id", "status", "error", "n_events")
