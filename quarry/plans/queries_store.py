"""Registered queries: text store, score cache, any landing in the stream, versioned deletes, failures as
rows, partial sums, search by postings (A6, B4, B7, E1-E5, E12, G1, H7, J1, J3, K1, K2)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.operators import postings as G
from quarry.operators import repos as RP
from quarry.plans import bind as B
from quarry.plans import oracle as O
from quarry.plans.queries_catalog import _AVG_Q, _BIN, _DEL_IDS, _STREAM_COLS, _deletes, _landing_batches, _text_sql, catalog
from quarry.plans.queries_signals import _PY, _verdict_body, reason_case
from quarry.plans.registry import query
from quarry.schema import REASON_FAILED
from quarry.session import scratch_path
from quarry.sources import partials as P
from quarry.sources import tables as T
from quarry.sources import texts as X
from quarry.sources.landing import append_landing
from quarry.streaming.ingest import dead_letters, ingest_batch, run_ingest


def _fresh(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _variant():
    return F.floor(F.col("seq") / F.lit(B.COPY_SEQ))


def _write_arrays(rows, path):
    """Landing rows as JSON array files over many lines, one array per task."""
    def lines(batches):
        import pyarrow as pa
        yield pa.RecordBatch.from_pydict({"value": ["["]})
        first = True
        for batch in batches:
            got = batch.column("value").to_pylist()
            yield pa.RecordBatch.from_pydict({"value": pa.array([v if first and i == 0 else "," + v for i, v in enumerate(got)], pa.string())})
            first = first and not got
        yield pa.RecordBatch.from_pydict({"value": ["]"]})
    text = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    text.mapInArrow(lines, "value string").write.mode("append").text(path)


# --- J1: any landing, dead letters ------------------------------------------------------

@query("j1_array_files", O.sql(["c_files"], f"SELECT {_STREAM_COLS} FROM c_files"))
def j1_array_files(spark, sf):
    """A landing folder that gets JSON Lines and then array files beside them, ingested by a resumed stream."""
    root = _fresh(spark, "arrays")
    rows = B.b_landing(spark, sf).drop("file_id", "lang")
    half = F.pmod("seq", F.lit(2)) == 0
    append_landing(rows.filter((_variant() == 0) & half), f"{root}/landing")
    run_ingest(spark, f"{root}/landing", f"{root}/catalog", fmt="json")
    _write_arrays(rows.filter((_variant() == 0) & ~half), f"{root}/landing")
    append_landing(rows.filter(_variant() > 0), f"{root}/landing")
    run_ingest(spark, f"{root}/landing", f"{root}/catalog", fmt="json")
    return spark.read.parquet(f"{root}/catalog/files").select(*[c.strip() for c in _STREAM_COLS.split(",")])


@query("j1_rejects", O.sql(["b_landing"], f"""
SELECT file_path, CASE seq // {B.COPY_SEQ} WHEN 1 THEN 'malformed record' WHEN 2 THEN 'no repository' ELSE 'no local_path' END AS reason
FROM b_landing WHERE seq >= {B.COPY_SEQ}"""))
def j1_rejects(spark, sf):
    """Dead letters of a stream over a landing with records cut off, without repository and without local path."""
    root = _fresh(spark, "letters")
    rows = B.b_landing(spark, sf).drop("file_id", "lang")
    line = F.to_json(F.struct(*rows.columns))
    cut = rows.select(F.when(_variant() == 1, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line).alias("value"))
    cut.write.text(f"{root}/landing")
    run_ingest(spark, f"{root}/landing", f"{root}/catalog", fmt="json")
    return dead_letters(spark, f"{root}/catalog").select(F.regexp_extract("record", '"file_path":"([^"]*)"', 1).alias("file_path"), "reason")


# --- A6 / K1: text store ----------------------------------------------------------------

def _text_store(spark, sf):
    """Texts of all documents under their paths, then conversation turns in their place, in three commits."""
    root = _fresh(spark, "texts")
    under = F.concat(F.lit("d/"), F.col("id").cast("string"))
    docs = B.b_docs(spark, sf).select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("local_path"), F.col("text").alias("content"))
    X.store_texts(docs, root, 1)
    for v in (2, 3):        # even turns are committed last
        turns = B.b_content_updates(spark, sf).filter(F.pmod("seq", F.lit(2)) == 3 - v)
        last = turns.groupBy("id").agg(F.max_by("content", F.struct("seq", "content")).alias("content"))
        X.store_texts(last.select(under.alias("local_path"), "content"), root, v)
    return root


_STORE_SQL = """
WITH u AS (SELECT 'd/' || CAST(conv_id AS VARCHAR) AS local_path, arg_max(text, (CASE WHEN turn % 2 = 0 THEN 1000000 ELSE 0 END) + turn) AS content
           FROM conversations GROUP BY conv_id),
d AS (SELECT 'd/' || CAST(doc_id AS VARCHAR) AS local_path, text AS content FROM documents)
SELECT coalesce(u.local_path, d.local_path) AS local_path, coalesce(u.content, d.content) AS content FROM d FULL JOIN u USING (local_path)"""


@query("a6_text_store", f"""
SELECT local_path, sha256(content) AS digest, CAST(length(content) AS BIGINT) AS n_chars FROM ({_STORE_SQL})""")
def a6_text_store(spark, sf):
    """The current text of every path of a content-addressed store after replacements."""
    return X.stored_texts(spark, _text_store(spark, sf)).select("local_path", "digest", F.length("content").cast("bigint").alias("n_chars"))


@query("a6_texts_once", """
SELECT sha256(t) AS digest, CAST(strlen(t) AS BIGINT) AS bytes FROM (
  SELECT text AS t FROM documents UNION SELECT t FROM (
    SELECT arg_max(text, turn) AS t FROM conversations GROUP BY conv_id, turn % 2))""")
def a6_texts_once(spark, sf):
    """Every stored text, equal ones once, also those no longer current."""
    return spark.read.parquet(f"{_text_store(spark, sf)}/texts").select("digest", F.octet_length("content").cast("bigint").alias("bytes"))


# --- J3: scores of what is new ----------------------------------------------------------

@query("j3_scores_once", O.sql([], """
SELECT CAST(b AS INTEGER) AS batch, CAST(count(DISTINCT doc_id) AS BIGINT) AS files, CAST(count(DISTINCT CASE WHEN b < 2 THEN doc_id END) AS BIGINT) AS scored
FROM (SELECT doc_id, CASE WHEN lang IN ('de', 'en') THEN 0 ELSE 1 END AS b FROM documents UNION ALL SELECT doc_id, 2 FROM documents) GROUP BY b"""))
def j3_scores_once(spark, sf):
    """Files added and texts scored per batch: two languages, then everything, then all files again under other paths."""
    rows = B.b_landing(spark, sf).filter(_variant() == 0)
    copied = lambda c: F.concat(F.lit("copy/"), F.col(c)).alias(c)
    again = rows.select(*[copied(c) if c in ("file_path", "local_path") else F.col(c) for c in rows.columns])
    texts = B.b_module_store(spark, sf)
    texts = texts.unionByName(texts.select(copied("local_path"), "content"))
    root = _fresh(spark, "scores-once")
    for i, batch in enumerate((rows.filter(F.col("lang").isin("de", "en")), rows, again)):
        ingest_batch(batch.drop("lang"), root, texts, B.PY_THRESHOLDS, version=i)

    def per_batch(table, name):
        return spark.read.parquet(f"{root}/{table}").groupBy("version").agg(F.count(F.lit(1)).alias(name))
    return per_batch("files", "files").join(per_batch("scores", "scored"), "version", "left").select(
        F.col("version").cast("int").alias("batch"), "files", F.coalesce("scored", F.lit(0).cast("bigint")).alias("scored"))


# --- H7: import after a delete ----------------------------------------------------------

def _reimported(spark, sf, after=lambda root: None):
    """An import, a committed delete and an import of the re-scored copies; `after` each."""
    root = _fresh(spark, "reimport")
    first, copies, _ = _landing_batches(B.b_landing(spark, sf))
    ingest_batch(first, root, version=1)
    after(root)
    T.commit_deletes(_deletes(spark, sf), root, 2)
    after(root)
    ingest_batch(copies, root, version=3)
    after(root)
    return root


@query("h7_reimport_after_delete", O.sql(["b_landing", "c_files"], f"""
SELECT id, name, quality_score FROM c_files WHERE id NOT IN {_DEL_IDS}
UNION ALL SELECT l.file_id, l.file_name, l.quality_score FROM b_landing l
WHERE l.seq // {B.COPY_SEQ} = 1 AND l.file_id IN (SELECT id FROM c_files WHERE id IN {_DEL_IDS})"""))
def h7_reimport_after_delete(spark, sf):
    """Files of a catalogue after an import, a committed delete and an import of the re-scored copies: a deleted
    file that is imported again stands with its later row, others keep their first."""
    root = _reimported(spark, sf)
    return T.without_deleted(spark, root, spark.read.parquet(f"{root}/files")).select("id", "name", "quality_score")


# --- B7 / G1: search by postings --------------------------------------------------------

_QUERIES = ["src1", "doc_1", ".PY", "en/doc_10", "rc%7/F", "c1", "no such text", "src3/de"]


@query("g1_search_postings", O.sql(["c_catalog"], " UNION ALL ".join(
    f"SELECT '{q}' AS query, c.id, c.repo_full_name AS repo_name FROM c_catalog c WHERE {_text_sql(q)}" for q in _QUERIES)))
def g1_search_postings(spark, sf):
    """Text searches over postings: names, wildcards, other case, too short for a run, without a match."""
    repos, files = catalog(spark, sf)
    root = _fresh(spark, "postings")
    first = F.col("lang_") == "en"
    lang = F.element_at(F.split("repo_full_name", "/"), -1).alias("lang_")
    G.append_postings(files.select("*", lang).filter(first), repos, root)
    G.append_postings(files.select("*", lang).filter(~first), repos.limit(0), root)
    out = None
    for q in _QUERIES:
        hit = G.search_postings(spark, root, files, repos, query=q, limit=None, with_tags=False).select(F.lit(q).alias("query"), "id", "repo_name")
        out = hit if out is None else out.unionByName(hit)
    return out


# --- E1-E5, E12 from partial sums ---------------------------------------------------------

_LIVE = ("live", f"""
SELECT id, repo_full_name, quality_score, code_lines, is_suitable FROM c_files WHERE id NOT IN {_DEL_IDS}
UNION ALL SELECT l.file_id, l.repo_full_name, l.quality_score, l.code_lines, coalesce(l.is_suitable, false) FROM b_landing l
WHERE l.seq // {B.COPY_SEQ} = 1 AND l.file_id IN (SELECT id FROM c_files WHERE id IN {_DEL_IDS})""")


@query("e12_dashboard_partials", O.sql(["b_landing", "c_files", "c_repos"], f"""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM c_repos) AS repository_count, CAST(count(*) AS BIGINT) AS file_count,
       CAST(count_if(is_suitable) AS BIGINT) AS suitable_file_count, coalesce({_AVG_Q}, 0.0) AS average_quality_score,
       coalesce(sum(code_lines) / count(code_lines), 0.0) AS average_code_lines,
       {", ".join(f"CAST(count_if(quality_score IS NOT NULL AND {_BIN} = {i}) AS BIGINT) AS q{i}" for i in range(5))}
FROM live""", extra=[_LIVE]))
def e12_dashboard_partials(spark, sf):
    """Dashboard figures of a catalogue that grew, shrank and grew, from sums kept after each change."""
    return P.scalars(spark, _reimported(spark, sf, lambda root: P.refresh(spark, root)))


@query("e4_top_repos_partials", O.sql(["b_landing", "c_files"], """
SELECT repo_full_name AS full_name, CAST(count(*) AS BIGINT) AS file_count FROM live GROUP BY 1 ORDER BY file_count DESC, full_name LIMIT 10""", extra=[_LIVE]))
def e4_top_repos_partials(spark, sf):
    """Top-10 repositories by file count, from the same sums."""
    return P.top_repositories(spark, _reimported(spark, sf, lambda root: P.refresh(spark, root)))


# --- K2: failures as rows ---------------------------------------------------------------

DEEP = 10_000              # nested operators that the parser gives up on


@query("k2_failure_rows", O.sql(["b_bodies"], f"""
SELECT repo_full_name, path AS file_path, CASE WHEN deep THEN 0 ELSE code_lines END AS code_lines,
       CASE WHEN NOT deep THEN round(q, 2) END AS quality_score, CASE WHEN NOT deep THEN reason_code = 'ok' END AS is_suitable,
       CASE WHEN deep THEN '{REASON_FAILED.format("MemoryError")}' ELSE {reason_case('repo_license', 'code_lines', 'q', *_PY[:3])} END AS unsuitable_reason,
       CASE WHEN NOT deep THEN function_count END AS function_count
FROM judged""", extra=[
    ("listed", "SELECT *, CAST(regexp_extract(path, 'doc_([0-9]+)', 1) AS BIGINT) % 8 = 1 AS deep FROM b_bodies WHERE suffix(name, '.py')"),
    ("judged", _verdict_body("listed", *_PY))]))
def k2_failure_rows(spark, sf):
    """Every listed file landed; one in eight ends in an expression that the parser gives up on and is a row without score and verdict."""
    from quarry.plans.curate import land_files
    n = F.pmod(F.regexp_extract("path", r"doc_([0-9]+)", 1).cast("bigint"), F.lit(8))
    deep = F.encode(F.concat(F.unbase64("content_b64").cast("string"), F.lit("x = "), F.repeat(F.lit("-"), F.lit(DEEP)), F.lit("1\n")), "UTF-8")
    bodies = B.b_file_bodies(spark, sf).withColumn("content_b64", F.when(n == 1, F.base64(deep)).otherwise(F.col("content_b64")))
    listed = RP.list_source_files(B.b_listing(spark, sf)).withColumn("seq", F.lit(0))
    out = land_files(B.b_repos(spark, sf), listed, bodies, B.PY_THRESHOLDS, "collected_code", F.localtimestamp())
    return out.select("repo_full_name", "file_path", "code_lines", "quality_score", "is_suitable", "unsuitable_reason",
                      F.col("complexity.function_count").alias("function_count"))
