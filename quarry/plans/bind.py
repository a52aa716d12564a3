"""Bindings of the driver's tables to the corpus-curation data model.

The driver's tables hold prose, not source files, so each operator is run
over deterministic views derived from them by Spark (their SQL twins live in
`quarry.plans.oracle`). Every view reads whole tables; nothing is sampled.

  b_repos        (source, lang) groups of `documents` as repositories
  b_files        `documents` as files of those repositories
  b_source       document text with synthetic comment / triple-quote lines
  b_listing      file listing with varying depth and suffix (A4, B1, G5)
  b_landing      scored landing rows + re-scored copies + rows without key / local path
  b_file_tags    (doc, lang) + quality / toxic labels as tag additions
  b_tag_ops      `events` as a tag add/remove log
  b_job_events   `events` as job status events
  b_content_updates  `conversations` turns as content replacements
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.lines import split_lines
from quarry.functions.signals import round2
from quarry.functions.text import landing_path
from quarry.operators.suitability import score_and_judge
from quarry.schema import LintRules, Thresholds

# Parameters of the bound corpus: the default thresholds are degenerate on
# prose (median line length 166), so the bound queries use wider lines and a
# narrow code-line window so every verdict branch occurs.
BIND_THRESHOLDS = Thresholds(min_quality=6.0, min_lines=3, max_lines=20,
                             lint=LintRules(max_line_length=400))
# Thresholds of the generated modules (b_pysource): short lines, so that some score low.
PY_THRESHOLDS = Thresholds(min_quality=7.0, min_lines=20, max_lines=400, lint=LintRules(max_line_length=20))
OUT_DIR = "out"
HOST_URL = "https://github.com/"
# Repository licence by source number mod 7 (binding choice, exercises every licence branch).
SOURCE_LICENSES = ("MIT License", "Apache License 2.0", "BSD License",
                   "GNU General Public License v3.0",
                   'BSD 3-Clause "New" or "Revised" License', None, "CC BY-NC 4.0")
# Arrival order: the variant of a row above its document id, which may have 56 bits.
COPY_SEQ = 1 << 56
EVENT_SEQ = 1 << 60


# Tables whose rows carry text that the operators parse per row; only these
# are worth fanning out when a scan yields fewer partitions than cores.
TEXT_TABLES = ("documents", "pages", "conversations")


def session_cached(fn):
    """Memoize a view builder per (Spark application, session, arguments).
    DataFrames are immutable lazy plans, so queries that share a view reuse
    one plan object instead of rebuilding (and re-analysing) it."""
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(spark, *args, **kw):
        key = (spark.sparkContext.applicationId, id(spark), args, tuple(sorted(kw.items())))
        if key not in cache:
            cache[key] = fn(spark, *args, **kw)
        return cache[key]

    wrapper.cache = cache
    return wrapper


@session_cached
def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from quarry.sources.tables import spread
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    df = spark.read.parquet(path)
    return spread(df, key=path) if name in TEXT_TABLES else df


def source_no(source: Column) -> Column:
    return F.substring(source, 4, 64).cast("int")


def source_license(source: Column) -> Column:
    n = F.pmod(source_no(source), F.lit(7))
    expr = F.lit(None).cast("string")
    for i, lic in reversed(list(enumerate(SOURCE_LICENSES))):
        expr = F.when(n == i, F.lit(lic).cast("string")).otherwise(expr)
    return expr


def repo_full_name(source: Column, lang: Column) -> Column:
    return F.concat(source, F.lit("/"), lang)


def synth_source(text: Column) -> Column:
    """b_source: line i (0-based) becomes a triple quote when i%11 in (3,8),
    a '# ' comment when i%5 == 0, else stays."""
    lines = F.transform(split_lines(text), lambda l, i: (
        F.when(F.pmod(i, F.lit(11)).isin(3, 8), F.lit('"""'))
        .when(F.pmod(i, F.lit(5)) == 0, F.concat(F.lit("# "), l))
        .otherwise(l)))
    return F.array_join(lines, "\n")


def paragraph_complexities(text: Column) -> Column:
    """Bound block complexities: one block per line, 1 + number of commas."""
    return F.transform(split_lines(text), lambda p: (
        F.lit(1) + F.length(p) - F.length(F.replace(p, F.lit(","), F.lit("")))).cast("bigint"))


def python_module(doc_id: Column, text: Column) -> Column:
    """b_pysource: a Python module per document — class Doc<id> with one method
    per text line and, per comma of the line, one branch construct cycling
    if / for / while / conditional expression. Method complexity is therefore
    1 + commas, which SQL can compute from the text alone."""
    constructs = {
        0: "        if x:\n            x = x - 1\n",
        1: "        for y in x:\n            x = y\n",
        2: "        while x:\n            break\n",
        3: "        x = 1 if x else 0\n",
    }

    cycle = constructs[1] + constructs[2] + constructs[3] + constructs[0]   # j % 4 = 1, 2, 3, 0

    commas = F.transform(split_lines(text), lambda line: F.length(line) - F.length(F.replace(line, F.lit(","), F.lit(""))))

    def method(k, i):
        rest = F.pmod(k, F.lit(4))
        tail = (F.when(rest == 1, F.lit(constructs[1]))
                .when(rest == 2, F.lit(constructs[1] + constructs[2]))
                .when(rest == 3, F.lit(constructs[1] + constructs[2] + constructs[3]))
                .otherwise(F.lit("")))
        body = F.concat(F.repeat(F.lit(cycle), F.floor(k / 4).cast("int")), tail)
        return F.concat(F.lit("    def m"), i.cast("string"), F.lit("(self, x):\n"), body, F.lit("        return x\n"))

    return F.concat(F.lit("class Doc"), doc_id.cast("string"), F.lit(":\n"),
                    F.array_join(F.transform(commas, method), ""))


@session_cached
def b_pysource(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select(F.col("doc_id").alias("file_id"), python_module(F.col("doc_id"), F.col("text")).alias("content"))


def downloaded_text(doc_id: Column) -> Column:
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.expr("INTERVAL '1' MINUTE") * doc_id
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


@session_cached
def b_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


@session_cached
def b_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository listing: one row per (source, lang)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    g = docs.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"),
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    full = repo_full_name(F.col("source"), F.col("lang"))
    return g.select(
        F.col("source").alias("name"),
        full.alias("full_name"),
        F.concat(F.lit(HOST_URL), full).alias("url"),
        F.concat(F.lit("Documents in "), F.col("lang"), F.lit(" from "), F.col("source")).alias("description"),
        (F.col("n") * 100).cast("bigint").alias("stars"),
        F.pmod(F.col("chars"), F.lit(997)).cast("bigint").alias("forks"),
        (base + F.expr("INTERVAL '1' HOUR") * F.col("first_doc")).alias("created_at"),
        (base + F.expr("INTERVAL '1' HOUR") * F.col("last_doc")).alias("updated_at"),
        source_license(F.col("source")).alias("license"),
    )


@session_cached
def b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their synthetic source text (`content`) and repo attributes
    including stars (joined from the per-repo aggregate; AQE broadcasts it
    when its measured size is small, else it is a shuffle join)."""
    return b_files_core(spark, sf_dir).join(_repo_stars(spark, sf_dir), "repo_full_name", "left")


def _repo_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b_repos(spark, sf_dir).select(F.col("full_name").alias("repo_full_name"), F.col("stars").alias("repo_stars"))


@session_cached
def b_files_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without repository aggregates (no join)."""
    docs = b_docs(spark, sf_dir)
    full = repo_full_name(F.col("source"), F.col("lang"))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".py"))
    path = F.concat(F.col("lang"), F.lit("/"), name)
    files = docs.select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("repo_name"),
        full.alias("repo_full_name"),
        F.concat(F.lit(HOST_URL), full).alias("repo_url"),
        source_license(F.col("source")).alias("repo_license"),
        name.alias("file_name"),
        path.alias("file_path"),
        F.concat(F.lit(HOST_URL), full, F.lit("/blob/master/"), path).alias("file_url"),
        landing_path(OUT_DIR, full, path).alias("local_path"),
        synth_source(F.col("text")).alias("content"),
        paragraph_complexities(F.col("text")).alias("block_complexities"),
        downloaded_text(F.col("doc_id")).alias("downloaded_at"),
        F.col("lang"),
    )
    return files


@session_cached
def _listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b_docs(spark, sf_dir)
    full = repo_full_name(F.col("source"), F.col("lang"))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"),
                    F.when(F.pmod(F.col("n_chars"), F.lit(5)) == 0, F.lit(".md")).otherwise(F.lit(".py")))
    sub = (F.when(F.pmod(F.col("doc_id"), F.lit(3)) == 0, F.lit(""))
           .when(F.pmod(F.col("doc_id"), F.lit(3)) == 1, F.lit("pkg/")).otherwise(F.lit("pkg/sub/")))
    path = F.concat(F.col("lang"), F.lit("/"), sub, name)
    return docs.select(
        full.alias("repo_full_name"), name.alias("name"), path.alias("path"),
        F.concat(F.lit(HOST_URL), full, F.lit("/blob/master/"), path).alias("url"),
        F.md5(F.col("text")).alias("sha"), F.col("n_chars").cast("bigint").alias("size"), "doc_id", "text")


@session_cached
def b_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-file listing (name, path, url, sha, size) with nesting depth 0..2
    and a non-.py suffix on every fifth size."""
    return _listing_rows(spark, sf_dir).drop("doc_id", "text")


@session_cached
def b_file_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base64 bodies of the listed files (what the code host would return): generated modules."""
    module = python_module(F.col("doc_id"), F.col("text"))
    return _listing_rows(spark, sf_dir).select(
        "repo_full_name", "path", F.base64(F.encode(module, "UTF-8")).alias("content_b64"))


@session_cached
def b_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated module of every file by its local path (what re-judging a landing reads)."""
    docs = b_docs(spark, sf_dir)
    full = repo_full_name(F.col("source"), F.col("lang"))
    path = F.concat(F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".py"))
    return docs.select(landing_path(OUT_DIR, full, path).alias("local_path"),
                       python_module(F.col("doc_id"), F.col("text")).alias("content"))


@session_cached
def b_module_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`b_modules` as a stored table, for queries that look texts up batch by batch."""
    from quarry.sources.tables import stored
    return stored(b_modules(spark, sf_dir), "modules")


@session_cached
def b_judged_core(spark: SparkSession, sf_dir: str, th: Thresholds = BIND_THRESHOLDS) -> DataFrame:
    """Signals and verdict of every bound file (no repository join)."""
    return score_and_judge(b_files_core(spark, sf_dir), th)


@session_cached
def b_scored_files(spark: SparkSession, sf_dir: str, th: Thresholds = BIND_THRESHOLDS) -> DataFrame:
    """Files with signals, verdict and repository attributes. Texts are scored where they lie: the
    repositories are joined behind it, so that no text has to move to the rows of its repository."""
    from quarry.functions.signals import complexity_summary
    scored = score_and_judge(b_files_core(spark, sf_dir), th).withColumn("complexity", complexity_summary(F.col("block_complexities")))
    return scored.join(_repo_stars(spark, sf_dir), "repo_full_name", "left")


LANDING_COLS = ["repo_name", "repo_full_name", "repo_url", "repo_stars", "repo_license",
                "file_name", "file_path", "file_url", "local_path", "quality_score",
                "downloaded_at", "code_lines", "complexity", "is_suitable", "unsuitable_reason"]


@session_cached
def b_landing_plan(spark: SparkSession, sf_dir: str, th: Thresholds = BIND_THRESHOLDS) -> DataFrame:
    """Landing rows (as a plan) in arrival order `seq`: every scored file once (variant 0);
    a later re-scored copy of every tenth file (1); rows without repository
    key (2); rows without local path (3) — the last two are rejected at import.
    The variants are generated from one scoring pass (explode), so the text
    signals are computed once per document."""
    scored = b_scored_files(spark, sf_dir, th)
    fid = F.col("file_id")
    wanted = F.filter(F.array(*[F.lit(v) for v in range(4)]), lambda v: (
        (v == 0) | ((v == 1) & (F.pmod(fid, F.lit(10)) == 0)) | ((v == 2) & (F.pmod(fid, F.lit(25)) == 3))
        | ((v == 3) & (F.pmod(fid, F.lit(40)) == 11))))
    rows = scored.select(*LANDING_COLS, "file_id", "lang", F.explode(wanted).alias("variant"))
    v = F.col("variant")
    bak = lambda c: F.when(v == 3, F.concat(F.col(c), F.lit(".bak"))).otherwise(F.col(c))
    return rows.select(
        "repo_name",
        F.when(v == 2, F.lit(None).cast("string")).otherwise(F.col("repo_full_name")).alias("repo_full_name"),
        "repo_url", "repo_stars", "repo_license", bak("file_name").alias("file_name"),
        bak("file_path").alias("file_path"), "file_url",
        F.when(v == 3, F.lit(None).cast("string")).otherwise(F.col("local_path")).alias("local_path"),
        F.when(v == 1, round2(F.col("quality_score") / 2)).otherwise(F.col("quality_score")).alias("quality_score"),
        "downloaded_at", "code_lines", "complexity", "is_suitable", "unsuitable_reason", "file_id",
        (v.cast("bigint") * F.lit(COPY_SEQ) + fid).alias("seq"), "lang")


@session_cached
def b_landing(spark: SparkSession, sf_dir: str, th: Thresholds = BIND_THRESHOLDS) -> DataFrame:
    """The landing as a stored table: `b_landing_plan` written once per session as
    Parquet in the shared folder, so the queries that read the landing neither
    re-derive and re-score it nor read columns they do not use."""
    from quarry.sources.tables import stored
    return stored(b_landing_plan(spark, sf_dir, th), "landing")


@session_cached
def b_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contents table: file id -> source text (kept apart from metadata)."""
    return b_files_core(spark, sf_dir).select(F.col("file_id").alias("id"), "content")


@session_cached
def b_file_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag additions: (doc, lang), plus 'quality' / 'toxic' from labels."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = read_table(spark, sf_dir, "labels")
    lang_tags = docs.select(F.col("doc_id").alias("file_id"), F.col("lang").alias("tag"),
                            (F.col("doc_id") * 3).alias("seq"))
    q = labels.filter(F.col("quality") == 1).select(
        F.col("doc_id").alias("file_id"), F.lit("quality").alias("tag"), (F.col("doc_id") * 3 + 1).alias("seq"))
    t = labels.filter(F.col("toxic") == 1).select(
        F.col("doc_id").alias("file_id"), F.lit("toxic").alias("tag"), (F.col("doc_id") * 3 + 2).alias("seq"))
    return lang_tags.unionByName(q).unionByName(t).withColumn("action", F.lit("add")) \
        .select("file_id", "tag", "action", F.col("seq").cast("bigint"))


@session_cached
def b_event_tag_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a tag log: user -> file, event type -> tag; every third
    event removes, the rest add."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return ev.select(
        F.col("user_id").cast("bigint").alias("file_id"), F.col("event_type").alias("tag"),
        F.when(F.pmod(F.col("event_id"), F.lit(3)) == 0, F.lit("remove")).otherwise(F.lit("add")).alias("action"),
        (F.lit(EVENT_SEQ) + F.col("event_id")).cast("bigint").alias("seq"))


@session_cached
def b_tag_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tag log: label-derived additions first, then the event log."""
    return b_file_tags(spark, sf_dir).unionByName(b_event_tag_ops(spark, sf_dir))


@session_cached
def b_job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as job status events: job = user, error -> failed,
    purchase -> completed, anything else -> in progress."""
    ev = read_table(spark, sf_dir, "events")
    status = (F.when(F.col("event_type") == "error", F.lit("failed"))
              .when(F.col("event_type") == "purchase", F.lit("completed"))
              .otherwise(F.lit("in_progress")))
    return ev.select(
        F.col("user_id").cast("bigint").alias("job_id"),
        F.col("event_id").cast("bigint").alias("seq"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("query"),
        status.alias("status"),
        F.floor(F.col("value")).cast("bigint").alias("files_downloaded"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
    )


@session_cached
def b_content_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations` turns as content replacements of file `conv_id`,
    applied in turn order (last wins)."""
    conv = read_table(spark, sf_dir, "conversations")
    return conv.select(F.col("conv_id").cast("bigint").alias("id"), F.col("text").alias("content"),
                       F.col("turn").cast("bigint").alias("seq"))
