"""Composed jobs (K1-K4): collect -> score -> judge -> land -> import.

The remote code host of the original is replaced by tables: a repository
listing, a file listing and base64 file bodies keyed by (repo, path). Each
job is one Spark plan; nothing loops on the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import decode_content, landing_path
from quarry.operators import catalog as C
from quarry.operators import jobs as J
from quarry.operators import repos as RP
from quarry.operators.complexity import analyze_ast, with_complexity
from quarry.operators.suitability import add_signals, filter_landing, judged_columns
from quarry.schema import DEFAULT_REPO_HOST, JOB_COMPLETED, JOB_FAILED, JOB_IN_PROGRESS, Thresholds
from quarry.sources.landing import append_landing
from quarry.sources.tables import stored
from quarry.sources.texts import store_texts


PICKED_REPOS = 1000        # names of so many picked repositories may go into a filter


def fetch_bodies(files: DataFrame, bodies: DataFrame, repos: list[str] | None = None) -> DataFrame:
    """The listed files with their encoded bodies (null where there is none).

    Keys come first: bodies of other repositories than `repos` are left out by a filter that reaches the scan, and
    the few keys are inner-joined to the rest, so that adaptive execution may send them to the bodies; a left
    join could not, and would move every body. Files without one are attached afterwards."""
    f = files.select("repo_full_name", F.col("name").alias("file_name"), F.col("path").alias("file_path"),
                     F.col("url").alias("file_url"), "seq")
    held = bodies.select("repo_full_name", F.col("path").alias("file_path"), "content_b64")
    if repos is not None:
        held = held.filter(F.col("repo_full_name").isin(repos))
    key = ["repo_full_name", "file_path"]
    hit = held.join(f.select(*key).distinct(), key, "inner")
    return f.join(hit, key, "left")


def land_files(repos: DataFrame, files: DataFrame, bodies: DataFrame, th: Thresholds, out_dir: str,
               clock: Column, names: list[str] | None = None) -> DataFrame:
    """Decode the bodies of the selected files, score and judge them, and
    shape landing rows (A5, A6, C1-C3, B3, A3). Files whose body is empty or
    undecodable are skipped, as the original skips empty downloads; a file that cannot be analysed
    is landed without score and verdict, with 0 lines and the failure as its reason. Only picked
    bodies are fetched and decoded: whether one is usable is asked behind the Arrow pass
    that measures complexity, where no filter is pushed below the join."""
    r = repos.select(F.col("full_name").alias("repo_full_name"), F.col("name").alias("repo_name"),
                     F.col("url").alias("repo_url"), F.col("stars").alias("repo_stars"),
                     F.col("license").alias("repo_license"))
    f = fetch_bodies(files, bodies, names).join(r, "repo_full_name", "inner")
    f = f.withColumn("content", decode_content(F.col("content_b64"))).drop("content_b64")
    f = f.withColumn("_present", F.coalesce(F.length("content") > 0, F.lit(False)))
    s = add_signals(f, "content", th).drop("lint_findings")
    measured = with_complexity(analyze_ast(s, s.columns, "content")).filter("_present").withColumn("error", F.col("ast_failure"))
    judged = measured.withColumns(judged_columns(th, F.lit(True))) \
        .withColumn("local_path", landing_path(out_dir, F.col("repo_full_name"), F.col("file_path")))
    return judged.select(
        "repo_name", "repo_full_name", "repo_url", "repo_stars", "repo_license", "file_name", "file_path",
        "file_url", "local_path", "quality_score", F.date_format(clock, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("downloaded_at"),
        "code_lines", "complexity", "is_suitable", "unsuitable_reason", "seq", "content")


def collect_failures(files: DataFrame, bodies: DataFrame) -> DataFrame:
    """(repo_full_name, path, error): listed files that `land_files` skips, and why."""
    f = fetch_bodies(files, bodies)
    text = decode_content(F.col("content_b64"))
    error = (F.when(F.col("content_b64").isNull(), F.lit("no body"))
             .when(F.col("content_b64") == "", F.lit("empty body")).when(text.isNull(), F.lit("not base64 of UTF-8 text"))
             .when(F.length(text) == 0, F.lit("empty body")))
    return f.select("repo_full_name", F.col("file_path").alias("path"), error.alias("error")).filter("error IS NOT NULL")


def land_and_store(landed: DataFrame, out: str, root: str | None, fmt: str = "json") -> int:
    """Append landed rows to the landing `out`, and their texts to the text store of the catalogue at `root`;
    returns the number of texts that were new. The rows are collected once, to the shared folder."""
    landed = stored(landed, "landed")
    append_landing(landed.drop("content"), out, fmt)
    return store_texts(landed, root, time.time_ns()) if root else 0


def collect_by_query(repo_listing: DataFrame, file_listing: DataFrame, bodies: DataFrame,
                     th: Thresholds = Thresholds(), max_repos: int = 5, max_files_per_repo: int | None = None,
                     out_dir: str = "collected_code", clock: Column | None = None, **select_kw) -> DataFrame:
    """K1: select repositories (A13), list their .py files breadth-first with
    a per-repository cap (A4/G5), then land and judge them."""
    clock = clock if clock is not None else F.localtimestamp()
    repos = RP.select_repositories(repo_listing, max_results=max_repos, **select_kw)
    names = None
    if max_repos <= PICKED_REPOS:
        # a few names: listing and bodies are filtered at their scans
        repos = stored(repos, "picked")
        names = sorted(r["full_name"] for r in repos.select("full_name").collect())
        of_picked = file_listing.filter(F.col("repo_full_name").isin(names))
    else:
        of_picked = file_listing.join(repos.select(F.col("full_name").alias("repo_full_name")), "repo_full_name", "left_semi")
    listed = RP.list_source_files(of_picked, max_files_per_repo).withColumn("seq", F.xxhash64("repo_full_name", "path"))
    return land_files(repos, listed, bodies, th, out_dir, clock, names)


def repository_of_url(url: str, host: str = DEFAULT_REPO_HOST) -> str:
    """owner/repo of a repository URL (B14 for one value); other URLs raise."""
    parts = url.strip("/").split("/")
    if len(parts) < 5 or parts[2] != host:
        raise ValueError(f"not a repository URL on {host}: {url!r}")
    return f"{parts[3]}/{parts[4]}"


def collect_repository(spark: SparkSession, repo_url: str, repo_listing: DataFrame, file_listing: DataFrame,
                       bodies: DataFrame, th: Thresholds = Thresholds(), max_files_per_repo: int | None = None,
                       host: str = DEFAULT_REPO_HOST, out_dir: str = "collected_code",
                       clock: Column | None = None) -> DataFrame:
    """K2: URL -> (owner, repo) (B14, invalid URL raises), repository record
    with fallback defaults (A14), then as K1."""
    full = repository_of_url(repo_url, host)
    clock = clock if clock is not None else F.localtimestamp()
    req = spark.range(1).select(F.lit(full).alias("full_name"))
    repos = RP.lookup_repositories(req, repo_listing, clock=clock.cast("timestamp_ntz"))
    listed = RP.list_source_files(file_listing.filter(F.col("repo_full_name") == full), max_files_per_repo)
    listed = listed.withColumn("seq", F.xxhash64("repo_full_name", "path"))
    return land_files(repos, listed, bodies, th, out_dir, clock, [full])


def curate(spark: SparkSession, landing: DataFrame, contents: DataFrame, th: Thresholds = Thresholds(),
           job_id: int = 1, query: str = "", repos: DataFrame | None = None, files: DataFrame | None = None):
    """K3: re-judge the landing from stored texts (B4), count verdicts (E7),
    and import into the catalogue (H1/H2). Returns the judged landing, the job
    record and the catalogue after the import."""
    judged = filter_landing(landing, contents, th)
    C.assert_importable(judged)
    job = J.job_event(judged, job_id, query)
    repos_after, files_after, new_r, new_f = C.import_landing(judged, repos, files)
    return {"landing": judged, "job": job, "repositories": repos_after, "files": files_after,
            "new_repositories": new_r, "new_files": new_f}


def run_job(spark: SparkSession, log: str, job_id: int, query: str, work: Callable[[], DataFrame]) -> DataFrame:
    """Run `work` (it returns judged rows) as a recorded job: an in-progress event is
    appended to the job log at `log`, then a completed one with its counts or a failed
    one with the error. Returns the log; fold it with `operators.jobs.job_states`."""
    def note(seq: int, status: str, counts: DataFrame | None = None, error: str | None = None) -> None:
        row = counts if counts is not None else spark.range(1).select(
            *[F.lit(None).cast("bigint").alias(c) for c in ("files_downloaded", "suitable_files", "unsuitable_files")])
        row.select(F.lit(job_id).cast("bigint").alias("job_id"), F.lit(seq).cast("bigint").alias("seq"), F.localtimestamp().alias("ts"),
                   F.lit(query).alias("query"), F.lit(status).alias("status"), "files_downloaded", "suitable_files",
                   "unsuitable_files", F.lit(error).cast("string").alias("error")).write.mode("append").parquet(log)
    start = time.time_ns()
    note(start, JOB_IN_PROGRESS)
    try:
        note(start + 1, JOB_COMPLETED, J.job_event(work(), job_id, query))
    except Exception as e:  # noqa: BLE001 - whatever ends the job is what its record tells
        note(start + 1, JOB_FAILED, error=str(e))
    return spark.read.parquet(log)
