"""Catalogue import and maintenance.

Identity is the natural key: repositories by `full_name`, files by
`(repo_full_name, path)`. Surrogate ids are `xxhash64` of the key (no global
sequence, so nothing funnels through one task) unless the landing carries
its own `file_id`.

First row wins per key (insert-if-absent). The dedup is an aggregation —
`min(struct(seq, row))` — so Spark combines map-side before the shuffle and a
key holding a third of all rows costs one small partial per map task, not a
sort of the hot group in one task (which `row_number()` would need).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import parse_iso

REPO_COLS = ["name", "full_name", "url", "stars", "license"]
FILE_COLS = ["id", "repo_id", "repo_full_name", "name", "path", "url", "local_path", "quality_score",
             "code_lines", "is_suitable", "unsuitable_reason", "complexity_avg", "complexity_max",
             "function_count", "downloaded_at"]
FILE_REQUIRED = ["file_name", "file_path", "file_url", "local_path"]
MAX_SEQ = (1 << 63) - 1          # order of rows that carry none


def repo_id(full_name: Column) -> Column:
    return F.xxhash64(full_name)


def file_key_id(full_name: Column, path: Column) -> Column:
    return F.xxhash64(full_name, path)


def first_wins(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Keep the earliest row of every key, via a partial aggregate.

    Earliest by `order`, rows without it last; then by `arrival` (the place in
    the landing files) where the frame has it; then by the row's own values, so
    nulls and ties have one defined winner."""
    rank = [F.coalesce(F.col(order), F.lit(MAX_SEQ)).alias("_seq")]
    if "arrival" in df.columns:
        rank.append(F.col("arrival").alias("_arrival"))
    payload = [c for c in df.columns if c not in (*keys, "arrival")]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*rank, F.struct(*payload).alias("row"))).alias("_first"))
    return picked.select(*keys, "_first.row.*")


def with_repo_key(landing: DataFrame) -> DataFrame:
    """Only rows naming a repository take part in an import."""
    return landing.filter(F.col("repo_full_name").isNotNull() & (F.col("repo_full_name") != ""))


def _order_columns(landing: DataFrame) -> list[Column]:
    """What orders landing rows: `seq` (null where the landing has none) and `arrival`."""
    seq = F.col("seq") if "seq" in landing.columns else F.lit(None)
    return [seq.cast("bigint").alias("seq")] + ([F.col("arrival")] if "arrival" in landing.columns else [])


def landing_repos(landing: DataFrame, added_at: Column | None = None) -> DataFrame:
    """Candidate repository rows of a landing batch, first row per full_name."""
    rows = with_repo_key(landing).select(
        F.col("repo_full_name").alias("full_name"), F.col("repo_name").alias("name"),
        F.col("repo_url").alias("url"), F.coalesce(F.col("repo_stars"), F.lit(0)).cast("bigint").alias("stars"),
        F.col("repo_license").alias("license"), *_order_columns(landing))
    out = first_wins(rows, ["full_name"]).withColumn("id", repo_id(F.col("full_name")))
    if added_at is not None:
        out = out.withColumn("added_at", added_at)
    return out


def invalid_repo_rows(landing: DataFrame) -> DataFrame:
    """Repositories whose first landing row lacks name or url: such a batch
    must be rejected as a whole before anything is written."""
    reps = landing_repos(landing)
    return reps.filter(F.col("name").isNull() | F.col("url").isNull())


def assert_importable(landing: DataFrame) -> None:
    """Reject a whole landing batch, before anything is written, when a
    repository's first row lacks name or url (the original aborts the whole
    import then). Names the first such repository; one row comes back."""
    raise_if_unnamed(invalid_repo_rows(landing).agg(F.min("full_name").alias("full_name")).first()["full_name"])


def raise_if_unnamed(full_name: str | None) -> None:
    if full_name is not None:
        raise ValueError(f"landing batch rejected: repository {full_name!r} has no name or url")


def landing_files(landing: DataFrame, clock: Column | None = None) -> DataFrame:
    """Candidate file rows: key present, required columns non-null, first row
    per (repo_full_name, path); complexity struct flattened; verdict as boolean."""
    rows = with_repo_key(landing).dropna(subset=FILE_REQUIRED)
    cx = F.col("complexity")
    parsed = parse_iso(F.col("downloaded_at"))
    if clock is not None:
        parsed = F.coalesce(parsed, clock)
    fid = F.col("file_id") if "file_id" in landing.columns else file_key_id(F.col("repo_full_name"), F.col("file_path"))
    sel = rows.select(
        "repo_full_name", F.col("file_path").alias("path"), fid.cast("bigint").alias("id"),
        F.col("file_name").alias("name"), F.col("file_url").alias("url"), "local_path",
        F.col("quality_score").cast("double").alias("quality_score"),
        F.col("code_lines").cast("bigint").alias("code_lines"),
        F.coalesce(F.col("is_suitable"), F.lit(False)).alias("is_suitable"),
        "unsuitable_reason",
        cx["avg_complexity"].cast("double").alias("complexity_avg"),
        cx["max_complexity"].cast("bigint").alias("complexity_max"),
        cx["function_count"].cast("bigint").alias("function_count"),
        parsed.alias("downloaded_at"), *_order_columns(landing))
    out = first_wins(sel, ["repo_full_name", "path"])
    return out.withColumn("repo_id", repo_id(F.col("repo_full_name"))).select(*FILE_COLS, "seq")


def new_rows(candidates: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose key is not yet present. Nothing is hinted: adaptive
    execution turns the join into a broadcast join when it has measured a small
    side. `existing` is the catalogue's key columns, pruned by the caller to the
    buckets that the batch touches (see `streaming.ingest`)."""
    return candidates.join(existing.select(*keys), keys, "left_anti")


def import_landing(landing: DataFrame, repos: DataFrame | None = None, files: DataFrame | None = None,
                   clock: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """H1 + H2: insert-if-absent of a landing batch into the catalogue.

    Returns (repos_after, files_after, new_repos, new_files); E10's counts are
    the row counts of the two `new_*` frames.
    """
    cand_r = landing_repos(landing, clock)
    cand_f = landing_files(landing, clock)
    if repos is None:
        new_r, repos_after = cand_r, cand_r
    else:
        new_r = new_rows(cand_r, repos, ["full_name"])
        repos_after = repos.unionByName(new_r, allowMissingColumns=True)
    if files is None:
        new_f, files_after = cand_f, cand_f
    else:
        new_f = new_rows(cand_f, files, ["repo_full_name", "path"])
        files_after = files.unionByName(new_f, allowMissingColumns=True)
    return repos_after, files_after, new_r, new_f


def import_counts(new_repos: DataFrame, new_files: DataFrame) -> DataFrame:
    """One row with the numbers of newly inserted repositories and files."""
    tagged = new_repos.select(F.lit("r").alias("t")).unionByName(new_files.select(F.lit("f").alias("t")))
    return tagged.agg(F.count_if(F.col("t") == "r").cast("bigint").alias("new_repositories"),
                      F.count_if(F.col("t") == "f").cast("bigint").alias("new_files"))


def files_with_repos(files: DataFrame, repos: DataFrame) -> DataFrame:
    """Files joined to their repository by its full name (inner). Not hinted: AQE turns it
    into a broadcast join when the measured repository side is small."""
    r = repos.select(F.col("full_name").alias("repo_full_name"), F.col("name").alias("repo_name"),
                     F.col("url").alias("repo_url"), F.col("stars").alias("repo_stars"),
                     F.col("license").alias("repo_license"))
    return files.join(r, "repo_full_name", "inner")


def ids_for_keys(keys: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_full_name, path) -> file id."""
    return keys.join(files.select("repo_full_name", "path", "id"), ["repo_full_name", "path"], "inner")


def delete_files(file_ids: DataFrame, files: DataFrame, file_tags: DataFrame,
                 contents: DataFrame | None = None):
    """H7/H8: tombstone ids -> files, tag links (and contents) without them,
    plus a per-id status ('deleted' / 'not_found'). Repositories and tags stay."""
    ids = file_ids.select(F.col("id").cast("bigint").alias("id")).distinct()
    status = ids.join(files.select("id").withColumn("_hit", F.lit(True)), "id", "left") \
        .select("id", F.when(F.col("_hit"), F.lit("deleted")).otherwise(F.lit("not_found")).alias("status"))
    files_after = files.join(ids, "id", "left_anti")
    # only links of ids that exist as files are removed, as the original deletes after the lookup
    hit = status.filter(F.col("status") == "deleted").select(F.col("id").alias("file_id"))
    tags_after = file_tags.join(hit, "file_id", "left_anti")
    out = {"files": files_after, "file_tags": tags_after, "status": status}
    if contents is not None:
        out["contents"] = contents.join(hit.withColumnRenamed("file_id", "id"), "id", "left_anti")
    return out


def update_status(contents: DataFrame, updates: DataFrame) -> DataFrame:
    """H9 per-id result: 'updated' for ids in the catalogue, 'not_found' otherwise."""
    ids = updates.select("id").distinct()
    hit = contents.select("id").distinct().withColumn("_hit", F.lit(True))
    return ids.join(hit, "id", "left").select(
        "id", F.when(F.col("_hit"), F.lit("updated")).otherwise(F.lit("not_found")).alias("status"))


def replace_contents(contents: DataFrame, updates: DataFrame) -> DataFrame:
    """H9: last update per id (by seq) replaces the stored text; other rows stay.
    Signals are not recomputed here (they go stale, as in the original) —
    rescore the changed ids with `operators.suitability` when wanted."""
    latest = updates.groupBy("id").agg(F.max_by("content", F.struct("seq", "content")).alias("_new"))
    merged = contents.join(latest, "id", "left")
    return merged.select("id", F.coalesce(F.col("_new"), F.col("content")).alias("content"),
                         F.col("_new").isNotNull().alias("changed"))
