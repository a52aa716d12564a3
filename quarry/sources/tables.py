"""Catalogue tables on Parquet (A8, A12) and the driver's input tables.

Tables are written as directories under a root in the shared checkpoint
folder (or a given path). Files are laid out by a hash bucket of the
repository key, so a repository's files sit together and a lookup by
repository prunes to one bucket directory.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.session import checkpoint_root, scratch_path

CATALOG_TABLES = ("repositories", "files", "tags", "file_tags", "contents", "landing")
REPO_BUCKETS = 64
BUCKET_WRITERS = 16


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet below the session's shared folder and return the table
    read back: lineage is cut, and readers prune columns and push filters."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """`df`, whose rows are counted while it is written, and where `observed_count` finds their number."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def observed_count(seen: Observation) -> int:
    """The observed `n`. A plan that adaptive execution finds to be empty loses its observed node and reports
    nothing, which is 0; a job that fails has raised before."""
    try:
        return seen.get["n"]
    except Py4JJavaError:
        return 0


_SCAN_PARTITIONS: dict[tuple, int] = {}


def scan_partitions(df: DataFrame, key) -> int:
    """Number of scan partitions of `df`, planned once per (application, key)."""
    k = (df.sparkSession.sparkContext.applicationId, key)
    if k not in _SCAN_PARTITIONS:
        _SCAN_PARTITIONS[k] = df.rdd.getNumPartitions()
    return _SCAN_PARTITIONS[k]


def spread(df: DataFrame, min_partitions: int | None = None, key=None) -> DataFrame:
    """Scan fan-out: a scan with fewer partitions than the cluster has cores
    (e.g. one file holding one row group) is spread round-robin so the per-row
    text work runs on every core. Scans that already have enough partitions —
    any large, multi-file input — are returned untouched (no shuffle)."""
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    n = scan_partitions(df, key) if key is not None else df.rdd.getNumPartitions()
    if n >= want:
        return df
    return df.repartition(want)


def repo_bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def catalogue_buckets(spark: SparkSession, root: str, buckets: int | None = None) -> int:
    """Bucket count of the catalogue at `root`, kept beside its tables; a new one gets
    `buckets` (choose expected bytes / 1 GB) or REPO_BUCKETS."""
    from quarry.sources.landing import path_exists
    path = f"{root}/_layout"
    if not path_exists(spark, path):
        spark.range(1).select(F.lit(buckets or REPO_BUCKETS).alias("buckets")).write.json(path)
    return spark.read.schema("buckets int").json(path).first()["buckets"]


def append_bucketed(df: DataFrame, path: str, repo: str, row: str, buckets: int, mode: str = "append") -> None:
    """Write rows by bucket of the `repo` column. Within a bucket they are dealt by hash of
    the `row` column, so a repository with a large share of all files has many
    writers; adaptive execution joins small pieces again."""
    out = df.withColumn("bucket", repo_bucket(repo, buckets))
    (out.repartition(F.col("bucket"), F.pmod(F.xxhash64(F.col(row)), F.lit(BUCKET_WRITERS)))
     .write.mode(mode).partitionBy("bucket").parquet(path))


def read_buckets(spark: SparkSession, path: str, buckets: list[int]) -> DataFrame | None:
    """The rows of some buckets (a partition filter: other folders are not read); None if there is no table."""
    from quarry.sources.landing import path_exists
    if not path_exists(spark, path):
        return None
    df = spark.read.parquet(path)
    return df.filter(F.col("bucket").isin(buckets)).drop("bucket") if "bucket" in df.columns else df


def commit_deletes(ids: DataFrame, root: str, version: int) -> None:
    """H7: append tombstones (id, version) to the catalogue's log."""
    ids.select(F.col("id").cast("bigint").alias("id"), F.lit(version).cast("bigint").alias("version")) \
        .write.mode("append").parquet(f"{root}/tombstones")


def commit_contents(updates: DataFrame, root: str, version: int) -> None:
    """H9: append new texts (id, content, seq, version) to the log of content versions."""
    updates.select(F.col("id").cast("bigint").alias("id"), "content", "seq", F.lit(version).cast("bigint").alias("version")) \
        .write.mode("append").parquet(f"{root}/content_versions")


def _deleted(spark: SparkSession, root: str) -> DataFrame | None:
    """(id, _deleted): the latest tombstone of every id."""
    from quarry.sources.landing import path_exists
    if not path_exists(spark, f"{root}/tombstones"):
        return None
    return spark.read.parquet(f"{root}/tombstones").groupBy("id").agg(F.max("version").alias("_deleted"))


def without_deleted(spark: SparkSession, root: str, rows: DataFrame, id_col: str = "id") -> DataFrame:
    """`rows` less those whose id has a tombstone. Rows that carry a `version` (when they were imported) go
    only with a tombstone as late or later: what is imported after a delete stands again."""
    gone = _deleted(spark, root)
    if gone is None:
        return rows
    if "version" not in rows.columns:
        return rows.join(gone.select(F.col("id").alias(id_col)), id_col, "left_anti")
    j = rows.join(gone.withColumnRenamed("id", id_col), id_col, "left")
    return j.filter(F.col("_deleted").isNull() | (F.coalesce("version", F.lit(0)) > F.col("_deleted"))).select(*rows.columns)


def live_ops(spark: SparkSession, root: str, ops: DataFrame) -> DataFrame:
    """The tag operations that still count: those of a file from before its deletion went with it."""
    gone = _deleted(spark, root)
    if gone is None:
        return ops
    j = ops.join(gone.withColumnRenamed("id", "file_id"), "file_id", "left")
    return j.filter(F.col("_deleted").isNull() | (F.col("seq") > F.col("_deleted"))).select(*ops.columns)


def current_contents(spark: SparkSession, root: str) -> DataFrame:
    """(id, content): stored texts with their latest version, without deleted ids."""
    from quarry.sources.landing import path_exists
    stored_ = spark.read.parquet(f"{root}/contents").select("id", "content")
    if path_exists(spark, f"{root}/content_versions"):
        log = spark.read.parquet(f"{root}/content_versions")
        last = log.groupBy("id").agg(F.max_by("content", F.struct("version", "seq")).alias("_new"))
        stored_ = stored_.join(last, "id", "left").select("id", F.coalesce("_new", "content").alias("content"))
    return without_deleted(spark, root, stored_)


def write_table(df: DataFrame, path: str, partition_key: str | None = None, mode: str = "overwrite",
                buckets: int = REPO_BUCKETS) -> str:
    if partition_key is None:
        df.write.mode(mode).parquet(path)
    else:
        row = "path" if "path" in df.columns else partition_key
        append_bucketed(df, path, partition_key, row, buckets, mode)
    return path


def write_catalog(spark: SparkSession, tables: dict[str, DataFrame], root: str | None = None) -> str:
    """Write the given catalogue tables under `root` (a fresh folder in the
    shared checkpoint location by default); returns the root."""
    root = root or scratch_path(spark, f"catalog-{uuid.uuid4().hex}")
    for name, df in tables.items():
        key = {"files": "repo_full_name", "repositories": "full_name"}.get(name)
        write_table(df, f"{root}/{name}", key)
    return root


def read_catalog(spark: SparkSession, root: str, names=("repositories", "files")) -> dict[str, DataFrame]:
    """Scan catalogue tables; Catalyst prunes columns and pushes filters."""
    out = {}
    for n in names:
        df = spark.read.parquet(f"{root}/{n}")
        out[n] = df.drop("bucket") if "bucket" in df.columns else df
    return out


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], backup_dir: str | None = None,
             clock: _dt.datetime | None = None) -> tuple[str, DataFrame]:
    """Copy every catalogue table (and the landing) to `backup_<ts>` under
    the shared folder, or to `backup_dir`; returns the path and per-table row
    counts (read back from the snapshot, so the counts describe what was written)."""
    ts = (clock or _dt.datetime.now()).strftime("%Y%m%d_%H%M%S")
    root = backup_dir or f"{checkpoint_root(spark).rstrip('/')}/backup_{ts}"
    counts = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        c = spark.read.parquet(f"{root}/{name}").agg(F.count(F.lit(1)).cast("bigint").alias("rows")) \
            .select(F.lit(name).alias("table"), "rows")
        counts = c if counts is None else counts.unionByName(c)
    return root, counts
