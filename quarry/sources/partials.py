"""Statistics of a growing catalogue from partial sums.

Below the catalogue's root:

  file_stats/   (repo_full_name, *SUMS, version)   what changed per repository since the version before
  repo_stats/   (license, repositories, version)   new repositories per licence

`refresh` reads only rows that were imported, and tombstones that were written, after the last version it
has summed, and appends their sums; a deleted file's figures are taken away. It is the one place
that reads `files`, and doing it again adds nothing, so an ingest that died half-way needs no care. Readers fold the sums:
counts and sums of whole numbers, from which averages and histogram are exact whatever the number of batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.signals import round2
from quarry.functions.text import or_unknown
from quarry.operators.stats import N_BINS, hundredths, score_bin
from quarry.schema import TOP_LIST_LIMIT
from quarry.sources.landing import path_exists

BINS = [f"q{i}" for i in range(N_BINS)]
SUMS = ["files", "suitable", "score_h", "score_n", "lines_sum", "lines_n", *BINS]


def _figures() -> list[Column]:
    """What one file adds to SUMS."""
    s, lines = F.col("quality_score"), F.col("code_lines").cast("bigint")
    one = lambda c: F.when(c, 1).otherwise(0).cast("bigint")
    return [F.lit(1).cast("bigint").alias("files"), one(F.coalesce("is_suitable", F.lit(False))).alias("suitable"),
            F.coalesce(hundredths(s), F.lit(0).cast("bigint")).alias("score_h"), one(s.isNotNull()).alias("score_n"),
            F.coalesce(lines, F.lit(0).cast("bigint")).alias("lines_sum"), one(lines.isNotNull()).alias("lines_n"),
            *[one(s.isNotNull() & (score_bin(s) == i)).alias(b) for i, b in enumerate(BINS)]]


def _latest(df: DataFrame) -> int:
    v = df.agg(F.max("version")).first()[0]
    return -1 if v is None else v


def _after(rows: DataFrame, last: int, now: int) -> DataFrame:
    return rows.filter((F.col("version") > last) & (F.col("version") <= now))


def refresh(spark: SparkSession, root: str) -> int:
    """Sum what came since the last refresh; returns the version that the sums now stand for."""
    stats, repo_stats = f"{root}/file_stats", f"{root}/repo_stats"
    files = spark.read.parquet(f"{root}/files")
    gone = spark.read.parquet(f"{root}/tombstones") if path_exists(spark, f"{root}/tombstones") else None
    last = _latest(spark.read.parquet(stats)) if path_exists(spark, stats) else -1
    now = max(_latest(files), -1 if gone is None else _latest(gone))
    if now <= last:
        return last
    change = _after(files, last, now).select("repo_full_name", *_figures())
    if gone is not None:
        # a row ends with the first tombstone that is not older
        hit = files.join(_after(gone, last, now).select("id").distinct(), "id", "left_semi")
        ends = hit.join(gone.select("id", F.col("version").alias("ended")), "id").filter(F.col("ended") >= F.col("version")) \
            .groupBy("id", "repo_full_name", "version", "quality_score", "code_lines", "is_suitable").agg(F.min("ended").alias("ended"))
        removed = ends.filter((F.col("ended") > last) & (F.col("ended") <= now)).select("repo_full_name", *_figures())
        change = change.unionByName(removed.select("repo_full_name", *[(-F.col(c)).alias(c) for c in SUMS]))
    at = F.lit(now).cast("bigint").alias("version")
    repos = _after(spark.read.parquet(f"{root}/repositories"), last, now)
    repos.groupBy(or_unknown(F.col("license")).alias("license")).agg(F.count(F.lit(1)).alias("repositories")).select("license", "repositories", at) \
        .write.mode("append").parquet(repo_stats)
    # the files' sums are written last: their version says what is done
    change.groupBy("repo_full_name").agg(*[F.sum(c).alias(c) for c in SUMS]).select("repo_full_name", *SUMS, at) \
        .write.mode("append").parquet(stats)
    return now


def per_repository(spark: SparkSession, root: str) -> DataFrame:
    """(repo_full_name, *SUMS) of the repositories that have files now."""
    return spark.read.parquet(f"{root}/file_stats").groupBy("repo_full_name").agg(*[F.sum(c).alias(c) for c in SUMS]).filter("files > 0")


def licences(spark: SparkSession, root: str) -> DataFrame:
    """(license, count). Sums of a refresh that was cut off count once: the files' sums tell which are done."""
    done = spark.read.parquet(f"{root}/file_stats").select("version").distinct()
    kept = spark.read.parquet(f"{root}/repo_stats").join(done, "version", "left_semi")
    once = kept.groupBy("version", "license").agg(F.max("repositories").alias("repositories"))
    return once.groupBy("license").agg(F.sum("repositories").alias("count"))


def _average(total: str, n: str, scale: float, rounded: bool) -> Column:
    mean = F.sum(total) / F.sum(n) / F.lit(scale)
    return F.coalesce(round2(mean) if rounded else mean, F.lit(0.0))


def scalars(spark: SparkSession, root: str, rounded: bool = False) -> DataFrame:
    """E1, E2, E5, E12 in one row: counts, averages and the histogram's bins."""
    count = licences(spark, root).agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("repository_count"))
    zero = lambda c, name: F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(name)
    figures = spark.read.parquet(f"{root}/file_stats").agg(
        zero("files", "file_count"), zero("suitable", "suitable_file_count"), _average("score_h", "score_n", 100.0, rounded).alias("average_quality_score"),
        _average("lines_sum", "lines_n", 1.0, rounded).alias("average_code_lines"), *[zero(b, b) for b in BINS])
    # two frames of one row each
    return figures.withColumn("_one", F.lit(1)).join(F.broadcast(count.withColumn("_one", F.lit(1))), "_one").drop("_one")


def top_repositories(spark: SparkSession, root: str, n: int = TOP_LIST_LIMIT) -> DataFrame:
    """The repositories with most files (tie: name)."""
    return per_repository(spark, root).select(F.col("repo_full_name").alias("full_name"), F.col("files").alias("file_count")) \
        .orderBy(F.desc("file_count"), F.asc("full_name")).limit(n)
