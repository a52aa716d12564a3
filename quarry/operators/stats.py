"""Catalogue statistics.

Every figure is one hash aggregate (partial + final); scores are averaged as
exact integer hundredths so the result does not depend on summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.signals import round2
from quarry.functions.text import or_unknown
from quarry.schema import SCORE_BIN_EDGES, TOP_LIST_LIMIT

N_BINS = len(SCORE_BIN_EDGES) + 1


def hundredths(score: Column) -> Column:
    return F.round(score * 100).cast("bigint")


def exact_avg_score(score: Column) -> Column:
    """avg of 2-decimal scores via integer hundredths (nulls ignored)."""
    return F.sum(hundredths(score)) / F.count(score) / F.lit(100.0)


def score_bin(score: Column) -> Column:
    e = SCORE_BIN_EDGES
    return (F.when(score < e[0], 0).when(score < e[1], 1).when(score < e[2], 2)
            .when(score < e[3], 3).otherwise(4))


def file_figures(files: DataFrame) -> DataFrame:
    """E1 (files part) + E2 + E5 in one pass over `files`."""
    s = F.col("quality_score")
    aggs = [
        F.count(F.lit(1)).cast("bigint").alias("file_count"),
        F.count_if(F.coalesce(F.col("is_suitable"), F.lit(False))).cast("bigint").alias("suitable_file_count"),
        F.sum(hundredths(s)).alias("_score_h"), F.count(s).alias("_score_n"),
        F.sum("code_lines").alias("_lines_sum"), F.count("code_lines").alias("_lines_n"),
    ]
    b = score_bin(s)
    for i in range(N_BINS):
        aggs.append(F.count_if(s.isNotNull() & (b == i)).cast("bigint").alias(f"q{i}"))
    return files.agg(*aggs)


def averages(fig: DataFrame, rounded: bool) -> list[Column]:
    avg_q = F.col("_score_h") / F.col("_score_n") / F.lit(100.0)
    avg_l = F.col("_lines_sum") / F.col("_lines_n")
    if rounded:
        avg_q, avg_l = round2(avg_q), round2(avg_l)
    # null or 0 -> 0 (both front ends)
    return [F.coalesce(avg_q, F.lit(0.0)).alias("average_quality_score"),
            F.coalesce(avg_l, F.lit(0.0)).alias("average_code_lines")]


def _tagged(repos: DataFrame, files: DataFrame, tags: DataFrame | None) -> DataFrame:
    """One narrow row per repository / file / tag, so all catalogue figures
    come out of a single aggregate (no join between the tables)."""
    nb, nl, ns = F.lit(None).cast("boolean"), F.lit(None).cast("bigint"), F.lit(None).cast("string")
    parts = [
        repos.select(F.lit("r").alias("t"), F.col("id").alias("rid"), nb.alias("s"), nl.alias("h"),
                     nl.alias("lines"), or_unknown(F.col("license")).alias("lic")),
        files.select(F.lit("f").alias("t"), nl.alias("rid"), F.coalesce(F.col("is_suitable"), F.lit(False)).alias("s"),
                     hundredths(F.col("quality_score")).alias("h"), F.col("code_lines").cast("bigint").alias("lines"),
                     ns.alias("lic")),
    ]
    if tags is not None:
        parts.append(tags.select(F.lit("t").alias("t"), nl.alias("rid"), nb.alias("s"), nl.alias("h"),
                                 nl.alias("lines"), ns.alias("lic")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _count_aggs() -> list[Column]:
    t = F.col("t")
    return [F.count_if(t == "r").cast("bigint").alias("repository_count"),
            F.count_if(t == "f").cast("bigint").alias("file_count"),
            F.count_if((t == "f") & F.col("s")).cast("bigint").alias("suitable_file_count"),
            F.count_if(t == "t").cast("bigint").alias("tag_count")]


def table_counts(repos: DataFrame, files: DataFrame, tags: DataFrame) -> DataFrame:
    """Repositories, files, suitable files, tags."""
    return _tagged(repos, files, tags).agg(*_count_aggs())


def score_and_lines(files: DataFrame, rounded: bool = True) -> DataFrame:
    """Average score and code lines (nulls ignored; null -> 0)."""
    fig = file_figures(files)
    return fig.select(*averages(fig, rounded))


def license_distribution(repos: DataFrame) -> DataFrame:
    """Repositories per licence, null and '' merged into 'Unknown'."""
    return repos.groupBy(or_unknown(F.col("license")).alias("license")) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("count"))


def repo_file_counts(files: DataFrame, repos: DataFrame) -> DataFrame:
    """Files per repository (repositories without files drop out). The
    files are counted per repository first, so only one row of each
    reaches the join."""
    per = files.groupBy(F.col("repo_full_name").alias("full_name")).agg(F.count("id").cast("bigint").alias("file_count"))
    return per.join(repos.select("full_name", "name"), "full_name", "inner")


def top_repositories(files: DataFrame, repos: DataFrame, n: int = TOP_LIST_LIMIT) -> DataFrame:
    """Top-n repositories by file count (tie: full_name)."""
    return repo_file_counts(files, repos).orderBy(F.desc("file_count"), F.asc("full_name")).limit(n) \
        .select("name", "full_name", "file_count")


def score_histogram(spark: SparkSession, files: DataFrame) -> DataFrame:
    """E5: 5 bins (<2, <4, <6, <8, rest), nulls out, empty bins present as 0.
    The counted side has at most 5 rows (one per bin), so its broadcast is
    size-bounded by construction."""
    s = F.col("quality_score")
    counted = files.filter(s.isNotNull()).groupBy(score_bin(s).alias("bin")) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    bins = spark.range(N_BINS).select(F.col("id").cast("int").alias("bin"))
    return bins.join(F.broadcast(counted), "bin", "left") \
        .select("bin", F.coalesce(F.col("count"), F.lit(0).cast("bigint")).alias("count"))


def flat_stats(flat: DataFrame, min_quality: float = 6.0) -> DataFrame:
    """E9 over the flat table: distinct repo names with null as one more group
    (as counting `SELECT DISTINCT` rows does), rows, rows with score >=
    min_quality, raw average score."""
    s = F.col("quality_score")
    null_group = F.max(F.when(F.col("repo_name").isNull(), 1).otherwise(0))
    return flat.agg((F.count_distinct("repo_name") + null_group).cast("bigint").alias("total_repos"),
                    F.count(F.lit(1)).cast("bigint").alias("total_files"),
                    F.count_if(s >= F.lit(min_quality)).cast("bigint").alias("suitable_files"),
                    (F.sum(hundredths(s)) / F.count(s) / F.lit(100.0)).alias("avg_quality"))


def statistics(repos: DataFrame, files: DataFrame, tags: DataFrame) -> DataFrame:
    """One row — counts, rounded averages, licence distribution map.
    Licences are pre-counted per (t, lic) group, so the final map collects at
    most one entry per distinct licence."""
    pre = _tagged(repos, files, tags).groupBy("t", "lic").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("s"), 1).otherwise(0)).alias("ns"),
        F.sum("h").alias("h"), F.count("h").alias("hn"),
        F.sum("lines").alias("ls"), F.count("lines").alias("ln"))
    t = F.col("t")
    avg_q = round2(F.sum(F.when(t == "f", F.col("h"))) / F.sum(F.when(t == "f", F.col("hn"))) / F.lit(100.0))
    avg_l = round2(F.sum(F.when(t == "f", F.col("ls"))) / F.sum(F.when(t == "f", F.col("ln"))))
    return pre.agg(
        F.sum(F.when(t == "r", F.col("n")).otherwise(0)).cast("bigint").alias("repository_count"),
        F.sum(F.when(t == "f", F.col("n")).otherwise(0)).cast("bigint").alias("file_count"),
        F.sum(F.when(t == "f", F.col("ns")).otherwise(0)).cast("bigint").alias("suitable_file_count"),
        F.sum(F.when(t == "t", F.col("n")).otherwise(0)).cast("bigint").alias("tag_count"),
        F.coalesce(avg_q, F.lit(0.0)).alias("average_quality_score"),
        F.coalesce(avg_l, F.lit(0.0)).alias("average_code_lines"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.when(t == "r", F.struct(F.col("lic").alias("license"), F.col("n").cast("bigint").alias("count"))))))
        .alias("license_distribution"))


def dashboard(spark: SparkSession, repos: DataFrame, files: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """The dashboard bundle as named frames (scalars incl. the 5 bins,
    top repositories, histogram, top tags)."""
    from quarry.operators.tags import top_tags
    u = _tagged(repos, files, None)
    t, h = F.col("t"), F.col("h")
    b = score_bin(h / F.lit(100.0))
    scalars = u.agg(
        F.count_distinct(F.when(t == "r", F.col("rid"))).cast("bigint").alias("repository_count"),
        F.count_if(t == "f").cast("bigint").alias("file_count"),
        F.count_if((t == "f") & F.col("s")).cast("bigint").alias("suitable_file_count"),
        F.coalesce(F.sum(h) / F.count(h) / F.lit(100.0), F.lit(0.0)).alias("average_quality_score"),
        *[F.count_if(h.isNotNull() & (b == i)).cast("bigint").alias(f"q{i}") for i in range(N_BINS)])
    return {"scalars": scalars, "repositories": top_repositories(files, repos),
            "quality_distribution": score_histogram(spark, files), "tags": top_tags(links)}
