"""Repository and file-listing operators.

The collection step of the original walks a code host over the network; here
the host's answers are tables (`repo_listing`, `file_listing`) and the walk
is relational: suffix filter, per-repository cap in breadth-first order,
ranked selection, defaulted lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import path_depth
from quarry.operators.ranking import top_per_group

SORT_KEYS = {"stars": "stars", "forks": "forks", "updated": "updated_at"}


def python_files(listing: DataFrame, suffix: str = ".py") -> DataFrame:
    """B1: names ending with `suffix` (case-sensitive)."""
    return listing.filter(F.col("name").endswith(suffix))


def first_files_per_repo(listing: DataFrame, max_files: int | None, repo_col: str = "repo_full_name") -> DataFrame:
    """The first `max_files` files of each repository in breadth-first
    order (depth, then path); 0 -> none, None -> all.

    The row is carried through the ranking, so duplicates count as rows of their own and a null
    repository is a group like any other. A large cap is ranked in two levels (see `ranking.top_per_group`),
    so a repository with a large share of all files is not sorted by one task.
    """
    with_depth = listing.withColumn("depth", path_depth(F.col("path")))
    if max_files is None:
        return with_depth
    if max_files <= 0:
        return with_depth.limit(0)
    return top_per_group(with_depth, [repo_col], [F.col("depth"), F.col("path")], max_files)


def list_source_files(listing: DataFrame, max_files: int | None = None, suffix: str = ".py") -> DataFrame:
    """A4: B1 then G5."""
    return first_files_per_repo(python_files(listing, suffix), max_files)


def select_repositories(listing: DataFrame, min_stars: int | None = None, license: str | None = None,
                        created_after=None, topic: str | None = None, sort: str = "stars",
                        order: str = "desc", max_results: int = 10) -> DataFrame:
    """Typed predicates instead of a remote query grammar, then the first
    `max_results` by sort key (ties: full_name). sort in {stars, forks, updated}."""
    if sort not in SORT_KEYS:
        raise ValueError(f"unknown sort key {sort!r}")
    df = listing
    if min_stars is not None:
        df = df.filter(F.col("stars") > F.lit(min_stars))
    if license is not None:
        df = df.filter(F.col("license") == F.lit(license))
    if created_after is not None:
        df = df.filter(F.col("created_at") > F.lit(created_after).cast("timestamp_ntz"))
    if topic is not None:
        df = df.filter(F.col("description").contains(topic))
    key = F.col(SORT_KEYS[sort])
    key = key.desc_nulls_last() if order == "desc" else key.asc_nulls_last()
    return df.orderBy(key, F.asc("full_name")).limit(max_results)


def lookup_repositories(requested: DataFrame, listing: DataFrame, host_url: str = "https://github.com/",
                        clock: Column | None = None) -> DataFrame:
    """Requested full names left-joined to the listing; a repository
    the listing does not know gets the fallback record (name from the key,
    host url, empty description, 0 stars / forks, no licence)."""
    req = requested.select("full_name").distinct()
    cols = ["name", "url", "description", "stars", "forks", "created_at", "updated_at", "license"]
    joined = req.join(listing.select("full_name", *cols).withColumn("_found", F.lit(True)), "full_name", "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    return joined.select(
        "full_name",
        F.when(found, F.col("name")).otherwise(F.element_at(F.split("full_name", "/"), -1)).alias("name"),
        F.when(found, F.col("url")).otherwise(F.concat(F.lit(host_url), F.col("full_name"))).alias("url"),
        F.when(found, F.col("description")).otherwise(F.lit("")).alias("description"),
        F.when(found, F.col("stars")).otherwise(F.lit(0)).cast("bigint").alias("stars"),
        F.when(found, F.col("forks")).otherwise(F.lit(0)).cast("bigint").alias("forks"),
        F.when(found, F.col("created_at")).otherwise(clock).alias("created_at"),
        F.when(found, F.col("updated_at")).otherwise(clock).alias("updated_at"),
        F.when(found, F.col("license")).alias("license"),
        found.alias("found"))
