"""Text search by postings (B7, G1): which files and repositories hold which three-letter runs.

Below the catalogue's root:

  file_grams/   (gram, id)          runs of GRAM letters of a file's name and path, in lower case
  repo_grams/   (gram, full_name)   those of a repository's name and full name

Both are written in order of (gram, key), cut by range into files, so a very common run spreads over many files and the
bounds kept in the files' footers let a search read only the row groups of its runs. A batch of new rows is appended.

A search takes the runs of the query's stretches between wildcards, looks up how common they are, joins the postings of
the RAREST and has thereby all rows that can match and some that do not; these go through the same LIKE
as a scan. A query without a stretch of GRAM letters has no runs and is answered by the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.search import search
from quarry.sources.landing import path_exists

GRAM = 3
RAREST = 3                 # postings that a search joins


def grams(*texts: Column) -> Column:
    """The distinct runs of GRAM characters of the lower-cased texts."""
    def of(text: Column) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        return F.when(F.length(low) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(low) - GRAM + 1), lambda i: F.substring(low, i, F.lit(GRAM)))) \
            .otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*map(of, texts)))


def append_postings(files: DataFrame, repos: DataFrame, root: str) -> None:
    """Add the postings of new `files` (id, name, path) and `repos` (full_name, name)."""
    for rows, key, texts, name in ((files, "id", ("name", "path"), "file_grams"), (repos, "full_name", ("name", "full_name"), "repo_grams")):
        rows.select(F.explode(grams(*map(F.col, texts))).alias("gram"), key).repartitionByRange("gram", key) \
            .sortWithinPartitions("gram", key).write.mode("append").parquet(f"{root}/{name}")


def query_grams(spark: SparkSession, query: str) -> list[str]:
    """The runs that every match of a query holds. '%' and '_' are wildcards."""
    # letters beyond ASCII are put in lower case by the engine that compares them
    low = query.lower() if query.isascii() else spark.range(1).select(F.lower(F.lit(query))).first()[0]
    return sorted({part[i:i + GRAM] for part in re.split("[%_]", low) for i in range(len(part) - GRAM + 1)})


def _holding(spark: SparkSession, path: str, wanted: list[str], key: str) -> DataFrame:
    """The keys whose texts hold the rarest of the wanted runs."""
    postings = spark.read.parquet(path).filter(F.col("gram").isin(wanted))
    count = {r["gram"]: r["n"] for r in postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    rarest = sorted(wanted, key=lambda g: (count.get(g, 0), g))[:RAREST]
    # repeated postings of one key count once
    return postings.filter(F.col("gram").isin(rarest)).groupBy(key).agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(rarest)).select(key)


def candidates(spark: SparkSession, root: str, files: DataFrame, query: str) -> DataFrame:
    """The files that can match `query`: all of `files` where it has no runs or no postings are kept."""
    wanted = query_grams(spark, query)
    if not wanted or not path_exists(spark, f"{root}/file_grams"):
        return files
    own = _holding(spark, f"{root}/file_grams", wanted, "id")
    theirs = _holding(spark, f"{root}/repo_grams", wanted, "full_name").withColumnRenamed("full_name", "repo_full_name")
    by_repo = files.join(theirs, "repo_full_name", "left_semi").join(own, "id", "left_anti")
    return files.join(own, "id", "left_semi").unionByName(by_repo)


def search_postings(spark: SparkSession, root: str, files: DataFrame, repos: DataFrame, links: DataFrame | None = None,
                    query: str | None = None, **how) -> DataFrame:
    """`search.search` over the candidates of its text query."""
    return search(candidates(spark, root, files, query) if query else files, repos, links, query=query, **how)
