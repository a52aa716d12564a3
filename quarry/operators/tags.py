"""Tag algebra over an append-only operation log.

The log holds (file_id, tag, action, seq). The current link set is the fold
"last action per (file, tag) is 'add'" — a `max_by` aggregate, combined
map-side, so a file or tag with a huge share of the log is still cheap.
Tags are never garbage-collected: the tag table is every tag ever added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.schema import TAG_OPS_SCHEMA

ACTIONS = ("add", "remove")


def tag_ops(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Build a log from (file_id, tag, action, seq) tuples (tests / small batches)."""
    return spark.createDataFrame(rows, TAG_OPS_SCHEMA)


def validate_action(action: str) -> str:
    """H5: only add / remove are operations."""
    if action not in ACTIONS:
        raise ValueError(f"invalid tag action: {action!r}")
    return action


def batch_ops(file_ids: DataFrame, tag: str, action: str, seq_base: int, id_col: str = "id") -> DataFrame:
    """H6: one operation per id of `file_ids` (ids x one tag). All carry
    `seq_base`: a (file, tag) pair occurs once in a batch, so nothing needs
    ordering within it, and ids of any size are safe."""
    validate_action(action)
    ids = file_ids.select(F.col(id_col).cast("bigint").alias("file_id")).distinct()
    return ids.select("file_id", F.lit(tag).alias("tag"), F.lit(action).alias("action"),
                      F.lit(seq_base).cast("bigint").alias("seq"))


def fold_links(ops: DataFrame) -> DataFrame:
    """Current (file_id, tag) links: the last action per pair is 'add'; of an 'add' and a 'remove' with the
    same sequence the 'add' counts. Two maxima of numbers, so Spark uses a (partial + final) hash aggregate."""
    last = lambda add: F.max(F.when((F.col("action") == "add") == F.lit(add), F.col("seq")))
    g = ops.groupBy("file_id", "tag").agg(last(True).alias("added"), last(False).alias("removed"))
    return g.filter(F.col("added").isNotNull() & (F.col("removed").isNull() | (F.col("added") >= F.col("removed")))).select("file_id", "tag")


def tag_table(ops: DataFrame) -> DataFrame:
    """Every tag name ever added, with a hash id."""
    names = ops.filter(F.col("action") == "add").select(F.col("tag").alias("name")).distinct()
    return names.select(F.xxhash64("name").alias("id"), "name")


def batch_status(ops_before: DataFrame, batch: DataFrame) -> DataFrame:
    """Per-id result of a batch: the original always reports success; we also
    say whether the operation changed the link set."""
    before = fold_links(ops_before).withColumn("_present", F.lit(True))
    joined = batch.join(before, ["file_id", "tag"], "left")
    present = F.coalesce(F.col("_present"), F.lit(False))
    changed = F.when(F.col("action") == "add", ~present).otherwise(present)
    return joined.select("file_id", "tag", "action", F.lit(True).alias("success"), changed.alias("changed"))


def any_tag_files(files: DataFrame, links: DataFrame, tags: list[str]) -> DataFrame:
    """Files carrying at least one of `tags` (semi-join, no duplicates)."""
    hit = links.filter(F.col("tag").isin(list(tags))).select(F.col("file_id").alias("id"))
    return files.join(hit, "id", "left_semi")


def tag_lists(links: DataFrame) -> DataFrame:
    """(file_id, tags sorted) — the collected list is per file, bounded by the
    number of distinct tags on that file."""
    return links.groupBy("file_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))


def attach_tags(files: DataFrame, links: DataFrame, max_rows: int | None = None) -> DataFrame:
    """D3: add `tags` (sorted array, [] when none) to each row of `files`.

    `max_rows` is a proven bound on `files` (the limit of a search): the links
    are then first filtered by a broadcast of these ids, so that only the links of
    the rows at hand are aggregated. Without it adaptive execution chooses."""
    if max_rows is not None:
        links = links.join(F.broadcast(files.select(F.col("id").alias("file_id"))), "file_id", "left_semi")
    lists = tag_lists(links).withColumnRenamed("file_id", "id")
    return files.join(lists, "id", "left").withColumn(
        "tags", F.coalesce(F.col("tags"), F.array().cast("array<string>")))


def tag_counts(links: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Files per tag; links to unknown files count (no file join)."""
    counted = links.groupBy(F.col("tag").alias("name")).agg(F.count("file_id").cast("bigint").alias("count"))
    if tags is not None:
        counted = counted.join(tags.select("name"), "name", "inner")
    return counted


def top_tags(links: DataFrame, n: int = 10) -> DataFrame:
    """Top-n tags by file count (tie: name)."""
    return tag_counts(links).orderBy(F.desc("count"), F.asc("name")).limit(n)
