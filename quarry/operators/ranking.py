"""Position of each row within its group, without one task per group.

`row_number()` over a window partitioned by the group sends a whole group to
one task; a group holding a third of all rows then makes one straggler task.
Here the (group, order) keys are range-partitioned — a hot group is cut
across many partitions — and numbered locally; a small table of
per-(partition, group) counts gives each piece its offset (prefix sum over
the partitions the group spans). The small table has at most
partitions + groups rows.

Range bounds come from sampling that Spark seeds per RDD, so two
evaluations of the same range shuffle may cut differently. The numbered keys
are therefore written once as Parquet in the shared checkpoint folder and both
the counts and the positions are read from that one copy — which also cuts the
lineage, so a lost executor recomputes nothing upstream.

`order` must be unique within a group (e.g. an event sequence number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.tables import stored

_LOW_BITS = (1 << 33) - 1


def rank_within_group(df: DataFrame, group: str, order, partitions: int | None = None) -> DataFrame:
    """(group, *order, step, total): 1-based position by `order` (a column
    name or a list of names, unique within the group) within `group`, and the
    group's row count."""
    spark = df.sparkSession
    order = [order] if isinstance(order, str) else list(order)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = (df.select(group, *order)
              .repartitionByRange(n, group, *order)
              .sortWithinPartitions(group, *order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_idx", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))))
    keys = stored(keys, "rank")
    pieces = keys.groupBy("_pid", group).agg(F.min("_idx").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group).orderBy("_pid")
    offsets = pieces.select(
        "_pid", group, "_first",
        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(group)).alias("total"))
    out = keys.join(offsets, ["_pid", group], "inner")
    step = F.coalesce(F.col("_before"), F.lit(0)) + (F.col("_idx") - F.col("_first")) + 1
    return out.select(group, *order, step.cast("bigint").alias("step"), F.col("total").cast("bigint").alias("total"))


TOP_SALTS = 64


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank", salts: int = TOP_SALTS) -> DataFrame:
    """The first `k` rows of each group by `order`, with their position as `name`.

    Up to spark.sql.optimizer.windowGroupLimitThreshold Spark keeps k rows per group and map task before it
    shuffles. Beyond, a plain window would sort a whole group in one task; here the rows of a group are dealt
    by a hash of all their columns into `salts` parts, each part keeps its first k, and only these are ranked together: a task then
    sorts its share of the group or salts * k rows. The rows are the same either way; equal rows fall into one part
    and count each for itself."""
    whole = Window.partitionBy(*group).orderBy(*order)
    if k > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        part = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
        df = df.withColumn(name, F.row_number().over(Window.partitionBy(*group, part).orderBy(*order))).filter(F.col(name) <= k).drop(name)
    return df.withColumn(name, F.row_number().over(whole)).filter(F.col(name) <= k)
