"""Incremental landing ingest (J1) with scoring of what is new.

The stream is one of *files*: `readStream` lists the files of a landing directory and
`foreachBatch` reads those of each trigger with the landing reader, which sees for each file
whether it holds JSON Lines or an array and keeps malformed records. First row per key inside
the micro-batch, anti-join against the keys already in the catalogue, append. No
streaming state is kept: the catalogue itself is the state, so a replayed micro-batch (after an
executor or driver loss) inserts nothing twice — insert-if-absent makes the at-least-once
sink effectively exactly-once. The checkpoint lives in the shared checkpoint folder.

The catalogue lies in buckets of the repository key (`sources.tables`): one aggregate over the batch
lists the buckets it touches (never more values than there are buckets), finds a repository that cannot be
imported and counts records that cannot; only the key columns of those buckets are scanned. A batch that
lacks a repository's name or url is rejected before anything is written. Records that are left out go to
the catalogue's `dead_letters` with their file and the reason.

Rows carry the `version` of their import: a file that was deleted before is new again.
"""

from __future__ import annotations

import os
import time
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.operators import catalog as C
from quarry.operators.suitability import judge_landing, wanted_texts
from quarry.schema import Thresholds
from quarry.session import scratch_path
from quarry.sources.landing import CORRUPT, SEQ_SCHEMA, path_exists, reject_reason, rejected, scan_landing, whole_records
from quarry.sources.tables import (append_bucketed, catalogue_buckets, observed, observed_count, read_buckets, repo_bucket,
                                   stored, without_deleted)
from quarry.sources.texts import cached_scores

FILES_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


class Ingested(NamedTuple):
    """What a batch added: repositories, files, texts that had to be scored, and records left out."""

    repositories: int
    files: int
    scored: int = 0
    rejects: int = 0


def ingest_batch(batch: DataFrame, catalog_root: str, contents: DataFrame | None = None, th: Thresholds | None = None,
                 buckets: int | None = None, version: int | None = None) -> Ingested:
    """Apply one landing batch to the catalogue (insert-if-absent).

    With `contents` (local_path, content) the files that are new are judged first (J3): only their texts are looked up,
    and only texts without a score in the catalogue's score table are scored. A batch scanned with its
    malformed records leaves these in `dead_letters`."""
    spark = batch.sparkSession
    version = time.time_ns() if version is None else version
    n = catalogue_buckets(spark, catalog_root, buckets)
    scanned = batch if CORRUPT in batch.columns else None
    bad = Observation()
    if scanned is not None:
        batch = whole_records(batch.observe(bad, F.count_if(reject_reason().isNotNull()).alias("n")))

    # one aggregate: buckets touched, the first repository that cannot be imported; records left out are counted on the way
    unnamed = F.col("name").isNull() | F.col("url").isNull()
    seen = C.landing_repos(batch).agg(F.collect_set(repo_bucket("full_name", n)).alias("touched"),
                                      F.min(F.when(unnamed, F.col("full_name"))).alias("unnamed")).first()
    C.raise_if_unnamed(seen["unnamed"])
    rejects = observed_count(bad) if scanned is not None else 0
    if rejects:
        rejected(scanned).write.mode("append").parquet(f"{catalog_root}/dead_letters")
    if scanned is not None:
        batch = whole_records(scanned)

    repos_path, files_path = f"{catalog_root}/repositories", f"{catalog_root}/files"
    repos, files = read_buckets(spark, repos_path, seen["touched"]), read_buckets(spark, files_path, seen["touched"])
    if files is not None:
        files = without_deleted(spark, catalog_root, files)
    scored = 0
    if contents is not None:
        fresh = batch
        if files is not None:
            known = files.select("repo_full_name", F.col("path").alias("file_path"))
            fresh = batch.join(known, ["repo_full_name", "file_path"], "left_anti")
        fresh = stored(fresh, "fresh")
        signals, scored = cached_scores(wanted_texts(fresh, contents), catalog_root, th or Thresholds(), version)
        batch = stored(judge_landing(fresh, signals, th or Thresholds()), "judged")
    _, _, new_r, new_f = C.import_landing(batch, repos, files)
    stamp = F.lit(version).cast("bigint")
    counts = []
    for rows, path, repo, row in ((new_r, repos_path, "full_name", "full_name"), (new_f, files_path, "repo_full_name", "path")):
        rows, added = observed(rows.withColumn("version", stamp))
        append_bucketed(rows, path, repo, row, n)
        counts.append(observed_count(added))
    return Ingested(*counts, scored, rejects)


def dead_letters(spark: SparkSession, root: str) -> DataFrame:
    """(file, split, row, record, reason) of all records left out so far, each once however often its batch ran."""
    if not path_exists(spark, f"{root}/dead_letters"):
        return spark.createDataFrame([], "file string, split bigint, row bigint, record string, reason string")
    return spark.read.parquet(f"{root}/dead_letters").groupBy("file", "split", "row").agg(
        F.min(F.struct("record", "reason")).alias("r")).select("file", "split", "row", "r.record", "r.reason")


def landing_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The files of a landing as they arrive, without their contents."""
    reader = spark.readStream.format("binaryFile").schema(FILES_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(landing_dir).select("path", "modificationTime", "length")


def run_ingest(spark: SparkSession, landing_dir: str, catalog_root: str, checkpoint: str | None = None,
               fmt: str = "parquet", contents: DataFrame | None = None, th: Thresholds | None = None,
               available_now: bool = True, max_files_per_trigger: int | None = None, buckets: int | None = None,
               report: list[Ingested] | None = None):
    """Start (or resume) the ingest stream. With `available_now` it
    processes every landing file not yet seen and stops; returns the query. `report` gets what each batch added.

    A trigger's file names pass through the driver, which lists them for the stream in any case;
    `max_files_per_trigger` bounds them."""
    checkpoint = checkpoint or os.path.join(catalog_root, "_ingest_checkpoint")

    def apply(files: DataFrame, _epoch: int) -> None:
        paths = sorted(r["path"] for r in files.select("path").collect())
        if paths:
            done = ingest_batch(scan_landing(spark, paths, fmt), catalog_root, contents, th, buckets)
            if report is not None:
                report.append(done)
    writer = (landing_stream(spark, landing_dir, max_files_per_trigger).writeStream
              .foreachBatch(apply).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q


def replay_landing_batches(spark: SparkSession, batches: list[DataFrame], contents: DataFrame | None = None,
                           th: Thresholds | None = None, root: str | None = None, report: list[Ingested] | None = None) -> DataFrame:
    """Land each batch as a new file set and run the ingest stream after each
    one (resuming from the same checkpoint); return the catalogue files."""
    import uuid
    root = root or scratch_path(spark, f"ingest-{uuid.uuid4().hex}")
    landing_dir, catalog_root = f"{root}/landing", f"{root}/catalog"
    cols = [f.name for f in SEQ_SCHEMA.fields]
    for i, b in enumerate(batches):
        b.select(*[F.col(c) if c in b.columns else F.lit(None).cast(SEQ_SCHEMA[c].dataType).alias(c) for c in cols]) \
            .write.mode("overwrite").parquet(f"{landing_dir}/b{i:05d}")
        run_ingest(spark, f"{landing_dir}/*", catalog_root, f"{root}/checkpoint", contents=contents, th=th, report=report)
    return spark.read.parquet(f"{catalog_root}/files").drop("bucket", "version")
