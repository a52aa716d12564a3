"""Job status as a stream (J2): the latest state per job, maintained by a
streaming aggregation over job events (`max_by` by sequence, partial +
state-store merge) in update mode. Each micro-batch appends only the jobs it
changed, tagged with the batch id, to a state log in the shared folder;
readers fold the log to the latest row per job. A replayed batch appends
identical rows, so the fold is unchanged — and no batch rewrites the whole
job table. The driver never holds the states.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.jobs import job_states
from quarry.schema import JOB_EVENT_SCHEMA
from quarry.session import scratch_path

EVENT_COLS = ["job_id", "seq", "ts", "query", "status", "files_downloaded", "error"]


def run_job_status_stream(spark: SparkSession, events_dir: str, out_dir: str, checkpoint: str):
    """Process all job-event files not yet seen (available-now); append the
    changed job states of each micro-batch to the state log under `out_dir`."""
    schema = JOB_EVENT_SCHEMA
    stream = spark.readStream.schema(schema).parquet(events_dir)
    states = job_states(stream)
    q = (states.writeStream.outputMode("update")
         .foreachBatch(lambda df, epoch: df.withColumn("batch_id", F.lit(epoch).cast("bigint"))
                       .write.mode("append").parquet(out_dir))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def read_job_states(spark: SparkSession, out_dir: str) -> DataFrame:
    """Latest state per job from the state log (map-side combined fold)."""
    log = spark.read.parquet(out_dir)
    cols = [c for c in log.columns if c not in ("id", "batch_id")]
    latest = log.groupBy("id").agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("s"))
    return latest.select("id", "s.*")


def replay_job_events(spark: SparkSession, batches: list[DataFrame], root: str | None = None) -> DataFrame:
    """Land event batches one after another, resuming the stream after each."""
    root = root or scratch_path(spark, f"jobs-{uuid.uuid4().hex}")
    for i, b in enumerate(batches):
        cols = [F.col(f.name).cast(f.dataType) if f.name in b.columns else F.lit(None).cast(f.dataType).alias(f.name)
                for f in JOB_EVENT_SCHEMA.fields]
        b.select(*cols).write.mode("overwrite").parquet(f"{root}/events/b{i:05d}")
        run_job_status_stream(spark, f"{root}/events/*", f"{root}/states", f"{root}/checkpoint")
    return read_job_states(spark, f"{root}/states")
