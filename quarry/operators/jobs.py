"""Job records as an append-only event log (J2, G4, C11, K3 summary).

A job's state is the latest event by `seq` (a maximum of structs, map-side combined);
start time is its first event; end time is set once it is completed or failed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.schema import JOB_COMPLETED, JOB_FAILED, JOB_HISTORY_LIMIT, JOB_IN_PROGRESS

FINAL = (JOB_COMPLETED, JOB_FAILED)


def job_states(events: DataFrame) -> DataFrame:
    """Latest state per job (id, start_time, query, status, files_downloaded,
    end_time, error, first_seq, last_seq, n_events)."""
    # one struct is the last event as a whole; events with the same sequence have one order by their values
    last = F.max(F.struct("seq", "ts", "status", "files_downloaded", "error"))
    g = events.groupBy("job_id").agg(
        F.min("ts").alias("start_time"), F.min(F.struct("seq", "query")).alias("first"), last.alias("last"),
        F.count(F.lit(1)).cast("bigint").alias("n_events"))
    return g.select(F.col("job_id").alias("id"), "start_time", "first.query", "last.status", "last.files_downloaded",
                    F.when(F.col("last.status").isin(*FINAL), F.col("last.ts")).alias("end_time"), "last.error",
                    F.col("first.seq").alias("first_seq"), F.col("last.seq").alias("last_seq"), "n_events")


def status_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count(F.lit(1)).cast("bigint").alias("jobs"))


def current_job(states: DataFrame) -> DataFrame:
    """The in-progress job with the latest activity (0 or 1 row)."""
    return states.filter(F.col("status") == JOB_IN_PROGRESS).orderBy(F.desc("last_seq"), F.desc("id")).limit(1)


def last_jobs(states: DataFrame, n: int = JOB_HISTORY_LIMIT) -> DataFrame:
    """The last `n` jobs in insertion order (by first event)."""
    return states.orderBy(F.desc("first_seq")).limit(n)


def progress(events: DataFrame, group: str = "job_id", order: str = "seq") -> DataFrame:
    """C11: (i+1)/total*100 of each event within its job. The position comes
    from a range-partitioned rank (see `operators.ranking`), so a job with a
    huge share of all events is spread over many tasks."""
    from quarry.operators.ranking import rank_within_group
    ranked = rank_within_group(events.select(group, order), group, order)
    return ranked.select(group, order, "step", F.col("total").cast("bigint").alias("total"),
                         (F.col("step") / F.col("total") * 100).alias("percent"))


def job_event(verdicts: DataFrame, job_id: int, query: str) -> DataFrame:
    """K3 job summary: files handled, suitable / unsuitable counts, status."""
    flag = F.coalesce(F.col("is_suitable"), F.lit(False))
    return verdicts.agg(
        F.lit(job_id).cast("bigint").alias("id"), F.lit(query).alias("query"),
        F.count(F.lit(1)).cast("bigint").alias("files_downloaded"),
        F.count_if(flag).cast("bigint").alias("suitable_files"),
        F.count_if(~flag).cast("bigint").alias("unsuitable_files"),
        F.lit(JOB_COMPLETED).alias("status"))
