"""The job log.  Batch functions fold it; stream functions keep the same answer up to date.

The checkpoint of a stream holds what was read and what is pending, so a job
that was running when a worker died is read again, not stranded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_hash

#: A job's states in the order in which they can follow each other.
STATE_RANK = {"queued": 0, "running": 1, "completed": 2, "completed_with_warnings": 2, "failed": 2}


#: States that nothing follows.
TERMINAL = tuple(s for s, r in STATE_RANK.items() if r == max(STATE_RANK.values()))


def can_follow(before: Column, after: Column) -> Column:
    """Whether a job in a state (null: none yet) can be written in another: queued first, a repeat, one step on, or failed at once."""
    rank = lambda c: F.coalesce(*(F.when(c == s, F.lit(r)) for s, r in STATE_RANK.items()))
    first = before.isNull() & (after == "queued")
    return F.coalesce(first | (before == after) | (~before.isin(*TERMINAL) & ((rank(after) == rank(before) + 1) | (after == "failed"))), F.lit(False))


def transitions(events: DataFrame, key: str, order: list[str], state: str = "state") -> DataFrame:
    """events with ``previous``, the state of the job's write before, and ``valid``; a job's writes are few."""
    from pyspark.sql import Window

    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("previous", before).withColumn("valid", can_follow(F.col("previous"), F.col(state)))


def overdue(jobs: DataFrame, now: Column, timeout_seconds: float, started: str = "started_at", state: str = "state") -> DataFrame:
    """Jobs (latest states) that are not over and began longer ago than the timeout; one without a start is not overdue."""
    late = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(started).cast("timestamp")) >= int(timeout_seconds * 1e6)
    return jobs.where(~F.col(state).isin(*TERMINAL) & late)


def find(jobs: DataFrame, **by: str) -> DataFrame:
    """The job with the least ``job_id`` among those that match: by idempotency_key, fingerprint, document_id, or any columns."""
    out = jobs
    for column, value in by.items():
        out = out.where(F.col(column) == F.lit(value))
    return out.orderBy("job_id").limit(1)


def fingerprint(checksum: Column, configuration: Column, mode: Column, key: Column) -> Column:
    """Identity of a submission."""
    return stable_hash({"source_checksum": (checksum, "string"), "configuration_hash": (configuration, "string"), "mode": (mode, "string"), "idempotency_key": (key, "string")})


def job_id(print_: Column) -> Column:
    return F.concat(F.lit("job-"), F.substring(print_, 1, 24))


def progress(done: Column, total: Column) -> Column:
    """Percent from 1 to 99 while pages are processed."""
    return F.least(F.lit(99.0), F.greatest(F.lit(1.0), 5 + done / F.greatest(total, F.lit(1)) * 90))


def submissions(requests: DataFrame, order: str = "seq") -> DataFrame:
    """requests with ``outcome``: accepted, replay or conflict.

    A key's first request decides what it stands for; the same fingerprint
    again is a replay, another one a conflict.  Two aggregations and joins on
    keys; no global order.
    """
    by_key = requests.where("idempotency_key is not null").groupBy("idempotency_key").agg(F.min_by("fingerprint", F.struct(order)).alias("_owner"))
    out = requests.join(by_key, "idempotency_key", "left")
    conflict = F.col("_owner").isNotNull() & (F.col("_owner") != F.col("fingerprint"))
    out = out.withColumn("_conflict", conflict)
    firsts = out.where(~F.col("_conflict")).groupBy("fingerprint").agg(F.min(order).alias("_first"))
    out = out.join(firsts, "fingerprint", "left")
    return out.withColumn("outcome", F.when(F.col("_conflict"), "conflict").when(F.col(order) == F.col("_first"), "accepted").otherwise("replay")).drop("_owner", "_conflict", "_first")


def latest(events: DataFrame, key: str, order: list[str], state: list[str]) -> DataFrame:
    """The last write of each key, and how many there were."""
    last = F.max_by(F.struct(*state), F.struct(*order)).alias("_s")
    return events.groupBy(key).agg(last, F.count(F.lit(1)).alias("events")).select(key, *(F.col(f"_s.{c}").alias(c) for c in state), "events")


def _timed(df: DataFrame, time: str) -> DataFrame:
    """Watermarks want a time with a zone; one without is taken in the session's."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def stream_submissions(requests: DataFrame, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """First request of each fingerprint within the watermark; replays are dropped."""
    return _timed(requests, time).withWatermark(time, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def stream_latest(events: DataFrame, key: str, order: str, state: list[str]) -> DataFrame:
    """Latest state per key; write it in update mode."""
    last = F.max_by(F.struct(*state), F.col(order)).alias("_s")
    return events.groupBy(key).agg(last, F.count(F.lit(1)).alias("events")).select(key, *(F.col(f"_s.{c}").alias(c) for c in state), "events")


def stream_counts(events: DataFrame, window: str, delay: str = "10 minutes", time: str = "ts", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counters and summaries of each window, final once the watermark has passed it."""
    v = F.col("value")
    by = _timed(events, time).withWatermark(time, delay).groupBy(F.window(time, window), *keys)
    return by.agg(F.count(F.lit(1)).alias("count"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"))
