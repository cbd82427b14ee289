"""Reports over task events: stale subjects, recent events, pages, conflicts, sliding latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stale(events: DataFrame, subject: str, ts: str, quiet: str, retries: Column, most_retries: int) -> DataFrame:
    """subject, n_retries, verdict: subjects without an event within `quiet` of the newest one are requeued, or dead after too many retries."""
    last = events.groupBy(subject).agg(F.max(ts).alias("_last"), F.count_if(retries).alias("n_retries"))
    cutoff = events.agg((F.max(ts) - F.expr(f"interval {quiet}")).alias("_cutoff"))  # one row
    out = last.join(F.broadcast(cutoff)).where("_last < _cutoff")
    return out.select(subject, "n_retries", F.when(F.col("n_retries") < most_retries, "requeue").otherwise("dead").alias("verdict"))


def recent(events: DataFrame, subject: str, order: Sequence[Column], most: int = 256) -> DataFrame:
    """The last `most` events of each subject with their place, newest first."""
    w = Window.partitionBy(subject).orderBy(*order)
    return events.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Rows of page `number` (from 1) with the total. Each task keeps its first rows only, as in any sorted limit."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total))


def sliding(events: DataFrame, ts: str, value: str, failed: Column, width: str, step: str) -> DataFrame:
    """begins, n, p95 (nearest rank), failure_rate of overlapping windows."""
    w = F.window(F.col(ts).cast("timestamp"), width, step)
    p95 = F.expr(f"percentile_disc(0.95) within group (order by `{value}`)")
    out = events.groupBy(w.alias("w")).agg(F.count("*").alias("n"), p95.alias("p95"), F.round(F.count_if(failed) / F.count("*"), 6).alias("failure_rate"))
    return out.select(F.col("w.start").alias("begins"), "n", "p95", "failure_rate")


def expired(tasks: DataFrame, finished: str, ttl: str, now: Column, live: DataFrame, on: str) -> DataFrame:
    """Tasks that finished more than `ttl` ago and that nothing live refers to."""
    return tasks.where(F.col(finished) + F.expr(f"interval {ttl}") < now).join(live.select(on).distinct(), on, "left_anti")
