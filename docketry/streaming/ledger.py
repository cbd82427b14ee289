"""Structured Streaming over event tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from docketry.sources.shared import shared_folder


#: Files that one micro-batch takes up at most.
FILES_PER_TRIGGER = 64


def _shared(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{shared_folder(spark, 'stream')}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, path: str, files: int = FILES_PER_TRIGGER) -> DataFrame:
    """A stream of the table at `path`, which is a folder of part files or one file."""
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files)
    folder, _, name = path.rstrip("/").rpartition("/")
    if any(f.rpartition("/")[2] == name and f.rpartition("/")[0].endswith(folder) for f in table.inputFiles()):
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def hourly_counts(spark: SparkSession, path: str, late: str = "40 days", files: int = FILES_PER_TRIGGER) -> DataFrame:
    """Counts and sums by type and hour of a stream of event files, each event id once.

    Every micro-batch replaces the updated groups in a table below spark.checkpoint.dir; the last
    batch's rows of each group are the result.
    """
    out = _shared(spark)
    timed = event_stream(spark, path, files).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    counts = timed.groupBy("event_type", F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("event_type", F.col("w.start").alias("hour"), "n", "total").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    last = rows.groupBy("event_type", "hour").agg(F.max_by(F.struct("n", "total"), "batch").alias("v"))
    return last.select("event_type", F.col("hour").cast("string").alias("hour"), "v.n", F.round("v.total", 4).alias("total"))


def transition_breaks(
    spark: SparkSession, path: str, subject: str, stage: str, refused: Sequence[tuple[str, str]], late_days: int = 40, files: int = FILES_PER_TRIGGER
) -> DataFrame:
    """subject, event_id, before, after of steps that are refused, from a stream of event files, in the order of event times.

    State holds a subject's events that the watermark has not passed and the stage before them. An event that arrives
    late but within the watermark takes its place: the step to it and the one behind it are judged anew under a higher
    version, and the last version of each event is the result. Memory per subject is bounded by its events of
    `late_days`; `files` bounds what one micro-batch adds. State ends when the watermark has passed all its events.
    """
    out = _shared(spark)
    events = event_stream(spark, path, files)
    timed = events.select(F.col("ts").cast("timestamp").alias("at"), F.col(subject).cast("long").alias("subject"), "event_id", F.col(stage).alias("stage")).withWatermark("at", f"{late_days} days")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        version, settled, held = state.get if state.exists else (0, None, [])
        known = {event: (at, event, name, before) for at, event, name, before in map(json.loads, held)}
        for rows in batches:
            for at, event, name in zip(rows["at"], rows["event_id"], rows["stage"], strict=True):
                known.setdefault(int(event), (at.value // 1000, int(event), name, "?"))
        found, before, kept, passed = [], settled, [], state.getCurrentWatermarkMs() * 1000
        for at, event, name, judged in sorted(known.values()):
            if judged != [before]:
                found.append((key[0], event, before, name, version + 1))
            if at < passed:
                settled = name
            else:
                kept.append(json.dumps((at, event, name, [before])))
            before = name
        state.update((version + 1, settled, kept))
        last = max(at for at, *_ in known.values())
        state.setTimeoutTimestamp(last // 1000 + late_days * 86_400_000)
        if found:
            yield pd.DataFrame(found, columns=["subject", "event_id", "before", "after", "version"])

    kind = "subject long, event_id long, before string, after string, version long"
    steps = timed.groupBy("subject").applyInPandasWithState(step, kind, "version long, settled string, held array<string>", "append", GroupStateTimeout.EventTimeTimeout)
    rows = steps.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
    rows.trigger(availableNow=True).start().awaitTermination()
    judged = spark.read.schema(kind).parquet(f"{out}/rows")
    last = judged.groupBy("subject", "event_id").agg(F.max_by(F.struct("before", "after"), "version").alias("v"))
    bad = [(F.col("v.before") == a) & (F.col("v.after") == b) for a, b in refused]
    return last.where(reduce(lambda a, b: a | b, bad, F.lit(False))).select("subject", "event_id", "v.before", "v.after")


def review_arrivals(spark: SparkSession, source: str, schema: StructType, review: Callable[[DataFrame], DataFrame], target: str, state: str) -> None:
    """Run a review over the files that have arrived since the last call; each micro-batch's results are a folder of `target`, so a repeated batch replaces itself."""

    def keep(batch: DataFrame, number: int) -> None:
        review(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
