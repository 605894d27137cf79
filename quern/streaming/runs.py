"""Incremental runs: known keys, late corrections, retries and run states with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL, TIMEOUT_S = ("done", "failed"), 1200


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one before its first version."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def incremental(source: DataFrame, store: str, checkpoint: str, key: str, schema: str, work: Callable[[DataFrame], DataFrame], failed: str = "failed"):
    """Process what arrived since the last run and stop. Rows whose key is stored are skipped; rows that `work` marks as failed are not stored,
    so the next run tries them again. Each batch writes its own folder under the store, so a repeated batch overwrites itself."""

    def batch(frame: DataFrame, number: int) -> None:
        known = _read(frame.sparkSession, store, f"{schema}, batch int").filter(F.col("batch") < number).select(key)
        fresh = frame.dropDuplicates([key]).join(known, key, "left_anti")
        work(fresh).filter(~F.col(failed)).drop(failed).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def corrections(stored: DataFrame, late: DataFrame, key: str, value: str, version: str) -> DataFrame:
    """Stored rows with the newest correction of their key; `changed` marks them."""
    newest = late.groupBy(key).agg(F.max_by(value, version).alias("_v"))
    out = stored.join(newest, key, "left").withColumn("changed", F.col("_v").isNotNull() & ~F.col("_v").eqNullSafe(F.col(value)))
    return out.withColumn(value, F.coalesce("_v", value)).drop("_v")


def upsert(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Fresh rows replace stored ones of the same key."""
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def run_states(events: DataFrame, timeout_s: int = TIMEOUT_S) -> DataFrame:
    """State of each run from its progress events (run_id, at, status, step): queued, running, done or failed. Final states don't change; a run
    without news for `timeout_s` seconds of processing time fails. Timers keep a query alive: start it with a continuous or a single-batch
    trigger, not with availableNow."""

    def step(run: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, steps = state.get if state.exists else ("queued", 0)
        if state.hasTimedOut:
            if status not in TERMINAL:
                status = "failed"
            state.remove()
        else:
            for frame in frames:
                for now in frame.sort_values("at")["status"]:
                    if status not in TERMINAL:
                        status, steps = now, steps + 1
            state.update((status, steps))
            if status not in TERMINAL:
                state.setTimeoutDuration(timeout_s * 1000)
        yield pd.DataFrame({"run_id": [run[0]], "status": [status], "steps": [steps]})

    return events.groupBy("run_id").applyInPandasWithState(step, "run_id string, status string, steps long", "status string, steps long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def final_states(events: DataFrame) -> DataFrame:
    """The batch form of run_states without timeouts: the first final event of a run, else its last."""
    rows = events.withColumn("final", F.col("status").isin(*TERMINAL))
    first = F.min_by("status", F.struct("at", "event_id"))
    ends = rows.filter("final").groupBy("run_id").agg(first.alias("end"), F.min(F.struct("at", "event_id")).alias("cut"))
    last = rows.groupBy("run_id").agg(F.max_by("status", F.struct("at", "event_id")).alias("last"))
    counted = rows.join(ends.select("run_id", "cut"), "run_id", "left").filter("cut is null or struct(at, event_id) <= cut").groupBy("run_id").agg(F.count("*").alias("steps"))
    return last.join(ends.select("run_id", "end"), "run_id", "left").join(counted, "run_id").select("run_id", F.coalesce("end", "last").alias("status"), "steps")
