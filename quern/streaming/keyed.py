"""Keyed state in a stream: records that later corrections change, kept as values with versions, and timers for corrections that find no record.

State is a value for each key in RocksDB, so it may exceed memory, and is restored from the checkpoint when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from quern.sources import sinks

#: Where state lives, as a session's setting.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Milliseconds for which a correction waits for its record.
WAIT_MS = 7 * 24 * 3600 * 1000
OUTPUT = "key string, value string, version long, status string"


class Corrected(StatefulProcessor):
    """One value for each key: the newest version of its record and corrections. A correction that comes before its record waits in the state; when its timer
    runs out it is given out as an orphan. Rows of one version that come again change nothing, so repeated batches are harmless."""

    def __init__(self, wait_ms: int = WAIT_MS):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "value string, version long, known boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        value, version, known = self.now.get() if self.now.exists() else (None, None, False)
        was, first = version, known
        for frame in rows:
            for row in frame.sort_values("version").itertuples(index=False):
                known = known or not row.correction
                if version is None or row.version > version:
                    value, version = row.value, int(row.version)
        self.now.update((value, version, known))
        if not known:
            if was is None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        elif not first or version != was:
            status = "new" if not first and version == was or was is None else "corrected"
            yield self._row(key, value, version, status)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value, version, known = self.now.get() if self.now.exists() else (None, None, True)
        if not known:
            self.now.clear()
            yield self._row(key, value, version, "orphan")

    def _row(self, key, value, version, status) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "value": [value], "version": [version], "status": [status]})

    def close(self) -> None:
        pass


def corrected(rows: DataFrame, wait_ms: int = WAIT_MS) -> DataFrame:
    """(key, value, version, status) of what changes, from a stream of rows (key, value, version, correction). The session's state store must be PROVIDER."""
    keyed = rows.select("key", "value", "version", "correction").groupBy("key")
    return keyed.transformWithStateInPandas(statefulProcessor=Corrected(wait_ms), outputStructType=OUTPUT, outputMode="Update", timeMode="ProcessingTime")


def upserted(changes: DataFrame, store: str, checkpoint: str, **trigger):
    """Write the changes of each batch into a versioned store, the newest of each key in place of the stored one; a repeated batch changes nothing."""

    def batch(frame: DataFrame, number: int) -> None:
        newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("version")))
        fresh = frame.withColumn("_k", newest).filter("_k = 1").drop("_k").persist()
        if fresh.head(1):
            sinks.upsert_store(fresh, store, "key")
        fresh.unpersist()

    return changes.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
