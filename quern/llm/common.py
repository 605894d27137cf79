"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import Staging, discard, scratch, ship, small, stage

__all__ = ["GAP", "WORD", "Staging", "aside", "back", "discard", "lean", "let", "scratch", "slices", "small", "stage", "sweep", "table"]

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sweep(spark: SparkSession) -> None:
    """Let go what no frame refers to any more: Spark deletes the shuffle files of plans that have been collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def aside(docs: DataFrame, used: list[str], *more: Column) -> DataFrame:
    """docs with the used columns, more that are made of docs, and all others in one struct, `_rest`, so that no name of theirs meets an operator's own."""
    rest = [c for c in docs.columns if c not in used]
    return docs.select(*used, *more, (F.struct(*[docs[f"`{c}`"] for c in rest]) if rest else F.lit(0)).alias("_rest"))


def back(out: DataFrame, docs: DataFrame, used: list[str], *more: str) -> DataFrame:
    """The columns of docs again, in their order, and those that an operator adds."""
    return out.select(*[F.col(c) if c in used else F.col("_rest").getField(c).alias(c) for c in docs.columns], *more)


def let(value: Column, body) -> Column:
    """Bind an expensive expression once and use it several times: body gets a lambda variable instead of the expression."""
    return F.transform(F.array(value), body)[0]


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of runs of rows with about `most` bytes; a longer text is a run of its own. A worker holds one run at a time."""
    sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    runs = np.cumsum(sizes) // most
    bounds = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(texts)]
    for start, end in zip(bounds, bounds[1:]):
        if end > start:
            yield start, texts.slice(start, end - start).to_pylist()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches, which gives its worker's free memory back to the system when a task ends: workers stay idle beside later stages."""

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
            if trim:
                trim(0)

    return leaner
