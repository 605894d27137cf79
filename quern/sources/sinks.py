"""Sinks: flat exports, keyed upserts, versioned stores with a pointer, index generations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.streaming.runs import upsert


def flat(rows: DataFrame) -> DataFrame:
    """Arrays joined by "; ", everything as text, so that a spreadsheet can hold it."""
    cell = lambda c, kind: F.array_join(F.col(c).cast("array<string>"), "; ") if kind.startswith("array") else F.col(c).cast("string")
    return rows.select(*[cell(c, kind).alias(c) for c, kind in rows.dtypes])


def export_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with a header and a byte order mark before it, quotes where needed: an export for a person, so one task writes it."""
    out = flat(rows)
    first, *rest = out.columns
    out.select(*[F.col(c).alias(("﻿" if c == first else "") + c) for c in [first, *rest]]).repartition(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def _store(spark: SparkSession, store: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(store).getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, store: str) -> int:
    """The greatest version that a pointer file names; 0 where there is none."""
    path, fs = _store(spark, store)
    found = fs.globStatus(path(f"{store}/CURRENT-*")) or []
    return max((int(f.getPath().getName().rsplit("-", 1)[1]) for f in found), default=0)


def generation(spark: SparkSession, store: str, save: Callable[[str], None]) -> int:
    """Let `save` write the next version whole, over what a stopped run has left, then write its pointer file, whose creation is one step of the file system:
    readers see the old or the new version, never a part or none, wherever this stops. Older pointers go last; their versions stay for
    those still reading."""
    before = current(spark, store)
    path, fs = _store(spark, store)
    save(f"{store}/v{before + 1}")
    fs.create(path(f"{store}/CURRENT-{before + 1}"), False).close()
    if before:
        fs.delete(path(f"{store}/CURRENT-{before}"), False)
    return before + 1


def replace(rows: DataFrame, store: str) -> int:
    """The rows as the next version of a store of one table."""
    return generation(rows.sparkSession, store, lambda folder: rows.write.mode("overwrite").parquet(folder))


def folder(spark: SparkSession, store: str) -> str:
    return f"{store}/v{current(spark, store)}"


def load(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(folder(spark, store))


def upsert_store(rows: DataFrame, store: str, key: str) -> int:
    """Rows by key into a versioned store."""
    spark = rows.sparkSession
    return replace(upsert(load(spark, store), rows, key) if current(spark, store) else rows, store)


def memo_rows(dropped: DataFrame, kept: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Finally dropped rows to remember, once each, without those kept or known."""
    return dropped.join(kept.select(key), key, "left_anti").join(known.select(key), key, "left_anti").dropDuplicates([key])


def index_generation(chunks: DataFrame, store: str) -> int:
    """Chunk index as a generation with its fingerprint; an unchanged corpus keeps the old one."""
    spark = chunks.sparkSession
    mark = chunks.agg(F.sum(F.xxhash64(*chunks.columns).cast("decimal(38,0)")).cast("string").alias("f"), F.count("*").alias("n")).head()
    fingerprint = f"{mark['f']}:{mark['n']}"
    now = current(spark, store)
    if now and spark.read.parquet(f"{store}/v{now}").select("fingerprint").head()[0] == fingerprint:
        return now
    return replace(chunks.withColumn("fingerprint", F.lit(fingerprint)), store)
