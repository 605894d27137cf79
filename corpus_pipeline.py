"""Corpus pipeline: quality rules, line deduplication, n-gram Jaccard join, mixing and best-fit packing, in this order.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but the last return the columns of
documents. Documents that the quality rules reject go; lines that match an earlier one go, their documents stay; of each group of
similar documents the one with the smallest id stays; the mix repeats a document as often as it takes it; the pieces
of what is left are packed. SQL can't express the robust estimates of the first stage, so there is no oracle.

A null text is rejected by the first stage, as any text of fewer than fifty words; a null id takes no part in the third and stays, a null source
is a source; texts of any length go through whole; repeated rows are documents each until the third stage, of which one stays; ties of
id are ordered by all columns; columns of any name are carried along; an empty table gives an empty result. A stage's staged frames
are its own: they are deleted when its result is written, or, where stages are called one by one, when the next but one begins.
"""

from __future__ import annotations

import functools
import string

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common, jaccard, lines, mixing, packing, quality


#: For each pipeline (session and tables) what its last stages have staged. Only frames that stages of that pipeline staged are here.
_stages: dict[tuple[int, str], list[common.Staging]] = {}


def begun(stage):
    """A stage that owns what it stages, and first deletes what was staged by those before its predecessor."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = _stages.setdefault((id(spark), sf_dir), [])
        while len(before) > 1:
            before.pop(0).release()
        common.sweep(spark)
        with common.Staging() as own:
            out = stage(spark, docs, sf_dir)
        before.append(own)
        return out

    return run


@begun
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


@begun
def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedupe(docs).withColumn("n_chars", F.length("text").cast("long"))


@begun
def dedupe_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words are similar to none and stay; a null id is in no group and stays. Rows that share an id are one
    document, as in the join: they go together, and where they stay, of those with the same words one does, the first by all columns."""
    found = common.stage(jaccard.join(docs), "components")
    gone = common.small(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct(), 400_000)
    wordy = F.coalesce(F.col("text").rlike(common.WORD), F.lit(False))
    out = docs.join(gone, (F.col("doc_id") == F.col("_gone")) & wordy, "left_anti")
    repeated = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("doc_id").alias("_twice"))
    repeated = common.stage(repeated, "repeated-ids")
    if not repeated.head(1):
        return out
    ids = common.small(repeated, 400_000)
    again = (F.col("doc_id") == F.col("_twice")) & wordy
    key = F.sha2(F.array_join(quality.words(F.translate("text", string.ascii_uppercase, string.ascii_lowercase)), " "), 256)
    first = F.row_number().over(Window.partitionBy("doc_id", key).orderBy(*docs.columns))
    once = out.join(ids, again, "left_anti")
    return once.unionByName(out.join(ids, again, "left_semi").withColumn("_k", first).filter("_k = 1").drop("_k"))


@begun
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mixing.mix(docs, mixing.words())
    return common.back(out.select("*", F.explode(F.array_repeat(F.lit(1), F.col("times_taken"))).alias("_copy")), docs, ["doc_id", "source"])


@begun
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", dedupe_lines),
    ("n-gram Jaccard join", dedupe_documents),
    ("mixing", mix_sources),
    ("best-fit packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        for own in _stages.pop((id(spark), sf_dir)):  # the result is written
            own.release()
        if k:
            common.discard(docs)
        docs = out
    return docs
