"""Language identification by rank-order profiles.

A text's letters, lower-cased, with other characters as word ends, give its n-grams of one to three characters. A language's
profile is the order of its most frequent n-grams over all training texts; a text's language is the one whose profile
has the smallest out-of-place distance to the text's own most frequent n-grams, an n-gram that a profile lacks counting as
far as the profile is long. The score is one less the distance as a share of the greatest possible.

Training counts are summed in each task before they are shuffled. A text that is null or has no letter is `und` with
score 0. Ties go to the smaller n-gram code and to the first language in code point order. Without training texts
every text is `und`, an empty table gives an empty result. A null id counts as training (its CRC is that of no text) and stays null; repeated rows are
learned and predicted each; a text of any length is read whole. Columns beside doc_id, text and lang are not read, and a prediction reads text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common

#: N-grams of a language's profile and of a text's.
PROFILE, OWN = 400, 300
#: Bytes of texts that a worker reads at a time; a longer text is read alone.
SLICE = 1_000_000


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's n-grams; a code holds up to three code points of 21 bits."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[c], c, 32).astype(np.uint64)
    c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
    gap = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    c, gap = c[keep], gap[keep]
    two = c[:-1] | c[1:] << np.uint64(21)
    three = two[:-1] | c[2:] << np.uint64(42)
    return np.unique(np.concatenate([c[~gap], two, three[~gap[1:-1]]]), return_counts=True) if len(c) > 1 else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def most(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    return codes[np.lexsort((codes, -counts))[:n]]


def learn(rows: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """The profile of each language of (lang, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            codes, where = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
            return codes, np.bincount(where, np.concatenate([x[1] for x in found])).astype(np.int64)

        for batch in batches:
            for at, texts in common.slices(batch.column(1), SLICE):
                for lang, text in zip(batch.column(0).slice(at, len(texts)).to_pylist(), texts, strict=True):
                    mine = kept.setdefault(lang, [])
                    mine.append(grams(text))
                    if len(mine) >= 500:
                        kept[lang] = [merged(mine)]
        for lang, found in kept.items():
            codes, counts = merged(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)], names=["lang", "code", "n"])

    counts = rows.select("lang", "text").mapInArrow(common.lean(run), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= size).orderBy("lang", "rank").toPandas()  # `size` rows a language
    return {lang: same["code"].to_numpy(np.int64).view(np.uint64) for lang, same in top.groupby("lang")}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE, own: int = OWN) -> DataFrame:
    """docs (doc_id, held_out, text) with lang_pred and score instead of the text."""
    names = sorted(profiles)
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *profiles.values()]))
    place = np.full((len(names), len(known) + 1), size, np.int64)
    for k, name in enumerate(names):
        place[k, np.searchsorted(known, profiles[name])] = np.arange(len(profiles[name]))
    sent = docs.sparkSession.sparkContext.broadcast((names, known, place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, place = sent.value
        for batch in batches:
            langs, scores = [], []
            for text in (t for _, texts in common.slices(batch.column(2), SLICE) for t in texts):
                first = most(*grams(text), own)
                if not len(first) or not names:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                at = np.searchsorted(known, first)
                at[at == len(known)] = 0
                at = np.where(known[at] == first, at, len(known))
                there = place[:, at]
                far = np.where(there == size, size, np.abs(there - np.arange(len(first)))).sum(axis=1)
                best = int(far.argmin())
                langs.append(names[best])
                scores.append(max(0.0, 1.0 - float(far[best]) / (size * len(first))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(common.lean(run), "doc_id long, held_out boolean, lang_pred string, score double")


def op8_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    docs = docs.withColumn("held_out", held)
    return predict(docs, learn(docs.filter("not held_out and lang is not null and text is not null")))
