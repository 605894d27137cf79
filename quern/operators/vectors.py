"""A stored approximate index of vectors: inverted lists around centroids, written as generations.

Centroids are fitted on a bounded sample (SAMPLE vectors, chosen by a hash of their id) on the driver; every vector is then put in the list
of its nearest centroid, in tasks, so the index holds every row. A search compares each query with the vectors of its nearest lists only.
How many of them is found when the index is written: as many as hold RECALL of the exact hits of some
vectors of the sample; data without clusters need most lists. retrieval.dense() is the exact way; recall() measures one against the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import retrieval as R
from quern.sources import sinks

#: Vectors that centroids are fitted on; passes of the fit; vectors of a list, about; greatest number of lists.
SAMPLE, PASSES, LIST, LISTS = 50_000, 8, 64, 4096
#: Recall that a search is to reach, and vectors of the sample, hits of each, by which the number of lists that it takes is found.
RECALL, TRIED, HITS = 0.95, 500, 10
#: Query vectors of a broadcast.
BLOCK = 4096


def unit(vectors) -> np.ndarray:
    m = np.stack(vectors).astype(np.float64)
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


def centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means from evenly spread rows; a list that loses all its vectors keeps its centre."""
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(PASSES):
        own = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


def probes(sample: np.ndarray, centres: np.ndarray, recall: float = RECALL) -> int:
    """How many of a query's nearest lists hold that share of its exact hits within the sample."""
    asked = np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int)
    sims = sample[asked] @ sample.T
    sims[np.arange(len(asked)), asked] = -2
    hits = np.argsort(-sims, axis=1, kind="stable")[:, : min(HITS, len(sample) - 1)]
    own = np.argmax(sample @ centres.T, axis=1)
    place = np.argsort(np.argsort(-(sample[asked] @ centres.T), axis=1, kind="stable"), axis=1)
    ranks = np.take_along_axis(place, own[hits], axis=1)
    return int(np.quantile(ranks, recall, method="inverted_cdf")) + 1 if ranks.size else len(centres)


def write(vectors: DataFrame, store: str) -> int:
    """The next generation of the index of vectors (vec_id, label, embedding); rows without an id or a vector take no part."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "label", "embedding").filter("vec_id is not null and embedding is not null")
    n = rows.count()
    share = min(1.0, SAMPLE / max(1, n))
    picked = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("vec_id", "embedding").orderBy("vec_id").limit(2 * SAMPLE)
    sample = picked.toPandas()["embedding"]
    centres = centroids(unit(sample), max(1, min(LISTS, len(sample), n // LIST))) if len(sample) else np.zeros((1, 1))
    take = probes(unit(sample), centres) if len(sample) else 1
    sent = spark.sparkContext.broadcast(centres)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                own = np.concatenate([np.argmax(unit(frame["embedding"].iloc[at : at + 1024]) @ sent.value.T, axis=1) for at in range(0, len(frame), 1024)])
                yield frame.assign(list=own.astype(np.int32))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", list int"

    def save(folder: str) -> None:
        spark.createDataFrame([(k, c.tolist(), take) for k, c in enumerate(centres)], "list int, centre array<double>, probes int").write.mode("overwrite").parquet(f"{folder}/centroids")
        rows.mapInPandas(assign, schema).repartition("list").sortWithinPartitions("list", "vec_id").write.mode("overwrite").parquet(f"{folder}/lists")

    return sinks.generation(spark, store, save)


def search(spark: SparkSession, store: str, queries: DataFrame, k: int, probed: int | None = None, digits: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, sim) of each query's k most similar other vectors in its nearest lists, ties to the smaller vec_id; `probed` lists, or as many as the index asks for. Queries (vec_id, embedding) are
    sent in blocks, each with a pass over the lists that its queries ask for."""
    folder = sinks.folder(spark, store)
    held = spark.read.parquet(f"{folder}/centroids").orderBy("list").collect()  # at most LISTS rows
    centres, probed = np.stack([r["centre"] for r in held]), probed or held[0]["probes"]
    stored = spark.read.parquet(f"{folder}/lists")
    asked = queries.select("vec_id", "embedding").filter("vec_id is not null and embedding is not null")
    blocks, out = -(-asked.count() // BLOCK) if stored.head(1) else 0, None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toPandas()
        if not len(rows):
            continue
        units = unit(rows["embedding"])
        near = np.argsort(-(units @ centres.T), axis=1, kind="stable")[:, :probed]
        by_list = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        sent = spark.sparkContext.broadcast((rows["vec_id"].to_numpy(np.int64), units, by_list))

        def run(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, units, by_list = sent.value
            best = None
            for frame in frames:
                for c, own in frame.groupby("list"):
                    at = by_list[int(c)]
                    for start in range(0, len(own), 1024):
                        part = own.iloc[start : start + 1024]
                        sims, vec = np.round(units[at] @ unit(part["embedding"]).T, digits), part["vec_id"].to_numpy(np.int64)
                        q, v = np.nonzero(ids[at][:, None] != vec[None, :])
                        found = pd.DataFrame({"query_id": ids[at][q], "vec_id": vec[v], "sim": sims[q, v]})
                        best = found if best is None else pd.concat([best, found])
                        best = best.sort_values(["query_id", "sim", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
            if best is not None:
                yield best

        part = stored.filter(F.col("list").isin(list(by_list))).select("list", "vec_id", "embedding").mapInPandas(run, "query_id long, vec_id long, sim double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, sim double")
    return R.top(out, k, [F.desc("sim"), F.col("vec_id")]).select("query_id", "rank", "vec_id", "sim")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact hits (query_id, vec_id) that were found."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).head()[0]
