"""Exact top-k search by Fagin's threshold algorithm.

Vectors are turned into integers, floor(1024 x). Each block of candidates has a sorted list for every dimension, read from
the top where the query is positive and from the bottom where it is negative. Vectors met in any list are scored in full; the
values at the depth read so far bound every vector not yet met, and a block is left when that bound is below the kth score
found so far, in this block or earlier ones of the task. Each task returns the k best of its rows for each query, which
one window per query merges.

Queries are broadcast in blocks of at most QUERIES, each with a pass over the candidates, so neither side is ever held
whole. Vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id;
vectors are only compared with others of their length; repeated rows are candidates each, and the hits of all query rows that share an id are pooled; ties go to the smaller id.
Finite components of any size are summed exactly; a score that no long holds is the nearest one that does, with ties as of any other.
Columns of other names are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common

K, SCALE = 10, 1024
#: Queries of a broadcast block; candidates of a block with its own lists; first depth to which lists are read.
QUERIES, BLOCK, DEPTH = 4096, 8192, 32
#: From this size of a component on, products are not summed as longs. Below it a product has at most 48 bits, which leaves room for 2^15 of them.
LARGE = 2**24


def usable(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "embedding").filter("vec_id is not null and embedding is not null").filter(finite)


def integers(vectors) -> np.ndarray:
    """Longs, or Python's integers where a component is too large for sums of products of longs."""
    floored = np.floor(np.stack(vectors).astype(np.float64) * SCALE)
    if floored.size and np.abs(floored).max() >= LARGE:
        return np.array([[int(x) for x in row] for row in floored], object)
    return floored.astype(np.int64)


def together(block: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as longs or both as Python's integers."""
    return (block, query) if block.dtype == query.dtype else (block.astype(object), query.astype(object))


def search_block(ids: np.ndarray, block: np.ndarray, lists: np.ndarray, query_id: int, query: np.ndarray, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """best: (-score, id) of the k best so far. The same, with this block's."""
    block, query = together(block, query)
    dims = np.flatnonzero(query)
    n, depth, start = len(ids), DEPTH, 0
    met = ids == query_id
    weights = query[dims]
    while start < n:
        depth = min(depth, n)
        span = np.arange(start, depth)
        rows = lists[np.where(weights > 0, n - 1 - span[:, None], span[:, None]), dims] if len(dims) else span[:, None]
        new = np.unique(rows)
        new = new[~met[new]]
        met[new] = True
        if len(new):
            scores = block[new] @ query
            if scores.dtype == object:
                scores = np.array([max(-(2**63), min(2**63 - 1, s)) for s in scores], object)
            if len(best) == k:
                keep = scores >= -best[-1][0]
                new, scores = new[keep], scores[keep]
            best = sorted([*best, *zip((-scores).tolist(), ids[new].tolist(), strict=True)])[:k]
        edge = lists[np.where(weights > 0, n - depth, depth - 1), dims] if len(dims) else None
        bound = int((block[edge, dims] * weights).sum()) if len(dims) else 0
        if len(best) == k and -best[-1][0] > bound:
            break
        start, depth = depth, depth * 2
    return best


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best."""
    spark = vectors.sparkSession
    vectors, queries = usable(vectors), usable(queries)
    blocks = max(1, -(-queries.count() // QUERIES))
    parts = []
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == b).toPandas()
        if not len(own):
            continue
        asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, same in own.groupby(own["embedding"].map(len)):
            asked[int(size)] = (same["vec_id"].to_numpy(np.int64), integers(same["embedding"]))
        sent = spark.sparkContext.broadcast(asked)

        def run(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            best: dict[int, list[tuple[int, int]]] = {}
            waiting: dict[int, list[tuple[int, np.ndarray]]] = {}

            def use(size: int) -> None:
                rows = sorted(waiting.pop(size), key=lambda r: r[0])
                ids, block = np.array([r[0] for r in rows], np.int64), integers([r[1] for r in rows])
                lists = np.argsort(block, axis=0, kind="stable")
                for query_id, query in zip(*sent.value[size], strict=True):
                    best[int(query_id)] = search_block(ids, block, lists, int(query_id), query, best.get(int(query_id), []), k)

            for frame in frames:
                for one, vector in zip(frame["vec_id"], frame["embedding"], strict=True):
                    if len(vector) in sent.value:
                        waiting.setdefault(len(vector), []).append((one, vector))
                        if len(waiting[len(vector)]) == BLOCK:
                            use(len(vector))
            for size in list(waiting):
                use(size)
            rows = [(q, i, -s) for q, found in best.items() for s, i in found]
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

        parts.append(common.stage(vectors.mapInPandas(run, "query_id long, vec_id long, score long"), "topk-block"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
