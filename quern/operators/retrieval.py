"""Retrieval: chunks, BM25 as a postings join, dense search, rank fusion and evaluation.

A query set is joined to postings by term, never to chunks by a cross join, so the shuffle is of the matching postings
only. Corpus statistics (N, average length, IDF) come from all chunks: a type filter stands above them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.session import small, stage

CHUNK, STEP = 200, 150
#: Rows up to which a list of terms or weights is broadcast.
SENT = 200_000
#: Scores that a task groups at once, about; the least chunks of a partition.
SCORES, CHUNKS = 2_000_000, 1000
#: Query vectors of a broadcast; similarities that a task holds at once.
BLOCK, PAIRS = 4096, 1 << 18
K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60


def chunk(docs: DataFrame, text: str = "text") -> DataFrame:
    """Windows of 200 words every 150; the first that reaches the end is the last. Adds chunk_no and chunk, drops the text. The windows are cut
    before they become rows, so that no row carries the whole text."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")

    def windows(w: Column) -> Column:
        count = F.when(F.size(w) <= CHUNK, 1).otherwise(F.ceil((F.size(w) - CHUNK) / STEP) + 1).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.array_join(F.slice(w, k * STEP + 1, F.lit(CHUNK)), " "))

    cut = F.transform(F.array(words), windows)[0]  # the words are split once
    return docs.select(*[c for c in docs.columns if c != text], F.posexplode(cut).alias("chunk_no", "chunk"))


def tokenized(chunks: DataFrame, key: list[str], text: str = "chunk") -> DataFrame:
    """(key.., toks, len) of every chunk, written once: all corpus statistics and postings read it."""
    toks = chunks.select(*key, T.tokenize(text).alias("toks"))
    return stage(toks.withColumn("len", F.size("toks")), "tokens")


def postings(tokens: DataFrame, key: list[str], terms: DataFrame | None = None) -> DataFrame:
    """(key.., term, tf, len) of every chunk with a term, of those in terms (term) where given."""
    long = tokens.select(*key, "len", F.explode("toks").alias("term"))
    if terms is not None:
        long = long.join(small(terms, SENT), "term")
    return long.groupBy(*key, "len", "term").agg(F.count("*").alias("tf"))


def bm25(tokens: DataFrame, queries: DataFrame, key: list[str], query_text: str = "text", query_id: str = "query_id") -> DataFrame:
    """(query_id, key.., score) of the chunks, as tokenized() wrote them, that score above 0, rounded to 6 decimals. Repeated query terms count again. Document
    frequencies are summed in each task before they are shuffled, and only postings of asked terms are ever made."""
    corpus = tokens.agg(F.count("*").alias("_n"), F.avg("len").alias("_avg"))
    df = tokens.select(F.explode(F.array_distinct("toks")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(corpus)).select("term", "_avg", (F.log(F.col("_n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    idf = stage(idf, "idf")
    floor = idf.agg((F.avg("idf") * EPSILON).alias("_eps"))  # one row, like the corpus
    asked = queries.select(F.col(query_id), F.explode(T.tokenize(query_text)).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("qtf"))
    asked = stage(asked, "asked")
    weights = asked.join(idf, "term").crossJoin(F.broadcast(floor))
    weights = weights.withColumn("idf", F.when(F.col("idf") < 0, F.col("_eps")).otherwise(F.col("idf")))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("_avg")))
    tokens = placed(tokens, key[0], asked.select(query_id).distinct().count())
    hits = postings(tokens, key, asked.select("term").distinct()).join(small(weights, SENT), "term").groupBy(query_id, *key).agg(F.round(F.sum(part), 6).alias("score"))
    return hits.filter("score > 0")


def placed(tokens: DataFrame, doc: str, queries: int) -> DataFrame:
    """tokens with the chunks of each document in one partition, so that postings, scores of chunks and the best of a document are all grouped where they are; the chunks are shuffled
    once, and not each of their hits. Partitions are as many as keep the scores of one, of all queries at most, in memory."""
    rows = tokens.count()
    cores = tokens.sparkSession.sparkContext.defaultParallelism
    return tokens.repartition(int(max(min(2 * cores, rows // CHUNKS + 1), min(-(-rows * queries // SCORES), rows // CHUNKS + 1))), doc)


def best_per_doc(hits: DataFrame, query_id: str = "query_id", tie: str = "chunk_no") -> DataFrame:
    """The best chunk of each document for each query, by score, then position."""
    rest = [c for c in hits.columns if c not in (query_id, "doc_id")]
    best = F.max_by(F.struct(*rest), F.struct(F.col("score"), -F.col(tie))).alias("_best")
    return hits.groupBy(query_id, "doc_id").agg(best).select(query_id, "doc_id", "_best.*")


def top(hits: DataFrame, k: int, by: list[Column], group: str = "query_id") -> DataFrame:
    """rank (from 1) of the k first of each group; the limit is pushed below the shuffle as a group limit."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*by))).filter(F.col("rank") <= k)


def _better(best: tuple[np.ndarray, ...], found: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query (by sim, then the smaller vec_id) of two lists of (query, vec_id, label's place, sim)."""
    q, v, at, s = (np.concatenate(x) for x in zip(best, found))
    order = np.lexsort((v, -s, q))
    q, v, at, s = q[order], v[order], at[order], s[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    kept = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < k
    return q[kept], v[kept], at[kept], s[kept]


def dense(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 4, within: str | None = None) -> DataFrame:
    """(query_id, vec_id, label, sim) of a stated query set against all other vectors: cosine similarities as matrix products of normalised
    blocks. Only the k best of each query in each task, ties to the smaller vec_id, so that what is shuffled doesn't grow with the vectors; `within` names a
    column in which a vector must equal the query. Queries are broadcast in blocks of BLOCK. A task holds PAIRS similarities at once, and of them makes
    rows only of those that the k best so far let in."""
    spark = vectors.sparkSession
    columns = ["vec_id", "label", "embedding"]
    asked = queries.select(*columns).filter("vec_id is not null and embedding is not null")
    blocks = max(1, -(-asked.count() // BLOCK))
    out = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toPandas()
        if not len(rows):
            continue
        unit = lambda x: (m := np.stack(x).astype(np.float64)) / np.sqrt((m * m).sum(axis=1, keepdims=True))
        sent = spark.sparkContext.broadcast((rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(), unit(rows["embedding"])))

        def run(frames: Iterator[pd.DataFrame], sent=sent, unit=unit) -> Iterator[pd.DataFrame]:
            ids, labels, asked = sent.value
            n = len(ids)
            step = max(1, PAIRS // n)
            names: dict[object, int] = {}  # labels by place
            best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            last, last_id = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)  # of the k best so far
            for frame in frames:
                for at in range(0, len(frame), step):
                    part = frame.iloc[at : at + step]
                    vec, own = part["vec_id"].to_numpy(np.int64), part["label"].to_numpy()
                    sims = np.round(asked @ unit(part["embedding"]).T, digits)
                    sims = np.where(np.isnan(sims), np.inf, sims)  # as Spark and SQL order them
                    let_in = (sims > last[:, None]) | ((sims == last[:, None]) & (vec[None, :] < last_id[:, None]))
                    let_in &= ids[:, None] != vec[None, :]
                    if within:
                        let_in &= labels[:, None] == own[None, :]
                    q, v = np.nonzero(let_in)
                    if not len(q):
                        continue
                    places = np.array([names.setdefault(None if pd.isna(x) else x, len(names)) for x in own], np.int64)
                    best = _better(best, (q, vec[v], places[v], sims[q, v]), k)
                    ends = np.flatnonzero(np.r_[best[0][1:] != best[0][:-1], True])
                    full = ends[np.bincount(best[0], minlength=n)[best[0][ends]] >= k]
                    last[best[0][full]], last_id[best[0][full]] = best[3][full], best[1][full]
            if len(best[0]):
                every = list(names)
                yield pd.DataFrame({"query_id": ids[best[0]], "vec_id": best[1], "label": [every[x] for x in best[2]], "sim": np.where(np.isinf(best[3]), np.nan, best[3])})

        schema = f"query_id long, vec_id long, label {dict(vectors.dtypes)['label']}, sim double"
        found = vectors.select(*columns).filter("vec_id is not null and embedding is not null").mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"query_id long, vec_id long, label {dict(vectors.dtypes)['label']}, sim double")


def fuse(a: DataFrame, b: DataFrame, key: str, query_id: str = "query_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two rankings (query_id, key, rank); a missing side adds nothing."""
    both = a.select(query_id, key, "rank").unionByName(b.select(query_id, key, "rank"))
    return both.groupBy(query_id, key).agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 6).alias("rrf"))


def metrics(ranked: DataFrame, grades: DataFrame, query_id: str = "query_id", key: str = "doc_id") -> DataFrame:
    """P@3, R@5, MRR, nDCG@5 and Hit@1 of each query. ranked: (query_id, key, rank); grades: (query_id, key, grade > 0)."""
    counts = grades.groupBy(query_id, "grade").agg(F.count("*").alias("n"))
    return judged_metrics(ranked.join(grades, [query_id, key], "left"), counts, query_id)


def judged_metrics(graded: DataFrame, counts: DataFrame, query_id: str = "query_id") -> DataFrame:
    """The metrics of rankings (query_id, rank, grade or null) where counts (query_id, grade > 0, n) says how many there are of each grade: the best order of five needs no more."""
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    hits = graded.groupBy(query_id).agg(
        (F.sum(F.when((F.col("rank") <= 3) & (F.col("grade") > 0), 1).otherwise(0)) / 3).alias("p3"),
        F.sum(F.when((F.col("rank") <= 5) & (F.col("grade") > 0), 1).otherwise(0)).alias("_hit5"),
        F.coalesce(F.max(F.when(F.col("grade") > 0, 1 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(F.when((F.col("rank") <= 5) & (F.col("grade") > 0), gain(F.col("grade")) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("_dcg"),
        F.max(F.when((F.col("rank") == 1) & (F.col("grade") > 0), 1).otherwise(0)).alias("hit1"),
    )
    up = Window.partitionBy(query_id).orderBy(F.desc("grade"))
    placed = counts.withColumn("_to", F.sum("n").over(up)).withColumn("_from", F.col("_to") - F.col("n"))
    place = F.when(F.col("_from") < 5, F.sequence(F.col("_from") + 1, F.least(F.col("_to"), F.lit(5)))).otherwise(F.array().cast("array<long>"))
    best = F.aggregate(place, F.lit(0.0), lambda s, i: s + gain(F.col("grade")) / F.log2(i + 1))
    ideal = placed.filter("n > 0").groupBy(query_id).agg(F.sum("n").alias("_n"), F.sum(best).alias("_idcg"))
    out = ideal.join(hits, query_id, "left")
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select(query_id, r(F.col("p3")).alias("p3"), r(F.col("_hit5") / F.col("_n")).alias("r5"), r(F.col("mrr")).alias("mrr"), r(F.when(F.col("_idcg") > 0, F.col("_dcg") / F.col("_idcg"))).alias("ndcg5"), F.coalesce("hit1", F.lit(0)).alias("hit1"))
