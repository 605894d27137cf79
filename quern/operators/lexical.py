"""A stored BM25 index: impact-ordered posting blocks with their maxima, and exact top-k search that skips blocks.

A generation of the index has three tables. `corpus` has one row: number of chunks, mean length, floor of weights. `terms` has
each term's inverse frequency. `blocks` has, for each shard of the documents, one row with the keys of its chunks and what their lengths add to a
divisor (`places`; its term is null), and for each term its postings in falling order of impact (what a posting adds to a score per unit of
query weight), cut into blocks, whose first posting has its greatest impact. A posting is the chunk's place in the shard and a count, two and one bytes as
a rule: the store, and what a search shuffles of it, stay below the size of the documents.

A document lies in one shard whole, and a shard in one task, when it is written and when it is searched, so that neither postings nor hits
are ever rows of a shuffle: only the texts of chunks and the blocks of asked terms are dealt by shard. That grouping, where rows of a key are known to lie
together by another key, has no native form without a shuffle of each posting.

Search reads the stored tables only. In each shard, the first block of each asked list gives scores that can't be lower than they will be, and so
a bound that the kth document of a query reaches there. A block is read on if its greatest impact, with the maxima of the query's other terms in
its shard, reaches that bound: a document that reaches it has all its postings in such blocks, so scores and ranks are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quern.functions import text as T
from quern.operators import retrieval as R
from quern.session import discard
from quern.sources import sinks

#: Postings of a block; chunks of a shard, about: what a Python worker holds at once.
BLOCK, SHARD = 128, 8_000
#: Scores that are rounded alike may differ by so much.
SLACK = 2e-6


def write(chunks: DataFrame, store: str, key: tuple[str, str] = ("doc_id", "chunk_no"), text: str = "chunk", block: int = BLOCK, shard: int = SHARD) -> int:
    """The next generation of the index of chunks, whole before its pointer is written."""
    spark = chunks.sparkSession
    tokens = R.tokenized(chunks, list(key), text)
    n, mean = tokens.agg(F.count("*"), F.avg("len")).head()
    shards = max(1, -(-n // shard))
    # tokens have no spaces; joined, they take half of what their list takes in a shuffle
    dealt = tokens.select(*key, "len", F.array_join("toks", " ").alias("toks")).repartition(shards, key[0]).withColumn("shard", F.spark_partition_id())
    kind = dict(tokens.dtypes)
    places = f"struct<{key[0]}: array<{kind[key[0]]}>, {key[1]}: array<{kind[key[1]]}>, norm: array<double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            yield from _indexed(pa.Table.from_batches(rows), key, mean, block)
        del rows
        pa.default_memory_pool().release_unused()  # workers stay idle beside later stages

    blocks = dealt.mapInArrow(run, f"shard int, term string, block int, n long, at binary, tf binary, places {places}")

    def save(folder: str) -> None:
        blocks.write.mode("overwrite").parquet(f"{folder}/blocks")
        discard(tokens)  # before the terms of all shards meet
        df = spark.read.parquet(f"{folder}/blocks").filter("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
        df.select("term", "df", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")).write.mode("overwrite").parquet(f"{folder}/terms")
        floor = spark.read.parquet(f"{folder}/terms").agg((F.avg("idf") * R.EPSILON).alias("floor"))
        floor.select(F.lit(n).alias("chunks"), F.lit(mean).cast("double").alias("mean"), "floor").write.mode("overwrite").parquet(f"{folder}/corpus")

    return sinks.generation(spark, store, save)


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether a row differs from the one before it in any of the columns."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
        out[1:] |= codes[1:] != codes[:-1]
    return out


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The values from each start on, one or two bytes each where that holds them all, else four."""
    top = values.max(initial=0)
    values = values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4")
    ends = (np.append(starts, len(values)) * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(values)]).cast(pa.binary())


def _values(parts: list[bytes], n: int) -> np.ndarray:
    """What _binary() packed of one list of a shard."""
    packed = b"".join(parts)
    return np.frombuffer(packed, f"<u{len(packed) // n}").astype(np.int64)


def _indexed(rows: pa.Table, key: tuple[str, str], mean: float, block: int) -> Iterator[pa.RecordBatch]:
    """The row of places and the blocks of one shard."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in (*key, "len")], null_placement="at_start"))
    new = _changes([rows[c].combine_chunks() for c in (*key, "len")])
    place, first = np.cumsum(new) - 1, np.flatnonzero(new)
    size = rows["len"].to_numpy()
    norm = R.K1 * (1 - R.B + R.B * size[first] / (mean or 1.0))
    shard = rows["shard"][0].as_py()
    held = rows.take(first)
    places = pa.StructArray.from_arrays([pa.ListArray.from_arrays([0, len(first)], x) for x in (*(held[c].combine_chunks() for c in key), pa.array(norm))], [*key, "norm"])
    yield _batch(shard, 1, {"places": places})

    full = np.flatnonzero(size)
    if not len(full):
        return
    toks = pc.split_pattern(rows["toks"].take(pa.array(full)).combine_chunks(), " ")
    del rows, held
    pairs = place[full][pc.list_parent_indices(toks).to_numpy()]
    words = pc.list_flatten(toks).dictionary_encode()
    del toks
    pairs += words.indices.to_numpy().astype(np.int64) * len(first)
    words = words.dictionary
    pairs, tf = np.unique(pairs, return_counts=True)
    word, at = np.divmod(pairs, len(first))
    del pairs
    impact = _impact(tf, norm[at])
    order = np.lexsort((-impact, word))
    word, at, tf, impact = word[order], at[order], tf[order], impact[order]
    begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    number = np.arange(len(word)) - np.repeat(begin, np.diff(np.append(begin, len(word))))
    starts = np.flatnonzero(number % block == 0)
    yield _batch(shard, len(starts), {
        "term": words.take(pa.array(word[starts])), "block": pa.array((number[starts] // block).astype(np.int32)),
        "n": pa.array(np.diff(np.append(starts, len(word)))), "at": _binary(at, starts), "tf": _binary(tf, starts), "places": pa.nulls(len(starts), places.type),
    })


def _batch(shard: int, n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    none = {"term": pa.string(), "block": pa.int32(), "n": pa.int64(), "at": pa.binary(), "tf": pa.binary()}
    every = {"shard": pa.array(np.full(n, shard, np.int32))} | {c: columns.get(c, pa.nulls(n, kind)) for c, kind in none.items()} | {"places": columns["places"]}
    return pa.RecordBatch.from_pydict(every)


def _impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return tf * (R.K1 + 1) / (tf + norm)


def lists(spark: SparkSession, store: str, queries: DataFrame, query_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The stored blocks, and (query_id, term, weight) of the asked terms that the index has."""
    folder = sinks.folder(spark, store)
    corpus = spark.read.parquet(f"{folder}/corpus").select("floor")  # one row
    asked = queries.select(F.col(query_id), F.explode(T.tokenize(text)).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("qtf"))
    known = asked.join(spark.read.parquet(f"{folder}/terms"), "term").crossJoin(F.broadcast(corpus))
    weight = F.col("qtf") * F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf"))
    return spark.read.parquet(f"{folder}/blocks"), known.select(query_id, "term", weight.alias("weight"))


class _Shard:
    """What a search holds of one shard: its chunks in order of their keys, and the whole list of each asked term."""

    def __init__(self, places: pa.StructScalar, rows: list[dict]) -> None:
        doc, tie, norm = (places[i].values for i in range(3))
        norm = norm.to_numpy()
        new_doc = _changes([doc])
        new = new_doc | _changes([tie])
        self.slot = np.cumsum(new) - 1  # chunks of one key and different lengths are one
        self.number = rows[0]["shard"]
        self.whole = len(norm) == self.slot[-1] + 1
        self.keys = [x.take(pa.array(np.flatnonzero(new))) for x in (doc, tie)]
        self.docs = np.flatnonzero(new_doc[new])  # where each document's chunks begin
        self.doc = np.cumsum(new_doc[new]) - 1
        self.lists: list[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.asked: dict[object, list[tuple[int, float]]] = {}
        at = 0
        while at < len(rows):
            to = at + 1
            while to < len(rows) and rows[to]["block"]:
                to += 1
            own = rows[at:to]
            ends = np.cumsum([r["n"] for r in own])
            place, tf = (_values([r[c] for r in own], int(ends[-1])) for c in ("at", "tf"))
            impact = _impact(tf, norm[place])
            for q in own[0]["asked"]:
                self.asked.setdefault(q["id"], []).append((len(self.lists), q["weight"]))
            self.lists.append((own[0]["term"], impact[np.r_[0, ends[:-1]]], ends, self.slot[place], impact))  # a block's first posting is its greatest
            at = to

    def _scores(self, own: list[tuple[int, float]], to: list[int]) -> np.ndarray:
        """Of each chunk, by so many postings of each list."""
        slots = np.concatenate([self.lists[t][3][:n] for (t, _), n in zip(own, to)])
        parts = np.concatenate([w * self.lists[t][4][:n] for (t, w), n in zip(own, to)])
        return np.bincount(slots, parts, len(self.doc))

    def _kth(self, scores: np.ndarray, k: int) -> tuple[np.ndarray, float]:
        """Each document's best score, and the kth of them, 0 at least."""
        best = np.maximum.reduceat(scores, self.docs)
        return best, max(0.0, float(np.partition(best, -k)[-k])) if len(best) >= k else 0.0

    def read(self, own: list[tuple[int, float]], k: int) -> list[int]:
        """How many blocks of each list can hold one of the query's k best documents: the first ones, as impact falls."""
        if not self.whole:  # a chunk may have two postings of a term
            return [len(self.lists[t][2]) for t, _ in own]
        up = [max(0.0, w * self.lists[t][1][0]) for t, w in own]
        best = sum(up)
        # terms of negative weight may lower a score by no more than their greatest impact
        lower = sum(min(0.0, w * self.lists[t][1][0]) for t, w in own)
        bound = max(0.0, self._kth(self._scores(own, [int(self.lists[t][2][0]) for t, _ in own]), k)[1] + lower)
        return [int(np.count_nonzero(np.maximum(0.0, w * self.lists[t][1]) + best - u >= bound - SLACK)) for (t, w), u in zip(own, up)]

    def best(self, own: list[tuple[int, float]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Chunks and their scores, among which are the best one of each of the k best documents, however scores are rounded and ties broken."""
        scores = self._scores(own, [int(self.lists[t][2][n - 1]) if n else 0 for (t, _), n in zip(own, self.read(own, k))])
        most, kth = self._kth(scores, k)
        docs = np.flatnonzero((most > 0) & (most >= kth - SLACK))
        docs = docs[np.argsort(-most[docs], kind="stable")]
        first = np.flatnonzero(np.r_[True, most[docs][1:] != most[docs][:-1]])
        docs = docs[np.arange(len(docs)) - np.repeat(first, np.diff(np.append(first, len(docs)))) < k] if len(docs) else docs  # of copies, the first k
        kept = np.zeros(len(most), bool)
        kept[docs] = True
        found = np.flatnonzero((scores > 0) & kept[self.doc] & (scores >= most[self.doc] - SLACK))
        return found, scores[found]


def _shards(blocks: DataFrame, weights: DataFrame, query_id: str, make: Callable[[_Shard], list], schema: str) -> DataFrame:
    """What make(_Shard) gives as columns for each shard that has an asked term. The blocks of asked terms are dealt by shard, with the queries that ask for a term at its first block."""
    asked = weights.groupBy("term").agg(F.collect_list(F.struct(F.col(query_id).alias("id"), "weight")).alias("asked"))
    asked = F.broadcast(asked) if weights.count() <= R.SENT else asked
    own = blocks.drop("places").join(asked, "term").withColumn("asked", F.when(F.col("block") == 0, F.col("asked")))
    both = own.unionByName(blocks.filter("term is null").select("shard", "term", "places"), allowMissingColumns=True)

    kept = to_arrow_schema(StructType.fromDDL(schema))

    def made(places: pa.StructScalar, rows: list[dict]) -> pa.RecordBatch:
        columns = make(_Shard(places, rows))
        return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, kept)], schema=kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, places, rows = None, None, []
        for batch in batches:
            held = batch.column("places")
            for i, r in enumerate(batch.drop_columns(["places"]).to_pylist()):
                if r["term"] is None:  # before all terms of its shard
                    if rows:
                        yield made(places, rows)
                    shard, places, rows = r["shard"], held[i], []
                else:
                    assert r["shard"] == shard, "a shard has no places"
                    rows.append(r)
        if rows:
            yield made(places, rows)

    return both.repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first(), "block").mapInArrow(run, schema)


def chosen(blocks: DataFrame, weights: DataFrame, k: int, query_id: str, doc: str) -> DataFrame:
    """(query_id, term, shard, block, weight, read) of every block of the asked terms; `read` says whether it can hold one of the query's k best documents."""
    kind = dict(weights.dtypes)[query_id]

    def make(s: _Shard) -> list:
        out = [(q, s.lists[t][0], s.number, b, w, b < n) for q, own in s.asked.items() for (t, w), n in zip(own, s.read(own, k)) for b in range(len(s.lists[t][2]))]
        return list(zip(*out))

    return _shards(blocks, weights, query_id, make, f"{query_id} {kind}, term string, shard int, block int, weight double, read boolean")


def _keys(blocks: DataFrame) -> list[str]:
    """The columns that name a chunk."""
    return blocks.schema["places"].dataType.fieldNames()[:2]


def search(spark: SparkSession, store: str, queries: DataFrame, k: int, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, document and chunk, score, rank) of each query's k best documents by their best chunk, with the scores of retrieval.bm25()."""
    blocks, weights = lists(spark, store, queries, query_id, text)
    doc, tie = _keys(blocks)
    kind = dict(weights.dtypes)[query_id]
    kinds = [blocks.schema["places"].dataType[c].dataType.elementType.simpleString() for c in (doc, tie)]

    def make(s: _Shard) -> list:
        found = [s.best(own, k) for own in s.asked.values()]
        at = pa.array(np.concatenate([x for x, _ in found]))
        who = np.repeat(np.arange(len(found)), [len(x) for x, _ in found])
        ids = list(s.asked)
        return [[ids[i] for i in who], s.keys[0].take(at), s.keys[1].take(at), np.concatenate([x for _, x in found])]

    hits = _shards(blocks, weights, query_id, make, f"{query_id} {kind}, {doc} {kinds[0]}, {tie} {kinds[1]}, score double")
    hits = hits.withColumn("score", F.round("score", 6)).filter("score > 0")
    best = hits.groupBy(query_id, doc).agg(F.max_by(F.struct(tie, "score"), F.struct(F.col("score"), -F.col(tie))).alias("b")).select(query_id, doc, "b.*")
    return R.top(best, k, [F.desc("score"), F.col(doc)], query_id)
