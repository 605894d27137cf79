"""The stored BM25 index against the search that reads all postings, generations, and runs that own their frames."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern import plans, session
from quern.operators import lexical, retrieval
from quern.sources import sinks
from tests.conftest import SF


@pytest.fixture(scope="module")
def corpus(spark):
    """Words of very different frequency, some in most chunks, so that their inverse frequency is below 0."""
    r = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for doc in range(900):
        for chunk in range(r.randint(1, 3)):
            n = r.choice([3, 20, 80, 200])
            rows.append((doc, chunk, " ".join([r.choice(words[: r.choice([3, 10, 60])]) for _ in range(n)] + (["rare"] if r.random() < 0.02 else []))))
    rows += [(5000, 0, ""), (5001, 0, None), (5002, 0, "w0 w0 w0"), (5003, 0, "w0 w0 w0")]  # the last two tie
    return spark.createDataFrame(rows, "doc_id long, chunk_no int, chunk string").cache()


QUERIES = [(0, "w0"), (1, "w0 w1 w59"), (2, "rare w40"), (3, "unknown"), (4, ""), (5, None), (6, "w5 w5 w5 w20 w0"), (7, "w0 w1 w2"), (8, "rare")]


def test_index_equals_search_of_all_postings(spark, tmp_path, corpus):
    asked = spark.createDataFrame(QUERIES, "query_id long, text string")
    store = str(tmp_path / "index")
    assert lexical.write(corpus, store, block=16, shard=300) == 1
    for k in (1, 5, 10):
        got = lexical.search(spark, store, asked, k).select("query_id", "rank", "doc_id", "chunk_no", "score").collect()
        every = retrieval.best_per_doc(retrieval.bm25(retrieval.tokenized(corpus, ["doc_id", "chunk_no"]), asked, ["doc_id", "chunk_no"]))
        want = retrieval.top(every, k, [F.desc("score"), F.col("doc_id")]).select("query_id", "rank", "doc_id", "chunk_no", "score").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 4 * k
    blocks, weights = lexical.lists(spark, store, asked, "query_id", "text")
    picked = lexical.chosen(blocks, weights, 5, "query_id", "doc_id").groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("read").alias("read")).collect()
    by = {r["query_id"]: (r["n"], r["read"]) for r in picked}
    assert all(0 < read <= n for n, read in by.values()) and by[0][1] < by[0][0] / 5 and by[1][1] < by[1][0]  # a word alone needs its first blocks only


def test_search_reads_the_stored_index_only(spark, tmp_path, corpus):
    store = str(tmp_path / "index")
    asked = spark.createDataFrame(QUERIES, "query_id long, text string")
    lexical.write(corpus.limit(50), store)
    out = lexical.search(spark, store, asked, 5)
    assert out.inputFiles() and all(f"{store}/v1/" in f for f in out.inputFiles())
    assert lexical.write(corpus, store) == 2 and sinks.current(spark, store) == 2
    assert all(f"{store}/v2/" in f for f in lexical.search(spark, store, asked, 5).inputFiles())
    assert out.count() > 0  # a reader of the old generation goes on


def test_empty_index(spark, tmp_path, corpus):
    store = str(tmp_path / "index")
    lexical.write(corpus.limit(0), store)
    assert lexical.search(spark, store, spark.createDataFrame(QUERIES, "query_id long, text string"), 5).count() == 0


def folders(spark):
    found = session.shared_dir(spark).removeprefix("file://")
    return set(os.listdir(found)) if os.path.isdir(found) else set()


def test_a_finished_query_leaves_no_folder(spark):
    before = folders(spark)
    with session.scratch() as run:
        rows = plans.QUERIES["bm25_search"](spark, SF).collect()
        plans.QUERIES["bm25_index_search"](spark, SF).collect()
        assert len(run.written) > 2 and folders(spark) > before
    assert rows and folders(spark) == before


def test_runs_release_their_own_frames_only(spark):
    frame = spark.range(5)
    with session.Staging() as outer:
        mine = session.stage(frame, "outer")
        with session.Staging() as inner:
            theirs = session.stage(frame, "inner")
        inner.release()
        assert mine.count() == 5 and len(outer.written) == 1
        with pytest.raises(Exception, match="FILE_NOT_EXIST|FileNotFound|does not exist"):
            theirs.collect()
        session.discard(mine)
        assert not outer.written


def test_vector_index_recall(spark, tmp_path):
    from quern.operators import vectors

    store, sf = str(tmp_path / "vectors"), SF.replace("0.001", "0.01")
    v = spark.read.parquet(f"{sf}/embeddings.parquet").cache()
    odd = v.limit(1).select(F.lit(None).cast("long").alias("vec_id"), "embedding", "label").unionByName(v.limit(1).select(F.lit(10**9).alias("vec_id"), F.lit(None).cast("array<float>").alias("embedding"), "label"))
    assert vectors.write(v.unionByName(odd), store) == 1
    stored = spark.read.parquet(f"{sinks.folder(spark, store)}/lists")
    assert stored.count() == v.count() and stored.select("vec_id").distinct().count() == v.count()  # every row is in it
    exact = plans.QUERIES["dense_topk"](spark, sf)
    asked = v.filter("vec_id % 50 = 0")
    found = vectors.search(spark, store, asked, 10)
    assert all(f"{store}/v1/" in f for f in found.inputFiles())
    assert vectors.recall(found, exact) >= 0.9
    whole = vectors.search(spark, store, asked, 10, probed=10**6)  # all lists: the exact result
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, exact.select("query_id", "rank", "vec_id", "sim").collect()))
    vectors.write(v.limit(0), store)
    assert vectors.search(spark, store, asked, 10).count() == 0


def test_hits_are_shuffled_once_by_document(spark, corpus, tmp_path):
    """Chunks are summed and the best of a document is found where its hits have come together."""
    store = str(tmp_path / "once")
    lexical.write(spark.createDataFrame([(k, c, f"w{k % 7} w{c} w1") for k in range(50) for c in range(3)], "doc_id long, chunk_no int, chunk string"), store)
    found = lexical.search(spark, store, spark.createDataFrame([(1, "w1 w2"), (2, "w5")], "query_id long, text string"), 3)
    dealt = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in line]
    assert any("query_id" in line and "doc_id" in line for line in dealt) and not any("chunk_no" in line for line in dealt)
    assert found.filter("query_id = 2").count() == 3


def shuffled(spark, after=-1):
    """The last stage so far, and the rows that stages after `after` have written to shuffles."""
    context, none = spark.sparkContext._jsc.sc(), spark._jvm.java.util.ArrayList()
    context.listenerBus().waitUntilEmpty(30_000)
    stages = context.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    stages = [stages.apply(i) for i in range(stages.size())]
    return max((s.stageId() for s in stages), default=-1), sum(s.shuffleWriteRecords() for s in stages if s.stageId() > after)


def test_neither_postings_nor_hits_are_shuffled(spark, corpus, tmp_path):
    """Rows of shuffles are chunks, blocks and what may be among the best; the store has three bytes of a posting, and some of a block and of a chunk."""
    postings = retrieval.postings(retrieval.tokenized(corpus, ["doc_id", "chunk_no"]), ["doc_id", "chunk_no"]).count()
    chunks, store = corpus.count(), str(tmp_path / "index")
    last, _ = shuffled(spark)
    lexical.write(corpus, store)
    last, rows = shuffled(spark, last)
    assert chunks <= rows < chunks + postings / 20
    asked = spark.createDataFrame([(k, f"w{k} w{k + 1} w{k + 7}") for k in range(40)], "query_id long, text string")
    assert lexical.search(spark, store, asked, 10).count() == 400
    _, rows = shuffled(spark, last)
    assert rows < postings / 10
    blocks = f"{sinks.folder(spark, store)}/blocks"
    assert sum(os.path.getsize(f"{blocks}/{f}") for f in os.listdir(blocks)) < 4 * postings


@pytest.mark.parametrize("kind", ["long", "string"])
def test_odd_keys_and_queries(spark, tmp_path, kind):
    """Chunks of one key, of equal and of different lengths, keys that are null, copies that tie, and a query without an id."""
    r = random.Random(5)
    rows = [(d % 150, c, " ".join(r.choices(["a1", "b1", "c1", "d1", "e1"], [60, 20, 10, 5, 1], k=r.randint(1, 30)))) for d in range(200) for c in range(2)]
    rows += [(None, 0, "a1 b1 e1"), (None, 0, "e1 d1 a1"), (None, 1, "c1"), (7, 0, "e1 e1")] + [(1000 + k, 0, "e1 d1 c1") for k in range(40)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_no int, chunk string").withColumn("doc_id", F.col("doc_id").cast(kind))
    asked = spark.createDataFrame([(0, "e1 d1"), (1, "a1"), (None, "c1 e1 e1"), (3, "b1 c1 d1 e1"), (4, "none")], "query_id int, text string")
    store = str(tmp_path / "odd")
    lexical.write(chunks, store, block=4, shard=60)
    got = lexical.search(spark, store, asked, 5).collect()

    # as the SQL has it: postings of equal key and length are one
    rows, k1, b = [(d if d is None or kind == "long" else str(d), c, t.split()) for d, c, t in rows], retrieval.K1, retrieval.B
    tf = Counter((d, c, len(t), w) for d, c, t in rows for w in t)
    df, mean = Counter(w for *_, w in tf), sum(len(t) for *_, t in rows) / len(rows)
    idf = {w: math.log(len(rows) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = retrieval.EPSILON * sum(idf.values()) / len(idf)
    for query, text in asked.collect():
        scores = Counter()
        for (d, c, n, w), x in tf.items():
            scores[d, c] += text.split().count(w) * (floor if idf.get(w, 0) < 0 else idf[w]) * x * (k1 + 1) / (x + k1 * (1 - b + b * n / mean))
        best = {}
        for (d, c), x in sorted(scores.items(), key=lambda y: (-round(y[1], 6), y[0][1])):
            if round(x, 6) > 0:
                best.setdefault(d, (c, round(x, 6)))
        first = sorted(best, key=lambda d: (-best[d][1], d is not None, d))[:5]
        found = sorted((x for x in got if x["query_id"] == query), key=lambda x: x["rank"])
        assert [(x["doc_id"], x["chunk_no"], x["rank"]) for x in found] == [(d, best[d][0], k + 1) for k, d in enumerate(first)]
        assert [x["score"] for x in found] == pytest.approx([best[d][1] for d in first], abs=2e-6)
    assert len([x for x in got if x["query_id"] is None]) == 5
