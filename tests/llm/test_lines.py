"""Order of words and what meets in the line deduplication."""

import random

from pyspark.sql import functions as F

from quern.llm import lines


def test_rare_words_of_shared_buckets_come_first(spark):
    """Words of one line each come before words of some 24 lines, so that no line meets others by those."""
    r = random.Random(5)
    rows = []
    for k in range(3000):
        own = [f"unique{k:05d}x{j}" for j in range(8)]
        rows.append((k, " ".join(own + [f"w{x}" for x in r.sample(range(4000), 32)]), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string").repartition(4)
    rank = lines.ranks(docs.select("doc_id", "text"))
    got = docs.select(lines.keys(F.col("text"), rank).alias("a"), lines.keys(F.col("own"), rank).alias("b"))
    first = got.select(F.size(F.array_except("b", F.slice("a", 1, 8))).alias("late"))
    assert first.agg(F.sum("late")).head()[0] < 0.02 * 8 * len(rows)  # but for clashes of buckets


def test_rare_words_come_first_in_a_large_vocabulary(spark):
    """100,000 words of one line each come before 12,500 of the same length that are in 16 lines, but for clashes of buckets (before, of 17 %)."""
    r = random.Random(6)
    common = [f"c{x:06d}" for x in range(12_500)] * 16
    r.shuffle(common)
    rows = []
    for k in range(12_500):
        own = [f"u{8 * k + j:06d}" for j in range(8)]
        rows.append((k, " ".join(own + common[16 * k : 16 * k + 16]), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string").repartition(4)
    rank = lines.ranks(docs.select("doc_id", "text"))
    got = docs.select(lines.keys(F.col("text"), rank).alias("a"), lines.keys(F.col("own"), rank).alias("b"))
    late = F.size(F.array_except("b", F.slice("a", 1, 8)))
    assert got.agg(F.sum(late)).head()[0] < 0.1 * 8 * len(rows)


def test_order_is_of_words_alone(spark):
    """Equal words are equal longs wherever they are, different ones differ; an empty table has an order too."""
    docs = spark.createDataFrame([(1, "b a a\tc ü " + "long" * 20), (2, "c b ü " + "long" * 20 + " a")], "doc_id long, text string")
    for rank in (lines.ranks(docs), lines.ranks(docs.limit(0))):
        x, y = (row["k"] for row in docs.select(lines.keys(F.col("text"), rank).alias("k")).collect())
        assert x == y == sorted(set(x)) and len(x) == 5


def test_rarer_words_come_first_among_frequent_ones(spark):
    """Of words beyond the rarest quarter of all words, those of 16 lines come before longer ones of 64 (before, all were in one level, long ones first)."""
    r = random.Random(7)
    mid, often = [f"m{x:04d}" for x in range(1600)] * 16, [f"frequent{x:04d}" for x in range(1000)] * 64
    r.shuffle(mid)
    r.shuffle(often)
    rows = [(k, " ".join([f"u{k}x{j}" for j in range(12)] + mid[8 * k : 8 * k + 8] + often[20 * k : 20 * k + 20]), " ".join(often[20 * k : 20 * k + 20])) for k in range(3200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, often string").repartition(4)
    rank = lines.ranks(docs.select("doc_id", "text"))
    got = docs.select(lines.keys(F.col("text"), rank).alias("a"), lines.keys(F.col("often"), rank).alias("b"))
    early = F.size(F.array_intersect("b", F.slice("a", 1, 20)))
    assert got.agg(F.sum(early)).head()[0] < 0.02 * 20 * len(rows)  # but for words that a line has twice and clashes of buckets


def test_rows_of_the_next_length_class(spark):
    """A set meets the next class from every place where a larger set of that class may have the overlap needed, and from one place more at most."""
    got = spark.range(1, 400).select(F.col("id").cast("int").alias("n"), *lines.classes(F.col("id").cast("int"), 80)).collect()
    own = {r["n"]: r["own"] for r in got}
    fewer = 0
    for r in got:
        n = r["n"]
        meets = [j for j in range(r["least"] + 1) for m in range(n, 5 * n // 4 + 1) if m in own and own[m] != own[n] and 180 * (n - j) >= 80 * (n + m)]
        if 5 * n // 4 in own:
            assert 0 <= min(r["far"], r["least"]) - max(meets, default=-1) <= 1  # 1: a class may begin between whole lengths
            fewer += r["own"] != r["next"] and r["far"] < r["least"]
    assert fewer > 50
