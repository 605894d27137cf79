"""Collocations of two to four words by hashed counts of buckets.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and those into words. Pass k over the texts counts phrases
of k words and, beside them, how often each of 2^BITS buckets is met by a phrase of k + 1 words. A phrase is counted in pass k only if

- its bucket, as counted in the pass before, was met often enough (PCY), and
- both phrases of k - 1 words in it were frequent (Apriori), as a table of hashed bits says.

Both tests may let a rare phrase through and never stop a frequent one; phrases are then counted exactly, by their words. In turn
only those made of phrases that pass are counted in buckets for the next pass (DHP). What is broadcast are bits of buckets, of fixed
size; counts of buckets are saturated at the least count, so a task's are a byte each, and are added by parts of the buckets in two
or more steps, so no task reads those of all tasks. More buckets prune more and change no result.

A candidate's score is the lowest of its cuts. Candidates that stand in a longer one nearly as frequent are dropped, and the first
of each language are kept, at first among shares of its phrases, so no task sorts a whole language.

A null text is empty; a null lang is `und`, as is that word itself; repeated rows count each; a text of any length is read whole, some texts
at a time. Scores that tie are ordered by count, then by phrase. Products are decimals of 38 digits. Other columns, doc_id included, are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common

#: Least count of a phrase; greatest number of its words; percentage of a phrase's count from which a longer one takes its place; first phrases of each language.
LEAST, LENGTH, PERCENT, FIRST = 30, 4, 80, 2000
#: Buckets are 2^BITS; their counts are kept by parts of 2^PART, which are added in steps of at most FAN tasks; bytes of texts that a worker reads at a time; shares of a language that are sorted apart.
BITS, PART, FAN, SLICE, SHARES = 26, 16, 256, 4_000_000, 64

_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_SPACES = bytes(32 if kind else byte for byte, kind in enumerate(_KIND.tolist()))
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each bit depends on all."""
    h = (h ^ (h >> np.uint64(30))) * _ODD[1]
    h = (h ^ (h >> np.uint64(27))) * _ODD[2]
    return h ^ (h >> np.uint64(31))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one word more."""
    return mixed(h * _ODD[0] + word)


class Words:
    """Words of some texts: their codes in a dictionary, hashes with their language's, and whether the next word is in the same piece."""

    def __init__(self, langs: list[str], texts: list[bytes | None]):
        raws = [(t or b"").lower() for t in texts]
        joined = b"\n".join(raws)
        kind = _KIND[np.frombuffer(joined, np.uint8)]
        within = kind == 0
        begins = np.flatnonzero(within & ~np.concatenate([[False], within[:-1]]))
        piece = np.cumsum(kind == 2, dtype=np.int32)[begins]
        starts = np.cumsum([0, *(len(r) + 1 for r in raws[:-1])])
        text = np.searchsorted(starts, begins, "right") - 1
        coded = pa.array(joined.translate(_SPACES).split(), pa.binary()).dictionary_encode()
        self.words: list[bytes] = coded.dictionary.to_pylist()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.same = piece[1:] == piece[:-1]
        own, self.langs = pd.factorize(np.array(langs, object))
        self.lang = own.astype(np.int64)[text]
        self.word_hash = hashes(self.words)[self.code] if len(self.code) else np.zeros(0, np.uint64)
        lang_hash = hashes([str(x).encode() for x in self.langs])
        self.hash = mixed(self.word_hash ^ lang_hash[self.lang] * _ODD[0]) if len(self.code) else np.zeros(0, np.uint64)

    def phrases(self, at: np.ndarray, k: int) -> tuple[list[str], list[str], np.ndarray]:
        """Language, phrase and count of the distinct phrases of k words that begin at the given words. Exact: they are told apart by codes."""
        key = self.lang[at] * len(self.words) + self.code[at]
        for j in range(1, k):
            key = pd.factorize(key)[0] * len(self.words) + self.code[at + j]
        own, distinct = pd.factorize(key)
        first = np.zeros(len(distinct), np.int64)
        first[own[::-1]] = at[::-1]
        words, code = self.words, self.code
        found = [b" ".join([words[c] for c in code[i : i + k].tolist()]).decode() for i in first.tolist()] if k > 1 else [words[c].decode() for c in code[first].tolist()]
        return [self.langs[c] for c in self.lang[first].tolist()], found, np.bincount(own, minlength=len(distinct))


def has(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    """Of a phrase's hash the first bits; frequent phrases are marked by the last."""
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def mark(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & np.uint64(2**bits - 1)).astype(np.int64)


ROWS = pa.schema({"lang": pa.string(), "phrase": pa.string(), "n": pa.int64(), "part": pa.int32(), "task": pa.int32(), "slots": pa.binary(), "counts": pa.binary()})
ROWS_SQL = "lang string, phrase string, n long, part int, task int, slots binary, counts binary"


def parts(counts: np.ndarray, task: int, step: int = 64) -> Iterator[pa.RecordBatch]:
    """Rows of the counted buckets: those of each part as 16-bit numbers and their counts as bytes."""
    there = np.flatnonzero(counts)
    bounds = np.searchsorted(there, np.arange(0, len(counts) + 1, 2**PART))
    full = np.flatnonzero(np.diff(bounds)).tolist()
    for k in range(0, len(full), step):
        own = [there[bounds[p] : bounds[p + 1]] for p in full[k : k + step]]
        empty = [None] * len(own)
        columns = [empty, empty, empty, full[k : k + step], [task] * len(own), [(o & (2**PART - 1)).astype("<u2").tobytes() for o in own], [counts[o].tobytes() for o in own]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ROWS.types, strict=True)], schema=ROWS)


def passed(docs: DataFrame, k: int, last: bool, least: int, bits: int, size: int, buckets: np.ndarray | None, frequent: np.ndarray | None) -> DataFrame:
    """Pass k: counts of phrases by slices of texts, and counts of buckets of longer ones by tasks, written."""
    sent = docs.sparkSession.sparkContext.broadcast((buckets, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, frequent = sent.value
        counts = None if last else np.zeros(2**bits, np.uint8)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, texts in common.slices(batch.column(1).cast(pa.binary()), size):
                words = Words(langs[at : at + len(texts)], texts)
                n, h, there = len(words.code), words.hash, np.ones(len(words.code), bool)
                for j in range(1, k):  # phrases of j + 1 words
                    below = h
                    h = longer(below[: n - j], words.word_hash[j:]) if n > j else h[:0]
                    there = there[: n - j] & words.same[j - 1 :] if n > j else there[:0]
                if k > 1 and len(h):
                    there &= has(buckets, bucket(h, bits))
                    there[there] = has(frequent, mark(below[:-1][there], bits)) & has(frequent, mark(below[1:][there], bits))
                found = np.flatnonzero(there)
                if len(found):
                    own = words.phrases(found, k)
                    nothing = [pa.nulls(len(own[0]), t) for t in ROWS.types[3:]]
                    yield pa.RecordBatch.from_arrays([pa.array(own[0], pa.string()), pa.array(own[1], pa.string()), pa.array(own[2].astype(np.int64)), *nothing], schema=ROWS)
                if not last and len(h) > 1:
                    both = np.flatnonzero(there[:-1] & there[1:] & words.same[k - 1 :])
                    slot, times = np.unique(bucket(longer(h[both], words.word_hash[both + k]), bits), return_counts=True)
                    counts[slot] = np.minimum(counts[slot] + np.minimum(times, least), least)
        if not last:
            yield from parts(counts, TaskContext.get().partitionId())

    return common.stage(docs.mapInArrow(common.lean(run), ROWS_SQL), f"phrases-{k}")


def frequent_of(counts: DataFrame, k: int, least: int, bits: int) -> DataFrame:
    """Rows, as of counted buckets, that mark the hashes of phrases of k words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(2**bits, np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            split = [p.encode().split(b" ") for p in batch.column(1).to_pylist()]
            columns = [hashes([s[j] for s in split]) for j in range(k)]
            h = mixed(columns[0] ^ hashes([x.encode() for x in batch.column(0).to_pylist()]) * _ODD[0])
            for c in columns[1:]:
                h = longer(h, c)
            marks[mark(h, bits)] = least
        yield from parts(marks, TaskContext.get().partitionId())

    return counts.select("lang", "phrase").mapInArrow(common.lean(run), ROWS_SQL)


def bits_of(rows: DataFrame, least: int, bits: int) -> np.ndarray:
    """Packed bits of the buckets with a count of at least `least`: 2^bits / 8 bytes on the driver. Counts of at most FAN tasks are added at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(2**PART, np.uint16)

        def row() -> pa.RecordBatch:
            slots = np.flatnonzero(total)
            columns = [[None], [None], [None], [now[0]], [now[1]], [slots.astype("<u2").tobytes()], [total[slots].astype(np.uint8).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ROWS.types, strict=True)], schema=ROWS)

        for batch in batches:
            for part, task, slots, counts in zip(*(batch.column(k) for k in range(4)), strict=True):
                key = (part.as_py(), task.as_py())
                if key != now:
                    if now is not None:
                        yield row()
                    now, total = key, np.zeros(2**PART, np.uint16)
                own = np.frombuffer(slots.as_py(), "<u2")
                total[own] = np.minimum(total[own] + np.frombuffer(counts.as_py(), np.uint8), least)
        if now is not None:
            yield row()

    rows = rows.select("part", "task", "slots", "counts")
    most = rows.agg(F.max("task")).head()[0]
    while most is not None:
        most //= FAN
        rows = rows.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).repartition("part", "task").sortWithinPartitions("part", "task")
        rows = rows.mapInArrow(common.lean(run), ROWS_SQL).select("part", "task", "slots", "counts")
        if most == 0:
            break
    packed = np.zeros(2**bits // 8, np.uint8)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for slots, counts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                flag = np.zeros(2**PART, bool)
                flag[np.frombuffer(slots, "<u2")[np.frombuffer(counts, np.uint8) >= least]] = True
                flags.append(np.packbits(flag, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flags, pa.binary())], names=["part", "bits"])

    for r in rows.mapInArrow(pack, "part int, bits binary").toLocalIterator():  # 2^(bits - PART) rows at most
        packed[r["part"] * 2**PART // 8 : (r["part"] + 1) * 2**PART // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return packed


def counted(docs: DataFrame, least: int = LEAST, length: int = LENGTH, bits: int = BITS, size: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, n) of every phrase of 1 to `length` words with a count of at least `least`, and (lang, n) of all words."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    found, totals, buckets, frequent = None, None, None, None
    for k in range(1, length + 1):
        rows = passed(docs, k, k == length, least, bits, size, buckets, frequent)
        phrases = rows.filter("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if k == 1:
            phrases = common.stage(phrases, "phrases-words")
            totals = common.stage(phrases.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals")
        kept = common.stage(phrases.filter(F.col("n") >= least).select("lang", "phrase", F.lit(k).alias("k"), "n"), f"phrases-frequent-{k}")
        found = kept if found is None else found.unionByName(kept)
        if k < length:
            buckets = bits_of(rows.filter("part is not null"), least, bits)
            frequent = bits_of(frequent_of(kept, k, least, bits), least, bits)
        common.discard(rows)
        if k == 1:
            common.discard(phrases)
        if k < length and not (buckets.any() and frequent.any()):
            break
    return found, totals


def best(found: DataFrame, totals: DataFrame, percent: int = PERCENT, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first candidates."""
    words = F.split("phrase", " ")
    joined = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    candidates = found.filter("k > 1").withColumnRenamed("n", "a").withColumn("words", words)
    cuts = candidates.select("lang", "phrase", "a", "words", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("left"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    left = found.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = found.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    wide = lambda name: f"cast({name} as decimal(20,0))"
    score = F.expr(f"(2000000 * {wide('a')}) div ({wide('l')} + {wide('r')})")
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", score)
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    spans = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " ")))))
    inside = candidates.filter("k > 2").select("lang", spans.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    gone = F.col("longer").isNotNull() & F.expr(f"100 * {wide('longer')} >= {percent} * {wide('a')}")
    left_over = scored.join(inside, ["lang", "phrase"], "left").filter(~gone).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(*order)
    top = left_over.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= first).drop("rank")
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    top = top.join(common.small(totals, 100_000), "lang")
    return top.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, least: int = LEAST, length: int = LENGTH, percent: int = PERCENT, first: int = FIRST, bits: int = BITS, size: int = SLICE) -> DataFrame:
    return best(*counted(docs, least, length, bits, size), percent, first)


def op13_mine_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(common.table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, row_number() OVER () AS piece, s FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS s FROM d)),
w AS (SELECT lang, piece, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT lang, piece, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM p)),
g AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY piece ORDER BY i)),
f AS MATERIALIZED (
  SELECT lang, 1 AS k, w1 AS phrase, CAST(count(*) AS BIGINT) AS f FROM g GROUP BY lang, w1 UNION ALL
  SELECT lang, 2, w1 || ' ' || w2, CAST(count(*) AS BIGINT) FROM g WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 30 UNION ALL
  SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, CAST(count(*) AS BIGINT) FROM g WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 30 UNION ALL
  SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, CAST(count(*) AS BIGINT) FROM g WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, string_split(phrase, ' ') AS w, phrase, f AS a FROM f WHERE k > 1 AND f >= 30),
y AS (SELECT lang || chr(9) || phrase AS key, f FROM f),
x AS (SELECT c.lang, c.phrase, c.a, j, c.lang || chr(9) || array_to_string(c.w[1:j], ' ') AS front, c.lang || chr(9) || array_to_string(c.w[j + 1 : c.k], ' ') AS rest FROM c JOIN (VALUES (1), (2), (3)) t(j) ON j < c.k),
s AS (
  SELECT x.lang, x.phrase, x.a, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * x.a) // (l.f::HUGEINT + r.f) AS BIGINT) AS score, j
  FROM x JOIN y l ON l.key = x.front JOIN y r ON r.key = x.rest),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, array_to_string(c.w[b : b + z - 1], ' ') AS phrase, max(a) AS longer FROM c JOIN (VALUES (2), (3)) t(z) ON z < c.k JOIN (VALUES (1), (2), (3)) u(b) ON b + z - 1 <= c.k GROUP BY 1, 2),
o AS (SELECT m.* FROM m LEFT JOIN i ON i.lang = m.lang AND i.phrase = m.phrase WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * m.a)
SELECT o.lang, CAST(row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM o JOIN n ON n.lang = o.lang QUALIFY row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
