"""Exact n-gram Jaccard join by a token-group matrix, and the components of its links.

Documents are sets of 5-word shingles; two link when their Jaccard similarity is at least 80 %.

1. Identical word sequences become one representative (the smallest id).
2. Similar representatives are gathered into groups: those that share a minimum hash are compared with one of
   them, and those that link form a group. Groups are cut into parts of about 48 members. In two rounds more, each that shares
   a minimum hash with a larger group is compared with one part of it. This only saves work for what follows.
3. The matrix has a row for each token and group. Tokens are ordered with the rare ones first, by the number of all documents'
   tokens in their bucket. Of two sets that link, the smaller shares one of its first n - ceil(8/9 n) + 1 tokens with the
   first n - ceil(0.8 n) + 1 of the larger, so groups are listed by the former and documents (queries) ask with the latter. A
   query meets the groups of other components that hold one of its tokens, have a smaller or equal member of fitting
   size, and, from that token on, as many tokens left as the overlap needs.
4. A met group's token union bounds the overlap of the query with any member; only where it reaches 80 % of the query is
   the group opened and its members compared exactly.

Every link between documents that aren't yet connected is found that way, so components are exact, while the links inside a
group of copies are never listed. Texts are sent to one task by parts of groups, with at most some hundred queries each.

Tokens are hashes of 61 bits at a random point, from bytes: two different shingles of n bytes agree with a chance of n / 2^61.

A null text, or one without words, is the empty set and links with nothing. Rows that share a doc_id are one
node. A null doc_id takes no part: its component is null. Texts of any length are read whole, some at a time. The first member
in no order that matches is linked; components don't depend on which. Other columns are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

WIDTH, PERCENT = 5, 80
#: Minimum hashes that gather groups; members of a part of a group; queries that one task compares with a part; bits of a token that choose its bucket; bytes of texts that a worker reads at a time; rounds in which groups take in what is like them.
HASHES, PART, QUERIES, BITS, SLICE, ROUNDS = 4, 48, 256, 16, 250_000, 2
#: Rows up to which a list of ids, or of tokens, is broadcast.
SENT, TOKENS = 400_000, 1_000_000

_random = np.random.default_rng(20_240_229)
_ODD = _random.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
#: Windows are polynomials of their bytes modulo a Mersenne prime at a random point: two different ones of n bytes agree with chance n / PRIME at most.
PRIME = 2**61 - 1
_BASE = int(_random.integers(2**60, PRIME - 1))
_powers = np.ones((2, 1), np.uint64)
_inverses = np.ones(1, np.uint64)
_LOW, _P = np.uint64(2**31 - 1), np.uint64(PRIME)


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, of any 64 bits."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of values below it: in halves of 31 bits, since 2^61 is 1."""
    a0, a1, b0, b1 = a & _LOW, a >> np.uint64(31), b & _LOW, b >> np.uint64(31)
    middle = a1 * b0 + a0 * b1
    high = (a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30))
    return _fold(_fold(high) + _fold((middle & np.uint64(2**30 - 1)) << np.uint64(31)) + _fold(a0 * b0))


def _grow(n: int) -> None:
    """Powers of the base, in halves of 31 bits, and of its inverse, for texts of up to n bytes."""
    global _powers, _inverses
    if _powers.shape[1] < n:
        both = np.ones((2, 1), np.uint64)
        steps = np.array([[_BASE], [pow(_BASE, -1, PRIME)]], np.uint64)
        while both.shape[1] < max(n, 1 << 16):
            both, steps = np.concatenate([both, _times(both, steps)], axis=1), _times(steps, steps)
        _powers, _inverses = np.stack([both[0] & _LOW, both[0] >> np.uint64(31)]), both[1]


def canonical(text: str | None) -> bytes:
    """Lower-case A-Z, words joined by one space; bytes.lower and bytes.split know ASCII only, as wanted."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def windows_of(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every window of `width` words of canonical texts, in order, and the bounds of each text's; a shorter sequence is one window."""
    n_words = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
    n_windows = np.where(n_words < width, np.minimum(n_words, 1), n_words - width + 1)
    bounds = np.concatenate([[0], np.cumsum(n_windows)])
    raw = np.frombuffer(b" ".join(t for t in texts if t), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), bounds
    _grow(len(raw) + 1)
    spaces = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(raw)]])
    first = np.repeat(np.cumsum(n_words) - n_words, n_windows) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], n_windows)
    starts, ends = starts[first], ends[first + np.repeat(np.minimum(n_words, width), n_windows) - 1]
    values = raw.astype(np.uint64)
    values += np.uint64(1)
    parts = []
    for half in _powers:  # a window's sum of 31-bit halves times bytes is below 2^64 up to 2^24 bytes, so differences are right although sums wrap
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(values * half[: len(raw)], out=sums[1:])
        parts.append(_fold(sums[ends] - sums[starts]))
    h = _times(_fold(parts[0] + _times(parts[1], np.full(1, 2**31, np.uint64))), _inverses[starts])
    h *= np.uint64(0x9E3779B97F4A7C15)  # from here on a bijection of 64 bits, which spreads the 61 over all
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h, bounds


def windows(words: bytes, width: int = WIDTH) -> np.ndarray:
    return windows_of([words], width)[0]


def tokens_of(texts: list[str | None], width: int, rank: np.ndarray | None = None) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's windows; with a rank of buckets, in that order."""
    h, bounds = windows_of([canonical(t) for t in texts], width)
    if rank is not None:
        h = ranked(h, rank)
    return [np.unique(h[a:b]) for a, b in zip(bounds, bounds[1:])]


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def ranked(h: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Hashes with the rank of their bucket for its number: a bijection that sorts rare ones first."""
    return rank[bucket(h)] << np.uint64(64 - BITS) | h & np.uint64(2 ** (64 - BITS) - 1)


def ranks(docs: DataFrame, width: int) -> np.ndarray:
    """For each of 2^BITS buckets of hashes its rank by the windows of all documents in it. Each task sums its own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for _, texts in common.slices(batch.column(0), SLICE):
                counts += np.bincount(bucket(windows_of([canonical(t) for t in texts], width)[0]), minlength=1 << BITS)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(counts[there])], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(common.lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # 2^BITS rows at most
    counts = np.zeros(1 << BITS, np.int64)
    counts[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    rank = np.empty(1 << BITS, np.uint64)
    rank[np.argsort(counts, kind="stable")] = np.arange(1 << BITS, dtype=np.uint64)
    return rank


def prefix(n, percent: int):
    """Of two similar sets, the first shared token is among so many of either's."""
    return n - -(-percent * n // 100) + 1


def short(n, percent: int):
    """Of two similar sets, the first shared token is among so many of the smaller's."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    low, high = sorted((len(a), len(b)))
    if not low or 100 * low < percent * high:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (low + high - both)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def sets(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """doc_id, key (of the word sequence), n, minimum hashes and first tokens, rarest first, of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in common.slices(batch.column(1), SLICE):
                keys = [hashlib.blake2b(canonical(t), digest_size=16).digest() for t in texts]
                found = tokens_of(texts, width, sent.value)
                sizes = np.array([len(f) for f in found], np.int64)
                full = sizes > 0
                starts = (np.cumsum(sizes) - sizes)[full]
                flat = np.concatenate([np.zeros(0, np.uint64), *found])
                arrays = [batch.column(0).slice(at, len(texts)), pa.array(keys, pa.binary()), pa.array(sizes)]
                for odd in _ODD:
                    least = np.zeros(len(texts), np.int64)
                    if len(starts):
                        least[full] = np.minimum.reduceat(flat * odd, starts).view(np.int64)
                    arrays.append(pa.array(least, mask=~full))
                first = [_signed(f[: prefix(len(f), percent)] if len(f) else f) for f in found]
                ends = np.cumsum([0, *map(len, first)])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *first]))))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "n", *(f"m{k}" for k in range(HASHES)), "first"])

    minima = "".join(f", m{k} long" for k in range(HASHES))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.lean(run), f"doc_id long, key binary, n long{minima}, first array<long>")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """ids with their texts; a short list goes to the texts, a long one is joined by a shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(common.small(ids, SENT), "id")


def compare(docs: DataFrame, members: DataFrame, asked: DataFrame, percent: int, width: int) -> DataFrame:
    """members and asked: (part, id). Links (a, b) of each asked document with the first member of its part that it matches. Parts that are
    asked for by many are dealt to several tasks, each with all members."""
    many = common.stage(asked.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("deals")), "deals")
    known = common.small(many, SENT)
    own = members.join(known, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(0).alias("asks"), "id")
    ask = asked.join(known, "part").select("part", F.pmod(F.xxhash64("id"), F.col("deals")).cast("int").alias("deal"), F.lit(1).alias("asks"), "id")
    parts = common.stage(own.unionByName(ask).distinct(), "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, members, union = None, [], None
        for batch in batches:
            for at, texts in common.slices(batch.column(4), SLICE):
                out: list[tuple[int, int]] = []
                columns = (batch.column(k).slice(at, len(texts)).to_pylist() for k in range(4))
                for now, deal, asks, one, found in zip(*columns, tokens_of(texts, width), strict=True):
                    if (now, deal) != part:
                        part, members, union = (now, deal), [], None
                    if not asks:
                        members.append((one, found))
                        continue
                    if len(members) > 1:
                        if union is None:
                            union = np.unique(np.concatenate([x for _, x in members]))
                        if len(np.intersect1d(found, union, assume_unique=True)) < -(-percent * len(found) // 100):
                            continue
                    hit = next((other for other, x in members if similar(found, x, percent)), None)
                    if hit is not None and hit != one:
                        out.append((one, hit))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])

    common.sweep(docs.sparkSession)  # shuffle files of what is staged go before texts are shuffled
    rows = texts_of(docs, parts).select("part", "deal", "asks", "id", "text")
    rows = rows.repartition("part", "deal").sortWithinPartitions("part", "deal", "asks")
    links = common.stage(rows.mapInArrow(common.lean(run), "a long, b long").distinct(), "links-found")
    for used in (many, parts):
        common.discard(used)
    return links


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every linked id: comp is the smallest id that its links lead to. Labels spread and jump until none changes."""
    both = common.stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = common.stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("heard"))
        now = labels.join(heard, "id").select("id", F.col("comp").alias("was"), F.least("comp", "heard").alias("comp"))
        above = labels.select(F.col("id").alias("comp"), F.col("comp").alias("above"))
        now = common.stage(now.join(above, "comp").select("id", "was", F.least("comp", "above").alias("comp")), "labels")
        common.discard(labels)
        labels = now.select("id", "comp")
        if not now.filter("comp <> was").head(1):
            common.discard(both)
            return labels


def part_of(comp, members):
    """The part of a component for a row's rid; parts have about PART members."""
    return F.when(members == 1, F.xxhash64(comp)).otherwise(F.xxhash64(comp, F.pmod(F.xxhash64("rid"), F.ceil(members / PART))))


def grouped(reps: DataFrame, comps: DataFrame) -> DataFrame:
    """rid, n, comp, members (of comp) and part of every representative."""
    groups = reps.select("rid", "n").join(comps, reps["rid"] == comps["id"], "left").select("rid", "n", F.coalesce("comp", "rid").alias("comp")).distinct()
    members = groups.groupBy("comp").agg(F.count("*").alias("members"))
    return common.stage(groups.join(members, "comp").withColumn("part", part_of(F.col("comp"), F.col("members"))), "groups")


def members_of(groups: DataFrame, asked: DataFrame) -> DataFrame:
    return groups.join(asked.select("part").distinct(), "part").select("part", F.col("rid").alias("id"))


def join(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    docs = docs.select("doc_id", "text")
    rows = common.stage(sets(docs, percent, width), "sets")
    minima = [f"m{k}" for k in range(HASHES)]
    keys = rows.filter("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rid"))
    reps = rows.select("key", "doc_id", "n", *minima).join(keys, "key").filter("doc_id = rid").select("rid", "n", *minima).distinct()
    reps = common.stage(reps, "reps")

    # groups of similar representatives
    shared = reps.select("rid", "n", F.posexplode(F.array(*minima)).alias("k", "m"))
    chosen = F.min_by(F.struct("rid", "n"), F.xxhash64(F.floor(F.col("k") / 2), F.col("rid")))  # two different ones of a large group
    heads = shared.groupBy("k", "m").agg(chosen.alias("head"), F.count("*").alias("c")).filter("c > 1")
    pairs = shared.join(heads, ["k", "m"]).filter(f"rid <> head.rid and 100 * n >= {percent} * head.n and 100 * head.n >= {percent} * n")
    pairs = common.stage(pairs.select(F.col("head.rid").alias("part"), F.col("rid").alias("id")).distinct(), "pairs")
    links = compare(docs, pairs.select("part", F.col("part").alias("id")).distinct(), pairs, percent, width)
    # rows that share an id are one node, whatever their texts
    same = rows.filter("n > 0").join(keys, "key").filter("doc_id <> rid").groupBy("doc_id").agg(F.min("rid").alias("b"), F.max("rid").alias("c")).filter("b <> c")
    links = common.stage(links.unionByName(same.select(F.col("c").alias("a"), "b")).unionByName(same.select(F.col("doc_id").alias("a"), "b").join(reps.select(F.col("rid").alias("a")).distinct(), "a")), "links-near")
    groups = grouped(reps, components(links))
    # whoever shares a minimum hash with a larger group asks one part of it
    for _ in range(ROUNDS):
        likes = shared.select("rid", "k", "m").join(common.small(groups, SENT), "rid").select("rid", "k", "m", "comp", "members")
        tops = likes.groupBy("k", "m").agg(F.max(F.struct("members", "comp")).alias("top"), F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least <> most")
        asked = likes.join(common.small(common.stage(tops.select("k", "m", "top"), "tops"), SENT), ["k", "m"]).filter("comp <> top.comp")
        asked = common.stage(asked.select(part_of(F.col("top.comp"), F.col("top.members")).alias("part"), F.col("rid").alias("id")).distinct(), "asked")
        if not asked.head(1):
            break
        links = common.stage(links.unionByName(compare(docs, members_of(groups, asked), asked, percent, width)), "links-near")
        groups = grouped(reps, components(links))

    # the matrix: the smaller of two similar sets is met by its group's row, the larger asks
    matrix = rows.select(F.col("doc_id").alias("rid"), "n", "first").join(common.small(groups.drop("members"), SENT), ["rid", "n"])
    matrix = matrix.select("rid", "n", "comp", "part", F.posexplode("first").alias("i", "token"))
    is_short = F.col("i") < F.expr(f"n - ceil({2 * percent} * n / {100 + percent}) + 1")
    across = matrix.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.bool_or(is_short).alias("met")).filter("met and low <> high")
    across = common.stage(across.select("token"), "across")
    common.sweep(docs.sparkSession)
    matrix = common.stage(matrix.join(common.small(across, TOKENS), "token"), "matrix")
    common.sweep(docs.sparkSession)
    held = matrix.filter(is_short).groupBy("token", "comp", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("i")).alias("after"))
    q, g = matrix.alias("q"), held.alias("g")
    low = F.greatest(F.col("low"), F.ceil(F.col("q.n") * percent / 100))  # the smallest member that may match
    needed = F.ceil((F.col("q.n") + low) * percent / (100 + percent))
    fits = (low <= F.least(F.col("high"), F.col("q.n"))) & (F.least(F.col("q.n") - F.col("q.i"), F.col("after")) >= needed)
    met = q.join(g, (F.col("q.token") == F.col("g.token")) & (F.col("q.comp") != F.col("g.comp")) & fits)
    met = common.stage(met.select("g.part", F.col("q.rid").alias("id")).distinct(), "met")
    more = compare(docs, members_of(groups, met), met, percent, width)
    for used in (matrix, across, met, groups, reps):
        common.discard(used)
    comps = components(links.unionByName(more))

    owner = keys.join(comps, keys["rid"] == comps["id"], "left").select("key", F.coalesce("comp", "rid").alias("comp"))
    empty = F.when(F.col("n") == 0, F.col("doc_id"))
    return rows.select("doc_id", "n", "key").join(owner, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", empty)).alias("component_id"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) END AS t FROM d),
n AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(t) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * n_both >= 80 * (na.n + nb.n - n_both)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(c.b, n.doc_id)) AS component_id FROM n LEFT JOIN c ON c.a = n.doc_id
"""
