"""Product codes of vectors, with the nearest entry found by a vantage-point tree for each part position.

Vectors become integers, floor(4096 x), and are cut into consecutive parts. Each part position has a codebook of entries. A round
assigns every part to its nearest entry and replaces entries by the floored mean of their parts. Each round is one pass over a
written table: the driver sends the codebooks and their trees, which have a fixed size, and gets back sums by position and
entry, added by Spark; so nothing that grows with the vectors reaches the driver or one task.

A tree node holds an entry (the vantage point) and, for the nearer and the farther half of the other entries, the least and the greatest
distance from it. A query part visits a half unless the triangle inequality puts all of it beyond the best entry so far. Distances are
roots and so are rounded, downwards for bounds and upwards for the best; a half whose bound equals the best is
visited; and entries are compared by their integer squared distances alone, so ties go to the lower index.

Vectors that are null, or hold null or non-finite components, are dropped. Vectors of each length are a table of their own with own
codebooks; a length that 8 does not divide has parts that differ in length by one, the longer first; empty vectors are alike. Fewer vectors
than entries make fewer entries. A null id comes after all others; repeated rows are vectors each, and those that share an id are
ordered by their components. Components of any size are summed exactly; an error or sum that no long holds is the greatest
long. A null label is a label. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors that a worker compares at a time.
BLOCK = 4096
#: From this size of a component on, sums of squares are not taken as longs.
LARGE = 2**24
#: Relative margin of rounded roots: more than conversion, root and subtraction lose.
EPS = 2.0**-50
MOST = 2**63 - 1


@dataclass
class Node:
    """An entry and, of each half of the others, its node and its least and greatest distance from the entry, rounded outwards."""

    entry: int
    halves: list[tuple["Node", float, float]]


def squared(parts: np.ndarray, entry: np.ndarray) -> np.ndarray:
    return ((parts - entry) ** 2).sum(axis=1)


def roots(d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots rounded downwards and upwards; of Python's integers, integers."""
    if d2.dtype == object:
        low = np.array([math.isqrt(x) for x in d2], object)
        return low, low + 1
    r = np.sqrt(d2.astype(np.float64))
    return r * (1 - EPS), r * (1 + EPS)


def grow(codebook: np.ndarray, entries: list[int]) -> Node:
    """The first entry is the vantage point; the others are halved by their distance from it."""
    top, rest = entries[0], entries[1:]
    if not rest:
        return Node(top, [])
    d2 = squared(codebook[rest], codebook[top])
    order = sorted(range(len(rest)), key=lambda k: d2[k])
    halves = []
    for half in (order[: (len(order) + 1) // 2], order[(len(order) + 1) // 2 :]):
        if half:
            low, high = roots(d2[half])
            halves.append((grow(codebook, [rest[k] for k in half]), low.min(), high.max()))
    return Node(top, halves)


def nearest(tree: Node, codebook: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each part's nearest entry, by branch and bound for all parts together."""
    if parts.dtype != codebook.dtype:
        parts, codebook = parts.astype(object), codebook.astype(object)
    best = np.full(len(parts), MOST if parts.dtype != object else 1 << 5000, parts.dtype)
    code = np.zeros(len(parts), np.int64)
    reach = np.full(len(parts), np.inf, object if parts.dtype == object else np.float64)

    def visit(node: Node, rows: np.ndarray) -> None:
        d2 = squared(parts[rows], codebook[node.entry])
        nearer = (d2 < best[rows]) | ((d2 == best[rows]) & (node.entry < code[rows]))
        hit = rows[nearer.astype(bool)]
        best[hit], code[hit] = d2[nearer.astype(bool)], node.entry
        if not node.halves:
            return
        low, high = roots(d2)
        reach[hit] = high[nearer.astype(bool)]
        bounds = [np.maximum(low - most, least - high) for _, least, most in node.halves]
        near = np.zeros(len(rows), np.int64) if len(bounds) == 1 else (bounds[1] < bounds[0]).astype(np.int64)
        for turn in range(len(bounds)):  # the half with the lesser bound first
            for k, (half, _, _) in enumerate(node.halves):
                mine = np.flatnonzero(((near == k) == (turn == 0)) & (bounds[k] <= reach[rows]).astype(bool))
                if len(mine):
                    visit(half, rows[mine])

    visit(tree, np.arange(len(parts)))
    return code, best


def integers(values: np.ndarray) -> np.ndarray:
    """floor(4096 x) as longs, or as Python's integers where a component is large."""
    values = values.astype(np.float64)
    if values.size and np.abs(values).max() >= LARGE / SCALE:
        return np.array([[int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE) for x in row] for row in values.tolist()], object).reshape(values.shape)
    return np.floor(values * SCALE).astype(np.int64)


def bounds_of(size: int, parts: int) -> list[int]:
    """Where parts begin, and the end."""
    return np.cumsum([0, *(size // parts + (k < size % parts) for k in range(parts))]).tolist()


def blocks(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, integers) of runs of at most BLOCK vectors."""
    for at in range(0, batch.num_rows, BLOCK):
        part = batch.column(column).slice(at, BLOCK)
        yield at, integers(part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), size))


def limbs(value: int) -> list[int]:
    """Parts of 32 bits, lowest first; all but the last are not negative."""
    out = []
    while not -(2**31) <= value < 2**31:
        out.append(value & 0xFFFFFFFF)
        value >>= 32
    return [*out, value]


Codebooks = list[np.ndarray]


def sums(vectors: DataFrame, books: Codebooks, size: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(count, componentwise sums) of the vectors' parts at each (position, entry). Each task adds its own; Spark adds those of all tasks,
    in limbs of 32 bits, so that no size of component or number of tasks can overflow."""
    at = bounds_of(size, len(books))
    width = at[1]
    sent = vectors.sparkSession.sparkContext.broadcast((books, [grow(b, list(range(len(b)))) for b in books]))
    names = ["p", "e", "limb", "n", *(f"v{k}" for k in range(width))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = sent.value
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            for _, block in blocks(batch, 0, size):
                for p, (book, tree) in enumerate(zip(books, trees, strict=True)):
                    own = block[:, at[p] : at[p + 1]]
                    code, _ = nearest(tree, book, own)
                    counts[p] += np.bincount(code, minlength=len(book))
                    for e in np.unique(code):
                        totals[p][e] += own[code == e].sum(axis=0).astype(object)
        rows = []
        for p, book in enumerate(books):
            for e in range(len(book)):
                if counts[p][e]:
                    split = [limbs(int(v)) for v in totals[p][e]]
                    for k in range(max([1, *map(len, split)])):
                        rows.append((p, e, k, int(counts[p][e]) if k == 0 else 0, *((s[k] if k < len(s) else 0) for s in split), *([0] * (width - len(split)))))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names=names)

    found = vectors.select("embedding").mapInArrow(common.lean(run), ", ".join(f"{n} long" for n in names))
    found = found.groupBy("p", "e", "limb").agg(*[F.sum(n).alias(n) for n in names[3:]]).collect()  # parts x entries x a few limbs
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in found:
        n, total = out.get((r["p"], r["e"]), (0, [0] * (at[r["p"] + 1] - at[r["p"]])))
        out[r["p"], r["e"]] = n + r["n"], [t + (r[f"v{k}"] << 32 * r["limb"]) for k, t in enumerate(total)]
    return out


def book(rows: list[list[int]]) -> np.ndarray:
    """Entries as longs, or as Python's integers where one is large."""
    large = any(abs(x) >= LARGE for row in rows for x in row)
    return np.array(rows, object if large else np.int64).reshape(len(rows), -1)


def train(vectors: DataFrame, size: int, parts: int, entries: int, rounds: int) -> Codebooks:
    """Codebooks after all rounds, from the first `entries` vectors by id."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    start = integers(np.array([r["embedding"] for r in first]).reshape(len(first), size))
    at = bounds_of(size, parts)
    books = [book(start[:, a:b].tolist()) for a, b in zip(at, at[1:])]
    for _ in range(rounds):
        found = sums(vectors, books, size)
        rows = [b.tolist() for b in books]
        for (p, e), (n, total) in found.items():
            rows[p][e] = [t // n for t in total]
        books = [book(r) for r in rows]
    return books


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for row in b.tolist() for x in row).encode()).hexdigest()


def encoded(vectors: DataFrame, books: Codebooks, size: int) -> DataFrame:
    """vec_id, label, code, error and codebooks_sha256 of every vector."""
    at, sha = bounds_of(size, len(books)), digest(books)
    sent = vectors.sparkSession.sparkContext.broadcast((books, [grow(b, list(range(len(b)))) for b in books]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = sent.value
        for batch in batches:
            for first, block in blocks(batch, 2, size):
                codes, error = [], np.zeros(len(block), object)
                for p, (book, tree) in enumerate(zip(books, trees, strict=True)):
                    code, d2 = nearest(tree, book, block[:, at[p] : at[p + 1]])
                    codes.append(code)
                    error += d2.astype(object)
                text = ["".join(f"{c:02x}" for c in row) for row in np.stack(codes, axis=1).tolist()]
                errors = pa.array([min(MOST, int(x)) for x in error], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(block)), batch.column(1).slice(first, len(block)), pa.array(text), errors], names=["vec_id", "label", "code", "error"])

    label = vectors.schema["label"].dataType.simpleString()
    out = vectors.select("vec_id", "label", "embedding").mapInArrow(common.lean(run), f"vec_id long, label {label}, code string, error long")
    return out.withColumn("codebooks_sha256", F.lit(sha))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every vector that takes part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").filter("embedding is not null").filter(finite)
    lengths = [r["n"] for r in kept.select(F.size("embedding").alias("n")).distinct().orderBy("n").collect()]  # a table has one, or a few
    out = None
    for size in lengths:
        own = kept.filter(F.size("embedding") == size)
        rows = encoded(own, train(own, size, parts, entries, rounds), size)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        label = kept.schema["label"].dataType.simpleString()
        return kept.sparkSession.createDataFrame([], f"vec_id long, label {label}, code string, error long, label_error long, codebooks_sha256 string")
    out = common.stage(out, "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    by_label = common.small(out.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")), 400_000)
    return out.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


def op12_compress_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(common.table(spark, sf_dir, "embeddings")).drop("label")


def _oracle() -> str:
    """Each round is a query of its own. Vectors are taken to be of one length that 8 divides."""
    start = """
k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS i FROM k),
x AS (SELECT i, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS v FROM r, range(8) t(p)),
c0 AS (SELECT p, i AS e, v AS c FROM x WHERE i < 16)"""
    assign = """
a{k} AS MATERIALIZED (
  SELECT i, p, min(d * 16 + e) % 16 AS e, min(d * 16 + e) // 16 AS d FROM (
    SELECT x.i, x.p, c.e, CAST(list_sum(list_transform(list_zip(x.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM x JOIN c{k} c ON c.p = x.p) GROUP BY i, p)"""
    mean = """
m{k} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM (
    SELECT x.p, a.e, j, CAST(sum(x.v[j]) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{k} a ON a.i = x.i AND a.p = x.p, unnest(range(1, len(x.v) + 1)) u(j) GROUP BY ALL) GROUP BY p, e),
c{n} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN m{k} m ON m.p = c.p AND m.e = c.e)"""
    steps = [start] + [part.format(k=k, n=k + 1) for k in range(ROUNDS) for part in (assign, mean)] + [assign.format(k=ROUNDS)]
    end = """
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{k}),
o AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{k} GROUP BY i)
SELECT r.vec_id, o.code, o.error, CAST(sum(o.error) OVER (PARTITION BY r.label) AS BIGINT) AS label_error, h.codebooks_sha256 FROM r JOIN o ON o.i = r.i, h""".format(k=ROUNDS)
    return "WITH" + ",".join(steps) + "," + end


OP12_SQL = _oracle()
