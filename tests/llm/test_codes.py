"""Product codes of vectors against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from quern.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, text string, code string, error long, _label string"


def brute(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label). {row: (code, error, sha)} by exhaustive search with Python's integers, of one length of vectors."""
    ints = [[math.floor(x) * 4096 if abs(x) > 2**53 else math.floor(x * 4096) for x in v] for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))
    size = len(ints[0])
    at = [0]
    for k in range(parts):
        at.append(at[-1] + size // parts + (k < size % parts))
    cut = [[v[a:b] for a, b in zip(at, at[1:])] for v in ints]
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]
    near = lambda part, book: min((sum((x - y) ** 2 for x, y in zip(part, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(v[p], books[p])[1] for v in cut]
            for e in range(len(books[p])):
                mine = [v[p] for v, k in zip(cut, own) if k == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)] if size >= parts or mine[0] else []
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    return [("".join(f"{k:02x}" for _, k in f), min(codes.MOST, sum(d for d, _ in f)), sha) for f in found]


def compare(spark, rows):
    frame = spark.createDataFrame([(*r, "t", "c", 1, "l") for r in rows], SCHEMA).repartition(3)
    got = codes.compress(frame)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    want = []
    for size in {len(v) for _, v, _ in kept}:
        own = [r for r in kept if len(r[1]) == size]
        want += [(r[0], r[2], *b) for r, b in zip(own, brute(own))]
    total = {}
    for _, label, _, error, _ in want:
        total[label] = total.get(label, 0) + error
    want = [(i, label, code, error, min(codes.MOST, total[label]), sha) for i, label, code, error, sha in want]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want))


def test_codes_equal_brute_force(spark):
    r = random.Random(4)
    rows = [(k, [r.gauss(0, 1) for _ in range(24)], r.choice([None, 1, 2])) for k in range(150)]
    rows += [(None, [0.5] * 24, 1), (7, None, 2), (8, [None] + [0.0] * 23, 1), (9, [float("nan")] * 24, 1), (10, [float("inf")] * 24, None)]
    rows += [rows[3], rows[3], (3, rows[5][1], None)]  # repeated rows and a repeated id
    rows += [(200 + k, [float(r.randint(0, 1)) for _ in range(24)], 3) for k in range(60)]  # many ties
    compare(spark, rows)


def test_codes_of_odd_lengths_and_sizes(spark):
    r = random.Random(5)
    rows = [(k, [], None) for k in range(3)] + [(k, [r.random() for _ in range(5)], 1) for k in range(9)]
    rows += [(50 + k, [r.gauss(0, 1) * 10.0 ** r.choice([0, 4, 30, 200]) for _ in range(8)], k % 2) for k in range(40)]
    compare(spark, rows)
    assert codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, 1, "", "", 1, "")], SCHEMA)).count() == 0


@pytest.mark.parametrize("scale", [1, 2**40])
def test_tree_equals_scan(scale):
    r = np.random.default_rng(6)
    for _ in range(30):
        book = (r.integers(-9, 9, (16, 3)) * scale).astype(object if scale > 1 else np.int64)
        parts = (r.integers(-12, 12, (500, 3)) * scale).astype(book.dtype)
        code, d2 = codes.nearest(codes.grow(book, list(range(16))), book, parts)
        all_ = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        assert code.tolist() == [row.index(min(row)) for row in all_.tolist()] and d2.tolist() == [min(row) for row in all_.tolist()]


def test_roots_are_rounded_outwards():
    d2 = np.array([*range(1000), 2**53 + 1, 2**60 - 1, 2**62 + 12345], np.int64)
    low, high = codes.roots(d2)
    for x, a, b in zip(d2.tolist(), low.tolist(), high.tolist(), strict=True):
        assert int(a * 2**40) ** 2 <= x << 80 and (math.ceil(b * 2**40)) ** 2 >= x << 80
