"""Quotes looked up in texts: a stated set of quotes, sent in blocks of counted size, against all texts.

Within a task each text meets the quotes of a block by hashes of what a quote must share with it, so that only pairs that may hold
are compared, and only pairs that do become rows. Texts are never shuffled, and no text meets all quotes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import parsing as P

#: Quotes of a block; words, and letters without spaces, by whose hash quotes and texts meet.
BLOCK, WORDS, LETTERS = 20_000, 8, 16
_ODD, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n values in a row."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * _ODD + h[k : len(h) - n + 1 + k]
    return out


def letters(glued: str, n: int) -> np.ndarray:
    """Hashes of every n letters in a row: a polynomial of their code points."""
    points = np.frombuffer(glued.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if len(points) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(points) - n + 1, np.uint64)
    for k in range(n):
        out = out * _BASE + points[k : len(points) - n + 1 + k]
    return out


@dataclass
class Keys:
    """Hashes of quotes, sorted, with the quote and weight of each."""

    hashes: np.ndarray
    quotes: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, int, int]]) -> Keys:
        rows = sorted(rows)
        return cls(np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))

    def met(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(quotes, weights) of the keys that are among the distinct hashes."""
        h = np.unique(h)
        low, high = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
        hit = np.flatnonzero(high > low)
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b) for a, b in zip(low[hit].tolist(), high[hit].tolist(), strict=True))])
        return self.quotes[at], self.weights[at]


Finder = Callable[[str], list[int]]


def found(texts: DataFrame, quotes: DataFrame, key: str, item: str, finder: Callable[[list[str]], Callable[[], Finder]]) -> DataFrame:
    """(item, key) of the quotes (item, quote) that texts (key, t) hold. `finder` makes of a block of quotes what a task needs to find
    the numbers of those that a text holds."""
    spark = texts.sparkSession
    asked = quotes.select(item, "quote").filter("quote is not null").distinct()
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    types = {c: dict(f.dtypes)[c] for f, c in ((quotes, item), (texts, key))}
    held = texts.select(key, "t").filter("t is not null")
    out = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("quote"), F.lit(blocks)) == b).collect()  # about BLOCK rows
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], finder([r[1] for r in rows])))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items, make = sent.value
            find = make()
            for batch in batches:
                at, hits = [], []
                for k in range(batch.num_rows):
                    own = find(batch.column(1)[k].as_py())
                    hits += own
                    at += [k] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array([items[h] for h in hits]).cast(target), batch.column(0).take(pa.array(at, pa.int64()))], names=[item, key])

        target = _arrow(quotes, item)
        part = held.mapInArrow(run, f"{item} {types[item]}, {key} {types[key]}")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _arrow(frame: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(frame.schema[column].dataType)


@dataclass
class Whole:
    """Quotes that stand word for word in a folded text, at word bounds: met by the hash of their first words."""

    quotes: list[str]

    def __call__(self) -> Finder:
        keys: dict[int, list[tuple[int, int, int]]] = {}
        for k, q in enumerate(self.quotes):
            h = word_hashes(q.split()[:WORDS])
            if len(h):
                keys.setdefault(len(h), []).append((int(runs(h, len(h))[0]), k, 1))
        by_length = {n: Keys.of(rows) for n, rows in keys.items()}

        def find(text: str) -> list[int]:
            words = text.split()
            h, padded = word_hashes(words), f" {' '.join(words)} "
            near = {q for n, own in by_length.items() for q in own.met(runs(h, n))[0].tolist()}
            return [q for q in near if f" {' '.join(self.quotes[q].split())} " in padded]

        return find


@dataclass
class Fuzzy:
    """Quotes of three words or more that a folded text holds as parsing.quoted() says. A text may hold a quote if, without spaces, it holds
    the quote's; or if it holds as many of the quote's neighbouring words, each at most three places on, as are left when 15 % of
    its words are missing (each is in two such pairs)."""

    quotes: list[str]

    def __call__(self) -> Finder:
        pairs, glued, least = [], {}, np.zeros(len(self.quotes), np.int64)
        whole = ["".join(q.split()) for q in self.quotes]
        for k, q in enumerate(self.quotes):
            words = q.split()
            least[k] = max(1, len(words) - 1 - 2 * (len(words) * 15 // 100))
            if len(words) < 3:
                continue
            h, times = np.unique(runs(word_hashes(words), 2), return_counts=True)
            pairs += [(x, k, n) for x, n in zip(h.tolist(), times.tolist(), strict=True)]
            n = min(LETTERS, len(whole[k]))
            glued.setdefault(n, []).append((int(letters(whole[k][:n], n)[0]), k, 1))
        keys, by_length = Keys.of(pairs), {n: Keys.of(rows) for n, rows in glued.items()}

        def find(text: str) -> list[int]:
            words = text.split()
            h, joined = word_hashes(words), "".join(words)
            steps = [_pair(h, s) for s in (1, 2, 3) if len(h) > s]
            met, times = keys.met(np.concatenate([np.zeros(0, np.uint64), *steps]))
            own, at = np.unique(met, return_inverse=True)
            near = set(own[np.bincount(at, times, minlength=len(own)) >= least[own]].tolist()) if len(own) else set()
            for n, k in by_length.items():
                near.update(q for q in k.met(letters(joined, n))[0].tolist() if whole[q] in joined)
            return [q for q in near if P.quoted(self.quotes[q], text)]

        return find


def _pair(h: np.ndarray, step: int) -> np.ndarray:
    """As runs(.., 2) of each word and the one `step` places on."""
    a = h[:-step]
    return (a ^ (a >> np.uint64(29))) * _ODD + h[step:]
