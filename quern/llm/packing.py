"""Best-fit packing of tokenised documents into sequences of fixed length.

A document is its token ids and an end id. Longer ones are cut into whole-sequence pieces; only the first piece may be
shorter. Only the number of pieces of each length matters for the plan, so the plan is made on a histogram of at
most `room` counts, whatever the number of documents:

1. the longest length left takes the single length, pair or triple of lengths that fills its gap exactly, as many
   times as the counts allow (longest parts first), again and again;
2. what no combination fills is packed best-fit: each length, longest first, goes to the bin with the
   least sufficient room, equal bins being handled together. The exact stage spares the shortest lengths for it, as many as
   make the shortest plan.

Each piece then finds its place by its rank among the pieces of its length. Ranks come from counts of (task, length),
so no task sees all pieces of one length.

Null and empty texts are the end id alone. Repeated rows are packed each; a null doc_id stays null. A text of any length is
tokenised whole and cut into pieces; a worker holds one slice of texts, or one long text, at a time. Equal lengths are
placed in the order of task and row. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common

ROOM, END_ID = 2048, 0
#: The vocabulary, and the same vocabulary as ranks for a faster encoder.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: In a text, this is one special token.
SPECIAL = "<|endoftext|>"
#: Lengths under room / d are spared by the exact stage, for each d that is tried beside sparing none.
SPARED = (16, 8, 6, 5, 4, 3, 2)
#: Characters of the texts that a worker tokenises at a time.
SLICE = 400_000
#: Texts of these characters alone are split into words alike by the tokenizer file and by the faster encoder of its ranks, whatever release
#: of Unicode each knows.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u017f]*")


class Encoder:
    """Ids of texts by the tokenizer file. Plain texts go through an encoder of the same ranks, which is several times faster; a text with
    other characters or with the special token goes through the tokenizer itself."""

    def __init__(self, file: str, ranks: str = RANKS):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(ranks), "rb") as lines:
            pairs = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(file))

    def exact(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if SPECIAL in text or not _PLAIN.fullmatch(text):
            return self.exact(text)
        return array("I", self.fast.encode_ordinary(text)).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(file: str = TOKENIZER) -> Encoder:
    """One for each worker."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def cut(ids: bytes, room: int) -> Iterator[tuple[int, int]]:
    """(start, length) of each piece, in tokens."""
    n = len(ids) // 4
    at, size = 0, n % room or room
    while at < n:
        yield at, min(size, n - at)
        at, size = at + size, room


def pieces(docs: DataFrame, room: int = ROOM, end_id: int = END_ID, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pieces of every document, with the task that made them and their rank among its pieces of that length. A worker
    yields the pieces of one slice of texts before it reads the next."""
    end = np.array([end_id], "<u4").tobytes()
    columns = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "task": pa.int32(), "local": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), [0] * (room + 1)
        for batch in batches:
            for at, texts in common.slices(batch.column(1), SLICE):
                out: list[list] = [[] for _ in columns]
                for doc_id, text in zip(batch.column(0).slice(at, len(texts)).to_pylist(), texts, strict=True):
                    ids = words.encode(text or "") + end
                    for k, (start, length) in enumerate(cut(ids, room)):
                        for column, value in zip(out, (doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, seen[length]), strict=True):
                            column.append(value)
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, columns.values(), strict=True)], names=list(columns))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local long")


def pair(left: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
    """Two lengths of at most `most` with pieces left that sum to the total; the longest first part wins."""
    low, high = (total + 1) // 2, min(most, total - 1)
    if high < low:
        return None
    a = np.arange(high, low - 1, -1)
    ok = (left[a] > 0) & (left[total - a] > (2 * a == total))
    hit = int(np.argmax(ok))
    return (int(a[hit]), int(total - a[hit])) if ok[hit] else None


def fill(left: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three lengths with pieces left that sum to the gap exactly: the fewest, then the longest first part."""
    if gap <= 0:
        return None
    if left[gap] > 0:
        return (gap,)
    if found := pair(left, gap, gap):
        return found
    for a in np.flatnonzero(left[1:gap])[::-1] + 1:
        if 3 * a < gap:
            break
        left[a] -= 1
        found = pair(left, gap - int(a), int(a))
        left[a] += 1
        if found:
            return (int(a), *found)
    return None


Patterns = list[tuple[tuple[int, ...], int]]


def exact(left: np.ndarray, room: int) -> Patterns:
    """Patterns that fill a sequence exactly, taken from the counts left, in the order in which they are found."""
    out: Patterns = []
    for top in range(room, 0, -1):
        while left[top] > 0:
            left[top] -= 1
            found = () if top == room else fill(left, room - top)
            left[top] += 1
            if found is None:
                break
            parts = (top, *found)
            times = min(int(left[p]) // parts.count(p) for p in set(parts))
            for p in parts:
                left[p] -= times
            out.append((parts, times))
    return out


def best_fit(left: np.ndarray, room: int) -> Patterns:
    """Each length, longest first, goes to the sequence with the least sufficient room; equal sequences are handled together."""
    bins: dict[int, list[list]] = {}  # room left: [parts, how many]
    for top in range(room, 0, -1):
        n = int(left[top])
        while n:
            gap = next((g for g in range(top, room + 1) if bins.get(g)), None)
            if gap is None:
                fit = room // top  # new ones take as many of this length as they hold
                whole, part = divmod(n, fit)
                for parts, times in (((top,) * fit, whole), ((top,) * part, min(part, 1))):
                    if times:
                        bins.setdefault(room - len(parts) * top, []).append([parts, times])
                break
            parts, times = bins[gap][-1]
            use = min(times, n)
            bins[gap][-1][1] -= use
            if not bins[gap][-1][1]:
                bins[gap].pop()
            bins.setdefault(gap - top, []).append([(*parts, top), use])
            n -= use
    return [(tuple(parts), times) for same in bins.values() for parts, times in same]


def plan(counts: dict[int, int], room: int = ROOM) -> tuple[Patterns, int]:
    """Patterns of lengths and how many sequences follow each, and how many sequences, from the first on, exact combinations fill; every
    counted piece has one place. Exact combinations are taken from lengths of at least a limit, and all of them stand; what is
    left, with the shorter lengths spared for it, is packed best-fit. Of a few limits the one with the shortest plan is taken, and of those
    the one that fills most sequences exactly; a plan that needs no more sequences than the tokens fill ends the search."""
    left = np.zeros(room + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    need = -(-int((left * np.arange(room + 1)).sum()) // room)
    best, score = ([], 0), None
    for limit in (1, *(max(1, room // d) for d in SPARED)):
        now = left.copy()
        now[:limit] = 0
        filled = exact(now, room)
        now[:limit] = left[:limit]
        rest = best_fit(now, room)
        n, more = (sum(times for _, times in part) for part in (filled, rest))
        if score is None or (n + more, -n) < score:
            best, score = (filled + rest, n), (n + more, -n)
        if n + more == need:
            break
    return best


def places(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length, ranges of ranks [first, last) with the sequence of the first rank and the offset there."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for parts, times in patterns:
        offset = 0
        for length in parts:
            first = used.get(length, 0)
            rows.append((length, first, sequence, offset))
            used[length] = first + times
            offset += length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(docs: DataFrame, room: int = ROOM, end_id: int = END_ID, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every piece with its sequence, its offset there, and whether an exact combination made the sequence."""
    spark = docs.sparkSession
    cut_up = common.stage(pieces(docs, room, end_id, tokenizer), "pack-pieces")
    per_task = cut_up.groupBy("task", "length").agg(F.count("*").alias("n"))
    per_task = common.stage(per_task, "pack-counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `room` rows
    patterns, n_exact = plan(counts, room)
    table = places(patterns)  # its rows are bounded by the lengths, not by the documents
    found = {int(k): v for k, v in table.groupby("length")} if len(table) else {}
    where = spark.sparkContext.broadcast({k: (v["first"].to_numpy(), v["sequence"].to_numpy(), v["offset"].to_numpy()) for k, v in found.items()})
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    # tasks grow with the input, so their counts are joined by a shuffle of the pieces, which are a few numbers each
    ranked = cut_up.join(shift.hint("shuffle_hash"), ["task", "length"]).withColumn("rank", F.col("local") + F.col("shift")).drop("task", "local", "shift")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = where.value
        for frame in frames:
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            length, rank = frame["length"].to_numpy(), frame.pop("rank").to_numpy()
            for value in np.unique(length):
                rows = np.nonzero(length == value)[0]
                first, start, at = lookup[int(value)]
                k = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows], offset[rows] = start[k] + rank[rows] - first[k], at[k]
            yield frame.assign(sequence_id=sequence, offset=offset, exact=sequence < n_exact)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, "rank").mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, exact boolean")


def op2_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
