"""Hierarchical packing of tokenised documents into windows of several lengths, in balanced step groups.

A document is its token ids and an end id. Whole windows of the greatest length are cut from its front. The tail that is left goes to the
shortest tier (a window length, a power of two) that holds it. Tiers are packed from the longest down: each of a tier's tails opens a window,
whose gap is filled from what is left of shorter tiers, exactly by one or two tails where lengths allow, else by the longest that fits;
a gap shorter than all that is left is filled by cutting the front from the longest tail, whose rest goes to the tier of its
new length. So every window is full, but for one at the end at most, which is padded to the greatest length.

Only counts of tail lengths matter for the plan: it is made for runs of equal tails at once, on a table that grows with the number
of lengths, not of documents. Each tail then finds its parts by its rank among the tails of its length; ranks come from
counts of (task, length), so no task sees all tails of one length.

Windows of a tier are ordered by attention cost, the sum of squared lengths of their parts, and dealt to steps to and fro, so that steps
of a tier hold as many windows as each other, but for one, of like cost.

Null and empty texts are the end id alone. Repeated rows are packed each; a null doc_id stays null. A text of any length is tokenised whole;
a worker holds one slice of texts, or one long text, at a time. Equal lengths are placed in the order of task and row. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common, packing

#: Window lengths, ascending powers of two; the id after each document; tokens of a step group.
TIERS, END_ID, STEP = (256, 512, 1024, 2048), 1, 65_536
#: Rows of a table of (task, length) up to which it is broadcast.
SENT = 400_000


@dataclass(frozen=True)
class Run:
    """Tokens [start, end) of the tails of one length that have ranks [first, first + count)."""

    length: int
    start: int
    end: int
    first: int
    count: int

    @property
    def size(self) -> int:
        return self.end - self.start

    def split(self, n: int) -> tuple[Run, Run]:
        """The first n tails and the others."""
        return replace(self, count=n), replace(self, first=self.first + n, count=self.count - n)

    def cut(self, n: int) -> tuple[Run, Run]:
        """The first n tokens of each tail and the others."""
        return replace(self, end=self.start + n), replace(self, start=self.start + n)


Windows = list[tuple[int, list[Run], int]]


class Left:
    """Runs that wait for a window, by size."""

    def __init__(self, counts: dict[int, int], room: int):
        self.runs: list[list[Run]] = [[] for _ in range(room + 1)]
        self.there = np.zeros(room + 1, bool)
        for length, n in counts.items():
            self.put(Run(length, 0, length, 0, n))

    def put(self, run: Run) -> None:
        self.runs[run.size].append(run)
        self.there[run.size] = True

    def take(self, size: int, most: int | None = None) -> Run:
        """A run of that size, of at most so many tails."""
        run = self.runs[size].pop()
        if most is not None and run.count > most:
            run, other = run.split(most)
            self.runs[size].append(other)
        self.there[size] = bool(self.runs[size])
        return run

    def longest(self, low: int, high: int) -> int | None:
        """The greatest size in (low, high] that waits."""
        found = np.flatnonzero(self.there[low + 1 : high + 1])
        return int(found[-1]) + low + 1 if len(found) else None

    def fitting(self, gap: int) -> int | None:
        """The size that fills the gap exactly, alone or with another, else the longest below it."""
        if self.there[gap]:
            return gap
        half = np.arange(gap - 1, gap // 2, -1)
        both = self.there[half] & self.there[gap - half]
        return int(half[np.argmax(both)]) if both.any() else self.longest(0, gap)


def plan(counts: dict[int, int], tiers: tuple[int, ...] = TIERS) -> Windows:
    """(tier, parts, how many windows) for tails below the greatest tier; every token of every counted tail has one place. The last window
    alone may not be full."""
    left, windows = Left(counts, tiers[-1]), []
    for tier, below in zip(reversed(tiers), [*reversed(tiers[:-1]), 0], strict=True):
        while (top := left.longest(below, tier)) is not None:
            first = left.take(top)
            groups = [([first], first.count)]
            while groups:
                parts, times = groups.pop()
                gap = tier - sum(p.size for p in parts)
                if gap == 0:
                    windows.append((tier, parts, times))
                    continue
                size = left.fitting(gap) or left.longest(gap, tiers[-1])
                if size is None and groups:  # nothing waits: another group's parts fill this one
                    for run in groups.pop()[0]:
                        left.put(run)
                    groups.append((parts, times))
                elif size is None and times > 1:  # some windows of the group fill the others
                    keep = max(1, times * (tier - gap) // tier)
                    both = [p.split(keep) for p in parts]
                    for _, freed in both:
                        left.put(freed)
                    groups.append(([kept for kept, _ in both], keep))
                elif size is None:
                    windows.append((tiers[-1], parts, times))  # the last window, not full
                else:
                    run = left.take(size, times)
                    if run.count < times:
                        both = [p.split(run.count) for p in parts]
                        groups.append(([other for _, other in both], times - run.count))
                        parts = [mine for mine, _ in both]
                    if run.size > gap:
                        run, rest = run.cut(gap)
                        left.put(rest)
                    groups.append(([*parts, run], run.count))
    return windows


@dataclass
class Places:
    """Where everything is: for each tail length, columns of its parts; for each tier, numbers of its windows and steps."""

    parts: dict[int, dict[str, np.ndarray]]
    tiers: np.ndarray
    first_sequence: np.ndarray
    n_steps: np.ndarray
    first_step: np.ndarray

    def steps(self, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tier and step of each sequence. In its tier the sequences, costly ones first, are dealt to and fro."""
        tier = np.searchsorted(self.first_sequence, sequence, "right") - 1
        n = self.n_steps[tier]
        rank = sequence - self.first_sequence[tier]
        turn, at = rank // n, rank % n
        return self.tiers[tier], self.first_step[tier] + np.where(turn % 2 == 0, at, n - 1 - at)


def places(windows: Windows, whole: int, tiers: tuple[int, ...] = TIERS, step: int = STEP) -> Places:
    """Numbers of all windows: tiers from the longest down, costly windows first; the `whole` ones that one document fills are the very first."""
    rows: dict[int, list[tuple]] = {}
    own, sequence, firsts, steps, first_steps, step_id = sorted(set(tiers), reverse=True), 0, [], [], [], 0
    for tier in own:
        firsts.append(sequence)
        first_steps.append(step_id)
        if tier == tiers[-1]:
            sequence += whole
        mine = [w for w in windows if w[0] == tier]
        for _, parts, times in sorted(mine, key=lambda w: -sum(p.size**2 for p in w[1])):
            offset = 0
            for p in parts:
                rows.setdefault(p.length, []).append((p.first, p.first + times, p.start, p.size, sequence, offset))
                offset += p.size
            sequence += times
        steps.append(max(1, -(-(sequence - firsts[-1]) // max(1, step // tier))))
        step_id += steps[-1]
    names = ("first", "last", "start", "size", "sequence", "offset")
    parts = {length: dict(zip(names, np.array(r, np.int64).T, strict=True)) for length, r in rows.items()}
    return Places(parts, *(np.array(x, np.int64) for x in (own, firsts, steps, first_steps)))


def halves(ids: bytes) -> bytes:
    """The low 16 bits of all ids, then the high ones, which are alike and so take no room once compressed."""
    return np.frombuffer(ids, "<u2").reshape(-1, 2).T.tobytes()


COLUMNS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int32(), "doc_tokens": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary(), "task": pa.int32(), "local": pa.int64()}


def tails(docs: DataFrame, room: int, end_id: int, tokenizer: str) -> DataFrame:
    """Whole windows with their checksum, and tails with their ids, of every document, each with its rank among those of its length in its task."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, seen = packing.encoder(tokenizer), TaskContext.get().partitionId(), [0] * (room + 1)
        for batch in batches:
            for at, texts in common.slices(batch.column(1), packing.SLICE):
                out: list[list] = [[] for _ in COLUMNS]
                for doc_id, text in zip(batch.column(0).slice(at, len(texts)).to_pylist(), texts, strict=True):
                    ids = words.encode(text or "") + end
                    n = len(ids) // 4
                    for start in range(0, n, room):
                        own = ids[4 * start : 4 * (start + room)]
                        length = len(own) // 4
                        known = (zlib.crc32(own), None) if length == room else (None, halves(own))
                        for column, value in zip(out, (doc_id, start, length, n, *known, task, seen[length]), strict=True):
                            column.append(value)
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, COLUMNS.values(), strict=True)], names=list(COLUMNS))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.lean(run), "doc_id long, start long, length int, doc_tokens long, ids_crc32 long, ids binary, task int, local long")


def placed(found: Places, length: np.ndarray, rank: np.ndarray, room: int) -> np.ndarray:
    """(row, start, size, sequence, offset) of every part of the given rows."""
    out = []
    for value in np.unique(length):
        rows = np.flatnonzero(length == value)
        if value == room:
            out.append(np.stack([rows, np.zeros_like(rows), np.full_like(rows, room), rank[rows], np.zeros_like(rows)]))
            continue
        rows = rows[np.argsort(rank[rows])]
        own = found.parts[int(value)]
        low, high = (np.searchsorted(rank[rows], own[side]) for side in ("first", "last"))
        part = np.repeat(np.arange(len(low)), high - low)
        at = rows[np.arange(len(part)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[part]]
        out.append(np.stack([at, own["start"][part], own["size"][part], own["sequence"][part] + rank[at] - own["first"][part], own["offset"][part]]))
    return np.concatenate([np.zeros((5, 0), np.int64), *out], axis=1)


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, tokenizer: str = packing.TOKENIZER, step: int = STEP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the sequence's padded length) and step_id of every piece."""
    spark, room = docs.sparkSession, tiers[-1]
    cut_up = common.stage(tails(docs, room, end_id, tokenizer), "tier-tails")
    per_task = common.stage(cut_up.groupBy("task", "length").agg(F.count("*").alias("n")), "tier-counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `room` rows
    whole = counts.pop(room, 0)
    where = spark.sparkContext.broadcast(places(plan(counts, tiers), whole, tiers, step))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = cut_up.join(common.small(shift, SENT), ["task", "length"])
    ranked = ranked.select("doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids", (F.col("local") + F.col("shift")).alias("rank"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
            row, start, size, sequence, offset = placed(where.value, number("length"), number("rank"), room)
            order = np.argsort(row, kind="stable")
            row, start, size, sequence, offset = (x[order] for x in (row, start, size, sequence, offset))
            crc, at, own = [], -1, None
            for k, a, n in zip(row.tolist(), start.tolist(), size.tolist(), strict=True):
                if k != at:
                    at, ids = k, batch.column("ids")[k].as_py()
                    own = None if ids is None else np.frombuffer(ids, "<u2").reshape(2, -1).T
                crc.append(batch.column("ids_crc32")[k].as_py() if own is None else zlib.crc32(own[a : a + n].tobytes()))
            tier, step_id = where.value.steps(sequence)
            take = pa.array(row)
            columns = [batch.column("doc_id").take(take), pa.array(number("start")[row] + start), pa.array(size), pa.array(crc, pa.int64()), batch.column("doc_tokens").take(take), pa.array(sequence), pa.array(offset), pa.array(tier.astype(np.int32)), pa.array(step_id)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return ranked.mapInArrow(common.lean(place), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long")


def op11_pack_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
