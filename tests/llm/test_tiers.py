"""Packing into windows of several lengths: every token once, full windows, balanced steps, and the ids of the tokenizer."""

import collections
import random
import zlib

import numpy as np
import pytest

from quern.llm import packing, tiers
from tests.llm.test_llm import odd  # noqa: F401
from tests.conftest import SF

SIZES = (16, 32, 64)


def check_plan(counts, windows, sizes):
    """Parts cover every token of every tail once; all windows but the last one are full."""
    used = collections.defaultdict(list)
    loose = 0
    for tier, parts, times in windows:
        filled = sum(p.size for p in parts)
        assert all(p.count == times for p in parts) and filled <= tier and tier in sizes
        loose += times if filled < tier else 0
        for p in parts:
            for rank in range(p.first, p.first + times):
                used[p.length, rank].append((p.start, p.end))
    assert loose <= 1
    for length, n in counts.items():
        for rank in range(n):
            spans = sorted(used.pop((length, rank)))
            assert spans[0][0] == 0 and spans[-1][1] == length and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert not used


def test_plan_covers_every_token():
    r = random.Random(1)
    for k in range(200):
        lengths = r.sample(range(1, SIZES[-1]), r.randint(0, 12)) if k % 2 else range(1, SIZES[-1])
        counts = {n: r.choice([1, 1, 2, 3, 40]) for n in lengths}
        check_plan(counts, tiers.plan(counts, SIZES), SIZES)
    for counts in ({50: 7}, {33: 1}, {33: 2}, {1: 100}, {63: 64}, {17: 3, 16: 1}):
        check_plan(counts, tiers.plan(counts, SIZES), SIZES)


def test_tails_go_to_their_tiers():
    """With nothing to fill gaps with, tails that fill a window stay in the tier of their length."""
    assert sorted((t, n) for t, _, n in tiers.plan({16: 5, 32: 3}, SIZES)) == [(16, 5), (32, 3)]
    windows = tiers.plan({40: 3, 24: 3, 16: 2}, SIZES)  # the gap of the long window is filled whole from a shorter tier
    assert sorted((t, [p.length for p in parts], n) for t, parts, n in windows) == [(16, [16], 2), (64, [40, 24], 3)]


def test_plan_does_not_grow_with_the_documents():
    r = random.Random(2)
    counts = {n: r.randint(1, 10**9) for n in range(1, 2048)}
    windows = tiers.plan(counts)
    assert sum(n * c for n, c in counts.items()) == sum(sum(p.size for p in parts) * n for _, parts, n in windows)
    assert sum(len(parts) for _, parts, _ in windows) < 200_000


def check(got, texts, step=tiers.STEP):
    """got: pandas. Gapless sequences, whole but for one, ids of the tokenizer, and balanced steps."""
    got = got.sort_values(["sequence_id", "offset"])
    by = got.groupby("sequence_id")
    assert (by["length"].cumsum() - got["length"] == got["offset"]).all() and (got["length"] > 0).all()
    filled, tier = by["length"].sum(), by["tier"].first()
    assert (filled <= tier).all() and (filled < tier).sum() <= 1 and (by["tier"].nunique() == 1).all() and (by["step_id"].nunique() == 1).all()
    assert set(tier) <= set(tiers.TIERS) and (tier[filled < tier] == tiers.TIERS[-1]).all()
    steps = by[["step_id", "tier"]].first().groupby("step_id")["tier"]
    assert (steps.nunique() == 1).all() and (steps.sum() <= step).all()
    per = steps.size().groupby(steps.first())
    assert (per.max() - per.min() <= 1).all()
    w = packing.encoder()
    for doc_id, own in got.groupby("doc_id", dropna=False):
        ids = np.array([*np.frombuffer(w.exact(texts[doc_id] or ""), "<u4"), tiers.END_ID], "<u4")
        own = own.sort_values("start")
        copies = own["length"].sum() // len(ids)
        assert own["length"].sum() == copies * len(ids) and (own["doc_tokens"] == len(ids)).all()
        for start, length, crc in zip(own["start"], own["length"], own["ids_crc32"], strict=True):
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc
        if copies == 1:
            assert (own["length"].cumsum() - own["length"] == own["start"]).all()


def test_tiers_on_odd_rows(odd):  # noqa: F811
    check(tiers.pack(odd).toPandas(), {r["doc_id"]: r["text"] for r in odd.collect()})
    assert tiers.pack(odd.limit(0)).count() == 0


def test_tiers_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = tiers.op11_pack_tiers(spark, SF).toPandas()
    check(got, {r["doc_id"]: r["text"] for r in docs.collect()})
    pieces = got.groupby("doc_id").size()
    whole = got.groupby("doc_id")["doc_tokens"].first() // 2048
    assert (pieces - whole).mean() < 2.5  # a tail is seldom cut


@pytest.mark.parametrize("seed", range(3))
def test_steps_are_balanced(seed):
    """Attention costs of the steps of a tier are alike."""
    r = random.Random(seed)
    counts = {n: r.randint(1, 60) for n in range(1, 2048)}
    windows = tiers.plan(counts)
    found = tiers.places(windows, 500)
    total = 500 + sum(n for _, _, n in windows)
    tier, step = found.steps(np.arange(total))
    costs = np.zeros(total, np.int64)
    costs[:500] = 2048**2
    for own in found.parts.values():
        for first, last, size, sequence in zip(own["first"], own["last"], own["size"], own["sequence"], strict=True):
            costs[sequence : sequence + last - first] += size**2
    for t in set(tier.tolist()):
        sums = np.bincount(step[tier == t] - step[tier == t].min(), costs[tier == t])
        windows_each = np.bincount(step[tier == t] - step[tier == t].min())
        if len(sums) > 4:
            assert windows_each.max() - windows_each.min() <= 1 and sums.max() <= 1.35 * sums.mean(), (t, sums.max() / sums.mean())
