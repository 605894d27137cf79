"""Collocations against brute force, with many and with few buckets."""

import collections
import random
import re

import numpy as np
import pytest

from quern.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, task int"


def brute(docs, least=30, percent=80, first=2000):
    """docs: (lang, text). Rows of the result, with Python's integers."""
    f = collections.defaultdict(collections.Counter)
    for lang, text in docs:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        n = sum(c for g, c in count.items() if len(g) == 1)
        candidates = {g: a for g, a in count.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in candidates.items():
            score, _, left, right = min((2000000 * a // (count[g[:j]] + count[g[j:]]), j, count[g[:j]], count[g[j:]]) for j in range(1, len(g)))
            if not any(len(o) > len(g) and 100 * b >= percent * a and any(o[i : i + len(g)] == g for i in range(len(o) - len(g) + 1)) for o, b in candidates.items()):
                rows.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:first])]
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame([(k, t, x, "p", 1, 2) for k, (x, t) in enumerate(docs)], SCHEMA)


def sample(seed):
    r = random.Random(seed)
    vocabulary = ["a", "B", "cé", "d", "È", "f-g", "(h)", "字", "i'j", "k"]
    ends = [*[" "] * 20, "  ", "\t", ", ", ".", "\n", "\x0b", ";x", "! ", " \x1f ", "\xa0"]
    text = lambda: "".join(r.choice(vocabulary) + r.choice(ends) for _ in range(r.randint(0, 160)))
    docs = [(r.choice(["en", "en", "en", None, "und", "fr"]), text()) for _ in range(260)]
    docs += [(x, "a b c d e, " * 30) for x in (None, "und")] + [("en", None), ("en", ""), (None, "  \t\n "), ("xx", "!?")] + [("en", "one Two three four. " * 40)] * 3
    return docs + [("fr", " ".join(["la"] * 5000))]  # overlaps count


@pytest.mark.parametrize("bits", [26, 17])
def test_collocations_equal_brute_force(spark, bits):
    docs = sample(bits)
    got = sorted(tuple(r) for r in collocations.mine(frame(spark, docs).repartition(5), first=40, bits=bits, size=2000).collect())
    want = brute(docs, first=40)
    assert got == want and {x[0] for x in want} == {"en", "und", "fr"} and len(want) > 60


def test_collocations_of_rare_words_and_nothing(spark):
    assert collocations.mine(frame(spark, sample(1)).limit(0)).count() == 0
    assert collocations.mine(frame(spark, [("en", "a b c d"), (None, None)])).count() == 0
    assert collocations.mine(frame(spark, [(None, "a. b. " * 50)])).count() == 0


def test_buckets_of_many_tasks_are_added_in_steps(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FAN", 3)
    r = np.random.default_rng(5)
    rows, total = [], np.zeros(2**17, np.int64)
    for task in range(20):
        counts = np.zeros(2**17, np.uint8)
        own = r.choice(2**17, 3000, replace=False)
        counts[own] = r.integers(1, 9, 3000)
        counts[7], counts[2**16 + 9] = 1, 2
        total += counts
        for batch in collocations.parts(counts, task):
            rows += batch.to_pylist()
    frame = spark.createDataFrame([tuple(x[c] for c in collocations.ROWS.names) for x in rows], collocations.ROWS_SQL).repartition(7)
    bits = collocations.bits_of(frame, 20, 17)
    assert (np.unpackbits(bits, bitorder="little").astype(bool) == (total >= 20)).all() and not bits[7 >> 3] >> 7 & 1 == 0


def test_every_frequent_phrase_passes(spark):
    """Marks of frequent phrases agree with the hashes taken from texts."""
    words = collocations.Words(["en", "fr"], [b"A bb c. d", b"bb c"])
    assert [words.words[c] for c in words.code] == [b"a", b"bb", b"c", b"d", b"bb", b"c"] and words.same.tolist() == [True, True, False, False, True]
    h = collocations.longer(words.hash[:-1], words.word_hash[1:])
    rows = spark.createDataFrame([("en", "a bb", 1), ("fr", "bb c", 1)], "lang string, phrase string, n long")
    bits = collocations.bits_of(collocations.frequent_of(rows, 2, 30, 18), 30, 18)
    assert collocations.has(bits, collocations.mark(h, 18)).tolist() == [True, False, False, False, True]
