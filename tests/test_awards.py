"""Copies of awards, names and claims against sequential versions."""

import datetime
import random
import time

import pytest

from quern.operators import awards

SCHEMA = "row long, source string, winners array<string>, amount double, day date, buyer string, bids int, framework boolean, others array<string>, part string"
DAY = datetime.date(2026, 1, 1)


def award(row, source="T", winners=("Firm SA",), amount=100.0, day=0, buyer="B", bids=None, framework=False, others=()):
    return (row, source, None if winners is None else list(winners), amount, None if day is None else DAY + datetime.timedelta(day), buyer, bids, framework, list(others), "x")


def key(winners):
    return sorted(w.lower().replace(" sa", "").replace("ste ", "") for w in winners or [] if w)


def sequential(rows):
    """The list as it stands, from the last to the first, one removal at a time."""
    def info(x):
        return (2 if x[3] and x[3] > 0 else 0) + (1 if x[6] else 0) + (1 if x[7] else 0) + len(x[8])

    def copies(x, y):
        if not key(x[2]) or key(x[2]) != key(y[2]) or x[4] is None or y[4] is None:
            return False
        a, b = (v if v and v > 0 else None for v in (x[3], y[3]))
        if x[1] == y[1]:
            return a is not None and a == b and x[4] == y[4] and x[5].lower() == y[5].lower()
        return (abs(a - b) <= 0.02 * max(a, b) if a and b else not a and not b) and abs((x[4] - y[4]).days) <= 90

    left, gone = sorted(rows), {}
    for x in reversed(sorted(rows)):
        if x not in left:
            continue
        y = next((y for y in left if y is not x and copies(x, y)), None)
        if y is not None:
            drop, kept = (y, x) if info(x) >= info(y) else (x, y)
            left.remove(drop)
            gone[drop[0]] = kept[0]
    return {r[0]: gone.get(r[0]) for r in rows}


def found(spark, rows):
    return {r["row"]: r["copy_of"] for r in awards.without_copies(spark.createDataFrame(rows, SCHEMA)).collect()}


HAND = [
    ([award(1), award(2, "D")], {1: 2, 2: None}),  # as much is said: the other goes
    ([award(1, bids=3), award(2, "D")], {1: None, 2: 1}),
    ([award(1), award(2, "D", amount=102.0), award(3, "D", amount=103.0)], {1: 2, 2: None, 3: None}),
    ([award(1), award(2, "D", day=90), award(3, "E", day=181)], {1: 2, 2: None, 3: None}),
    ([award(1), award(2, "D", day=90, bids=2), award(3, "E", day=180)], {1: 2, 2: None, 3: 2}),  # a copy of a copy
    ([award(1), award(2), award(3, day=1), award(4, buyer="b")], {1: 4, 2: None, 3: None, 4: 2}),
    ([award(1, amount=None), award(2, amount=None), award(3, "D", amount=None, day=80)], {1: 3, 2: None, 3: 2}),
    ([award(1, winners=()), award(2, "D", winners=None), award(3, winners=("",)), award(4, day=None)], {1: None, 2: None, 3: None, 4: None}),
]


@pytest.mark.parametrize("k", range(len(HAND)))
def test_copies_by_hand(k):
    rows, want = HAND[k]
    assert sequential(rows) == want


def test_copies_equal_the_sequence(spark):
    r = random.Random(6)
    rows = []
    for k, (hand, _) in enumerate(HAND):  # under winners of their own
        rows += [(1000 * (k + 1) + x[0], x[1], None if x[2] is None else [f"{w} {k}" if w else w for w in x[2]], *x[3:]) for x in hand]
    for k in range(700):
        amount = r.choice([None, 0.0, 100.0, 101.5, 103.0, 98.0, 5000.0, 5100.0])
        rows.append(award(k, r.choice("TDU"), [r.choice(["Firm A SA", "ste Firm A", "Firm B", "Firm C"])] + (["Z"] if r.random() < 0.1 else []), amount, r.randint(0, 900), r.choice(["B", "b", "C"]), r.choice([None, 0, 4]), r.random() < 0.2, ["o"] * r.randint(0, 2)))
    got = found(spark, rows)
    want = sequential(rows)
    assert got == want and 100 < sum(v is not None for v in got.values()) < 600
    assert awards.without_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_of_one_firm_in_seconds(spark):
    """40,000 awards of one firm that all days and amounts connect: every award met with every other takes minutes."""
    r = random.Random(8)
    rows = [award(k, "TD"[k % 2], ["Firm"], r.choice([None, 100.0 * 1.01 ** r.randint(0, 300)]) if k % 9 else 200.0, r.randint(0, 900), str(r.randint(0, 50)), r.randint(0, 2)) for k in range(40_000)]
    frame = spark.createDataFrame(rows, SCHEMA).cache()
    frame.count()
    start = time.monotonic()
    got = {x["row"]: x["copy_of"] for x in awards.without_copies(frame).collect()}
    assert time.monotonic() - start < 60 and len(got) == 40_000
    few = [x for x in rows if x[0] < 3000]
    assert found(spark, few) == sequential(few)


def test_names_meet_as_all_pairs_do(spark):
    from pyspark.sql import functions as F

    from quern.operators import names

    r = random.Random(7)
    vocabulary = "centre communal action sociale bourgoin jallieu agence technique hospitalier service ville lyon paris nord sud regional departement".split()
    def one():
        w = r.sample(vocabulary, r.randint(1, 6))
        return " ".join([r.choice(["", "", "de "]) + x + r.choice(["", "", "s"]) for x in w] + ([r.choice(["ccas", "CCAS", "at", "sv"])] if r.random() < 0.3 else []))
    asked = spark.createDataFrame([(k, one()) for k in range(90)] + [(900, "CCAS de Bourgoin-Jallieu"), (901, None), (902, ""), (903, "A1")], "ask long, name string")
    rows = [(k, one(), k % 3 == 0, r.choice(["Lyon", "12 rue X Paris", None])) for k in range(300)]
    rows += [(900, "Centre communal d'action sociale de Bourgoin Jallieu", True, "x"), (901, None, True, None)]
    registry = spark.createDataFrame(rows, "id long, name string, public boolean, place string")
    every = asked.crossJoin(registry.withColumnRenamed("name", "other")).withColumn("s", names.A.name_match(names.words("name"), names.words("other")))
    want = {(x["ask"], x["id"]) for x in every.filter("s >= 0.6").collect()}
    got = {(x["ask"], x["id"]) for x in names.pairs(asked, registry).collect()}
    assert want <= got and len(want) > 100 and len(got) < 0.5 * 90 * 300
    best = {x["ask"]: (x["id"], x["similarity"]) for x in names.best_match(asked, registry).collect()}
    assert best[900] == (900, 1.0) and all(s >= 0.6 for _, s in best.values())
    public = {x[0] for x in rows if x[2]}
    assert all(k in public or s >= 0.85 for k, s in best.values())


def test_claims_by_hand(spark):
    from pyspark.sql import functions as F

    from quern.operators import claims

    cases = {"for 1 234,50 EUR": [1234.5], "1.234,5 and 12.5": [1234.5, 12.5], "3 k€ or 2,5 MEUR": [3000.0, 2500000.0], "1.234.567": [1234567.0], "v2.0 x3 none": [], "": [], "10 000 à 12": [10000.0, 12.0]}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", claims.numbers(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == cases
    assert claims.superlatives("our best and bestest, garantir, a leader's top-5", "en") == {"best", "leader", "top"}
    assert claims.superlatives("solution garantie, garantir, meilleurs; n°1", "fr") == {"garanti", "meilleur", "n°1"}
    assert claims.named("Our Team met Anna Berg. Paris is near Lyon, not in UK. Project Plan") == ["Anna Berg", "Lyon"]
    own = claims.Facts(("Acme Leader Group", "Berg"), ("Rated best by all",))
    assert own.unsupported("Acme Leader Group is the best, leading top firm", "en") == ["leading", "top"]
    assert own.unknown("We met Anna Berg and Carl Meyer of Acme Leader [TO FILL: Some Name]") == ["Carl Meyer"]
    texts = spark.createDataFrame([(1, "a", "en", "We know Carl Meyer for 12,50 EUR"), (2, "b", "fr", "garanti"), (3, "c", "xx", None), (None, "d", "en", "top 7")], "tender long, path string, language string, text string")
    facts = spark.createDataFrame([(1, 12.504, None, None), (1, None, "Carl Meyer", None), (None, 7.0, None, "top")], "tender long, number double, name string, claim string")
    assert sorted((r["tender"] or 0, r["kind"], r["found"]) for r in claims.violations(texts, facts, "tender").collect()) == [(0, "claim", "top"), (0, "number", "7.0"), (2, "claim", "garanti")]
