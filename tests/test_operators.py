"""Tiny frames with exact rows."""

import datetime as dt
import itertools
import json
import random
import time

from pyspark.sql import functions as F

from quern.functions import parsing as P
from quern.functions import text as T
from quern.operators import dates, decide, deck, market, quality, rank, retrieval
from quern.operators import matching as M
from quern.sources import readers, sinks
from quern.streaming import runs
from tests.conftest import SF


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


def test_text(spark):
    assert one(spark, T.fold(F.lit("L'Été: 2e édition!"))) == "l ete 2e edition"
    assert one(spark, T.tokenize(F.lit("The Café of the années 90"))) == ["cafe", "annees", "90"]
    assert one(spark, T.fnv(F.lit("abc"))) == "7ai9xn" or len(one(spark, T.fnv(F.lit("abc")))) > 0
    h = 0x811C9DC5
    for c in "abc":
        h = ((h ^ ord(c)) * 0x01000193) % 2**32
    assert int(one(spark, T.fnv(F.lit("abc"))), 36) == h
    assert one(spark, T.firm_key(F.lit("Sté Nachd S.A.S"))) == "nachd"
    assert one(spark, T.firm_key(F.lit("SA"))) == "sa"
    assert one(spark, T.dice(T.name_tokens(F.lit("data platforms")), T.name_tokens(F.lit("data platform")))) == 1.0
    assert one(spark, T.money(F.lit("1.234.567,89 EUR"))) == 1234567.89
    assert one(spark, T.money(F.lit("none"))) is None
    assert one(spark, T.without_parameters(F.lit("HTTPS://A.example:443/x/?q=1&ref=2#t"), ["ref"])) == "https://a.example/x/?q=1"
    assert one(spark, T.strip_markup(F.lit("<p>a &amp; b</p><script>x</script>"))) == "a & b"


def test_chunks(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(200)))), (2, " ".join(map(str, range(201)))), (3, ""), (4, None), (5, " ".join(map(str, range(500))))], "doc_id long, text string")
    n = {r[0]: r[1] for r in retrieval.chunk(docs).groupBy("doc_id").count().collect()}
    assert n == {1: 1, 2: 2, 3: 1, 4: 1, 5: 3}


def test_bm25_negative_idf_has_a_floor(spark):
    chunks = spark.createDataFrame([(1, 0, "alpha beta"), (2, 0, "alpha gamma"), (3, 0, "alpha delta")], "doc_id long, chunk_no int, chunk string")
    asked = spark.createDataFrame([(7, "alpha beta")], "query_id long, text string")
    got = {r["doc_id"]: r["score"] for r in retrieval.bm25(retrieval.tokenized(chunks, ["doc_id", "chunk_no"]), asked, ["doc_id", "chunk_no"]).collect()}
    assert max(got, key=got.get) == 1


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id long, doc_id string, rank int")
    grades = spark.createDataFrame([(1, "b", 2), (1, "z", 1)], "query_id long, doc_id string, grade int")
    r = retrieval.metrics(ranked, grades).head()
    assert (r["p3"], r["r5"], r["mrr"], r["hit1"]) == (0.333333, 0.5, 0.5, 0)


def test_greedy_dedupe(spark):
    schema = "row_id long, canonical_id string, pair_key string, deadline string, richness double"
    rows = [(1, "c1", "p", "d1", 5.0), (2, "c1", "q", "d1", 4.0), (3, "c2", "p", "d1", 3.0), (4, "c3", "p", "d2", 2.0), (5, "c4", "p", "d2", 1.0)]
    got = {r["row_id"]: (r["duplicate_of"], r["relaunch_of"]) for r in quality.greedy_two_keys(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (None, None), 2: (1, None), 3: (1, None), 4: (None, 1), 5: (4, None)}
    r = random.Random(21)
    rows = [(k, f"c{r.randint(0, 60)}", f"p{r.randint(0, 60)}", f"d{r.randint(0, 2)}", float(r.randint(0, 9))) for k in range(150)]
    ids, pairs, want = {}, {}, {}
    for k, c, p, d, _ in sorted(rows, key=lambda x: (-x[4], x[0])):  # all rows in one sequence
        if c in ids:
            want[k] = (ids[c], None)
        elif p in pairs and pairs[p][0] == d:
            want[k] = (pairs[p][1], None)
        else:
            want[k] = (None, pairs[p][1] if p in pairs else None)
            ids[c], pairs[p] = k, (d, k)
    assert {x["row_id"]: (x["duplicate_of"], x["relaunch_of"]) for x in quality.greedy_two_keys(spark.createDataFrame(rows, schema)).collect()} == want


def test_fold_of_other_scripts(spark):
    assert one(spark, T.fold(F.lit("E\u0301te\u0301 Šumava Iaşi"))) == "ete sumava iasi"
    assert one(spark, T.fold(F.lit("إدارة المدرسة ٢٠٢٤"))) == one(spark, T.fold(F.lit("اداره المدرسه 2024")))
    assert one(spark, T.normalize(F.lit("  Ǆ L’Œuvre\u200b Ñ "))).endswith("n") and one(spark, T.normalize(F.lit("Straße ł"))) == "straße ł"


def test_fallback_join_uses_each_side_once(spark):
    left = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "z")], "s long, pos int, k string")
    right = spark.createDataFrame([(1, 1, "q", 10), (1, 2, "a", 20), (1, 3, "y", 30)], "s long, pos int, k string, v int")
    got = {r["pos"]: (r["matched"], r["v"]) for r in quality.join_with_fallback(left, right, "s", "k", "pos", ["v"]).collect()}
    assert got == {1: ("key", 20), 2: ("missing", None), 3: ("position", 30)}


def test_near_copies(spark):
    day = dt.date(2026, 1, 1)
    rows = [(1, 5, day), (2, 5, day + dt.timedelta(7)), (3, 5, day + dt.timedelta(15)), (4, 6, day)]
    got = market.near_copies(spark.createDataFrame(rows, "id long, w long, d date"), ["w"], "d", "id", 7).collect()
    assert [(r["id"], r["copy_of"]) for r in got] == [(2, 1)]


def test_budget_outliers(spark):
    rows = spark.createDataFrame([("g", float(x)) for x in (100, 110, 120, 5000)] + [("h", 1.0), ("h", 900.0)], "g string, v double")
    got = {r["g"]: (r["median"], r["n_outliers"], r["confidence"]) for r in market.budget(rows, ["g"], "v").collect()}
    assert got == {"g": (110, 1, "low"), "h": (451, 0, "very low")}


def test_islands(spark):
    spans = spark.createDataFrame([(1, 10, 12), (1, 13, 20), (1, 30, 30), (2, 1, 24), (2, 5, 6)], "k long, s int, e int")
    got = {r["k"]: (r["months"], r["years"], r["islands"]) for r in dates.island_months(spans, "k", "s", "e").collect()}
    assert got == {1: (12, 1, 2), 2: (24, 2, 1)}


def test_dates(spark):
    rows = spark.createDataFrame([(x,) for x in ("2026-10-19", "le 3 février 2025", "31/02/2025", "May 4, 2024", "19.10.2026")], "t string")
    assert [str(r[0]) for r in rows.select(dates.parse_date("t")).collect()] == ["2026-10-19", "2025-02-03", "None", "2024-05-04", "2026-10-19"]


def test_decisions(spark):
    rows = [(1, "technical", True, "covered", 100.0), (1, "team", True, "covered", 100.0), (2, "technical", True, "missing", 0.0), (2, "technical", True, "missing", 0.0), (3, "technical", True, "covered", 100.0), (3, "team", True, "missing", 0.0)]
    m = spark.createDataFrame(rows, "t long, category string, mandatory boolean, status string, percent double")
    assert {r["t"]: r["recommendation"] for r in decide.recommendation(m, "t").collect()} == {1: "bid", 2: "no_bid", 3: "bid_with_partner"}
    assert {r["t"]: r["overall"] for r in decide.fit_score(m, "t", "category").collect()} == {1: 100, 2: 0, 3: 50}
    assert one(spark, decide.status(F.lit(1), F.lit(2), F.lit(2))) == "partial"
    assert one(spark, decide.logit_percent(F.lit(-4.0))) == 50.0


def test_smallest_team(spark):
    rows = [(1, "a", 1, 1, 1), (1, "b", 1, 1, 1), (1, "a", 2, 2, 1), (1, "c", 3, 1, 2)]
    r = decide.smallest_team(spark.createDataFrame(rows, "tender long, role string, person long, rank int, needed int"), "tender").head()
    assert (r["size"], r["team"], r["exact"]) == (2, "1,3", True)


def test_smallest_team_equals_brute_force(spark):
    r = random.Random(6)
    rows, want = [], {}
    for tender in range(60):
        people, places = range(r.randint(1, 8)), {f"r{k}": r.randint(1, 3) for k in range(r.randint(1, 5))}
        able = {role: [p for p in people if r.random() < 0.45] for role in places}
        able = {role: ps for role, ps in able.items() if ps}
        if not able:
            continue
        ranks = {p: r.randint(1, 3) for p in people}
        rows += [(tender, role, p, ranks[p], places[role]) for role, ps in able.items() for p in ps]
        fits = lambda team, able=able, places=places: all(len(set(team) & set(ps)) >= min(places[role], len(ps)) for role, ps in able.items())
        want[tender] = min((len(t), sum(ranks[p] for p in t)) for n in range(len(people) + 1) for t in itertools.combinations(people, n) if fits(t))
        want[tender] = (*want[tender], ranks, fits)
    slots = spark.createDataFrame(rows, "tender long, role string, person long, rank int, needed int")
    got = decide.smallest_team(slots, "tender").collect()
    assert len(got) == len(want)
    for x in got:
        size, total, ranks, fits = want[x["tender"]]
        team = [int(p) for p in x["team"].split(",")]
        assert x["exact"] and fits(team) and (x["size"], sum(ranks[p] for p in team)) == (size, total)
    assert all(not x["exact"] or x["size"] <= want[x["tender"]][0] for x in decide.smallest_team(slots, "tender", 1).collect())


def test_team_set_cover_keeps_the_default(spark, monkeypatch):
    from quern.plans import decisions

    asked = []
    monkeypatch.setattr(decisions.D, "smallest_team", lambda *a, **k: asked.append((len(a), k)))
    decisions.team_set_cover(spark, SF)
    assert asked == [(2, {})]


def test_quotes_glued_and_number_words():
    text = "we need three senior engineers who have shipped data platforms before"
    assert P.quoted("three senior engineers", "the threesenior engin eers here")
    assert not P.quoted("three senior 5", "we need threesenior 55 of them") and P.quoted("three senior 5", "threesenior 55 threesenior 5")
    assert not P.quoted(text.replace("three", "trois"), text.replace("three", "deux"))


def test_quotes_equal_brute_force(spark):
    from quern.operators import quotes as lookup

    r = random.Random(8)
    base = [[f"w{r.choice('abcdefgh')}{r.choice('abcdefgh')}" for _ in range(n)] for n in (3, 4, 7, 12, 20, 33, 40)]
    texts = ["x " + " ".join(q) + " y" for q in base] + ["x" + "".join(q) + "y" for q in base] + ["", "one", "a b c"]
    for q in base:
        for _ in range(12):
            texts.append(" ".join(x for w in q for x in ([] if r.random() < 0.05 else ["zz"] if r.random() < 0.06 else [w, "yy"] if r.random() < 0.1 else [w])))
    quotes = [(k, " ".join(q)) for k, q in enumerate(base)] + [(90, "a b"), (91, "")]
    rows, asked = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (500, None)], "doc_id long, t string"), spark.createDataFrame([*quotes, (92, None)], "item_id long, quote string")
    pairs = lambda how: {(x["item_id"], x["doc_id"]) for x in lookup.found(rows, asked, "doc_id", "item_id", how).collect()}
    want = {(k, d) for k, q in quotes for d, t in [*enumerate(texts), (None, texts[0])] if P.quoted(q, t)}
    assert pairs(lookup.Fuzzy) == want and len(want) > 40
    assert pairs(lookup.Whole) == {(k, d) for k, q in quotes for d, t in [*enumerate(texts), (None, texts[0])] if q and f" {q} " in f" {t} "}


def test_project_score(spark):
    score = rank.project_score(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")), F.lit(3.5), F.lit("software"), F.lit("saas"))
    assert one(spark, score) == 55.0


def test_parsers():
    text = "we need three senior engineers who have shipped data platforms before"
    assert P.quoted("three senior engineers who have shipped data platforms", text)
    assert P.quoted("three senior engineers have shipped data platforms before today", text) is True
    assert not P.quoted("5 senior engineers who have shipped data platforms", text)
    assert not P.quoted("two words", text)
    assert P.repaired('note {"a": [1, 2,], "b": "}"} more') == '{"a":[1,2],"b":"}"}'
    assert P.repaired("none") is None
    assert P.grouped("ISO 27001 or SOC 2, and PMP", ["iso 27001", "soc 2", "pmp"]) == [["iso 27001", "soc 2"], ["pmp"]]
    assert P.listed("java, c (c99, c11); 1,5 years") == ["java", "c (c99, c11)", "1,5 years"]
    assert P.digits("twenty-five engineers") == "25 engineers"
    assert P.filled([5, 5, 1, 9, 20], 10) == [0, 0, 1, 1, 2]


def test_sources_and_sinks(spark, tmp_path):
    assert readers.pages("u?o={offset}&n={limit}&p={page}", 50, 120) == ["u?o=0&n=50&p=1", "u?o=50&n=50&p=2", "u?o=100&n=20&p=3"]
    (tmp_path / "reply1.json").write_text(json.dumps({"d": {"items": [{"id": 1, "t": " "}, {"id": 2, "t": "x"}]}}))
    spark.dataSource.register(readers.RestSource)
    raw = spark.read.format("paged_rest").option("url", f"file://{tmp_path}/reply{{page}}.json").option("limit", 5).option("max", 5).option("records", "d.items").load()
    got = readers.map_records(raw, {"title": ["t", "id"]}).orderBy("title").collect()
    assert [r["title"] for r in got] == ["1", "x"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id": "a", "n": 1}')
    (tmp_path / "in/b.json").write_text("{broken")
    good, bad = readers.records(spark, f"{tmp_path}/in", "id string, n int")
    assert (good.count(), bad.count()) == (1, 1)
    (tmp_path / "p.csv").write_text("key,value\nqa,200\nnone,1\npm,x\n")
    prices, rejected = readers.catalogue(spark, f"{tmp_path}/p.csv", spark.createDataFrame([("qa",), ("pm",)], "key string"))
    assert prices.count() == 1 and {r["reason"] for r in rejected.collect()} == {"unknown key", "not a number"}
    store = f"{tmp_path}/store"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert sinks.upsert_store(rows, store, "k") == 1
    assert sinks.upsert_store(spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), store, "k") == 2
    assert sorted(map(tuple, sinks.load(spark, store).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sinks.index_generation(rows, f"{tmp_path}/ix") == sinks.index_generation(rows, f"{tmp_path}/ix") == 1
    sinks.export_csv(rows.withColumn("l", F.array(F.lit("x"), F.lit("y"))), f"{tmp_path}/csv")
    (csv,) = (tmp_path / "csv").glob("part-*")
    head, *body = csv.read_text().splitlines()
    assert head == "\ufeffk,v,l" and sorted(body) == ["1,a,x; y", "2,b,x; y"]


def test_replace_stopped_half_way(spark, tmp_path, monkeypatch):
    store, rows = f"{tmp_path}/store", spark.createDataFrame([(1, "a")], "k long, v string")
    assert sinks.replace(rows, store) == 1
    real = sinks._store

    class Stopped:
        def __init__(self, fs, step):
            self.fs, self.step = fs, step

        def __getattr__(self, name):
            if name == self.step:
                raise RuntimeError(name)
            return getattr(self.fs, name)

    for step, held in (("create", [(1, "a")]), ("delete", [(2, "b")])):  # before and after the new pointer
        monkeypatch.setattr(sinks, "_store", lambda *a, step=step: (real(*a)[0], Stopped(real(*a)[1], step)))
        try:
            sinks.replace(spark.createDataFrame([(2, "b")], "k long, v string"), store)
            raise AssertionError("it should have stopped")
        except RuntimeError:
            monkeypatch.setattr(sinks, "_store", real)
        assert [tuple(r) for r in sinks.load(spark, store).collect()] == held
    assert sinks.upsert_store(spark.createDataFrame([(3, "c")], "k long, v string"), store, "k") == 3
    assert sorted(map(tuple, sinks.load(spark, store).collect())) == [(2, "b"), (3, "c")]


def test_sync(spark):
    cache = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "k long, v string")
    server = spark.createDataFrame([(2, "b"), (3, "c"), (5, "e")], "k long, v string")
    changes = deck.sync(cache, server, "k")
    assert sorted(map(tuple, changes.collect())) == [("delete", 1, None), ("delete", 4, None), ("upsert", 3, "c"), ("upsert", 5, "e")]
    assert sorted(map(tuple, deck.apply_sync(cache, changes, "k").collect())) == sorted(map(tuple, server.collect()))
    assert deck.sync(server, server, "k").count() == 0


def test_incremental_run(spark, tmp_path):
    schema = "k long, v double"
    source = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/src")
    work = lambda d: d.withColumn("failed", F.col("v") < 0)
    run = lambda: runs.incremental(source(), f"{tmp_path}/store", f"{tmp_path}/log", "k", schema, work).awaitTermination(60)
    spark.createDataFrame([(1, 1.0), (2, -1.0)], schema).write.mode("append").parquet(f"{tmp_path}/src")
    run()
    spark.createDataFrame([(1, 9.0), (2, 2.0), (3, 3.0)], schema).write.mode("append").parquet(f"{tmp_path}/src")
    run()
    got = spark.read.parquet(f"{tmp_path}/store").select("k", "v").collect()
    assert sorted(map(tuple, got)) == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_run_states(spark, tmp_path):
    schema = "run_id string, at long, status string"
    spark.createDataFrame([("a", 1, "running"), ("a", 2, "done"), ("a", 3, "running"), ("b", 1, "running")], schema).write.parquet(f"{tmp_path}/ev")
    states = runs.run_states(spark.readStream.schema(schema).parquet(f"{tmp_path}/ev"))
    query = states.writeStream.outputMode("update").format("memory").queryName("states").trigger(once=True).start()
    assert query.awaitTermination(60)
    assert {r["run_id"]: r["status"] for r in spark.sql("SELECT * FROM states").collect()} == {"a": "done", "b": "running"}


def test_word_coverage_meets_words_not_items(spark):
    """Many needs and items that share a word, which as pairs would be 400 million; an item of two rows has the words of both."""
    needs = spark.range(20_000).selectExpr("id", "concat('brand alpha', id % 50) AS text").unionByName(spark.createDataFrame([(-1, "nothing"), (-2, None), (-3, "brand"), (-4, "left right")], "id long, text string"))
    items = spark.range(20_000).selectExpr("id AS item", "concat('Brand alpha', id % 40, ' of') AS text").unionByName(spark.createDataFrame([(-1, "left"), (-1, "right"), (None, None)], "item long, text string"))
    start = time.monotonic()
    got = {r["id"]: r["status"] for r in M.word_coverage(needs, items, "id", "text", "item").collect()}
    assert time.monotonic() - start < 60
    assert [got[k] for k in (-1, -2, -3, -4)] == ["to_clarify", "to_clarify", "partial", "covered"]
    assert all(got[k] == ("covered" if k % 50 < 40 else "partial") for k in range(20_000))


def test_best_match_compares_different_names_once(spark):
    """6,000 asked names and 20,000 registry rows of few names: as pairs of rows they would be 24 million."""
    from quern.operators import names

    asked = spark.range(6000).selectExpr("id AS ask", "concat('service regional beta', id % 3) AS name")
    registry = spark.range(20_000).selectExpr("id", "concat('Service régional beta', id % 5) AS name", "id % 2 = 0 AS public", "cast(null AS string) AS place")
    start = time.monotonic()
    got = {r["ask"]: (r["id"], r["similarity"]) for r in names.best_match(asked, registry).collect()}
    assert time.monotonic() - start < 60
    assert len(got) == 6000 and {got[k] for k in range(3)} == {(0, 1.0), (6, 1.0), (2, 1.0)} and got[5999] == got[2]


def test_dense_holds_few_similarities_at_once(spark, monkeypatch):
    """The k best with ties, by small blocks of similarities, equal those of all pairs; grades are counted, not listed."""
    monkeypatch.setattr(retrieval, "PAIRS", 64)
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    r = random.Random(3)
    rows = [(k, [float(r.randint(-2, 2)) + 0.1, float(r.randint(-2, 2))], k % 3) for k in range(150)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 4)
    for within in (None, "label"):
        got = retrieval.top(retrieval.dense(v, v.filter("vec_id % 10 = 0"), 7, within=within), 7, [F.desc("sim"), F.col("vec_id")])
        want = {}
        for q in rows[::10]:
            found = sorted((-cos(q[1], x[1]), x[0]) for x in rows if x[0] != q[0] and (not within or x[2] == q[2]))
            want |= {(q[0], k + 1): x[1] for k, x in enumerate(found[:7])}
        assert {(x["query_id"], x["rank"]): x["vec_id"] for x in got.collect()} == want
    graded = spark.createDataFrame([(1, 1, 2), (1, 2, None), (1, 3, 1)], "query_id long, rank int, grade int")
    counts = spark.createDataFrame([(1, 2, 2), (1, 1, 10**10)], "query_id long, grade int, n long")
    m = retrieval.judged_metrics(graded, counts).head()
    ideal = 3 + 3 / 1.5849625007211562 + 1 / 2 + 1 / 2.321928094887362 + 1 / 2.584962500721156
    assert abs(m["ndcg5"] - 3.5 / ideal) < 1e-5 and m["hit1"] == 1 and m["p3"] == 0.666667


def test_groups_are_met_in_order_without_frames(spark):
    """20,000 small groups in seconds; a frame for each takes minutes."""
    from quern.session import sorted_groups

    rows = spark.range(60_000).selectExpr("id % 20000 AS g", "-id AS v")
    start = time.monotonic()
    got = sorted_groups(rows, "g", [F.col("v")], lambda key, found: [(key, len(found), found[0][0], str(found[-1][0]))], "g long, n long, first long, last string").collect()
    assert time.monotonic() - start < 30
    assert {tuple(r) for r in got} == {(k, 3, -(k + 40_000), str(-k)) for k in range(20_000)}


def test_spread_deals_rows_of_one_row_group(spark, tmp_path):
    """A file of one row group is read by one task, however many partitions the scan has."""
    from quern.session import spread

    spark.range(200_000).selectExpr("id", "sha2(cast(id AS string), 256) AS t").coalesce(1).write.option("parquet.block.size", 1 << 30).parquet(str(tmp_path / "one"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        scan = spark.read.parquet(str(tmp_path / "one"))
        assert scan.rdd.getNumPartitions() >= 4
        sizes = [r["count"] for r in spread(scan).groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 0.3 * 200_000 and sum(sizes) == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bm25_shuffles_chunks_once(spark, monkeypatch):
    """Postings, scores and best chunks are grouped where a document's chunks lie: only chunks are shuffled, by document."""
    monkeypatch.setattr(retrieval, "CHUNKS", 10)
    docs = spark.createDataFrame([(k, "en", " ".join(f"w{(k * 7 + j % 5) % 60}" for j in range(300))) for k in range(60)], "doc_id long, lang string, text string")
    tokens = retrieval.tokenized(retrieval.chunk(docs), ["doc_id", "lang", "chunk_no"])
    asked = spark.createDataFrame([(1, "w3 w5"), (2, "w7 w7")], "query_id long, text string")
    best = retrieval.best_per_doc(retrieval.bm25(tokens, asked, ["doc_id", "lang", "chunk_no"]))
    plan = best._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "hashpartitioning(" in line and any(c in line.split("hashpartitioning(")[1].split(")")[0] for c in ("chunk_no", "query_id"))]
    assert not moved and "hashpartitioning(doc_id" in plan and best.count() > 0
