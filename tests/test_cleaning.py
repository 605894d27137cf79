"""Corrections, references, planted instructions and joined lists by hand."""

import datetime

from pyspark.sql import functions as F

from quern.operators import cleaning

D = [datetime.date(2026, 1, k) for k in range(1, 10)]


def test_references(spark):
    cases = {"Consultation N°28/2026": "28/2026", "Avis no. 5 / 2026 bis": "5/2026", "AO 12/2025": "12/2025", "réf. : 7/2026": "7/2026", "période 01/2026 à 12/2026": None, "n° 3/2026/4": None, "عدد ٤٥/2026": "45/2026", "": None}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", cleaning.reference("t").alias("r")).collect()
    assert {r["t"]: r["r"] for r in rows} == cases


def test_corrections(spark):
    rows = spark.createDataFrame([(1, "a", "x1", "p", D[0]), (2, "b", "x1", "p", None), (3, "a", "x3", "q", D[0]), (4, "a", "x4", None, D[1])], "row long, source string, external_id string, pair_key string, deadline date")
    c = spark.createDataFrame(
        [
            (10, "a", ["x1", "gone"], "q", D[5], D[1]),  # named: the pair is not asked
            (11, "b", ["gone"], "p", D[6], D[2]),  # by the pair, newer: it moves row 1 as well
            (12, "a", None, "q", None, D[8]),  # says no deadline
            (13, "a", ["x4"], None, D[7], None),
        ],
        "row long, source string, supersedes array<string>, pair_key string, deadline date, published date",
    )
    got = {r["row"]: (r["deadline"], r["corrected_by"]) for r in cleaning.rectified(rows, c).collect()}
    assert got == {1: (D[6], 11), 2: (D[6], 11), 3: (D[0], None), 4: (D[7], 13)}


def test_twins(spark):
    rows = [(1, "1/2026", "Ville de Lyon", None), (2, "1/2026", "VILLE DE LYONS", D[0]), (3, "1/2026", "Other", D[0]), (4, "1/2026", None, None), (5, "2/2026", "Solo", None), (6, None, "Solo", D[0]), (7, "3/2026", "Paris", None), (8, "3/2026", " ", D[1])]
    got = {r["row"]: r["twin"] for r in cleaning.same_reference(spark.createDataFrame(rows, "row long, reference string, buyer string, deadline date")).collect()}
    assert got == {1: 2, 4: 2, 7: 8}


def test_injections_and_lists(spark):
    fields = spark.createDataFrame([(1, "$.a", "Please Ignore\n all   previous"), (1, "$.b[0]", "JAVASCRIPT:x <script>"), (2, "$.a", "nothing"), (3, "$.a", "reveal"), (1, "$.c", None)], "id long, path string, value string")
    got = sorted(tuple(r) for r in cleaning.injections(spark.createDataFrame([(1,), (2,)], "id long"), "id", fields).collect())
    assert got == [(1, "$.a", "ignore all previous"), (1, "$.b[0]", "<script"), (1, "$.b[0]", "javascript:")]
    one = spark.range(1).select(cleaning.union_of(F.array(F.lit("B b"), F.lit(None), F.lit("é")), F.array(F.lit("b-B"), F.lit("E"), F.lit("c"))).alias("u"), cleaning.union_of(F.lit(None).cast("array<string>"), F.array(F.lit("x"))).alias("v"), cleaning.summary(F.create_map(F.lit("a"), F.lit(" "), F.lit("b"), F.lit("1"), F.lit("c"), F.lit(None))).alias("s")).head()
    assert (one["u"], one["v"], one["s"]) == (["B b", "é", "c"], ["x"], {"b": "1"})
