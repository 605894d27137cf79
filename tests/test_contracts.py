"""Contracts: what fits, what is made to fit, and where they are broken."""

from pyspark.sql import functions as F

from quern.functions import contracts as C

SPEC = C.Record(
    (
        ("kind", C.String(enum=("Software Build", "audit"))), ("reason", C.String(most=20)), ("score", C.Number()), ("rank", C.Number(whole=True, nullable=True)), ("ok", C.Flag()),
        ("ids", C.List(C.Number(whole=True), most=4)), ("items", C.List(C.Record((("name", C.String()), ("n", C.Number())), ("name",)))), ("note", C.String(default="-")),
    ),
    ("kind", "score"),
)


def run(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").withColumn("v", C.answer("t"))
    got = rows.select("k", C.coerced(SPEC, F.col("v")).alias("c"), C.violations(SPEC, F.col("v")).alias("f")).orderBy("k").collect()
    return [(r["c"].asDict(True) if r["c"] else None, [tuple(x) for x in r["f"]]) for r in got]


def test_values_are_made_to_fit(spark):
    (good, faults), (odd, warned), (bad, errors), (none, missing) = run(
        spark,
        '<think>{"kind": 1}</think>Here: ```json\n{"kind":"software_build","reason":["a","b"],"score":"12.5 %","rank":"n/a","ok":"Oui","ids":"1, 4 and -7","items":[{"name":"x","n":2}],}\n```',
        '{"kind":"AUDIT","score":3,"rank":2.5,"ok":0,"ids":[1,"x",3],"items":[{"name":"y"},{"n":1},"z",{"name":"w","n":"q"}],"reason":"' + "long " * 9 + '"}',
        '{"kind":"other","score":[1],"reason":{"a":1}}', "no object",
    )
    assert good == {"kind": "Software Build", "reason": "a; b", "score": 12.5, "rank": None, "ok": True, "ids": [1, 4, -7], "items": [{"name": "x", "n": 2.0}], "note": "-"}
    assert faults == []  # what could be read otherwise is no fault
    assert odd == {"kind": "audit", "reason": "long long long long ", "score": 3.0, "rank": 3, "ok": False, "ids": [1, 3], "items": [{"name": "y", "n": None}, {"name": "w", "n": None}], "note": "-"}
    assert warned == [("$.ids[1]", "not a number", "warning"), ("$.items[0].n", "missing", "warning"), ("$.items[1].name", "missing", "warning"), ("$.items[2]", "not an object", "warning"), ("$.items[3].n", "not a number", "warning")]
    assert bad is None and errors == [("$.kind", "not one of Software Build|audit", "error"), ("$.reason", "not a string", "warning"), ("$.score", "not a number", "error"), ("$.ok", "missing", "warning")]
    assert none is None and missing == [("$", "missing", "error")]


def test_broken_json_is_mended(spark):
    texts = ['{"a": "x\ny", "b": [1, 2,], }', "{“a”: “x”}", 'x {"a": "{"} y', "{", None, '{"a": "unterminated}']
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", F.to_json(C.answer("t")).alias("j")).orderBy("k").collect()
    assert [r["j"] for r in rows] == ['{"a":"x y","b":[1,2]}', '{"a":"x"}', '{"a":"{"}', None, None, None]
