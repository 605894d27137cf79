"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by the MD5 of their id) and get a virtual finish time: the source's cumulative
words divided by its target. All sources are served in that order until the total budget is spent. A source
whose target exceeds its words is served a second time round, its clock running on.

Cumulative sums are built from (source, hash bucket) totals, so that a source with a third of all rows is
spread over many tasks, and the final cut is found from totals of ranges of virtual time, so that only
one narrow range is ever sorted.

Null text has size 0; null source is a source of its own (last in order); a null id hashes as its text; rows
that share source and id (or, without an id, their text) are served together and counted together. Equal finish times are ordered by source, hash, id and
round. A text of any length is one document, taken whole. Columns of any name beside doc_id and source are kept aside. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common

#: Weights of the sources in code point order, repeating; share of all words to take; times a source or document may be used.
WEIGHTS, SHARE, TIMES = (5, 2, 1), 1.5, 2
#: Rows that one task sorts.
ROWS = 50_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, times: int = TIMES) -> DataFrame:
    """Target of each row of (source, source_size): the budget is shared by weight, no target exceeds `times` the size, and the excess goes to the others by weight."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(int(w)) for w in weights])
    rows = sizes.withColumn("weight", weight[(F.row_number().over(in_order) - 1) % len(weights)].cast("double"))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(times))).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    rows = rows.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    level = F.max("level").over(everything)
    return rows.select("source", "source_size", "budget", F.least("cap", level * F.col("weight")).alias("target"))


def plan(docs: DataFrame, size, weights=WEIGHTS, share: float = SHARE, times: int = TIMES) -> DataFrame:
    """docs: source, doc_id, h (a hash of the id). For each source: source_size, target, and per round the last (hash, id) that is taken, as `cut` (array of structs, null where none)."""
    spark = docs.sparkSession
    item = docs.select("source", "h", "doc_id", size.cast("long").alias("size"))
    item = common.stage(item.groupBy("source", "h", "doc_id").agg(F.sum("size").alias("size")), "mix-items")
    sources = common.stage(targets(item.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, times), "mix-targets")
    n = item.count()
    digits = next(k for k in range(1, 8) if 16**k * ROWS >= n or k == 7)
    item = item.withColumn("bucket", F.substring("h", 1, digits))
    # running totals: of whole buckets before, plus within the bucket
    per = item.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    whole = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(whole), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "bucket").orderBy("h", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    item = item.withColumn("running", F.sum("size").over(within)).alias("i")
    per = per.alias("p")
    item = item.join(per, F.col("i.source").eqNullSafe(F.col("p.source")) & (F.col("i.bucket") == F.col("p.bucket"))).select("i.source", "h", "doc_id", "size", (F.col("running") + F.col("before")).alias("running")).alias("i")
    sources = common.small(sources, 100_000)
    item = item.join(sources.alias("s"), F.col("i.source").eqNullSafe(F.col("s.source"))).select("i.*", "source_size", "target", "budget")
    rounds = F.explode(F.sequence(F.lit(0), F.lit(int(times) - 1)))
    item = item.select("*", rounds.alias("round"))
    finish = F.when(F.col("target") > 0, (F.col("source_size") * F.col("round") + F.col("running")) / F.col("target")).otherwise(F.lit(0.0))
    item = common.stage(item.withColumn("finish", finish), "mix-finish")
    ranges = max(1024, n * int(times) // ROWS)
    item = item.withColumn("range", F.floor(F.least("finish", F.lit(4.0)) * ranges))
    spent = item.groupBy("range").agg(F.sum("size").alias("size"), F.max("budget").alias("budget"))
    spent = spent.select("range", "size", "budget", F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
    edge = spent.filter("total > budget").orderBy("range").select("range", (F.col("total") - F.col("size")).alias("before")).head()
    taken = item
    if edge:
        order = Window.orderBy("finish", F.col("source").asc_nulls_last(), "h", F.col("doc_id").asc_nulls_first(), "round")
        last = item.filter(F.col("range") == edge["range"]).select("*", (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.lit(edge["before"])).alias("total"))
        taken = item.filter(F.col("range") < edge["range"]).unionByName(last.filter("total <= budget").drop("total"))
    cuts = taken.filter("target > 0").groupBy("source", "round").agg(F.max(F.struct("h", F.col("doc_id"))).alias("last"))
    cuts = cuts.groupBy("source").agg(F.collect_list("last").alias("cut"))  # at most `times` structs
    s, c = sources.alias("s"), cuts.alias("c")
    return common.stage(s.join(c, F.col("s.source").eqNullSafe(F.col("c.source")), "left").select("s.source", "source_size", "target", "cut"), "mix-cuts")


def mix(docs: DataFrame, size, weights=WEIGHTS, share: float = SHARE, times: int = TIMES) -> DataFrame:
    """doc_id, source, size, source_size, target, times_taken (0 to `times`) and `_rest` (the other columns) of every document; the documents
    themselves are never shuffled. size: a column of docs."""
    used = ["doc_id", "source"]
    text = F.md5(F.coalesce("text", F.lit(""))) if "text" in docs.columns else F.lit("")
    own = common.aside(docs, used, size.alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), text)).alias("h"))
    cuts = common.small(plan(own, F.col("size"), weights, share, times).withColumnRenamed("source", "_source"), 100_000)
    key = F.struct("h", "doc_id")
    served = F.coalesce(F.size(F.filter("cut", lambda c: key <= c)), F.lit(0))
    served = F.when(F.col("cut").isNull(), 0).otherwise(served)
    return own.join(cuts, F.col("source").eqNullSafe(F.col("_source"))).withColumn("times_taken", served).drop("_source", "cut", "h")


def words(column: str = "text"):
    return F.coalesce(F.regexp_count(column, F.lit(common.WORD)), F.lit(0)).cast("long")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"), words())
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times_taken")).alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
w AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget
  FROM w),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM c),
t AS (SELECT source, source_size, budget, least(cap, max(lvl) OVER () * weight) AS target FROM l),
i AS (
  SELECT d.source, d.h, d.doc_id, CAST(sum(d.size) AS BIGINT) AS size FROM d GROUP BY ALL),
r AS (
  SELECT i.*, t.source_size, t.target, t.budget, e.round,
         CASE WHEN t.target > 0 THEN (t.source_size * e.round + CAST(sum(i.size) OVER (PARTITION BY i.source, e.round ORDER BY i.h, i.doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT))
              / CAST(t.target AS DOUBLE) ELSE 0.0 END AS finish
  FROM i JOIN t ON i.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) e(round)),
s AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, h, doc_id NULLS FIRST, round ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total
  FROM r),
k AS (SELECT source, h, doc_id, count(*) AS times FROM s WHERE total <= budget AND target > 0 GROUP BY ALL)
SELECT d.doc_id, d.size, t.source_size, t.target, CAST(d.size * coalesce(k.times, 0) AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.h = k.h
"""
