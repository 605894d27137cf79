"""Cleaning, joins, aggregation and ranking queries over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import market as M
from quern.operators import quality as Q
from quern.operators import rank as K
from quern.plans import sql as S
from quern.session import table

#: The day on which every query runs.
TODAY = "2000-06-30"


def _day() -> F.Column:
    return F.lit(TODAY).cast("date")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))


def _awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as awards: winner is the supplier, buyer the customer."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.to_date("l_shipdate").alias("day"))
    return lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")


_ORDERS = "o AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders)"
_AWARDS = "a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_shipdate AS DATE) AS day, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


# filters and drop reasons
def keyword_prefilter(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return parts.filter(~Q.prefilter(parts, "p_name", ["small", "red"], ["widget"]))


def _reason():
    kind = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "cancelled").when(F.col("o_orderstatus") == "F", "award").otherwise("open")
    deadline = F.when(F.col("o_orderkey") % 3 != 0, F.date_add("day", 45))
    return Q.drop_reason(kind, deadline, F.col("day"), _day())


def notice_drops(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", _reason().alias("reason"))


def drop_reason_buckets(spark, sf_dir):
    rows = _orders(spark, sf_dir).withColumn("reason", _reason()).filter("reason is not null")
    return rows.groupBy(Q.reason_bucket(F.col("reason")).alias("bucket")).agg(F.count("*").alias("n"))


def funnel_counts(spark, sf_dir):
    rows = _orders(spark, sf_dir).withColumn("reason", _reason())
    return rows.groupBy("o_orderpriority").agg(
        F.count("*").alias("fetched"), F.count_if(F.col("reason").isNull()).alias("kept"),
        F.count_if(F.col("reason") == "award notice").alias("awards"), F.count_if(F.col("reason").startswith("expired")).alias("expired"),
        F.count_if(F.col("o_totalprice") >= 400000).alias("high_fit"),
    )


def run_totals(spark, sf_dir):
    rows = _orders(spark, sf_dir).withColumn("reason", _reason())
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("reason").isNull()).alias("kept"), F.count_distinct("o_custkey").alias("buyers"), F.count_if(F.datediff("day", _day()) > 0).alias("future"), F.max("day").cast("string").alias("newest"))


_REASON = f"""CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'cancelled' WHEN o_orderstatus = 'F' THEN 'award notice'
  WHEN o_orderkey % 3 <> 0 AND day + 45 < DATE '{TODAY}' THEN 'expired on ' || CAST(CAST(day + 45 AS DATE) AS VARCHAR)
  WHEN o_orderkey % 3 = 0 AND DATE '{TODAY}' - day > 90 THEN 'stale: no deadline' END"""
_BUCKET = "trim(regexp_replace(regexp_replace(reason, '[0-9]{4}-[0-9]{2}-[0-9]{2}', '', 'g'), '( on|:).*$', ''))"


# deduplication and set operations
def exact_dedupe_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def greedy_first_wins_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.md5(T.fold("text")).alias("k"))
    return Q.first_of_key(docs, ["k"], [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "n_chars")


def duplicate_absorption(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice")
    return Q.absorb(parts, ["p_name", "p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], "p_partkey", F.col("p_partkey")).select("p_name", "p_brand", "p_partkey", F.array_join("also_seen", ",").alias("also_seen"))


def merge_lanes(spark, sf_dir):
    """UNION ALL of three lanes with different columns."""
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("lane"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("lane"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    n = table(spark, sf_dir, "nation").select(F.lit("nation").alias("lane"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True).unionByName(n, allowMissingColumns=True)


def occurrence_index_titles(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    k = Q.occurrence(parts, "p_name", [F.col("p_partkey")])
    return parts.select("p_partkey", F.when(k > 1, F.concat("p_name", F.lit(" ("), k.cast("string"), F.lit(")"))).otherwise(F.col("p_name")).alias("title"))


def identity_duplicates(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.groupBy("p_type", T.fold("p_name").alias("name"), "p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).filter("n > 1")


def greedy_relaunch_dedupe(spark, sf_dir):
    """Ordered two-key deduplication of orders as notices: pair is (customer, status), canonical id (customer, price band)."""
    o = _orders(spark, sf_dir)
    rows = o.select(
        F.col("o_orderkey").alias("row_id"), F.concat_ws(":", "o_custkey", F.floor(F.col("o_totalprice") / 100000)).alias("canonical_id"),
        F.concat_ws(":", "o_custkey", "o_orderstatus").alias("pair_key"), F.date_format("day", "yyyy-MM").alias("deadline"), F.col("o_totalprice").alias("richness"),
    )
    return Q.greedy_two_keys(rows)


# joins
def anti_join_known(spark, sf_dir):
    """Priorities in which a customer has never ordered: every order makes its customer and priority known."""
    key = F.concat_ws("|", "o_custkey", "o_orderpriority").alias("k")
    priorities = F.explode(F.array(*[F.lit(p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])).alias("priority")
    rows = table(spark, sf_dir, "customer").select("c_custkey", priorities).withColumn("k", F.concat_ws("|", "c_custkey", "priority"))
    return Q.anti_known(rows, _orders(spark, sf_dir).select(key), ["k"]).select("c_custkey", "priority")


def left_join_fallback_position(spark, sf_dir):
    """User turns matched to assistant turns of the same conversation by their whole folded text, then by position."""
    c = table(spark, sf_dir, "conversations").filter("conv_id is not null")
    number = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    c = c.withColumn("pos", number).withColumn("key", T.fold("text"))
    asked = c.filter("role = 'user'").select("conv_id", "pos", "key")
    given = c.filter("role = 'assistant'").select("conv_id", "pos", "key", "turn")
    return Q.join_with_fallback(asked, given, "conv_id", "key", "pos", ["turn"]).withColumn("turn", F.coalesce("turn", F.lit(-1)))


def rect_merge(spark, sf_dir):
    """Newest correction (status P) of each customer moves the date of its open orders."""
    o = _orders(spark, sf_dir)
    rect = o.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max_by(F.struct("day", "o_orderkey"), F.struct("day", "o_orderkey")).alias("r"))
    out = o.filter("o_orderstatus = 'O'").join(rect, "o_custkey", "left")
    return out.select("o_orderkey", F.greatest("day", F.col("r.day")).cast("string").alias("effective"), F.coalesce(F.col("r.o_orderkey"), F.lit(-1)).alias("corrected_by"))


def supersede_self_join(spark, sf_dir):
    """Orders with a later one of the same customer, status and priority: a window finds it, no self-join is needed."""
    w = Window.partitionBy("o_custkey", "o_orderstatus", "o_orderpriority").orderBy(F.desc("day"), F.desc("o_orderkey"))
    rows = _orders(spark, sf_dir).withColumn("newest", F.first("o_orderkey").over(w))
    return rows.filter("newest <> o_orderkey").select("o_orderkey", F.col("newest").alias("superseded_by"))


def same_reference_join(spark, sf_dir):
    """Orders without a deadline matched to the first dated twin of the same customer and priority."""
    o = _orders(spark, sf_dir)
    dated = o.filter("o_orderkey % 3 <> 0").groupBy("o_custkey", "o_orderpriority").agg(F.min(F.struct("day", "o_orderkey")).alias("t"))
    out = o.filter("o_orderkey % 3 = 0").join(dated, ["o_custkey", "o_orderpriority"])
    return out.select("o_orderkey", F.col("t.o_orderkey").alias("twin"))


def near_copy_join(spark, sf_dir):
    rows = _awards(spark, sf_dir).withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return M.near_copies(rows, ["l_suppkey", "l_partkey"], "day", "key", 7)


def band_join_copies(spark, sf_dir):
    """Orders of one customer from two sources (O and P), amounts within 2 %, dates within 90 days."""
    o = _orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "day")
    pairs = M.near_amounts(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'P'"), ["o_custkey"], "o_totalprice", "day", 0.02, 90)
    return pairs.select(F.col("a.o_orderkey").alias("order_a"), F.col("b.o_orderkey").alias("order_b"))


def catalogue_price_lookup(spark, sf_dir):
    """Lines priced by a catalogue of ECONOMY parts; a missing price is 0."""
    catalogue = table(spark, sf_dir, "part").filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    cents = F.sum(F.round(F.coalesce("p_retailprice", F.lit(0.0)) * 100).cast("long") * F.col("l_quantity").cast("long"))
    return lines.join(catalogue, "l_partkey", "left").groupBy("l_orderkey").agg(cents.cast("long").alias("cents"))


def full_outer_plan_check(spark, sf_dir):
    """Planned against shipped value of each order, over 15 % apart or on one side only."""
    plan = _orders(spark, sf_dir).filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("planned"))
    done = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("shipped"))
    out = plan.join(done, "k", "full_outer").select("k", F.coalesce("planned", F.lit(0.0)).alias("planned"), F.coalesce("shipped", F.lit(0.0)).alias("shipped"))
    return out.filter(F.abs(F.col("planned") / 2500 - F.col("shipped")) > 0.15 * F.greatest(F.col("planned") / 2500, F.col("shipped")))


# aggregates
def percentile_budget(spark, sf_dir):
    rows = _orders(spark, sf_dir).withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return M.budget(rows, ["o_orderpriority"], "cents")


def outlier_10x_median(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem")
    middle = o.groupBy("l_suppkey").agg(F.percentile("l_extendedprice", F.lit(0.5)).alias("m"), F.count("*").alias("n"))
    out = o.join(middle, "l_suppkey").filter("n >= 3 and (l_extendedprice > 10 * m or l_extendedprice < m / 10)")
    return out.groupBy("l_suppkey").agg(F.count("*").alias("n_outliers"))


def upper_median(spark, sf_dir):
    return M.buyer_signals(table(spark, sf_dir, "part"), "p_brand", "p_retailprice")


def dominant_currency(spark, sf_dir):
    return M.dominant(_orders(spark, sf_dir), ["o_custkey"], "o_orderpriority", "o_orderkey").select("o_custkey", "o_orderpriority", "n")


def competitor_rollup(spark, sf_dir):
    top = M.competitors(_awards(spark, sf_dir), "o_custkey", "l_suppkey", "l_extendedprice", "day")
    return top.select("o_custkey", "rank", "l_suppkey", "wins", F.round("won", 2).alias("won"), F.col("last_win").cast("string").alias("last_win"))


def past_winners(spark, sf_dir):
    """Each customer's suppliers with their three latest awards."""
    rows = _awards(spark, sf_dir)
    latest = F.array_join(F.transform(F.slice(F.sort_array(F.collect_set(F.struct("day", "l_orderkey")), asc=False), 1, 3), lambda x: x["l_orderkey"].cast("string")), ",")
    return rows.groupBy("o_custkey", "l_suppkey").agg(F.count_distinct("l_orderkey").alias("wins"), latest.alias("latest"))


def buyer_groups(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.groupBy("o_custkey").agg(
        F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities"), F.max("o_totalprice").alias("max_price"),
        F.coalesce(F.min(F.when(F.col("day") >= _day(), F.datediff("day", _day()))), F.lit(-1)).alias("nearest"), F.bool_or(F.col("o_orderstatus") == "O").alias("any_open"), F.count("*").alias("size"),
    )


def weighted_fit_bround(spark, sf_dir):
    """Weighted mean, returned lines at half weight, halves rounded to even."""
    w = F.when(F.col("l_returnflag") == "R", 0.5).otherwise(1.0)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bround(F.sum(F.col("l_quantity") * w) / F.sum(w), 0).cast("long").alias("fit"))


def coverage_ratio(spark, sf_dir):
    """(covered + half of partial) of all, in hundredths; N lines are covered, R partial."""
    s = F.when(F.col("l_returnflag") == "N", 1.0).when(F.col("l_returnflag") == "R", 0.5).otherwise(0.0)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg(s), 2).alias("coverage"), T.half_up(100 * F.avg(s)).cast("long").alias("percent"))


def dashboard_kpis(spark, sf_dir):
    o = _orders(spark, sf_dir)
    active = F.col("o_orderstatus") != "F"
    return o.groupBy("o_orderpriority").agg(
        F.count_if(active).alias("active"),
        F.round(F.sum(F.when(active, F.col("o_totalprice")).otherwise(0.0)) / F.greatest(F.count_if(active), F.lit(1)), 2).alias("average"),
    )


def confusion_matrix(spark, sf_dir):
    """Labels against a length rule, as counts of expect by got."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("got"))
    both = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return both.groupBy("quality").pivot("got", [0, 1]).agg(F.count(F.lit(1))).na.fill(0).select("quality", F.col("0").alias("got_0"), F.col("1").alias("got_1"))


def usage_cost(spark, sf_dir):
    """Tokens (a quarter of the characters, rounded up) and their price by role."""
    c = table(spark, sf_dir, "conversations").withColumn("tokens", F.ceil(F.length("text") / 4).cast("long"))
    price = F.when(F.col("role") == "user", 0.6).when(F.col("role") == "assistant", 0.8)
    return c.groupBy("role").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("turns")).select("role", "tokens", "turns", F.round(F.col("tokens") / 1e6 * price, 6).alias("cost"))


def knowledge_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 2000).alias("long_docs"))


def pricing_totals(spark, sf_dir):
    """Build, support, contingency and margin in whole cents of each order's lines."""
    build = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(build.alias("build"))
    part = lambda share: T.half_up(F.col("build") * share).cast("long")
    rows = rows.withColumns({"support": part(0.15), "contingency": part(0.1), "margin": part(0.15)})
    return rows.withColumn("total", F.col("build") + F.col("support") + F.col("contingency") + F.col("margin"))


def budget_scenarios(spark, sf_dir):
    """Low, middle and high budget of each priority with their multiple of the middle."""
    b = M.budget(_orders(spark, sf_dir).withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long")), ["o_orderpriority"], "cents")
    rows = b.select("o_orderpriority", "median", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("target")) for n, c in (("basic", "low"), ("recommended", "median"), ("premium", "high"))])).alias("s"))
    return rows.select("o_orderpriority", "s.name", "s.target", F.round(F.col("s.target") / F.col("median"), 6).alias("multiplier"))


# ranking
def tender_rank(spark, sf_dir):
    o = _orders(spark, sf_dir)
    fit = F.when(F.col("o_totalprice") > 300000, "high").when(F.col("o_totalprice") > 100000, "medium").otherwise("low")
    late = F.datediff("day", _day()) < 3
    order = K.tender_order(late, fit, F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 100) / 100.0), F.col("day"), F.col("o_orderkey"))
    rank = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(*order))
    return o.filter("o_totalprice > 100000").select("o_orderkey", "o_orderpriority", rank.cast("long").alias("rank"))


def eligible_slots(spark, sf_dir):
    o = _orders(spark, sf_dir)
    out = K.slots(o, "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], F.col("o_orderstatus") == "O", 2)
    return out.filter("chosen").select("o_custkey", "o_orderkey", F.col("slot").cast("long").alias("slot"))


def topk_per_group(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.row_number().over(w).cast("long").alias("rank")).filter("rank <= 3")


def running_char_budget(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("conv_id is not null")
    return K.within_budget(c, "conv_id", [F.col("turn")], F.length("text"), 1000).select("conv_id", "turn", F.col("used").cast("long").alias("used"))


def retention(spark, sf_dir):
    return K.newest(_orders(spark, sf_dir), "o_custkey", [F.desc("day"), F.desc("o_orderkey")], 3).filter("kept").select("o_custkey", "o_orderkey")


def project_ranking(spark, sf_dir):
    """Parts as projects against one wanted profile, best three of each brand."""
    wanted = F.array(F.lit("blue"), F.lit("widget"))
    age = (F.col("p_size") % 8).cast("double")
    kind = F.when(F.col("p_type") == "ECONOMY", "saas").when(F.col("p_type") == "SMALL", "software").otherwise("other")
    score = K.project_score(F.split("p_name", " "), wanted, age, kind, F.lit("saas"))
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", score.alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("score"), "p_partkey")).cast("long")).filter("rank <= 3")


def key_partners(spark, sf_dir):
    """Suppliers of each nation by awards, then last award, with three pieces of evidence each, top 8."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey", F.to_date("l_shipdate").alias("day"))
    evidence = F.array_join(F.transform(F.slice(F.array_sort(F.collect_set("l_orderkey")), 1, 3), lambda x: x.cast("string")), ",")
    stats = rows.groupBy("s_suppkey").agg(F.count("*").alias("awards"), F.max("day").alias("last"), evidence.alias("evidence")).join(s, "s_suppkey")
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("awards"), F.desc("last"), "s_suppkey")
    return stats.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 8").select("s_nationkey", "rank", "s_suppkey", "awards", "evidence")


_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_BUDGET = f"""
r AS (SELECT o_orderpriority, {_CENTS} AS cents FROM orders),
m AS (SELECT o_orderpriority, quantile_cont(cents, 0.5) AS m, count(cents) AS n FROM r GROUP BY 1),
k AS (SELECT r.*, n >= 3 AND (cents > 10 * m OR cents < m / 10) AS out FROM r JOIN m USING (o_orderpriority)),
b AS (SELECT o_orderpriority, quantile_cont(cents, 0.25) FILTER (WHERE NOT out) AS p25, quantile_cont(cents, 0.5) FILTER (WHERE NOT out) AS p50, quantile_cont(cents, 0.75) FILTER (WHERE NOT out) AS p75,
             min(cents) FILTER (WHERE NOT out) AS lo, max(cents) FILTER (WHERE NOT out) AS hi, count(*) FILTER (WHERE NOT out) AS n_used, count(*) FILTER (WHERE out) AS n_outliers FROM k GROUP BY 1),
f AS (SELECT o_orderpriority, CAST(floor(p25 + 0.5) AS BIGINT) AS low, CAST(floor(p50 + 0.5) AS BIGINT) AS median, CAST(floor(p75 + 0.5) AS BIGINT) AS high, n_used, n_outliers,
             ['very low', 'low', 'medium'][1 + greatest(0, (CASE WHEN n_used >= 5 THEN 2 WHEN n_used >= 2 THEN 1 ELSE 0 END) - (CASE WHEN p75 / p25 > 5 OR hi / CAST(lo AS DOUBLE) > 50 THEN 1 ELSE 0 END))] AS confidence FROM b)"""
_ROW = "SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {by}) AS rank FROM {of}"

QUERIES = {
    "keyword_prefilter": (keyword_prefilter, f"SELECT p_partkey, p_name FROM part WHERE NOT (regexp_matches(' ' || {S.fold('p_name')} || ' ', ' (small|red) ') AND NOT regexp_matches(' ' || {S.fold('p_name')} || ' ', ' (widget) '))"),
    "notice_drops": (notice_drops, f"WITH {_ORDERS} SELECT o_orderkey, {_REASON} AS reason FROM o"),
    "drop_reason_buckets": (drop_reason_buckets, f"WITH {_ORDERS}, r AS (SELECT {_REASON} AS reason FROM o) SELECT {_BUCKET} AS bucket, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1"),
    "funnel_counts": (funnel_counts, f"WITH {_ORDERS}, r AS (SELECT *, {_REASON} AS reason FROM o) SELECT o_orderpriority, count(*) AS fetched, count(*) FILTER (WHERE reason IS NULL) AS kept, count(*) FILTER (WHERE reason = 'award notice') AS awards, count(*) FILTER (WHERE starts_with(reason, 'expired')) AS expired, count(*) FILTER (WHERE o_totalprice >= 400000) AS high_fit FROM r GROUP BY 1"),
    "run_totals": (run_totals, f"WITH {_ORDERS}, r AS (SELECT *, {_REASON} AS reason FROM o) SELECT count(*) AS n, count(*) FILTER (WHERE reason IS NULL) AS kept, count(DISTINCT o_custkey) AS buyers, count(*) FILTER (WHERE day > DATE '{TODAY}') AS future, CAST(max(day) AS VARCHAR) AS newest FROM r"),
    "exact_dedupe_documents": (exact_dedupe_documents, "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"),
    "greedy_first_wins_dedupe": (greedy_first_wins_dedupe, f"SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY md5({S.fold('text')}) ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1"),
    "duplicate_absorption": (duplicate_absorption, "WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) SELECT p_name, p_brand, max(p_partkey) FILTER (WHERE r = 1) AS p_partkey, coalesce(string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) FILTER (WHERE r > 1), '') AS also_seen FROM r GROUP BY 1, 2"),
    "merge_lanes": (merge_lanes, "SELECT 'customer' AS lane, c_custkey AS id, c_name AS name, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT 'nation', n_nationkey, n_name, NULL FROM nation"),
    "occurrence_index_titles": (occurrence_index_titles, "SELECT p_partkey, CASE WHEN r > 1 THEN p_name || ' (' || r || ')' ELSE p_name END AS title FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)"),
    "identity_duplicates": (identity_duplicates, f"SELECT p_type, {S.fold('p_name')} AS name, p_brand, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL HAVING count(*) > 1"),
    "greedy_relaunch_dedupe": (greedy_relaunch_dedupe, None),
    "anti_join_known": (anti_join_known, "SELECT c_custkey, priority FROM customer, (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS priority) WHERE (c_custkey, priority) NOT IN (SELECT o_custkey, o_orderpriority FROM orders)"),
    "left_join_fallback_position": (left_join_fallback_position, f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS pos, {S.fold('text')} AS key FROM conversations WHERE conv_id IS NOT NULL),
        a AS (SELECT conv_id, pos, key, row_number() OVER (PARTITION BY conv_id, key ORDER BY pos) AS k FROM c WHERE role = 'user'), b AS (SELECT conv_id, pos, key, turn, row_number() OVER (PARTITION BY conv_id, key ORDER BY pos) AS k FROM c WHERE role = 'assistant'),
        e AS (SELECT a.conv_id, a.pos, b.pos AS used, b.turn FROM a LEFT JOIN b ON a.conv_id = b.conv_id AND a.key = b.key AND a.k = b.k),
        f AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = b.conv_id AND e.used = b.pos))
        SELECT e.conv_id, CAST(e.pos AS INTEGER) AS pos, CASE WHEN e.used IS NOT NULL THEN 'key' WHEN f.pos IS NOT NULL THEN 'position' ELSE 'missing' END AS matched, coalesce(e.turn, f.turn, -1) AS turn FROM e LEFT JOIN f ON e.used IS NULL AND f.conv_id = e.conv_id AND f.pos = e.pos"""),
    "rect_merge": (rect_merge, f"WITH {_ORDERS}, r AS (SELECT * FROM ({_ROW.format(part='o_custkey', by='day DESC, o_orderkey DESC', of='o')} WHERE o_orderstatus = 'P') WHERE rank = 1) SELECT o.o_orderkey, CAST(greatest(o.day, r.day) AS VARCHAR) AS effective, coalesce(r.o_orderkey, -1) AS corrected_by FROM o LEFT JOIN r USING (o_custkey) WHERE o.o_orderstatus = 'O'"),
    "supersede_self_join": (supersede_self_join, f"WITH {_ORDERS}, r AS (SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY day DESC, o_orderkey DESC) AS superseded_by FROM o) SELECT * FROM r WHERE superseded_by <> o_orderkey"),
    "same_reference_join": (same_reference_join, f"WITH {_ORDERS}, d AS (SELECT * FROM ({_ROW.format(part='o_custkey, o_orderpriority', by='day, o_orderkey', of='o')} WHERE o_orderkey % 3 <> 0) WHERE rank = 1) SELECT o.o_orderkey, d.o_orderkey AS twin FROM o JOIN d USING (o_custkey, o_orderpriority) WHERE o.o_orderkey % 3 = 0"),
    "near_copy_join": (near_copy_join, f"WITH {_AWARDS}, k AS (SELECT *, l_orderkey * 10 + l_linenumber AS key FROM a) SELECT x.key, min(y.key) AS copy_of FROM k x JOIN k y ON x.l_suppkey = y.l_suppkey AND x.l_partkey = y.l_partkey AND x.day - y.day BETWEEN 0 AND 7 AND (x.day > y.day OR y.key < x.key) GROUP BY x.key"),
    "band_join_copies": (band_join_copies, f"WITH {_ORDERS} SELECT a.o_orderkey AS order_a, b.o_orderkey AS order_b FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = 'O' AND b.o_orderstatus = 'P' AND abs(a.day - b.day) <= 90 AND abs(a.o_totalprice - b.o_totalprice) <= 0.02::DOUBLE * greatest(a.o_totalprice, b.o_totalprice)"),
    "catalogue_price_lookup": (catalogue_price_lookup, "SELECT l_orderkey, CAST(sum(CAST(round(coalesce(p_retailprice, 0) * 100) AS BIGINT) * CAST(l_quantity AS BIGINT)) AS BIGINT) AS cents FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_type = 'ECONOMY') ON l_partkey = p_partkey GROUP BY 1"),
    "full_outer_plan_check": (full_outer_plan_check, "WITH p AS (SELECT o_orderkey AS k, o_totalprice AS planned FROM orders WHERE o_orderkey % 7 <> 0), d AS (SELECT l_orderkey AS k, sum(l_quantity) AS shipped FROM lineitem GROUP BY 1), x AS (SELECT coalesce(p.k, d.k) AS k, coalesce(planned, 0) AS planned, coalesce(shipped, 0) AS shipped FROM p FULL JOIN d ON p.k = d.k) SELECT * FROM x WHERE abs(planned / 2500 - shipped) > 0.15::DOUBLE * greatest(planned / 2500, shipped)"),
    "percentile_budget": (percentile_budget, f"WITH {_BUDGET} SELECT * FROM f"),
    "outlier_10x_median": (outlier_10x_median, "WITH m AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.5) AS m, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, count(*) AS n_outliers FROM lineitem JOIN m USING (l_suppkey) WHERE n >= 3 AND (l_extendedprice > 10 * m OR l_extendedprice < m / 10) GROUP BY 1"),
    "upper_median": (upper_median, "SELECT p_brand, count(p_retailprice) AS n, min(p_retailprice) AS low, list_sort(list(p_retailprice))[1 + CAST(floor(count(*) / 2) AS BIGINT)] AS middle, max(p_retailprice) AS high FROM part GROUP BY 1"),
    "dominant_currency": (dominant_currency, "WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY ALL) SELECT o_custkey, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) AS r FROM c) WHERE r = 1"),
    "competitor_rollup": (competitor_rollup, f"WITH {_AWARDS}, s AS (SELECT o_custkey, l_suppkey, count(*) AS wins, round(sum(l_extendedprice), 2) AS won, CAST(max(day) AS VARCHAR) AS last_win FROM a GROUP BY 1, 2), r AS ({_ROW.format(part='o_custkey', by='wins DESC, won DESC, l_suppkey', of='s')}) SELECT o_custkey, CAST(rank AS INTEGER) AS rank, l_suppkey, wins, won, last_win FROM r WHERE rank <= 8"),
    "past_winners": (past_winners, f"WITH {_AWARDS}, d AS (SELECT DISTINCT o_custkey, l_suppkey, day, l_orderkey FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, l_suppkey ORDER BY day DESC, l_orderkey DESC) AS k FROM d) SELECT o_custkey, l_suppkey, count(DISTINCT l_orderkey) AS wins, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k <= 3) AS latest FROM r GROUP BY 1, 2"),
    "buyer_groups": (buyer_groups, f"WITH {_ORDERS} SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities, max(o_totalprice) AS max_price, CAST(coalesce(min(day - DATE '{TODAY}') FILTER (WHERE day >= DATE '{TODAY}'), -1) AS INTEGER) AS nearest, bool_or(o_orderstatus = 'O') AS any_open, count(*) AS size FROM o GROUP BY 1"),
    "weighted_fit_bround": (weighted_fit_bround, "WITH w AS (SELECT l_orderkey, l_quantity, CASE WHEN l_returnflag = 'R' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM lineitem) SELECT l_orderkey, CAST(round_even(sum(l_quantity * w) / sum(w), 0) AS BIGINT) AS fit FROM w GROUP BY 1"),
    "coverage_ratio": (coverage_ratio, "WITH w AS (SELECT l_orderkey, CASE l_returnflag WHEN 'N' THEN 1.0::DOUBLE WHEN 'R' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS s FROM lineitem) SELECT l_orderkey, round(avg(s), 2) AS coverage, CAST(floor(100 * avg(s) + 0.5) AS BIGINT) AS percent FROM w GROUP BY 1"),
    "dashboard_kpis": (dashboard_kpis, "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus <> 'F') AS active, round(sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE 0 END) / greatest(count(*) FILTER (WHERE o_orderstatus <> 'F'), 1), 2) AS average FROM orders GROUP BY 1"),
    "confusion_matrix": (confusion_matrix, "SELECT quality, count(*) FILTER (WHERE n_chars < 1000) AS got_0, count(*) FILTER (WHERE n_chars >= 1000) AS got_1 FROM labels JOIN documents USING (doc_id) GROUP BY 1"),
    "usage_cost": (usage_cost, "WITH c AS (SELECT role, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS BIGINT) AS tokens, count(*) AS turns FROM conversations GROUP BY 1) SELECT role, tokens, turns, round(tokens / 1000000.0::DOUBLE * (CASE role WHEN 'user' THEN 0.6::DOUBLE WHEN 'assistant' THEN 0.8::DOUBLE END), 6) AS cost FROM c"),
    "knowledge_counts": (knowledge_counts, "SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars > 2000) AS long_docs FROM documents GROUP BY 1"),
    "pricing_totals": (pricing_totals, "WITH b AS (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS build FROM lineitem GROUP BY 1), s AS (SELECT *, CAST(floor(build * 0.15::DOUBLE + 0.5) AS BIGINT) AS support, CAST(floor(build * 0.1::DOUBLE + 0.5) AS BIGINT) AS contingency, CAST(floor(build * 0.15::DOUBLE + 0.5) AS BIGINT) AS margin FROM b) SELECT *, build + support + contingency + margin AS total FROM s"),
    "budget_scenarios": (budget_scenarios, f"WITH {_BUDGET}, s AS (SELECT o_orderpriority, median, unnest(['basic', 'recommended', 'premium']) AS name, unnest([low, median, high]) AS target FROM f) SELECT o_orderpriority, name, target, round(target / CAST(median AS DOUBLE), 6) AS multiplier FROM s"),
    "tender_rank": (tender_rank, f"WITH {_ORDERS}, t AS (SELECT *, day - DATE '{TODAY}' < 3 AS late, CASE WHEN o_totalprice > 300000 THEN 3 WHEN o_totalprice > 100000 THEN 2 ELSE 0 END AS fit, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 100) / 100.0 END AS cov FROM o WHERE o_totalprice > 100000) SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY late, fit DESC, coalesce(cov, 0) DESC, day, o_orderkey) AS rank FROM t"),
    "eligible_slots": (eligible_slots, "WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS slot FROM orders) SELECT o_custkey, o_orderkey, slot FROM s WHERE o_orderstatus = 'O' AND slot <= 2"),
    "topk_per_group": (topk_per_group, "SELECT source, doc_id, n_chars, rank FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3"),
    "running_char_budget": (running_char_budget, "SELECT conv_id, turn, used FROM (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM conversations WHERE conv_id IS NOT NULL) WHERE used <= 1000"),
    "retention": (retention, "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 3"),
    "project_ranking": (project_ranking, """WITH p AS (SELECT p_brand, p_partkey, list_distinct(string_split(p_name, ' ')) AS w, CAST(p_size % 8 AS DOUBLE) AS age, CASE p_type WHEN 'ECONOMY' THEN 'saas' WHEN 'SMALL' THEN 'software' ELSE 'other' END AS kind FROM part),
        s AS (SELECT p_brand, p_partkey, round(50 * len(list_intersect(w, ['blue', 'widget'])) / CAST(len(list_distinct(list_concat(w, ['blue', 'widget']))) AS DOUBLE) + CASE WHEN age <= 2 THEN 30.0::DOUBLE WHEN age <= 5 THEN 30.0::DOUBLE * (1 - (age - 2) / 3) ELSE 0 END + CASE kind WHEN 'saas' THEN 20 WHEN 'software' THEN 15 ELSE 0 END, 2) AS score FROM p)
        SELECT p_brand, p_partkey, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS rank FROM s) WHERE rank <= 3"""),
    "key_partners": (key_partners, """WITH d AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), e AS (SELECT l_suppkey, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) FILTER (WHERE k <= 3) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS k FROM d) GROUP BY 1),
        s AS (SELECT l_suppkey, count(*) AS awards, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem GROUP BY 1), x AS (SELECT s_nationkey, s_suppkey, awards, last, evidence FROM s JOIN e USING (l_suppkey) JOIN supplier ON s_suppkey = l_suppkey)
        SELECT s_nationkey, rank, s_suppkey, awards, evidence FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY awards DESC, last DESC, s_suppkey) AS rank FROM x) WHERE rank <= 8"""),
}
