"""Document-side and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import parsing as P
from quern.functions import text as T
from quern.operators import claims as C
from quern.operators import deck as K
from quern.operators import quotes
from quern.plans import sql as S
from quern.session import shared_dir, spread, table
from quern.streaming import runs


def certification_rollup(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy("l_suppkey").agg(F.collect_set("p_brand").alias("brands"))
    return K.roll_up(held, "brands", "l_suppkey")


def asset_grouping(spark, sf_dir):
    return K.asset_groups(table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey", F.col("l_returnflag") == "R")


def asset_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("conv_id is not null")
    rows = rows.select("conv_id", "turn", F.when(F.col("role") != "system", F.col("role")).alias("role"), F.col("text").alias("snippet"))
    return K.first_values(rows, "conv_id", "turn", ["role"], "snippet").withColumn("snippet", F.md5("snippet"))


def table_chunks(spark, sf_dir):
    out = K.chunks(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 10)
    return out.select("p_brand", "p_partkey", F.col("page").cast("long").alias("page"), F.col("place").cast("long").alias("place"), F.col("pages").cast("long").alias("pages"))


def slide_order(spark, sf_dir):
    """Regions in a fixed order of keys, one of which has no data."""
    order = spark.range(7).select(F.col("id").cast("int").alias("r_regionkey"))
    return K.ordered(table(spark, sf_dir, "region"), order, "r_regionkey").select("r_regionkey", F.coalesce("r_name", F.lit("to be completed")).alias("title"), "placeholder")


def cache_sync(spark, sf_dir):
    """A client that holds every second customer, some under another segment, and a server that has every third."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    held = c.filter("c_custkey % 2 = 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, "OTHER").otherwise(F.col("c_mktsegment")))
    return K.sync(held, c.filter("c_custkey % 3 = 0"), "c_custkey")


def delete_referential(spark, sf_dir):
    links = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_set(F.col("o_orderkey") % 1500)), lambda x: x).alias("links"))
    out = K.delete_with_links(links, links.filter("o_custkey % 10 = 0"), "o_custkey", "links")
    return out.select("o_custkey", F.array_join(F.transform("links", lambda x: x.cast("string")), ",").alias("links"), "unlinked")


def claim_numbers(spark, sf_dir):
    """Order prices rounded in a sentence: which numbers does the order itself not hold?"""
    o = table(spark, sf_dir, "orders")
    text = F.concat_ws(" ", F.lit("order"), F.col("o_orderkey").cast("string"), F.lit("for"), F.floor("o_totalprice").cast("string"), F.lit("of"), F.year("o_orderdate").cast("string"))
    bad = K.unmatched_claims(text, F.array(F.col("o_orderkey").cast("string"), F.year("o_orderdate").cast("string")))
    return o.select("o_orderkey", F.array_join(bad, ",").alias("unmatched"), K.scrub(F.lit("text"), F.size(bad) > 0).alias("scrubbed"))


def claim_checks(spark, sf_dir):
    """A sentence for each order with a name, a price and a superlative, against facts of which some orders lack one."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = F.get(F.array(F.lit("Blue Harbour"), F.lit("Red Mill"), F.lit("Green Valley")), (k % 3).cast("int"))
    price = F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(","))
    text = F.concat(F.lit("Offer to "), name, F.lit(" for "), price, F.when(k % 2 == 0, " EUR with guaranteed delivery").otherwise(" EUR with the best team"))
    texts = o.select(k.alias("tender"), F.lit("slide/1").alias("path"), F.lit("en").alias("language"), text.alias("text"))
    facts = o.select(k.alias("tender"), F.when(k % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("number"), F.when(k % 4 == 0, "Red Mill").otherwise(name).alias("name"), F.when(k % 3 == 0, "Best in class").alias("claim"))
    out = C.violations(texts, facts, "tender")
    return out.withColumn("found", F.when(F.col("kind") == "number", F.format_string("%.2f", F.col("found").try_cast("double"))).otherwise(F.col("found")))


def contact_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("a"), F.array_sort(F.collect_set("o_orderstatus")).alias("b"))
    return o.select("o_custkey", F.array_join(K.contacts(["a", "b"], 6), "|").alias("contacts"))


def legal_types(spark, sf_dir):
    rules = [("supplier#00000000[0-4]", "public"), ("supplier#0000000[0-2]", "association")]
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", K.legal_type(F.col("s_name"), rules).alias("kind"), K.staff_band(F.concat(F.col("s_suppkey").cast("string"), F.lit(" to 99 staff"))).alias("size"))


def card_summary(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.round(F.max("l_discount") * 10, 4).alias("score"))


def deck_fill(spark, sf_dir):
    """Blocks of each conversation on pages of 400 characters, filled in order."""
    c = table(spark, sf_dir, "conversations").filter("conv_id is not null")
    heights = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("h")))), lambda x: x["h"])
    rows = c.groupBy("conv_id").agg(heights.alias("h")).withColumn("page", P.fill_pages(400)("h"))
    return rows.select("conv_id", F.array_join(F.transform("page", lambda x: x.cast("string")), ",").alias("pages"))


def quote_fuzzy(spark, sf_dir):
    """Documents that hold benchmark passages with their third word left out."""
    w = F.filter(F.split(T.fold("text"), " "), lambda w: w != "")
    b = table(spark, sf_dir, "benchmark").select("item_id", w.alias("w"))
    b = b.select("item_id", F.array_join(F.concat(F.slice("w", 1, 2), F.slice("w", F.lit(4), F.greatest(F.size("w"), F.lit(1)))), " ").alias("quote"))
    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.fold("text").alias("t"))
    return quotes.found(texts, b, "doc_id", "item_id", quotes.Fuzzy)


def run_states_final(spark, sf_dir):
    """Final state of each user's run: signups end it well, errors badly."""
    status = F.when(F.col("event_type") == "signup", "done").when(F.col("event_type") == "error", "failed").otherwise("running")
    rows = table(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("run_id"), F.col("ts").alias("at"), status.alias("status"), "event_id")
    return runs.final_states(rows)


def stream_known_keys(spark, sf_dir):
    """Incremental run over the events as a stream: one row a key is stored, in batches, and read back."""
    events = table(spark, sf_dir, "events")
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = "event_id long, user_id long, value double"
    query = runs.incremental(source.select("event_id", "user_id", "value"), f"{root}/store", f"{root}/log", "event_id", schema, lambda d: d.withColumn("failed", F.col("value") < 1))
    query.awaitTermination()
    return spark.read.parquet(f"{root}/store").select("event_id", "user_id", "value")


def late_corrections(spark, sf_dir):
    """Events of each user's last day correct the value stored for the first."""
    day = F.to_date("ts")
    e = table(spark, sf_dir, "events").withColumn("late", day == F.max(day).over(Window.partitionBy("user_id"))).select("user_id", "value", "event_id", "late")
    stored = e.groupBy("user_id").agg(F.min_by("value", "event_id").alias("value"))
    return runs.corrections(stored, e.filter("late").drop("late"), "user_id", "value", "event_id")


QUERIES = {
    "certification_rollup": (certification_rollup, "WITH h AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT p_brand AS item, count(*) AS holders, array_to_string(list_sort(list(l_suppkey))[1:5], ',') AS first_holders FROM h GROUP BY 1"),
    "asset_grouping": (asset_grouping, "SELECT l_partkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS proves, count(*) FILTER (WHERE l_returnflag = 'R') AS weak, min(l_orderkey) AS first_row FROM lineitem GROUP BY 1"),
    "asset_merge": (asset_merge, "SELECT conv_id, (list(role ORDER BY turn) FILTER (WHERE role <> 'system'))[1] AS role, md5(string_agg(text, ' / ' ORDER BY turn)) AS snippet FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1"),
    "table_chunks": (table_chunks, "SELECT p_brand, p_partkey, k // 10 AS page, k % 10 AS place, CAST(ceil(n / 10.0) AS BIGINT) AS pages FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)"),
    "slide_order": (slide_order, "SELECT CAST(i AS INTEGER) AS r_regionkey, coalesce(r_name, 'to be completed') AS title, r_name IS NULL AS placeholder FROM range(7) t(i) LEFT JOIN region ON r_regionkey = i"),
    "cache_sync": (cache_sync, """SELECT CASE WHEN c_custkey % 3 <> 0 THEN 'delete' ELSE 'upsert' END AS action, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS c_mktsegment
        FROM customer WHERE (c_custkey % 2 = 0 AND c_custkey % 3 <> 0) OR (c_custkey % 3 = 0 AND (c_custkey % 2 = 1 OR c_custkey % 4 = 0))"""),
    "delete_referential": (delete_referential, "WITH l AS (SELECT DISTINCT o_custkey, o_orderkey % 1500 AS x FROM orders), k AS (SELECT DISTINCT o_custkey AS d FROM orders WHERE o_custkey % 10 = 0), r AS (SELECT * FROM l LEFT JOIN k ON x = d WHERE o_custkey % 10 <> 0) SELECT o_custkey, coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FILTER (WHERE d IS NULL), '') AS links, count(d) AS unlinked FROM r GROUP BY 1"),
    "claim_numbers": (claim_numbers, "WITH t AS (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS p, CAST(o_orderkey AS VARCHAR) AS k, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders) SELECT o_orderkey, CASE WHEN p IN (k, y) THEN '' ELSE p END AS unmatched, CASE WHEN p IN (k, y) THEN 'text' ELSE '[removed]' END AS scrubbed FROM t"),
    "claim_checks": (claim_checks, """WITH o AS (SELECT o_orderkey AS tender, o_totalprice AS p, ['Blue Harbour', 'Red Mill', 'Green Valley'][1 + o_orderkey % 3] AS n FROM orders)
        SELECT tender, 'slide/1' AS path, 'number' AS kind, printf('%.2f', p) AS found FROM o WHERE tender % 5 = 0 UNION ALL SELECT tender, 'slide/1', 'name', n FROM o WHERE tender % 4 = 0 AND n <> 'Red Mill'
        UNION ALL SELECT tender, 'slide/1', 'claim', CASE WHEN tender % 2 = 0 THEN 'guaranteed' ELSE 'best' END FROM o WHERE tender % 2 = 0 OR tender % 3 <> 0"""),
    "contact_union": (contact_union, "WITH a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS a, list_sort(list(DISTINCT o_orderstatus)) AS b FROM orders GROUP BY 1) SELECT o_custkey, array_to_string(list_concat(a, b)[1:6], '|') AS contacts FROM a"),
    "legal_types": (legal_types, "SELECT s_suppkey, CASE WHEN s_suppkey < 5 THEN 'public' WHEN s_suppkey < 30 THEN 'association' ELSE 'company' END AS kind, CASE WHEN s_suppkey < 50 THEN 'small' WHEN s_suppkey < 1000 THEN 'medium' ELSE 'large' END AS size FROM supplier"),
    "card_summary": (card_summary, "SELECT l_orderkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, round(max(l_discount) * 10, 4) AS score FROM lineitem GROUP BY 1"),
    "deck_fill": (deck_fill, None),
    "quote_fuzzy": (quote_fuzzy, None),
    "run_states_final": (run_states_final, """WITH r AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS run_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS status FROM events),
        k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS k FROM r), c AS (SELECT run_id, coalesce(min(k) FILTER (WHERE status <> 'running'), max(k)) AS c FROM k GROUP BY 1) SELECT run_id, status, c AS steps FROM k JOIN c USING (run_id) WHERE k = c"""),
    "stream_known_keys": (stream_known_keys, "SELECT event_id, user_id, value FROM events WHERE value >= 1"),
    "late_corrections": (late_corrections, "WITH s AS (SELECT user_id, arg_min(value, event_id) AS v FROM events GROUP BY 1), l AS (SELECT *, CAST(ts AS DATE) = max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS late FROM events), n AS (SELECT user_id, arg_max(value, event_id) AS w FROM l WHERE late GROUP BY 1) SELECT user_id, coalesce(w, v) AS value, w IS NOT NULL AND w <> v AS changed FROM s LEFT JOIN n USING (user_id)"),
}
