"""Decision queries: suppliers stand for documents (their part types are what they hold), orders for tenders, lines for requirements."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import decide as D
from quern.session import table


def _matrix(spark, sf_dir):
    """Lines as requirement rows of their order."""
    category = F.get(F.array(F.lit("technical"), F.lit("team"), F.lit("experience")), (F.col("l_partkey") % 3).cast("int"))
    needed = F.lit(10)
    q, e = (F.col("l_quantity") / 4).cast("int"), (F.col("l_discount") * 50).cast("int")
    lines = table(spark, sf_dir, "lineitem")
    certs = F.when(F.col("l_tax") > 0.04, F.array(F.lit("iso"))).otherwise(F.array().cast("array<string>"))
    return lines.select(
        "l_orderkey", "l_linenumber", category.alias("category"), (F.col("l_returnflag") != "R").alias("mandatory"), q.alias("found"), certs.alias("certs"),
        D.status(q, e, needed).alias("status"), D.percent(q, e, needed).alias("percent"),
    )


_MATRIX = """m AS (
  SELECT l_orderkey, l_linenumber, ['technical', 'team', 'experience'][1 + l_partkey % 3] AS category, l_returnflag <> 'R' AS mandatory, q AS found, l_tax > 0.04::DOUBLE AS certs,
         CASE WHEN q >= 10 THEN 'covered' WHEN q + e > 0 THEN 'partial' ELSE 'missing' END AS status, 100 * least(q + 0.5::DOUBLE * e, 10) / 10 AS percent
  FROM (SELECT *, CAST(trunc(l_quantity / 4) AS INTEGER) AS q, CAST(trunc(l_discount * 50) AS INTEGER) AS e FROM lineitem))"""


def status_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir).groupBy("category", "mandatory", "status").agg(F.count("*").alias("n"), F.round(F.avg("percent"), 6).alias("percent"))


def fit_and_recommendation(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return D.fit_score(m, "l_orderkey", "category").join(D.recommendation(m, "l_orderkey"), "l_orderkey")


def gap_report(spark, sf_dir):
    return D.gap_report(_matrix(spark, sf_dir), "l_orderkey")


def risk_list(spark, sf_dir):
    return D.risks(_matrix(spark, sf_dir), "l_orderkey")


def rule_match_matrix(spark, sf_dir):
    """Each nation needs two part types; even nations need both. Which suppliers qualify?"""
    types = F.array(*[F.lit(x) for x in ("ECONOMY", "SMALL", "STANDARD", "MEDIUM", "LARGE", "PROMO")])
    k = F.col("n_nationkey")
    needs = table(spark, sf_dir, "nation").select("n_nationkey", (k % 2 == 0).alias("all_of"), F.explode(F.array(F.get(types, k % 6), F.get(types, (k + 2) % 6))).alias("item"))
    sold = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    held = sold.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("item")), "l_partkey").select("l_suppkey", "item").distinct()
    return D.rule_match(needs, held, "n_nationkey", "l_suppkey", "item", "all_of").select("n_nationkey", "l_suppkey", "matched", "qualified")


def certificate_groups(spark, sf_dir):
    """Suppliers that hold a certificate of every group, as they are or by an equivalent."""
    names = F.array(*[F.lit(x) for x in ("iso9001", "iso27001", "soc2", "pmp", "prince2")])
    held = F.filter(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(F.shiftright(F.col("s_suppkey"), 0).bitwiseAND(F.shiftleft(F.lit(1).cast("long"), 0) * F.pow(F.lit(2), i).cast("long")) > 0, F.get(names, i))), lambda x: x.isNotNull())
    s = table(spark, sf_dir, "supplier").select("s_suppkey", held.alias("held"))
    asked = F.array(F.lit("iso27001"), F.lit("pmp"))
    strict = D.groups_met(F.transform(asked, lambda c: F.array(c)), F.col("held"))
    loose = D.groups_met(D.with_equivalents(asked, {"iso27001": "soc2", "pmp": "prince2"}), F.col("held"))
    return s.select("s_suppkey", strict.alias("qualified"), loose.alias("equivalent"))


def rerank_percent(spark, sf_dir):
    score = F.col("value") / 10 - 9
    return table(spark, sf_dir, "events").select("event_id", F.round(D.logit_percent(score), 6).alias("percent"))


def proof_selection(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("need"), (F.col("l_returnflag") == "R").alias("demo"), F.col("l_extendedprice").alias("score"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("doc_id"))
    return D.proof(lines, "need", F.lit(2)).select("need", "doc_id", "proves")


def team_set_cover(spark, sf_dir):
    """For each customer, the fewest suppliers that cover its part types, two for each where there are two."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    roles = lines.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    slots = roles.groupBy(F.col("o_custkey").alias("tender"), F.col("p_type").alias("role"), F.col("l_suppkey").alias("person")).agg(F.min("l_linenumber").alias("rank")).withColumn("needed", F.lit(2))
    return D.smallest_team(slots, "tender")


QUERIES = {
    "status_matrix": (status_matrix, f"WITH {_MATRIX} SELECT category, mandatory, status, count(*) AS n, round(avg(percent), 6) AS percent FROM m GROUP BY ALL"),
    "fit_and_recommendation": (fit_and_recommendation, f"""WITH {_MATRIX}, c AS (SELECT l_orderkey, category, round_even(sum(percent * w) / sum(w), 0) AS fit FROM (SELECT *, CASE WHEN mandatory THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w FROM m) GROUP BY ALL),
        f AS (SELECT l_orderkey, CAST(round_even(avg(fit), 0) AS BIGINT) AS overall, count(*) AS categories, CAST(min(fit) AS BIGINT) AS weakest FROM c GROUP BY 1),
        s AS (SELECT l_orderkey, count(*) FILTER (WHERE status = 'missing') AS gaps, count(*) FILTER (WHERE status = 'partial') AS partials, count(*) FILTER (WHERE status = 'missing' AND category = 'technical' AND mandatory) AS hard, count(*) FILTER (WHERE status = 'missing' AND category = 'technical') AS tech_gaps,
              avg(CASE status WHEN 'covered' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5::DOUBLE ELSE 0 END) FILTER (WHERE category = 'technical') AS tech FROM m GROUP BY 1)
        SELECT l_orderkey, overall, categories, weakest, gaps, partials, CASE WHEN gaps = 0 AND partials = 0 THEN 'bid' WHEN hard > 0 AND tech < 0.5 THEN 'no_bid' WHEN gaps > 0 AND tech_gaps = 0 THEN 'bid_with_partner' ELSE 'review' END AS recommendation FROM f JOIN s USING (l_orderkey)"""),
    "gap_report": (gap_report, f"WITH {_MATRIX} SELECT l_orderkey, CASE WHEN category = 'team' THEN 'people' WHEN category = 'experience' THEN 'project' WHEN certs THEN 'certification' WHEN found = 0 THEN 'technology' ELSE 'evidence' END AS cause, count(*) AS n FROM m WHERE status <> 'covered' GROUP BY 1, 2"),
    "risk_list": (risk_list, f"WITH {_MATRIX}, r AS (SELECT l_orderkey, bool_or(status = 'missing' AND mandatory) AS a, count(*) FILTER (WHERE status = 'partial') > 2 AS b, count(*) FILTER (WHERE category = 'team') = 0 AS c FROM m GROUP BY 1) SELECT l_orderkey, array_to_string(list_filter([CASE WHEN a THEN 'mandatory_gap' END, CASE WHEN b THEN 'many_partials' END, CASE WHEN c THEN 'no_team' END], lambda x: x IS NOT NULL), ',') AS risks FROM r"),
    "rule_match_matrix": (rule_match_matrix, """WITH t AS (SELECT ['ECONOMY', 'SMALL', 'STANDARD', 'MEDIUM', 'LARGE', 'PROMO'] AS t), n AS (SELECT n_nationkey, n_nationkey % 2 = 0 AS all_of, unnest([t[1 + n_nationkey % 6], t[1 + (n_nationkey + 2) % 6]]) AS item FROM nation, t),
        h AS (SELECT l_suppkey, p_type AS item FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
        SELECT n_nationkey, l_suppkey, count(*) AS matched, CASE WHEN any_value(all_of) THEN count(*) = 2 ELSE true END AS qualified FROM n JOIN h USING (item) GROUP BY 1, 2"""),
    "certificate_groups": (certificate_groups, "SELECT s_suppkey, (s_suppkey & 2) > 0 AND (s_suppkey & 8) > 0 AS qualified, (s_suppkey & 6) > 0 AND (s_suppkey & 24) > 0 AS equivalent FROM supplier"),
    "rerank_percent": (rerank_percent, "SELECT event_id, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 * (value / 10 - 9 + 8) / 8)), 6) AS percent FROM events"),
    "proof_selection": (proof_selection, "SELECT l_orderkey AS need, l_partkey * 10 + l_linenumber AS doc_id, l_returnflag <> 'R' AS proves FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R', l_extendedprice DESC, l_partkey * 10 + l_linenumber) AS r FROM lineitem) WHERE r <= 2"),
    "team_set_cover": (team_set_cover, None),
}
