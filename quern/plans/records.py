"""Records, names, awards and joins over the driver tables: orders and suppliers stand for records and awards, parts for requirements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import awards as A
from quern.operators import names as N
from quern.operators import records as R
from quern.plans import sql as S
from quern.session import spread, table


def visible_records(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rec = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 3 == 0, "demo").otherwise("user_entered").alias("origin"), F.when(F.col("o_orderstatus") == "O", "indexed").otherwise("draft").alias("status"), F.md5("o_orderpriority").alias("digest"))
    index = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.md5(F.when(F.col("o_orderkey") % 4 == 0, "changed").otherwise(F.col("o_orderpriority"))).alias("digest"))
    return R.visible(rec, index, "company").select("id")


TYPES = {"technical": ["cv", "past_project", "tech_stack", "tool"], "team": ["cv"], "experience": ["past_project", "client_portfolio", "cv"]}


def category_routing(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    category = F.get(F.array(*map(F.lit, TYPES)), (F.col("p_partkey") % 3).cast("int"))
    sectors = F.when(F.col("p_size") % 7 == 0, F.array(F.lit("bank"))).otherwise(F.array().cast("array<string>"))
    needs = p.select("p_partkey", category.alias("category"), F.concat("p_name", F.when(F.col("p_size") > 25, " Projects").otherwise("")).alias("text"), sectors.alias("sectors"))
    return R.routed(needs, TYPES).select("p_partkey", "doc_type")


def record_search(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return R.searched(c, ["c_name", "c_mktsegment"], " 7 Build ").select("c_custkey")


def record_errors(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    rec = s.select(k.alias("id"), (k % 2).alias("type"), F.when(k % 5 == 0, F.lit("Same  Title")).otherwise(F.col("s_name")).alias("title"), F.when(k % 4 != 0, "c").alias("client"), F.array(k + 1).alias("links"), F.when(k % 3 == 0, F.col("s_acctbal")).alias("budget"), F.when(k % 6 == 0, "EUR").alias("currency"))
    found = R.errors(rec, ["client"], "links", "budget", "currency")
    return found.select("id", F.array_join(F.array_sort(F.transform(F.map_entries("errors"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("errors"))


def cv_projects(spark, sf_dir):
    projects = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("team"))
    out = R.members_projects(projects, "l_orderkey", "team")
    return out.select("member", F.size("projects").cast("long").alias("n"), F.md5(F.array_join(F.col("projects").cast("array<string>"), ",")).alias("projects"))


def client_projects(spark, sf_dir):
    """Projects whose client is a title, as it is written."""
    clients = table(spark, sf_dir, "nation").select(F.col("n_name").alias("title"), "n_nationkey")
    projects = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("NATION_"), (F.col("s_suppkey") % 40).cast("string")).alias("client"))
    return projects.join(clients, F.col("client") == F.col("title")).select("s_suppkey", "n_nationkey")


def tender_buyer_profiles(spark, sf_dir):
    """Tenders that survive (fit high or medium) with their buyer's profile, or without one."""
    o = table(spark, sf_dir, "orders")
    fit = F.when(F.col("o_totalprice") > 200000, "high").when(F.col("o_totalprice") > 100000, "medium").otherwise("low")
    profiles = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return o.withColumn("fit", fit).filter("fit <> 'low'").join(profiles, "o_custkey", "left").select("o_orderkey", "fit", "c_mktsegment")


def gap_requirement_ids(spark, sf_dir):
    """Gaps with the id of the requirement of the same folded text; the smallest id where several say the same."""
    p = table(spark, sf_dir, "part")
    ids = p.filter("p_size > 10").groupBy(T.normalize(F.concat("p_name", F.lit(" "), "p_type")).alias("key")).agg(F.min("p_partkey").alias("requirement_id"))
    gaps = p.filter("p_size <= 10").select("p_partkey", T.normalize(F.concat(F.upper("p_name"), F.lit("   "), "p_type")).alias("key"))
    return gaps.join(ids, "key", "left").select("p_partkey", "requirement_id")


def rank_lookup(spark, sf_dir):
    """Proposals of ranked tenders only, with their rank by price."""
    o = table(spark, sf_dir, "orders")
    ranks = o.filter("o_orderstatus = 'P'").withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).select("o_orderkey", "rank")
    return o.filter("o_orderkey % 2 = 0").select("o_orderkey").join(ranks, "o_orderkey")


# names against a vocabulary
_ALIAS = [("small ring", "ring"), ("ring", "ring"), ("gear", "gear"), ("large gear", "gear"), ("standard", "standard"), ("economy small", "small economy"), ("promo", "promotion")]
_IMPLIES = [("ring", "metal"), ("metal", "material"), ("gear", "machine"), ("machine", "metal"), ("promotion", "offer")]


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_name").alias("text"))


def dictionary_tags(spark, sf_dir):
    return R.tagged(_texts(spark, sf_dir), spark.createDataFrame(_ALIAS, "alias string, name string"), "p_partkey", "text")


def skill_closure(spark, sf_dir):
    """Tags of each text with all that they imply."""
    tags = dictionary_tags(spark, sf_dir)
    chains = R.closure(spark.createDataFrame(_IMPLIES, "name string, implied string"))
    return tags.unionByName(tags.join(F.broadcast(chains), "name").select("p_partkey", F.col("implied").alias("name"))).distinct()  # a vocabulary's chains, some tens


def leftover_words(spark, sf_dir):
    known, generic = F.array(*[F.lit(w) for w in ("ring", "gear")]), F.array(*[F.lit(w) for w in ("small", "large", "standard")])
    left = R.leftover(F.split(T.normalize("text"), " "), known, generic)
    return _texts(spark, sf_dir).select("p_partkey", F.array_join(left, " ").alias("words"))


def glossary_translation(spark, sf_dir):
    t = R.translated(T.normalize("text"), {"small": "petit", "small ring": "bague", "gear": "engrenage"})
    return _texts(spark, sf_dir).select("p_partkey", t.alias("text"))


def word_forms(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct().unionByName(spark.createDataFrame([("study",), ("schedule",), ("c++",), ("./test-",)], "word string"))
    return words.select("word", F.array_join(F.array_sort(R.word_forms(F.col("word"))), " ").alias("forms"))


def unknown_word_support(spark, sf_dir):
    """How many of a part's words the next part of its brand holds, and whether that names it."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("own"), F.split(F.lower(F.lead(F.concat_ws(" ", F.concat("p_name", F.lit("s")), "p_type")).over(w)), " ").alias("next")).filter("next is not null")
    none = F.array().cast("array<string>")
    return rows.select("p_partkey", F.round(R.support(F.col("own"), F.col("next")), 6).alias("support"), R.names_line(none, F.col("own"), F.col("next")).alias("named"), R.names_line(F.array(F.lit("promo")), none, F.col("next")).alias("by_term"))


def unknown_names(spark, sf_dir):
    """Words of the benchmark that no document writes in lower case, or that have a capital, digit or sign."""
    words = lambda t, c, key: table(spark, sf_dir, t).select(*key, F.explode(F.regexp_extract_all(c, F.lit("([A-Za-z][A-Za-z0-9+#]*)"), 1)).alias("word"))
    corpus = words("documents", "text", []).filter(F.col("word").rlike("^[a-z]+$")).distinct()
    return R.unknown_names(words("benchmark", "text", ["item_id"]).distinct(), corpus, "item_id").groupBy("item_id").agg(F.count("*").alias("n"), F.min("word").alias("first"))


def record_statements(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("note", F.when(F.col("s_suppkey") % 2 == 0, " ").otherwise(F.lit("n")))
    lines = R.statements({"Name": "s_name", "Nation": "s_nationkey", "Note": "note"})
    return s.select("s_suppkey", F.array_join(R.shortened(lines, 2, 12), "|").alias("lines"))


# awards
def _awards(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("row"), (F.col("o_orderkey") % 4000).alias("id"), F.col("o_orderstatus").alias("source"), F.to_date("o_orderdate").alias("day"), F.concat(F.lit("Contract "), F.col("o_custkey").cast("string"), F.lit(" "), F.lower("o_orderpriority")).alias("title"), F.col("o_totalprice").alias("amount"), F.col("o_custkey").alias("buyer"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 7).alias("bids"))


_AW = "a AS (SELECT o_orderkey AS row, o_orderkey % 4000 AS id, o_orderstatus AS source, CAST(o_orderdate AS DATE) AS day, 'Contract ' || o_custkey || ' ' || lower(o_orderpriority) AS title, o_totalprice AS amount, o_custkey AS buyer, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 7 END AS bids FROM orders)"


def partner_awards(spark, sf_dir):
    a = _awards(spark, sf_dir)
    return A.same_award(a.filter("row % 5 = 0"), a.filter("row % 5 <> 0"))


def award_dedupe(spark, sf_dir):
    return A.unique_awards(_awards(spark, sf_dir).withColumn("amount", F.round("amount", -4))).select("row", "id", "source")


def award_copies(spark, sf_dir):
    """Awards counted once across sources and within one: each order is an award, listed again by another source where its key is even, a little later and dearer."""
    a = _awards(spark, sf_dir).withColumns({"winners": F.array(F.concat(F.lit("Firm "), (F.col("buyer") % 40).cast("string"), F.lit(" S.A."))), "framework": F.col("row") % 11 == 0, "others": F.array().cast("array<string>")})
    again = a.filter("row % 2 = 0").withColumns({"source": F.lit("T"), "day": F.date_add("day", (F.col("row") % 120).cast("int")), "amount": F.when(F.col("row") % 10 > 0, F.col("amount") * (1 + (F.col("row") % 5) / 100)), "row": F.col("row") + 10**12, "winners": F.array(F.concat(F.lit("Ste FIRM "), (F.col("buyer") % 40).cast("string")))})
    return A.without_copies(a.unionByName(again).withColumn("buyer", F.col("buyer").cast("string")))


def award_richest(spark, sf_dir):
    return A.richest(_awards(spark, sf_dir).withColumn("day", F.when(F.col("row") % 2 == 0, F.col("day"))), ["buyer", "source"], ["bids", "day"]).select("row", "buyer", "source")


def median_bids(spark, sf_dir):
    return A.median_bids(_awards(spark, sf_dir), "buyer", "bids")


def comparable_awards(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    codes = F.array(F.lpad((F.col("p_size") * 10000).cast("string"), 8, "0"), F.lit("72000000"))
    rows = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, codes).otherwise(F.slice(codes, 1, 1)).alias("codes"), F.concat_ws(" ", "p_name", "p_type").alias("title"))
    return A.comparable(rows, "codes", "title", ["72000000"], "Standard economy works").select("p_partkey")


def body_names(spark, sf_dir):
    kinds = F.get(F.array(*[F.lit(x) for x in ("Mairie de", "CA (agglo) du", "Conseil départemental", "City SARL", "Ministry of")]), (F.col("s_suppkey") % 5).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws(" ", kinds, "s_name").alias("name")).select("s_suppkey", A.body_of("name").alias("body"))


def acronym_match(spark, sf_dir):
    """Parts' types and names against their initials with one word kept; odd parts have them in the wrong order."""
    full = F.split(F.lower(F.concat_ws(" ", "p_type", "p_name", F.lit("works"))), " ")
    first = F.array_join(F.transform(F.slice(full, 1, 3), lambda w: F.substring(w, 1, 1)), "")
    short = F.array(F.when(F.col("p_partkey") % 2 == 0, first).otherwise(F.reverse(first)), F.lit("works"))
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")).select("p_partkey", F.round(A.name_match(short, full), 6).alias("match"))


def past_projects(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), F.col("l_suppkey").alias("buyer"), F.concat(F.lit("P "), (F.col("l_partkey") % 50).cast("string")).alias("title"), (F.col("l_returnflag") == "R").alias("digital"))
    out = A.first_titles(rows.filter("row % 2 = 0"), rows.filter("row % 2 = 1"), "buyer")
    return out.select("buyer", "place", "row")


def fuzzy_names(spark, sf_dir):
    """The best customer for each supplier's name of four words; a third of the customers are public bodies, and each has a place."""
    name = lambda k, step: F.concat_ws(" ", *[F.concat(F.lit(w), ((F.col(k) * step) % n).cast("string")) for w, n in zip(("alpha", "beta", "gamma", "delta"), (3, 5, 7, 11), strict=True)])
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ask"), name("s_suppkey", 1).alias("name"))
    place = F.concat(F.lit("town gamma"), ((F.col("c_custkey") + 1) % 7).cast("string"), F.lit(" delta"), (F.col("c_custkey") % 4).cast("string"))
    registry = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), name("c_custkey", 3).alias("name"), (F.col("c_custkey") % 3 == 0).alias("public"), place.alias("place"))
    return N.best_match(asked, registry)


def official_domains(spark, sf_dir):
    k = F.col("s_suppkey")
    site = lambda m, name: F.when(k % m == 0, F.concat(F.lit(f"{name}"), k.cast("string"), F.lit(".org")))
    mail = F.when(k % 2 == 0, F.concat(F.lit("a@m"), k.cast("string"), F.lit(".fr"))).otherwise(F.lit("none"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", A.official_domain(site(7, "n"), site(5, "e"), (k % 10) / 10, site(3, "t"), mail).alias("domain"))


def award_search(spark, sf_dir):
    a = _awards(spark, sf_dir).select(F.concat(F.lit("72"), F.lpad((F.col("row") % 50).cast("string"), 2, "0")).alias("code"), "title", "day", "amount", F.col("buyer").alias("uid"), (F.col("row") % 9).alias("winner"))
    return A.award_search(a, ["720", "7213"], "urgent", "1996-01-01").select("uid", F.array_join(F.col("winners").cast("array<string>"), ",").alias("winners"), F.col("day").cast("string").alias("day"), "amount")


def registry_lookup(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    registry = s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("House W"), (F.col("s_suppkey") % 20).cast("string"), F.lit(" "), "s_name").alias("name"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") * 20).alias("staff"))
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ask"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") + 1).cast("long").alias("number"), F.concat(F.lit("HOUSE  w"), F.col("n_nationkey").cast("string")).alias("called"))
    return A.registry_lookup(asked, registry)


_T = "t AS (SELECT p_partkey, concat_ws(' ', p_name, p_type, p_name) AS text FROM part)"
_TAGS = f"{_T}, v(alias, name) AS (VALUES {', '.join(f"('{a}', '{n}')" for a, n in _ALIAS)}), g AS (SELECT DISTINCT p_partkey, name FROM t JOIN v ON contains(' ' || lower(text) || ' ', ' ' || alias || ' '))"

QUERIES = {
    "visible_records": (visible_records, "SELECT o_orderkey AS id FROM orders WHERE o_custkey % 3 <> 0 AND o_orderstatus = 'O' AND o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0"),
    "category_routing": (category_routing, """SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN ['cv', 'past_project', 'tech_stack', 'tool'] WHEN 1 THEN ['cv'] ELSE CASE WHEN p_size > 25 OR p_size % 7 = 0 THEN ['past_project'] ELSE ['past_project', 'client_portfolio', 'cv'] END END) AS doc_type FROM part"""),
    "record_search": (record_search, "SELECT c_custkey FROM customer WHERE strpos(lower(c_name || ' ' || c_mktsegment), '7 build') > 0"),
    "record_errors": (record_errors, """WITH r AS (SELECT s_suppkey AS id, s_suppkey % 2 AS type, CASE WHEN s_suppkey % 5 = 0 THEN 'same' ELSE s_name END AS title FROM supplier), d AS (SELECT type, title FROM r GROUP BY ALL HAVING count(*) > 1)
        SELECT id, array_to_string(list_sort(list_filter([CASE WHEN id % 4 = 0 THEN 'client=required' END, CASE WHEN id % 3 = 0 AND id % 6 <> 0 THEN 'currency=currency is missing' END, CASE WHEN id = (SELECT max(id) FROM r) THEN 'links=unknown link' END, CASE WHEN d.title IS NOT NULL THEN 'title=duplicate' END], lambda x: x IS NOT NULL)), ';') AS errors
        FROM r LEFT JOIN d USING (type, title)"""),
    "cv_projects": (cv_projects, "WITH l AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) SELECT l_suppkey AS member, count(*) AS n, md5(string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey)) AS projects FROM l GROUP BY 1"),
    "client_projects": (client_projects, "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON n_nationkey = s_suppkey % 40"),
    "tender_buyer_profiles": (tender_buyer_profiles, "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'medium' END AS fit, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey WHERE o_totalprice > 100000"),
    "gap_requirement_ids": (gap_requirement_ids, "SELECT g.p_partkey, min(r.p_partkey) AS requirement_id FROM part g LEFT JOIN part r ON r.p_size > 10 AND r.p_name = g.p_name AND r.p_type = g.p_type WHERE g.p_size <= 10 GROUP BY 1"),
    "rank_lookup": (rank_lookup, "SELECT o_orderkey, rank FROM (SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders WHERE o_orderstatus = 'P') WHERE o_orderkey % 2 = 0"),
    "dictionary_tags": (dictionary_tags, f"WITH {_TAGS} SELECT * FROM g"),
    "skill_closure": (skill_closure, f"WITH RECURSIVE {_TAGS}, i(name, implied) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _IMPLIES)}), c(p_partkey, name) AS (SELECT p_partkey, name FROM g UNION SELECT p_partkey, implied FROM c JOIN i USING (name)) SELECT * FROM c"),
    "leftover_words": (leftover_words, f"WITH {_T} SELECT p_partkey, array_to_string(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 1 AND w NOT IN ('ring', 'gear', 'small', 'large', 'standard')), ' ') AS words FROM t"),
    "glossary_translation": (glossary_translation, f"WITH {_T} SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(text), '\\bsmall ring\\b', 'bague', 'g'), '\\bsmall\\b', 'petit', 'g'), '\\bgear\\b', 'engrenage', 'g') AS text FROM t"),
    "word_forms": (word_forms, """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part UNION ALL VALUES ('study'), ('schedule'), ('c++'), ('./test-')), p AS (SELECT word, trim(word, './-') AS w FROM w)
        SELECT word, array_to_string(list_sort(list_distinct(list_filter([w, w || 's', w || 'es', w || 'ing', w || 'ed', w || 'd', CASE WHEN w LIKE '%e' THEN w[:-2] || 'ing' END, CASE WHEN w LIKE '__%y' THEN w[:-2] || 'ies' END, CASE WHEN w LIKE '__%y' THEN w[:-2] || 'ied' END], lambda x: x IS NOT NULL))), ' ') AS forms FROM p"""),
    "unknown_word_support": (unknown_word_support, """WITH r AS (SELECT p_partkey, string_split(lower(p_name || ' ' || p_type), ' ') AS own, lead(string_split(lower(p_name || 's ' || p_type), ' ')) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nxt FROM part),
        c AS (SELECT *, len(list_filter(own, lambda w: list_has_any([w, w || 's', w || 'es', w || 'ing', w || 'ed', w || 'd', CASE WHEN w LIKE '%e' THEN w[:-2] || 'ing' ELSE w END, CASE WHEN w LIKE '__%y' THEN w[:-2] || 'ies' ELSE w END, CASE WHEN w LIKE '__%y' THEN w[:-2] || 'ied' ELSE w END], nxt))) AS h FROM r WHERE nxt IS NOT NULL)
        SELECT p_partkey, round(CAST(h AS DOUBLE) / len(own), 6) AS support, 2 * h > len(own) AS named, list_contains(nxt, 'promo') AS by_term FROM c"""),
    "unknown_names": (unknown_names, """WITH c AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+#]*')) AS word FROM documents) WHERE regexp_full_match(word, '[a-z]+')), b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+#]*')) AS word FROM benchmark)
        SELECT item_id, count(*) AS n, min(word) AS first FROM b WHERE regexp_matches(word, '[0-9+#A-Z]') OR word NOT IN (SELECT word FROM c) GROUP BY 1"""),
    "record_statements": (record_statements, "SELECT s_suppkey, left('Name: ' || s_name, 12) || '|' || left('Nation: ' || s_nationkey, 12) AS lines FROM supplier"),
    "partner_awards": (partner_awards, f"WITH {_AW} SELECT DISTINCT p.row AS partner_row, a.row AS award_row FROM a p JOIN a ON p.row % 5 = 0 AND a.row % 5 <> 0 AND (p.id = a.id OR (p.source <> a.source AND left({S.fold('p.title')}, 40) = left({S.fold('a.title')}, 40) AND abs(date_diff('day', p.day, a.day)) <= 7))"),
    "award_dedupe": (award_dedupe, f"""WITH {_AW}, o AS (SELECT row, id, source, left({S.fold('title')}, 80) AS t, round(amount, -4) AS m FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY row) = 1),
        k AS (SELECT *, CASE WHEN m > 0 THEN round(m / pow(10, floor(log10(m)) - 1)) * pow(10, floor(log10(m)) - 1) END AS k FROM o)
        SELECT row, id, source FROM k QUALIFY k IS NULL OR source = first_value(source) OVER (PARTITION BY t, k ORDER BY row)"""),
    "award_copies": (award_copies, None),
    "award_richest": (award_richest, f"WITH {_AW} SELECT row, buyer, source FROM a QUALIFY row_number() OVER (PARTITION BY buyer, source ORDER BY CAST(bids IS NOT NULL AS INT) + CAST(row % 2 = 0 AS INT) DESC, row) = 1"),
    "median_bids": (median_bids, f"WITH {_AW} SELECT buyer, quantile_cont(CAST(bids AS DOUBLE), 0.5) AS median_bids, count(*) AS n FROM a WHERE bids > 0 GROUP BY 1"),
    "comparable_awards": (comparable_awards, """WITH r AS (SELECT p_partkey, p_size, p_partkey % 3 = 0 AS it, string_split(lower(p_name || ' ' || p_type), ' ') AS w FROM part),
        f AS (SELECT *, it OR len(list_filter(w, lambda x: length(x) >= 5 AND left(x, 6) IN ('standa', 'econom', 'works'))) > 0 AS alike, p_size BETWEEN 3 AND 44 AS goods FROM (SELECT p_partkey, it, w, CAST(left(lpad(CAST(p_size * 10000 AS VARCHAR), 8, '0'), 2) AS INT) AS p_size FROM r)),
        s AS (SELECT bool_or(alike) AS found, bool_or(alike AND NOT goods) AS bare, bool_or(NOT goods) AS free FROM f)
        SELECT p_partkey FROM f, s WHERE (alike OR NOT found) AND (NOT goods OR NOT CASE WHEN found THEN bare ELSE free END)"""),
    "award_search": (award_search, f"""WITH {_AW} SELECT buyer AS uid, string_agg(DISTINCT CAST(row % 9 AS VARCHAR), ',' ORDER BY CAST(row % 9 AS VARCHAR)) AS winners, CAST(max(day) AS VARCHAR) AS day, max(amount) AS amount FROM a
        WHERE (row % 50 < 10 OR row % 50 = 13) AND day >= DATE '1996-01-01' AND contains(title, 'urgent') GROUP BY 1"""),
    "registry_lookup": (registry_lookup, """WITH r AS (SELECT s_suppkey AS id, s_suppkey % 20 AS w, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey * 20 END AS staff, 'House W' || s_suppkey % 20 || ' ' || s_name AS name FROM supplier),
        m AS (SELECT n_nationkey AS ask, id, name, staff, CASE WHEN n_nationkey % 2 = 0 AND id = n_nationkey + 1 THEN 0 ELSE 1 END AS way FROM nation JOIN r ON (n_nationkey % 2 = 0 AND id = n_nationkey + 1) OR w = n_nationkey),
        p AS (SELECT *, CAST(row_number() OVER (PARTITION BY ask ORDER BY way, name, id) AS INTEGER) AS place FROM m)
        SELECT ask, place, id, CASE WHEN staff < 50 THEN 'small' WHEN staff < 1000 THEN 'medium' WHEN staff IS NOT NULL THEN 'large' END AS band FROM p WHERE place <= 5"""),
    "body_names": (body_names, """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'commune de' WHEN 1 THEN 'communaute agglomeration du' WHEN 2 THEN 'departement' WHEN 3 THEN 'commune' ELSE 'ministere of' END || ' supplier ' || regexp_extract(s_name, '[0-9]+') AS body FROM supplier"""),
    "acronym_match": (acronym_match, """WITH w AS (SELECT p_partkey, string_split(lower(p_type || ' ' || p_name || ' works'), ' ') AS w FROM part), s AS (SELECT p_partkey, list_distinct(list_transform(w, lambda x: CASE WHEN length(x) > 4 THEN regexp_replace(x, '[sx]$', '') ELSE x END)) AS a FROM w)
        SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 OR i = reverse(i) THEN 1.0::DOUBLE ELSE round(2.0::DOUBLE / (2 + len(a)), 6) END AS match FROM s JOIN (SELECT p_partkey, left(w[1], 1) || left(w[2], 1) || left(w[3], 1) AS i FROM w) USING (p_partkey)"""),
    "past_projects": (past_projects, """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS row, l_suppkey AS buyer, l_partkey % 50 AS t, l_returnflag = 'R' AS d FROM lineitem),
        o AS (SELECT *, row % 2 AS lane FROM r QUALIFY row_number() OVER (PARTITION BY buyer, t ORDER BY row % 2, row) = 1)
        SELECT buyer, CAST(place AS INTEGER) AS place, row FROM (SELECT *, row_number() OVER (PARTITION BY buyer ORDER BY d DESC, lane, row) AS place FROM o) WHERE place <= 10"""),
    "fuzzy_names": (fuzzy_names, """WITH a AS (SELECT s_suppkey AS ask, ['alpha' || s_suppkey % 3, 'beta' || s_suppkey % 5, 'gamma' || s_suppkey % 7, 'delta' || s_suppkey % 11] AS a FROM supplier),
        b AS (SELECT c_custkey AS id, ['alpha' || c_custkey * 3 % 3, 'beta' || c_custkey * 3 % 5, 'gamma' || c_custkey * 3 % 7, 'delta' || c_custkey * 3 % 11] AS b, c_custkey % 3 = 0 AS public, ['gamma' || (c_custkey + 1) % 7, 'delta' || c_custkey % 4] AS w FROM customer),
        p AS (SELECT *, round(2.0::DOUBLE * len(list_intersect(a, b)) / 8, 6) AS similarity FROM a, b WHERE len(list_filter(a, lambda x: NOT list_contains(b, x) AND NOT list_contains(w, x))) = 0)
        SELECT ask, id, similarity FROM p WHERE similarity >= CASE WHEN public THEN 0.6::DOUBLE ELSE 0.85::DOUBLE END QUALIFY row_number() OVER (PARTITION BY ask ORDER BY similarity + CASE WHEN public THEN 0.05::DOUBLE ELSE 0 END DESC, id) = 1"""),
    "official_domains": (official_domains, """SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'n' || s_suppkey || '.org' WHEN s_suppkey % 5 = 0 THEN 'e' || s_suppkey || '.org' WHEN s_suppkey % 10 = 9 AND s_suppkey % 3 = 0 THEN 't' || s_suppkey || '.org' WHEN s_suppkey % 2 = 0 THEN 'm' || s_suppkey || '.fr' END AS domain FROM supplier"""),
}
