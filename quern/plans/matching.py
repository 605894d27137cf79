"""Matching in full, checks of results, notices, CVs and deck inputs over the driver tables: order lines stand for candidates, orders for requirements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import matching as M
from quern.operators import sheets as K
from quern.plans import sql as S
from quern.session import table


def _candidates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("need"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("doc_id"), (F.col("l_quantity") / 5 - 8).alias("score"), F.round(F.col("l_discount") * 10, 2).alias("support"),
        (F.col("l_partkey") % 4 == 0).alias("qualified"), (F.col("l_partkey") % 4 == 1).alias("equivalent"), (F.col("l_tax") > 0.04).alias("named"), (F.col("l_returnflag") == "R").alias("demo"), (F.col("l_orderkey") % 2 == 0).alias("plain_words"),
    )


def _needs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("need"), (1 + F.col("o_orderkey") % 2).alias("needed"))


def good_set_order(spark, sf_dir):
    return M.good_documents(_candidates(spark, sf_dir), "need").select("need", "doc_id", "weight", "place")


def status_decision(spark, sf_dir):
    out = M.judged(M.good_documents(_candidates(spark, sf_dir), "need"), _needs(spark, sf_dir), "need")
    return out.withColumn("percent", F.round("percent", 4))


def closest_candidate(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return M.closest(c, M.judged(M.good_documents(c, "need"), _needs(spark, sf_dir), "need"), "need")


def similarity_decision(spark, sf_dir):
    best = table(spark, sf_dir, "events").groupBy("user_id").agg((F.max("value") / 10).alias("best"))
    status, percent = M.by_similarity(F.col("best"), 0.8, 0.9)
    return best.select("user_id", status.alias("status"), F.round(percent, 4).alias("percent"))


def citation_dedupe(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_partkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("need"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity")).alias("score"), F.col("l_discount").alias("sim"))
    return M.citations(rows).select("doc_id", "need", F.round("key", 4).alias("key"))


def result_checks(spark, sf_dir):
    c = M.good_documents(_candidates(spark, sf_dir), "need")
    docs = c.groupBy("need").agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))
    got = M.judged(c, _needs(spark, sf_dir), "need").join(docs, "need", "left")
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("need"), F.when(F.col("o_orderkey") % 3 == 0, "found").when(F.col("o_orderkey") % 3 == 1, "missing").otherwise("partial").alias("expect"), F.array().cast("array<bigint>").alias("allowed"), (F.col("o_orderkey") % 2).alias("least"))
    return M.result_checks(got, wanted, "need")


def row_scoring(spark, sf_dir):
    """Statuses by candidates against those by similarity of the customer."""
    got = M.judged(M.good_documents(_candidates(spark, sf_dir), "need"), _needs(spark, sf_dir), "need")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("need"), "o_orderpriority", F.when(F.col("o_totalprice") > 200000, "covered").when(F.col("o_totalprice") > 100000, "partial").otherwise("missing").alias("expect"))
    return M.row_scores(got.select("need", F.col("status").alias("got")).join(o, "need"), "o_orderpriority")


def relevance_score(spark, sf_dir):
    """A base by recommendation and up to thirty points for coverage."""
    base = F.when(F.col("o_orderstatus") == "F", 70).when(F.col("o_orderstatus") == "O", 50).otherwise(30)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.floor(base + 30 * F.least(F.lit(1.0), F.col("o_totalprice") / 400000) + 0.5).cast("long").alias("relevance"))


def study_selection(spark, sf_dir):
    """The first three orders of each customer for a market study: demo ones last, then by price."""
    o = table(spark, sf_dir, "orders").withColumn("demo", F.col("o_orderkey") % 4 == 0)
    w = Window.partitionBy("o_custkey").orderBy("demo", F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("place", F.row_number().over(w)).filter("place <= 3").select("o_custkey", "place", "o_orderkey")


def run_listing(spark, sf_dir):
    """Runs of a user, newest first."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("place", F.row_number().over(w)).filter("place <= 5").select("user_id", "place", "event_id")


def heuristic_coverage(spark, sf_dir):
    """Parts as needs; evidence is what each supplier's first sold part is called, and its brand."""
    p = table(spark, sf_dir, "part")
    needs = p.select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    first = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min("l_partkey").alias("p_partkey"))
    evidence = first.join(p, "p_partkey").select(F.col("l_suppkey").alias("item"), F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    return M.word_coverage(needs, evidence, "p_partkey", "text", "item")


def coverage_column(spark, sf_dir):
    """A table of part types with the status of their text."""
    p = table(spark, sf_dir, "part")
    statuses = p.groupBy(F.col("p_type").alias("text")).agg(F.avg("p_size").alias("m")).filter("text <> 'PROMO'").select("text", M.from_score(F.col("m") / 33).alias("status"))
    return M.with_status(p.select("p_partkey", F.col("p_type").alias("text")), statuses, "text").select("p_partkey", "status")


def uncovered_obligations(spark, sf_dir):
    """Obliging sentences on a customer's orders that no need of the customer's orders says."""
    o = table(spark, sf_dir, "orders")
    verb = F.when(F.col("o_orderkey") % 2 == 0, "must deliver").when(F.col("o_orderkey") % 3 == 0, "may deliver").otherwise("shall be signed before")
    marks = lambda k: [F.concat(F.lit(x), (k % n).cast("string")) for x, n in zip("abcde", (5, 7, 11, 13, 17), strict=True)]
    sentence = F.concat_ws(" ", F.lit("supplier"), verb, *marks(F.col("o_orderkey")))
    needs = o.select(F.col("o_custkey").alias("grp"), F.concat_ws(" ", F.lit("supplier must deliver"), *marks(F.col("o_orderkey") * 7 + 1)).alias("text"))
    return M.uncovered(o.select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("no"), sentence.alias("text")), needs, "grp")


# notices and CVs
def _notice(c):
    k = F.col(c)
    return F.concat_ws("\n", F.concat(F.lit("Price ("), (k % 120).cast("string"), F.lit(" %)")), F.concat(F.lit("Quality : "), (k % 90).cast("string"), F.lit(" points")), F.lit("Delay : 15 days"), F.lit("Article 4"))


def award_criteria(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("text", _notice("s_suppkey")).select("s_suppkey", F.posexplode(K.criteria("text")).alias("place", "c"))
    return rows.select("s_suppkey", "place", F.col("c.name").alias("name"), F.col("c.weight").alias("weight"))


def contact_block(spark, sf_dir):
    """Suppliers of a nation as contact blocks; the buyer is named like one of them."""
    s = table(spark, sf_dir, "supplier")
    blocks = s.select("s_nationkey", F.col("s_suppkey").alias("row"), F.concat_ws(" ", F.lit("supplier"), F.concat(F.lit("w"), (F.col("s_suppkey") % 11).cast("string"))).alias("name"), F.concat_ws(" ", F.lit("buyer"), F.concat(F.lit("w"), (F.col("s_nationkey") % 13).cast("string"))).alias("buyer"))
    return K.contact(blocks, "s_nationkey", "buyer", "name").select("s_nationkey", "row")


def requirement_counts(spark, sf_dir):
    k = F.col("p_size").cast("string")
    text = F.get(F.array(F.concat(F.lit("Minimum "), k, F.lit(" rings")), F.concat(F.lit("at least "), k, F.lit(" gears")), F.concat(k, F.lit("+ parts")), F.concat(k, F.lit(" small parts")), F.lit("some parts")), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, sf_dir, "part").withColumn("text", text).select("p_partkey", K.required_count("text").alias("needed"))


_CV = ["Anna", "Profil", "Builds things", "Expérience professionnelle", "Welder, {a} - {b}", "Intern 2019 - present", "Skills:", "Ring: {c}", "Gear"]


def _cvs(spark, sf_dir):
    k = F.col("s_suppkey")
    values = {"a": F.concat(F.lit("Mar "), (2000 + k % 15).cast("string")), "b": F.concat(F.lit("juin "), (2005 + k % 10).cast("string")), "c": k.cast("string")}
    text = F.lit("\n".join(_CV))
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text"))


_HEADS = {"profile": ["profile", "profil"], "experience": ["experience", "experience professionnelle"], "skills": ["skills", "competences"]}


def cv_sections(spark, sf_dir):
    return K.sections(_cvs(spark, sf_dir), "s_suppkey", "text", _HEADS)


def cv_spans(spark, sf_dir):
    lines = K.sections(_cvs(spark, sf_dir), "s_suppkey", "text", _HEADS).filter("section = 'experience'")
    return lines.withColumn("s", K.job_span("line", 2024 * 12 + 6)).filter("s is not null").select("s_suppkey", "line_no", "s.first", "s.last")


def cv_fields(spark, sf_dir):
    text = F.replace(F.replace(F.col("text"), F.lit("Ring"), F.lit("  ring ")), F.lit("Gear"), F.lit("ﬁne ﬂow oﬃce"))
    return _cvs(spark, sf_dir).withColumn("text", text).select("s_suppkey", K.field("text", "missing", "ring").alias("ring"), F.element_at(F.split(K.unligated(F.col("text")), "\n"), -1).alias("last"))


def durations(spark, sf_dir):
    k = F.col("p_size").cast("string")
    text = F.get(F.array(F.concat(k, F.lit(" Months")), F.concat(k, F.lit(" ans")), F.concat(F.lit("within "), k, F.lit(" days")), F.concat(k, F.lit(",5 semaines")), F.lit("soon")), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, sf_dir, "part").withColumn("text", text).select("p_partkey", F.round(K.months_of("text"), 4).alias("months"))


def structured_notices(spark, sf_dir):
    """Two layouts of notice, read by the same rules; lots are not the notice's own."""
    k = F.col("s_suppkey")
    code = F.lpad((k % 90).cast("string"), 8, "7")
    one = F.to_json(F.struct(F.struct(F.struct(code.alias("cbc:ItemClassificationCode"), F.concat(F.lit("Works "), "s_name").alias("cbc:Description")).alias("cac:ProcurementProject")).alias("ContractNotice"), F.array(F.struct(F.lit("99").alias("cbc:ItemClassificationCode"))).alias("lot")))
    two = F.to_json(F.struct(F.struct(F.array(code, code, F.lit("45000000")).alias("CPV"), F.col("s_name").alias("OBJET")).alias("FNSimple")))
    raw = table(spark, sf_dir, "supplier").withColumn("raw", F.when(k % 3 == 0, one).when(k % 3 == 1, two).otherwise("{broken"))
    out = K.notice(raw, "s_suppkey", "raw", {"cpv": r"(?i)(ItemClassificationCode|CPV)$", "title": r"(?i)(Description|OBJET)$"}, without=r"(?i)^lot")
    return out.select("s_suppkey", "field", F.array_join("values", "|").alias("values"))


def new_deadlines(spark, sf_dir):
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    text = F.concat(F.lit("Instead of 01/02/1999. "), F.when(F.col("o_orderkey") % 3 == 0, "Visit on 03/03/1998; ").otherwise(""), F.lit("New date: "), F.when(F.col("o_orderkey") % 4 == 0, "unknown").otherwise(day), F.lit("."))
    return table(spark, sf_dir, "orders").withColumn("text", text).select("o_orderkey", K.new_deadline("text").cast("string").alias("deadline"))


def date_proofs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("day", "d MMMM yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("day", "yyyy-MM-dd")).otherwise(F.date_format(F.date_add("day", 1), "dd.MM.yyyy"))
    return o.withColumn("page", F.concat(F.lit("Closing: "), shown, F.lit(" noon"))).select("o_orderkey", K.date_in(F.col("page"), F.col("day")).alias("proved"))


def requirement_verification(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat("p_name", F.lit(" at least "), F.col("p_size").cast("string"))
    quote = F.concat(F.lit("of "), "p_name", F.lit(" in size "), F.when(F.col("p_partkey") % 5 == 0, "9").otherwise(F.col("p_size").cast("string")))
    page = F.concat(F.lit("Supply of "), F.upper("p_name"), F.lit(", in size "), F.when(F.col("p_partkey") % 7 == 0, "0").otherwise(F.col("p_size").cast("string")), F.lit(" or more"))
    return K.verified_requirements(p.select("p_brand", F.col("p_partkey").alias("no"), text.alias("text"), quote.alias("quote"), page.alias("page")), "p_brand")


def unwrapped_lines(spark, sf_dir):
    """Lines of each document joined to paragraphs."""
    lines = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    out = K.unwrapped(lines, "doc_id")
    return out.select("doc_id", "paragraph", F.md5("text").alias("text"))


def deck_review(spark, sf_dir):
    """Orders as decks: lines are slides that say their part's type, in a language by return flag; the order's price is the total."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    li = table(spark, sf_dir, "lineitem").join(p, "l_partkey")
    slides = li.select("l_orderkey", F.concat(F.lit("The "), "p_type", F.lit(" plan")).alias("text"), F.when(F.col("l_returnflag") == "R", "fr").otherwise("en").alias("lang"))
    needs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(F.lit("promo"), F.lit("plan"))).alias("word"))
    total = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("total"))
    prices = li.groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("amount")).join(total, "l_orderkey").withColumn("total", F.when(F.col("l_orderkey") % 3 == 0, F.col("amount")).otherwise(F.col("total")))
    return K.reviewed(slides, needs, prices, "l_orderkey", "en")


# deck and inputs
def role_counts(spark, sf_dir):
    said = F.get(F.array(*[F.lit(x) for x in ("Java developer", "React Developer", "Kubernetes engineer", "Chef de projet", "UX lead", "Quality engineer", "Painter", "Redux expert")]), (F.col("s_suppkey") % 8).cast("int"))
    return K.role_counts(table(spark, sf_dir, "supplier").withColumn("text", said), "s_nationkey", "text")


def diagram_facts(spark, sf_dir):
    """The part types and mean line number of an order."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    li = table(spark, sf_dir, "lineitem").join(p, "l_partkey")
    rows = li.groupBy("l_orderkey", F.col("l_linenumber").alias("row")).agg(F.array(F.min("p_type"), F.max("p_brand")).alias("stack"), F.max(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")).otherwise(0)).alias("months"))
    return K.diagram_facts(rows, "l_orderkey", "stack", "months", 3).select("l_orderkey", "months", F.array_join("technologies", "|").alias("technologies"))


def budget_input_faults(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("budget"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 12).alias("role"), (F.col("l_quantity") / 2 - 3).alias("days"))
    catalogue = table(spark, sf_dir, "nation").filter("n_nationkey < 9").select(F.col("n_nationkey").cast("long").alias("role"))
    return K.checked_days(rows, catalogue, "role", "days").groupBy("fault").agg(F.count("*").alias("n"))


def slide_map(spark, sf_dir):
    plan = spark.createDataFrame([("s2", "Economy"), ("s3", "Standard works in the whole plant of the town")], "slide string, title string")
    p = table(spark, sf_dir, "part")
    title = F.when(F.col("p_type") == "STANDARD", "Standard works in the whole plant (2/3)").otherwise(F.concat("p_type", F.lit(" (1/2)")))
    pages = p.select("p_brand", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("page"), title.alias("title"))
    return K.slide_of(pages, plan, "p_brand", "title").select("p_brand", "page", "slide", "part")


def test_report(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    out = F.concat(F.lit("start\n  tests/a.py::one["), k, F.lit("] PASSED [ 5%]\ntests/b.py::two FAILED\n3 passed"))
    return K.test_report(table(spark, sf_dir, "supplier").withColumn("out", out), "s_suppkey", "out")


def section_cut(spark, sf_dir):
    text = F.concat(F.lit("# A\na\n## Annexe\nb\n### deep\nc\n## B\nd\n# Annexe "), F.col("s_suppkey").cast("string"), F.lit("\ne"))
    lines = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(F.split(text, "\n")).alias("no", "line"))
    return K.section_cut(lines, "s_suppkey", "annexe")


def studio_filter(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") % 2 == 0, "cv").otherwise("tool")
    rows = li.select("l_orderkey", (F.col("l_returnflag") == "R").alias("demo"), (F.col("l_quantity") > 10).alias("proves"), kind.alias("kind"), (F.col("l_suppkey") % 2 == 0).alias("in_team"))
    return K.studio_rows(rows, "l_orderkey")


def division_names(spark, sf_dir):
    """Parts with the text of their code's division."""
    names = table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("division"), F.col("n_name").alias("name"))
    return table(spark, sf_dir, "part").withColumn("division", F.substring(F.lpad((F.col("p_size") * 100).cast("string"), 4, "0"), 1, 2)).join(F.broadcast(names), "division", "left").select("p_partkey", "name")  # divisions have two digits


def input_forms(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    raw = F.concat(F.lit('{"title": " '), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(k), F.lit('", "language": "'), F.when(F.col("s_suppkey") % 2 == 0, "en").otherwise("de"), F.lit('", "score": '), (F.col("s_suppkey") % 150 / 2).cast("string"), F.lit(', "team": {"QA": '), (F.col("s_suppkey") % 4 - 1).cast("string"), F.lit(', "PM": 2, "Cook": 5}}'))
    return table(spark, sf_dir, "supplier").select("s_suppkey", K.input_form(F.when(F.col("s_suppkey") % 10 == 9, "{broken").otherwise(raw)).alias("f")).select("s_suppkey", "f.title", "f.language", F.round("f.score", 6).alias("score"), "f.people")


_C = """c AS (SELECT l_orderkey AS need, l_partkey * 10 + l_linenumber AS doc_id, l_quantity / 5 - 8 AS score, round(l_discount * 10, 2) AS support, l_partkey % 4 = 0 AS q, l_partkey % 4 = 1 AS e, l_tax > 0.04::DOUBLE AS named, l_returnflag = 'R' AS demo, l_orderkey % 2 = 0 AS plain FROM lineitem),
  al AS (SELECT *, score >= 0 OR (support >= 0.5::DOUBLE AND score >= -6) AS alone FROM c),
  an AS (SELECT *, bool_or(alone) OVER (PARTITION BY need) AS any_good FROM al),
  gd AS (SELECT *, NOT any_good AND (q OR e) AND plain AS rescued, CASE WHEN e THEN 1 WHEN q OR named THEN 0 ELSE 2 END AS weight FROM an WHERE alone OR (NOT any_good AND (q OR e) AND plain)),
  od AS (SELECT *, row_number() OVER w AS k, first_value(demo) OVER w AS td, first_value(weight) OVER w AS tw, first_value(score) OVER w AS ts FROM gd WINDOW w AS (PARTITION BY need ORDER BY weight, score DESC, doc_id)),
  bp AS (SELECT *, min(k) FILTER (WHERE td AND NOT demo AND weight <= tw AND score >= ts - 1) OVER (PARTITION BY need) AS bump FROM od),
  pl AS (SELECT *, CAST(row_number() OVER (PARTITION BY need ORDER BY CASE WHEN k = bump THEN 0 ELSE k END) AS INTEGER) AS place FROM bp),
  by_need AS (SELECT need, count(*) FILTER (WHERE score >= 0 AND weight = 0) AS strong, count(*) AS found, arg_min(score, place) AS ts, arg_min(weight, place) AS tw, arg_min(rescued, place) AS tr FROM pl GROUP BY 1),
  jd AS (SELECT o_orderkey AS need, CASE WHEN found IS NULL THEN 'missing' WHEN strong >= 1 + o_orderkey % 2 THEN 'covered' ELSE 'partial' END AS status, coalesce(found, 0) AS found,
         coalesce(CASE WHEN tr THEN least(50.0::DOUBLE, 100.0::DOUBLE * found / (1 + o_orderkey % 2)) WHEN tw = 2 THEN least(50.0::DOUBLE, least(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 * (ts + 8) / 8)), 100.0::DOUBLE * found / (1 + o_orderkey % 2)))
              ELSE least(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 * (ts + 8) / 8)), 100.0::DOUBLE * found / (1 + o_orderkey % 2)) END, 0) AS percent FROM orders LEFT JOIN by_need ON need = o_orderkey)"""

QUERIES = {
    "good_set_order": (good_set_order, f"WITH {_C} SELECT need, doc_id, weight, place FROM pl"),
    "status_decision": (status_decision, f"WITH {_C} SELECT need, status, round(percent, 4) AS percent, found FROM jd"),
    "closest_candidate": (closest_candidate, f"WITH {_C} SELECT c.need, arg_max(doc_id, struct_pack(s := score, d := -doc_id)) AS closest FROM c JOIN jd ON jd.need = c.need AND status = 'missing' GROUP BY 1"),
    "similarity_decision": (similarity_decision, "WITH b AS (SELECT user_id, max(value) / 10 AS b FROM events GROUP BY 1) SELECT user_id, CASE WHEN b >= 0.9::DOUBLE THEN 'covered' WHEN b >= 0.8::DOUBLE THEN 'partial' ELSE 'missing' END AS status, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 * (b - 0.8::DOUBLE) / (0.9::DOUBLE - 0.8::DOUBLE))), 4) AS percent FROM b"),
    "citation_dedupe": (citation_dedupe, "WITH m AS (SELECT l_partkey AS doc_id, l_orderkey * 10 + l_linenumber AS need, coalesce(CASE WHEN l_linenumber % 3 > 0 THEN l_quantity END, 5) + l_discount AS key FROM lineitem) SELECT doc_id, need, round(key, 4) AS key FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY key DESC, need) = 1"),
    "result_checks": (result_checks, f"WITH {_C} SELECT need, CASE need % 3 WHEN 0 THEN status <> 'missing' WHEN 1 THEN status = 'missing' ELSE status = 'partial' END AS status_ok, 0 AS n_wrong, found >= need % 2 AS count_ok FROM jd"),
    "row_scoring": (row_scoring, f"WITH {_C}, x AS (SELECT o_orderpriority, CASE status WHEN 'missing' THEN 1 WHEN 'partial' THEN 2 ELSE 3 END AS g, CASE WHEN o_totalprice > 200000 THEN 3 WHEN o_totalprice > 100000 THEN 2 ELSE 1 END AS w FROM jd JOIN orders ON o_orderkey = need) SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE g > w) AS over, count(*) FILTER (WHERE g < w) AS under, count(*) FILTER (WHERE g = w) AS \"right\" FROM x GROUP BY 1"),
    "relevance_score": (relevance_score, "SELECT o_orderkey, CAST(floor(CASE o_orderstatus WHEN 'F' THEN 70 WHEN 'O' THEN 50 ELSE 30 END + 30 * least(1.0::DOUBLE, o_totalprice / 400000) + 0.5::DOUBLE) AS BIGINT) AS relevance FROM orders"),
    "study_selection": (study_selection, "SELECT o_custkey, place, o_orderkey FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4 = 0, o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders) WHERE place <= 3"),
    "run_listing": (run_listing, "SELECT user_id, place, event_id FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM events) WHERE place <= 5"),
    "heuristic_coverage": (heuristic_coverage, f"""WITH w AS (SELECT p_partkey, list_distinct(list_filter(string_split({S.fold("p_name || ' ' || p_type || ' ' || p_brand")}, ' '), lambda x: length(x) >= 3)) AS w, list_distinct(list_filter(string_split({S.fold("p_name || ' ' || p_brand")}, ' '), lambda x: length(x) >= 3)) AS e FROM part),
        f AS (SELECT DISTINCT e FROM (SELECT min(l_partkey) AS p_partkey FROM lineitem GROUP BY l_suppkey) JOIN w USING (p_partkey)),
        h AS (SELECT w.p_partkey, max(len(list_intersect(w.w, f.e))) AS h FROM w, f GROUP BY 1)
        SELECT p_partkey, CASE WHEN h >= 2 THEN 'covered' WHEN h = 1 THEN 'partial' ELSE 'to_clarify' END AS status FROM h"""),
    "coverage_column": (coverage_column, "WITH m AS (SELECT p_type, avg(p_size) / 33 AS m FROM part WHERE p_type <> 'PROMO' GROUP BY 1) SELECT p_partkey, CASE WHEN m >= 0.75::DOUBLE THEN 'covered' WHEN m >= 0.4::DOUBLE THEN 'partial' ELSE 'to_clarify' END AS status FROM part LEFT JOIN m USING (p_type)"),
    "uncovered_obligations": (uncovered_obligations, """WITH m AS (SELECT o_custkey AS grp, o_orderkey AS no, o_orderkey % 2 = 0 AS must, list_transform([1, 2, 3, 4, 5], lambda i: o_orderkey % [5, 7, 11, 13, 17][i] || 'x' || i) AS s, list_transform([1, 2, 3, 4, 5], lambda i: (o_orderkey * 7 + 1) % [5, 7, 11, 13, 17][i] || 'x' || i) AS n FROM orders),
        c AS (SELECT DISTINCT a.grp, a.no FROM m a JOIN m b ON a.grp = b.grp WHERE 3 + len(list_intersect(a.s, b.n)) >= 0.6::DOUBLE * 8),
        u AS (SELECT m.grp, m.no FROM m LEFT JOIN c USING (grp, no) WHERE m.must AND c.no IS NULL), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY no) AS INTEGER) AS place FROM u) SELECT * FROM p WHERE place <= 10"""),
    "award_criteria": (award_criteria, """WITH c AS (SELECT s_suppkey, 0 AS k, 'Price' AS name, CAST(s_suppkey % 120 AS DOUBLE) AS weight FROM supplier WHERE s_suppkey % 120 <= 100 UNION ALL SELECT s_suppkey, 1, 'Quality', CAST(s_suppkey % 90 AS DOUBLE) FROM supplier)
        SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY k) - 1 AS INTEGER) AS place, name, weight FROM c"""),
    "contact_block": (contact_block, """WITH b AS (SELECT s_nationkey, s_suppkey AS row, CASE WHEN s_suppkey % 11 = s_nationkey % 13 THEN 0.5::DOUBLE ELSE 0 END AS s FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s DESC, row) AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM b)
        SELECT s_nationkey, row FROM r WHERE k = 1 AND (s >= 0.5::DOUBLE OR n = 1)"""),
    "requirement_counts": (requirement_counts, "SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN 1 ELSE p_size END AS needed FROM part"),
    "cv_sections": (cv_sections, f"""WITH l AS (SELECT s_suppkey, unnest([{', '.join("'" + x.replace("{a}", "Mar ' || (2000 + s_suppkey % 15) || '").replace("{b}", "juin ' || (2005 + s_suppkey % 10) || '").replace("{c}", "' || s_suppkey || '") + "'" for x in _CV)}]) AS line, unnest(range({len(_CV)})) AS line_no FROM supplier)
        SELECT s_suppkey, CASE WHEN line_no < 1 THEN 'top' WHEN line_no < 3 THEN 'profile' WHEN line_no < 6 THEN 'experience' ELSE 'skills' END AS section, CAST(line_no AS INTEGER) AS line_no, line FROM l WHERE line_no NOT IN (1, 3, 6)"""),
    "cv_spans": (cv_spans, """SELECT s_suppkey, 4 AS line_no, CAST((2000 + s_suppkey % 15) * 12 + 3 AS INTEGER) AS first, CAST((2005 + s_suppkey % 10) * 12 + 6 AS INTEGER) AS last FROM supplier WHERE (2005 + s_suppkey % 10) * 12 + 6 >= (2000 + s_suppkey % 15) * 12 + 3
        UNION ALL SELECT s_suppkey, 5, 2019 * 12 + 1, 2024 * 12 + 6 FROM supplier"""),
    "cv_fields": (cv_fields, "SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS ring, 'fine flow office' AS last FROM supplier"),
    "durations": (durations, "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size * 12.0::DOUBLE WHEN 2 THEN round(p_size * 12 / 365.0::DOUBLE, 4) WHEN 3 THEN round((p_size + 0.5::DOUBLE) * 84 / 365, 4) END AS months FROM part"),
    "structured_notices": (structured_notices, """WITH s AS (SELECT s_suppkey, s_name, lpad(CAST(s_suppkey % 90 AS VARCHAR), 8, '7') AS c, s_suppkey % 3 AS k FROM supplier)
        SELECT s_suppkey, 'cpv' AS field, CASE k WHEN 0 THEN c ELSE c || '|45000000' END AS values FROM s WHERE k < 2 UNION ALL SELECT s_suppkey, 'title', CASE k WHEN 0 THEN 'Works ' || s_name ELSE s_name END FROM s WHERE k < 2"""),
    "new_deadlines": (new_deadlines, "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS deadline FROM orders"),
    "date_proofs": (date_proofs, "SELECT o_orderkey, o_orderkey % 3 <> 2 AS proved FROM orders"),
    "requirement_verification": (requirement_verification, """SELECT p_brand, min(p_partkey) AS no FROM (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 9 ELSE p_size END AS q, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size END AS g FROM part) WHERE q = g AND q = p_size GROUP BY p_brand, p_name, p_size"""),
    "unwrapped_lines": (unwrapped_lines, """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents WHERE text IS NOT NULL),
        w AS (SELECT doc_id, quantile_cont(CAST(length(line) AS DOUBLE), 0.9) AS w FROM l GROUP BY 1), b AS (SELECT l.*, w, lag(line) OVER (PARTITION BY doc_id ORDER BY no) AS prev FROM l JOIN w USING (doc_id)),
        n AS (SELECT *, sum(CASE WHEN prev IS NULL OR length(prev) < 0.8::DOUBLE * w OR regexp_matches(prev, '[.!?:]\\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS paragraph FROM b)
        SELECT doc_id, CAST(paragraph AS BIGINT) AS paragraph, md5(string_agg(line, ' ' ORDER BY no)) AS text FROM n GROUP BY 1, 2"""),
    "deck_review": (deck_review, """WITH s AS (SELECT l_orderkey, lower(p_type) AS t, l_returnflag = 'R' AS fr, l_extendedprice AS x FROM lineitem JOIN part ON p_partkey = l_partkey), g AS (SELECT l_orderkey, bool_or(t = 'promo') AS promo, count(*) FILTER (WHERE fr) AS fr, round(sum(x), 2) AS x FROM s GROUP BY 1)
        SELECT o_orderkey AS l_orderkey, 'requirement not said' AS finding, CASE WHEN g.l_orderkey IS NULL THEN 2 ELSE 1 END AS n FROM orders LEFT JOIN g ON g.l_orderkey = o_orderkey WHERE g.l_orderkey IS NULL OR NOT promo
        UNION ALL SELECT l_orderkey, 'language', fr FROM g WHERE fr > 0
        UNION ALL SELECT l_orderkey, 'total', 1 FROM g JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 3 <> 0 AND CAST(round(x * 100) AS BIGINT) <> CAST(round(o_totalprice * 100) AS BIGINT)"""),
    "role_counts": (role_counts, """WITH r AS (SELECT s_nationkey, ['Backend', 'Frontend', 'DevOps', 'PM', 'Designer', 'QA'][1 + s_suppkey % 8] AS role, 1 + s_suppkey % 8 AS k FROM supplier WHERE s_suppkey % 8 < 6)
        SELECT s_nationkey, role, count(*) AS n, CAST(CASE role WHEN 'Backend' THEN 1 WHEN 'Frontend' THEN 2 WHEN 'DevOps' THEN 3 WHEN 'PM' THEN 4 WHEN 'Designer' THEN 5 ELSE 6 END AS BIGINT) AS place FROM r GROUP BY 1, 2"""),
    "diagram_facts": (diagram_facts, """WITH r AS (SELECT l_orderkey, l_linenumber AS row, min(p_type) AS a, max(p_brand) AS b, max(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE 0 END) AS m FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
        t AS (SELECT l_orderkey, a AS t, min(row * 2) AS pos FROM r GROUP BY 1, 2 UNION ALL SELECT l_orderkey, b, min(row * 2 + 1) FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS k FROM t),
        j AS (SELECT l_orderkey, string_agg(t, '|' ORDER BY k) AS technologies FROM k WHERE k <= 3 GROUP BY 1)
        SELECT l_orderkey, CAST(coalesce(floor(avg(CASE WHEN m > 0 THEN m END) + 0.5::DOUBLE), 6) AS BIGINT) AS months, any_value(technologies) AS technologies FROM r JOIN j USING (l_orderkey) GROUP BY 1"""),
    "budget_input_faults": (budget_input_faults, """WITH r AS (SELECT l_partkey % 12 AS role, l_quantity / 2 - 3 AS days, count(*) OVER (PARTITION BY l_orderkey, l_partkey % 12) AS n FROM lineitem)
        SELECT CASE WHEN role >= 9 THEN 'unknown key' WHEN NOT (days > 0 AND days = floor(days)) THEN 'bad days' WHEN n > 1 THEN 'twice' END AS fault, count(*) AS n FROM r GROUP BY 1"""),
    "slide_map": (slide_map, """WITH p AS (SELECT p_brand, p_type, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS page, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
        SELECT p_brand, page, CASE WHEN page = 1 THEN 'cover' WHEN page = n THEN 'end' WHEN p_type = 'STANDARD' THEN 's3' WHEN p_type = 'ECONOMY' THEN 's2' END AS slide, CASE WHEN p_type = 'STANDARD' THEN 2 ELSE 1 END AS part FROM p"""),
    "test_report": (test_report, "SELECT s_suppkey, 'one[' || s_suppkey || ']' AS test, 'PASSED' AS result FROM supplier UNION ALL SELECT s_suppkey, 'two', 'FAILED' FROM supplier"),
    "section_cut": (section_cut, "SELECT s_suppkey, no, line, place FROM supplier, (VALUES (0, '# A', 1), (1, 'a', 2), (6, '## B', 3), (7, 'd', 4)) v(no, line, place)"),
    "studio_filter": (studio_filter, "WITH e AS (SELECT l_orderkey, l_returnflag = 'R' AS demo, l_returnflag <> 'R' AND l_quantity > 10 AND (l_linenumber % 2 = 1 OR l_suppkey % 2 = 0) AS fine FROM lineitem) SELECT l_orderkey, count(*) FILTER (WHERE fine) AS shown, count(*) FILTER (WHERE NOT fine) AS dropped, count(*) FILTER (WHERE demo) AS demo FROM e GROUP BY 1"),
    "division_names": (division_names, "SELECT p_partkey, n_name AS name FROM part LEFT JOIN nation ON n_nationkey = p_size"),
    "input_forms": (input_forms, """SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 9 OR s_suppkey % 3 = 0 THEN 'Untitled' ELSE CAST(s_suppkey AS VARCHAR) END AS title, CASE WHEN s_suppkey % 10 <> 9 AND s_suppkey % 2 = 0 THEN 'en' ELSE 'fr' END AS language,
        CASE WHEN s_suppkey % 10 = 9 THEN 0 ELSE round(CASE WHEN s_suppkey % 150 / 2.0::DOUBLE > 1 THEN s_suppkey % 150 / 200.0::DOUBLE ELSE s_suppkey % 150 / 2.0::DOUBLE END, 6) END AS score, CAST(CASE WHEN s_suppkey % 10 = 9 THEN 0 ELSE 2 + greatest(0, s_suppkey % 4 - 1) END AS INTEGER) AS people FROM supplier"""),
}
