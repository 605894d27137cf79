"""Text, URL, page, date and identifier queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import dates as D
from quern.operators import quotes
from quern.plans import sql as S
from quern.plans.procurement import TODAY
from quern.session import spread, table


# similarities
def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name beside the next one's."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" "), "p_type").alias("a"), F.lead(F.concat("p_name", F.lit("s of "), "p_type")).over(w).alias("b")).filter("b is not null")


def name_dice(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", F.round(T.dice(T.name_tokens("a"), T.name_tokens("b")), 6).alias("dice"))


def token_coverage(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", F.round(T.coverage(T.toks("a"), T.toks("b")), 6).alias("coverage"))


def overlap_coefficient(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", F.round(T.overlap_coefficient(T.toks("a"), T.toks("b")), 6).alias("overlap"))


def token_jaccard(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", F.round(T.jaccard(T.toks("a"), T.toks("b")), 6).alias("jaccard"))


def name_containment(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", F.round(T.containment("a", "b"), 6).alias("containment"))


def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize("text")).alias("normal_md5"), F.size(T.tokenize("text")).cast("long").alias("n_tokens"))


def firm_keys(spark, sf_dir):
    forms = F.array(*[F.lit(x) for x in (" S.A.", " GmbH", " Ltd", "", " S.A.S")])
    name = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "Ste ").otherwise(""), F.col("s_name"), F.get(forms, (F.col("s_suppkey") % 5).cast("int")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.firm_key(name).alias("firm"))


def contamination_overlap(spark, sf_dir):
    """Benchmark passages quoted word for word in documents: passages of any length meet documents by a hash of their first eight words (of all, where
    fewer), within a task, and are then compared whole."""
    b = table(spark, sf_dir, "benchmark").select("item_id", T.fold("text").alias("quote"))
    return quotes.found(spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.fold("text").alias("t")), b, "doc_id", "item_id", quotes.Whole)


def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.normal_url("url").alias("canonical"))


def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(T.url_host("url").alias("host")).agg(F.count("*").alias("n"))


def tracking_param_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.without_parameters("url", ["ref", "utm_source"]).alias("url"))


def url_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(T.url_key("url").alias("key")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_markup("html")).alias("text_md5"))


def _links(spark, sf_dir):
    link = F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">([^<]*)</a>'), 0)).alias("link")
    rows = table(spark, sf_dir, "pages").select("page_id", "url", link)
    return rows.select("page_id", "url", F.regexp_extract("link", r'href="([^"]*)"', 1).alias("target"), F.regexp_extract("link", r">([^<]*)<", 1).alias("label"))


def page_links(spark, sf_dir):
    """Links of each page, one row for each target with its longest label."""
    rows = _links(spark, sf_dir)
    return rows.groupBy("page_id", "target").agg(F.max_by("label", F.struct(F.length("label"), "label")).alias("label"))


def repeated_link_labels(spark, sf_dir):
    """Short labels on three or more links of a page to two or more targets."""
    rows = _links(spark, sf_dir).filter(F.length("label") < 40)
    return rows.groupBy("page_id", "label").agg(F.count("*").alias("links"), F.count_distinct("target").alias("targets")).filter("links >= 3 and targets >= 2")


def next_page_number(spark, sf_dir):
    """Pages that carry a page number, by the view they belong to."""
    number = F.regexp_extract("url", r"[?&](?:page|paged|pg|start|offset)=(\d+)", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", T.without_parameters("url", ["page", "paged", "pg", "start", "offset"]).alias("view"), number.alias("n")).filter("n <> ''")
    return rows.select("page_id", "view", F.col("n").cast("int").alias("n"))


def soft_errors(spark, sf_dir):
    """Pages too short, or whose title says that nothing was found."""
    title = F.lower(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    bad = (F.length(T.strip_markup("html")) < 200) | title.rlike("not found|introuvable|404")
    return table(spark, sf_dir, "pages").select("page_id", bad.alias("rejected"))


# fields and identifiers
def props_json_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).cast("long").alias("total"), F.max(k).alias("most"), F.count_if(k.isNull()).alias("missing"))


def fnv1a_id(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("T"), T.fnv("c_name")).alias("id"))


def luhn_flag(spark, sf_dir):
    number = F.lpad((F.col("o_orderkey") * 7919 + 13).cast("string"), 9, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.call_function("luhn_check", number).alias("valid"))


def record_digest(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.concat_ws("|", "c_name", "c_nationkey", "c_mktsegment"), 256).alias("digest"))


def contact_fields(spark, sf_dir):
    """E-mail addresses and long digit runs of documents."""
    mails = F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9])"), 1)
    digits = F.regexp_extract_all("text", F.lit(r"(\d{9,14})"), 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(mails)).cast("long").alias("mails"), F.size(digits).cast("long").alias("numbers"), F.array_join(F.slice(F.array_sort(F.array_distinct(mails)), 1, 6), ",").alias("first_mails"))


def money_parse(spark, sf_dir):
    written = F.when(F.col("o_orderkey") % 2 == 0, F.regexp_replace(F.format_number("o_totalprice", 2), ",", " ")).otherwise(F.translate(F.format_number("o_totalprice", 2), ".,", ",."))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.money(F.concat(written, F.lit(" EUR"))).alias("amount"))


def kv_rows(spark, sf_dir):
    """`AWARD | id | k=v | ..` rows and back."""
    o = table(spark, sf_dir, "orders")
    row = F.concat_ws(" | ", F.lit("AWARD"), "o_orderkey", F.concat(F.lit("buyer="), F.col("o_custkey").cast("string")), F.concat(F.lit("status="), "o_orderstatus"))
    cells = F.split(row, r" \| ")
    field = lambda name: F.regexp_extract(row, rf"{name}=([^|]*?)(?: \||$)", 1)
    return o.select(F.get(cells, F.lit(1)).cast("long").alias("id"), field("buyer").cast("long").alias("buyer"), field("status").alias("status"))


def inject_scan(spark, sf_dir):
    """Texts that try to give instructions or hold secrets."""
    patterns = {"secret": r"(?i)(token|password|api[_-]?key)\s*=", "address": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "shout": r"[A-Z]{4,}!!"}
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", *[F.col("text").rlike(p).alias(n) for n, p in patterns.items()])


def language_pick(spark, sf_dir):
    """Preferred language of a source's documents, else the first in order: the smallest id of that language."""
    by = table(spark, sf_dir, "documents").groupBy("source").agg(F.min(F.when(F.col("lang") == "fr", F.col("doc_id"))).alias("fr"), F.min("doc_id").alias("any"))
    return by.select("source", F.coalesce("fr", "any").alias("doc_id"))


def line_profile(spark, sf_dir):
    """Headings (short lines without a full stop) and widest line of each document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if((F.length("line") < 40) & ~F.col("line").endswith(".")).alias("headings"), F.max(F.length("line")).cast("long").alias("widest"))


# dates
def island_months(spark, sf_dir):
    """Months in which a customer had an order open for a quarter, overlaps counted once."""
    start = D.month_number(F.to_date("o_orderdate"))
    spans = table(spark, sf_dir, "orders").select("o_custkey", start.alias("s"), (start + 2).alias("e"))
    return D.island_months(spans, "o_custkey", "s", "e")


def session_gaps(spark, sf_dir):
    s = D.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 240)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("value"))


def days_left(spark, sf_dir):
    left = F.datediff(F.to_date("o_orderdate"), F.lit(TODAY).cast("date"))
    label = F.when(left < 0, "closed").when(left == 0, "today").when(left <= 7, "this week").otherwise("open")
    return table(spark, sf_dir, "orders").groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.max(left).alias("most"))


def date_cascade(spark, sf_dir):
    """Order dates written in four ways and read back."""
    d = F.to_date("o_orderdate")
    names = F.array(*[F.lit(x) for x in "January février March avril May juin July août September octobre November décembre".split()])
    k = F.col("o_orderkey") % 4
    day, year = F.dayofmonth(d).cast("string"), F.year(d).cast("string")
    written = F.when(k == 0, d.cast("string")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.concat_ws(" ", day, F.get(names, F.month(d) - 1), year)).otherwise(F.concat(F.lit("32/13/"), year))
    return table(spark, sf_dir, "orders").withColumn("w", written).select("o_orderkey", F.coalesce(D.parse_date("w").cast("string"), F.lit("none")).alias("day"))


_PAIRS = "p AS (SELECT * FROM (SELECT p_partkey, p_name || ' ' || p_type AS a, lead(p_name || 's of ' || p_type) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part) WHERE b IS NOT NULL)"
_TOKS = f"t AS (SELECT p_partkey, {S.toks('a')} AS a, {S.toks('b')} AS b FROM p)"
_STEMS = f"list_distinct(list_transform(list_filter({{x}}, lambda t: length(t) > 2), lambda t: {S.stem('t')}))"
_NORMAL = "regexp_replace(regexp_replace(lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)), ':(80|443)$', '') || regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$', 1), '/$', '')".format(u="regexp_replace(url, '#.*$', '')")


def _without(names: str) -> str:
    kept = f"array_to_string(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT list_contains([{names}], lower(string_split(p, '=')[1]))), '&')"
    return f"(regexp_replace(u, '\\?.*$', '') || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END)"


_MARKUP = r"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"""
_LINKS = """l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS target, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label FROM pages)"""
_FOLDED = f"list_filter(string_split({S.fold('text')}, ' '), lambda w: w <> '')"

QUERIES = {
    "name_dice": (name_dice, f"WITH {_PAIRS}, t AS (SELECT p_partkey, {_STEMS.format(x=S.toks('a'))} AS a, {_STEMS.format(x=S.toks('b'))} AS b FROM p) SELECT p_partkey, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN 2 * len(list_intersect(a, b)) / CAST(len(a) + len(b) AS DOUBLE) ELSE 0 END, 6) AS dice FROM t"),
    "token_coverage": (token_coverage, f"WITH {_PAIRS}, {_TOKS} SELECT p_partkey, round(CASE WHEN len(a) > 0 THEN len(list_filter(a, lambda x: list_contains(b, x))) / CAST(len(a) AS DOUBLE) ELSE 0 END, 6) AS coverage FROM t"),
    "overlap_coefficient": (overlap_coefficient, f"WITH {_PAIRS}, {_TOKS} SELECT p_partkey, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(list_distinct(a), list_distinct(b))) / CAST(least(len(list_distinct(a)), len(list_distinct(b))) AS DOUBLE) ELSE 0 END, 6) AS overlap FROM t"),
    "token_jaccard": (token_jaccard, f"WITH {_PAIRS}, {_TOKS} SELECT p_partkey, round(CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(list_distinct(a), list_distinct(b))) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) ELSE 0 END, 6) AS jaccard FROM t"),
    "name_containment": (name_containment, f"WITH {_PAIRS}, {_TOKS}, s AS (SELECT p_partkey, list_transform(list_filter(a, lambda x: NOT list_contains([{', '.join(repr(x) for x in T.PARTICLES)}], x)), lambda t: {S.stem('t')}) AS a, list_transform(b, lambda t: {S.stem('t')}) AS b FROM t) SELECT p_partkey, round(CASE WHEN len(a) > 0 THEN len(list_filter(a, lambda x: list_contains(b, x))) / CAST(len(a) AS DOUBLE) ELSE 0 END, 6) AS containment FROM s"),
    "normalize_text": (normalize_text, f"SELECT doc_id, md5({S.normalize('text')}) AS normal_md5, CAST(len({S.tokens('text')}) AS BIGINT) AS n_tokens FROM documents"),
    "firm_keys": (firm_keys, "SELECT s_suppkey, 'supplier ' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS firm FROM supplier"),
    "contamination_overlap": (contamination_overlap, f"WITH b AS (SELECT item_id, {S.fold('text')} AS p FROM benchmark WHERE len({_FOLDED}) >= 1), d AS (SELECT doc_id, {S.fold('text')} AS t FROM documents) SELECT item_id, doc_id FROM b JOIN d ON contains(' ' || t || ' ', ' ' || p || ' ')"),
    "canonical_url": (canonical_url, f"SELECT page_id, {_NORMAL} AS canonical FROM pages"),
    "url_host": (url_host, "SELECT regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1), ':(80|443)$', ''), '^www\\.', '') AS host, count(*) AS n FROM pages GROUP BY 1"),
    "tracking_param_strip": (tracking_param_strip, f"WITH n AS (SELECT page_id, {_NORMAL} AS u FROM pages) SELECT page_id, {_without(chr(39) + 'ref' + chr(39) + ', ' + chr(39) + 'utm_source' + chr(39))} AS url FROM n"),
    "url_keys": (url_keys, f"WITH n AS (SELECT page_id, regexp_replace({_NORMAL}, '://www\\.', '://') AS u FROM pages), k AS (SELECT page_id, regexp_replace(regexp_replace(u, '\\?.*$', ''), '/$', '') AS p, array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '')), '&') AS q FROM n) SELECT p || CASE WHEN q = '' THEN '' ELSE '?' || q END AS key, count(*) AS n, min(page_id) AS first FROM k GROUP BY 1"),
    "html_to_text": (html_to_text, f"SELECT page_id, md5({_MARKUP}) AS text_md5 FROM pages"),
    "page_links": (page_links, f"WITH {_LINKS} SELECT page_id, target, label FROM (SELECT *, row_number() OVER (PARTITION BY page_id, target ORDER BY length(label) DESC, label DESC) AS r FROM l) WHERE r = 1"),
    "repeated_link_labels": (repeated_link_labels, f"WITH {_LINKS} SELECT page_id, label, count(*) AS links, count(DISTINCT target) AS targets FROM l WHERE length(label) < 40 GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT target) >= 2"),
    "next_page_number": (next_page_number, f"WITH n AS (SELECT page_id, {_NORMAL} AS u, regexp_extract(url, '[?&](?:page|paged|pg|start|offset)=(\\d+)', 1) AS n FROM pages) SELECT page_id, {_without(', '.join(repr(x) for x in ('page', 'paged', 'pg', 'start', 'offset')))} AS view, CAST(n AS INTEGER) AS n FROM n WHERE n <> ''"),
    "soft_errors": (soft_errors, f"SELECT page_id, length({_MARKUP}) < 200 OR regexp_matches(lower(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), 'not found|introuvable|404') AS rejected FROM pages"),
    "props_json_extract": (props_json_extract, "WITH e AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, CAST(sum(k) AS BIGINT) AS total, max(k) AS most, count(*) FILTER (WHERE k IS NULL) AS missing FROM e GROUP BY 1"),
    "fnv1a_id": (fnv1a_id, "WITH h AS (SELECT c_custkey, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(c_name, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM customer) SELECT c_custkey, 'T' || lower(to_base(h, 36)) AS id FROM h"),
    "luhn_flag": (luhn_flag, "WITH n AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 + 13 AS VARCHAR), 9, '0') AS s FROM orders), d AS (SELECT o_orderkey, list_transform(list_reverse(string_split(s, '')), lambda c, i: CASE WHEN i % 2 = 0 THEN (CASE WHEN CAST(c AS INTEGER) * 2 > 9 THEN CAST(c AS INTEGER) * 2 - 9 ELSE CAST(c AS INTEGER) * 2 END) ELSE CAST(c AS INTEGER) END) AS d FROM n) SELECT o_orderkey, list_sum(d) % 10 = 0 AS valid FROM d"),
    "record_digest": (record_digest, "SELECT c_custkey, sha256(c_name || '|' || c_nationkey || '|' || c_mktsegment) AS digest FROM customer"),
    "contact_fields": (contact_fields, r"WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]')) AS m, len(regexp_extract_all(text, '\d{9,14}')) AS n FROM documents) SELECT doc_id, CAST(len(m) AS BIGINT) AS mails, CAST(n AS BIGINT) AS numbers, coalesce(array_to_string(list_sort(m)[1:6], ','), '') AS first_mails FROM d"),
    "money_parse": (money_parse, "SELECT o_orderkey, round(o_totalprice, 2) AS amount FROM orders"),
    "kv_rows": (kv_rows, "SELECT o_orderkey AS id, o_custkey AS buyer, o_orderstatus AS status FROM orders"),
    "inject_scan": (inject_scan, r"SELECT doc_id, regexp_matches(text, '(?i)(token|password|api[_-]?key)\s*=') AS secret, regexp_matches(text, '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}') AS address, regexp_matches(text, '[A-Z]{4,}!!') AS shout FROM documents"),
    "language_pick": (language_pick, "SELECT source, coalesce(min(doc_id) FILTER (WHERE lang = 'fr'), min(doc_id)) AS doc_id FROM documents GROUP BY 1"),
    "line_profile": (line_profile, "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE length(line) < 40 AND NOT ends_with(line, '.')) AS headings, max(length(line)) AS widest FROM l GROUP BY 1"),
    "island_months": (island_months, "WITH s AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS s FROM orders), m AS (SELECT DISTINCT o_custkey, unnest([s, s + 1, s + 2]) AS m FROM s), g AS (SELECT o_custkey, m, m - row_number() OVER (PARTITION BY o_custkey ORDER BY m) AS i FROM m) SELECT o_custkey, count(*) AS months, count(*) // 12 AS years, count(DISTINCT i) AS islands FROM g GROUP BY 1"),
    "session_gaps": (session_gaps, "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 14400000000 THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS events, round(sum(value), 2) AS value FROM s GROUP BY 1, 2"),
    "days_left": (days_left, f"WITH d AS (SELECT CAST(CAST(o_orderdate AS DATE) - DATE '{TODAY}' AS INTEGER) AS l FROM orders) SELECT CASE WHEN l < 0 THEN 'closed' WHEN l = 0 THEN 'today' WHEN l <= 7 THEN 'this week' ELSE 'open' END AS label, count(*) AS n, max(l) AS most FROM d GROUP BY 1"),
    "date_cascade": (date_cascade, "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'none' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders"),
}
