"""Links, addresses and agent traces over the pages table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import contracts as C
from quern.functions import urls as U
from quern.operators import links as L
from quern.operators import traces as R
from quern.session import spread, table


def _scanned(spark, sf_dir, html="html"):
    pages = table(spark, sf_dir, "pages").withColumn("md", L.markdown(F.expr(html))).select("page_id", F.col("url").alias("base"), "md")
    return L.links(pages, "md")


def resolved_urls(spark, sf_dir):
    """References of eight kinds, resolved against each page's address."""
    kinds = ("../x/y", "./a/./b", "/r/../s", "?k=1", "", "//h.org/p", "a b", "../../../z/")
    kind = F.get(F.array(*map(F.lit, kinds)), (F.col("page_id") % 8).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", U.resolve("url", kind).alias("resolved"))


def link_graph(spark, sf_dir):
    return L.graph(_scanned(spark, sf_dir), "page_id", "base").select("page_id", "url", "text")


def silent_labels(spark, sf_dir):
    """Labels that say nothing on a page, to which four links are added, with one label, to as many addresses as page_id leaves when divided by three."""
    more = " ".join(f"""'<a href="/t', page_id % 3 * {k}, '"> Lire  la suite </a>',""" for k in range(4))
    return L.silent_labels(_scanned(spark, sf_dir, f"concat({more} html)"), "page_id", "base")


def next_pages(spark, sf_dir):
    """The next page of each page, to which a link is added whose label says next, holds such a word, or is a number."""
    label = "element_at(array('Next page', 'les suivants', '2'), cast(page_id % 3 + 1 as int))"
    html = f"""concat(html, '<a href="?page=', page_id % 5, '&amp;ref=x">', {label}, '</a>')"""
    return L.next_pages(L.graph(_scanned(spark, sf_dir, html), "page_id", "base"), "page_id", "base")


def _traces(spark, sf_dir):
    """A trace for each host, in which its pages are read in order of page_id; the answer names the first link of each page, and an unknown id after each fourth."""
    mark = F.concat(F.lit("l"), F.substring(F.md5("url"), 1, 8))
    shown = L.graph(_scanned(spark, sf_dir), "page_id", "base").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", mark.alias("id"), F.concat_ws(" | ", F.concat(F.lit("["), mark, F.lit("] "), "text"), "url").alias("line")))).alias("shown"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", U.host("url").alias("trace")).join(shown, "page_id", "left")
    lines = F.transform("shown", lambda x: x["line"])
    text = F.concat_ws("\n", F.concat(F.lit("PAGE [p"), "page_id", F.lit("] | "), "url", F.lit(" | Page")), F.lit("TEXT: what it says"), F.lit("REPEATED LABELS: none"), F.array_join(lines, "\n"))
    named = F.array_compact(F.array(F.get("shown", F.lit(0))["id"], F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("zz"), "page_id"))))
    step = F.struct(F.struct(F.lit("open_page").alias("tool"), F.struct("url").alias("toolInput")).alias("action"), text.alias("observation"))
    rows = pages.groupBy("trace").agg(F.array_sort(F.collect_list(F.struct("page_id", step.alias("step"), named.alias("named")))).alias("s"))
    answer = F.to_json(F.struct(F.flatten(F.transform("s", lambda x: x["named"])).alias("tender_links")))
    return rows.select("trace", F.to_json(F.struct(F.concat(F.lit("Found: "), answer).alias("output"), F.transform("s", lambda x: x["step"]).alias("intermediateSteps"))).alias("raw"))


def trace_pages(spark, sf_dir):
    return R.pages(R.steps(_traces(spark, sf_dir), "trace", "raw"), "trace").select("trace", "step", "id", "url", "title", "excerpt", "asked")


def trace_links(spark, sf_dir):
    w = Window.partitionBy("trace", "step").orderBy("place")
    return R.links(R.steps(_traces(spark, sf_dir), "trace", "raw"), "trace").withColumn("place", F.row_number().over(w)).select("trace", "step", "place", "id", "url", "text")


def trace_picks(spark, sf_dir):
    return R.picks(_traces(spark, sf_dir), "trace", "raw").select("trace", "place", "token", "url", "kind")


_CONTRACT = C.Record((("kind", C.String(enum=("software build", "audit"))), ("score", C.Number(whole=True)), ("ids", C.List(C.Number(whole=True))), ("note", C.String(nullable=True))), ("kind", "score"))


def _answers(spark, sf_dir):
    """An answer about each part, as models give them: with a kind in another spelling or none of the known ones, a score in words or none, and a bad item in a list."""
    k = F.col("p_partkey")
    kind = F.get(F.array(F.lit("Software-Build"), F.lit("AUDIT"), F.lit("other")), (k % 3).cast("int"))
    score = F.when(k % 4 == 3, "").otherwise(F.concat(F.lit('"score": "'), F.col("p_size").cast("string"), F.lit(' points", ')))
    text = F.concat(F.lit('Sure: ```json\n{"kind": "'), kind, F.lit('", '), score, F.lit('"ids": ['), F.col("p_size").cast("string"), F.lit(', "x", 7], "note": "n/a",}\n```'))
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", C.answer(text).alias("v"))


def coerced_answers(spark, sf_dir):
    c = C.coerced(_CONTRACT, F.col("v"))
    return _answers(spark, sf_dir).select("p_partkey", c.alias("c")).select("p_partkey", F.col("c.kind").alias("kind"), F.col("c.score").alias("score"), F.array_join(F.col("c.ids").cast("array<string>"), ",").alias("ids"))


def contract_violations(spark, sf_dir):
    return _answers(spark, sf_dir).select("p_partkey", F.explode(C.violations(_CONTRACT, F.col("v"))).alias("f")).select("p_partkey", "f.*")


_SITE = r"regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
#: Anchors of the pages, all of one form with absolute paths.
_GRAPH = rf"""a AS (
  SELECT page_id, url AS base, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS target, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label,
         unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)))) AS pos, {_SITE} AS site FROM pages),
u AS (SELECT page_id, base, site || target AS url, trim(regexp_replace(regexp_replace(label, '[*_`#>]+', ' ', 'g'), '\s+', ' ', 'g')) AS text, pos FROM a),
g AS (SELECT page_id, base, url, arg_max(text, length(text) * 100000 - pos) AS text, min(pos) AS pos FROM u WHERE url <> regexp_replace(base, '#.*$', '')
      AND NOT regexp_matches(lower(url), '\.(png|jpg|jpeg|gif|svg|webp|ico|bmp|css|js|xml|rss|zip|json)$') GROUP BY ALL)"""
_STEPS = f"""{_GRAPH}, p AS (SELECT page_id, url, regexp_replace(regexp_extract(lower(url), '://([^/?#:]*)', 1), '^www\\.', '') AS trace, row_number() OVER (PARTITION BY regexp_replace(regexp_extract(lower(url), '://([^/?#:]*)', 1), '^www\\.', '') ORDER BY page_id) - 1 AS step FROM pages),
l AS (SELECT p.trace, p.step, p.page_id, row_number() OVER (PARTITION BY p.page_id ORDER BY g.pos) AS place, 'l' || md5(g.url)[1:8] AS id, g.url, g.text FROM g JOIN p USING (page_id))"""

QUERIES = {
    "resolved_urls": (resolved_urls, f"""WITH s AS (SELECT page_id, url, {_SITE} AS site, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '(\\?[^#]*)', 1) AS query FROM pages)
        SELECT page_id, CASE page_id % 8 WHEN 0 THEN site || regexp_replace(path, '[^/]*/[^/]*$', '') || 'x/y' WHEN 1 THEN site || regexp_replace(path, '[^/]*$', '') || 'a/b' WHEN 2 THEN site || '/s' WHEN 3 THEN site || path || '?k=1' WHEN 4 THEN site || path || query
        WHEN 5 THEN regexp_extract(url, '^([a-z]+:)', 1) || '//h.org/p' WHEN 6 THEN site || regexp_replace(path, '[^/]*$', '') || 'a%20b' ELSE site || '/z/' END AS resolved FROM s"""),
    "coerced_answers": (coerced_answers, """WITH a AS (SELECT p_partkey, p_size, p_partkey % 3 < 2 AND p_partkey % 4 < 3 AS fine FROM part)
        SELECT p_partkey, CASE WHEN fine THEN CASE p_partkey % 3 WHEN 0 THEN 'software build' ELSE 'audit' END END AS kind, CASE WHEN fine THEN CAST(p_size AS BIGINT) END AS score, CASE WHEN fine THEN p_size || ',7' END AS ids FROM a"""),
    "contract_violations": (contract_violations, """SELECT p_partkey, '$.kind' AS path, 'not one of software build|audit' AS fault, 'error' AS level FROM part WHERE p_partkey % 3 = 2
        UNION ALL SELECT p_partkey, '$.score', 'missing', 'error' FROM part WHERE p_partkey % 4 = 3 UNION ALL SELECT p_partkey, '$.ids[1]', 'not a number', 'warning' FROM part"""),
    "link_graph": (link_graph, f"WITH {_GRAPH} SELECT page_id, url, text FROM g"),
    "silent_labels": (silent_labels, rf"""WITH x AS (SELECT page_id, url, repeat('<a href="/t0">lire la suite</a>', CASE page_id % 3 WHEN 0 THEN 4 ELSE 1 END) || CASE WHEN page_id % 3 > 0 THEN '<a href="/t1">lire la suite</a><a href="/t2">lire la suite</a><a href="/t3">lire la suite</a>' ELSE '' END || html AS html FROM pages),
        {_GRAPH.split("u AS (")[0].replace("FROM pages", "FROM x").rstrip().rstrip(",")}, r AS (SELECT page_id, lower(trim(regexp_replace(regexp_replace(label, '[*_`#>]+', ' ', 'g'), '\s+', ' ', 'g'))) AS label, site || target AS url FROM a)
        SELECT page_id, label FROM r WHERE label <> '' AND length(label) < 40 GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT url) >= 2"""),
    "next_pages": (next_pages, """WITH s AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS b, regexp_replace(url, '[?#].*$', '') AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q, page_id % 5 AS n FROM pages),
        c AS (SELECT *, path || '?page=' || n || '&ref=x' AS url, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(x, 'page='))), '&') = 'ref=x' AS same, coalesce(try_cast(regexp_extract(q, '(?:^|&)page=([0-9]+)', 1) AS INT), 0) AS here FROM s)
        SELECT page_id, url FROM c WHERE url <> b AND (page_id % 3 = 0 OR page_id % 3 = 1 AND same AND n > here)"""),
    "trace_pages": (trace_pages, f"WITH {_STEPS} SELECT trace, CAST(step AS INTEGER) AS step, 'p' || page_id AS id, url, 'Page' AS title, 'what it says' AS excerpt, url AS asked FROM p"),
    "trace_links": (trace_links, f"WITH {_STEPS} SELECT trace, CAST(step AS INTEGER) AS step, CAST(place AS INTEGER) AS place, id, url, text FROM l"),
    "trace_picks": (trace_picks, f"""WITH {_STEPS}, t AS (SELECT trace, step * 2 AS o, id AS token, url FROM l WHERE place = 1 UNION ALL SELECT trace, step * 2 + 1, 'zz' || page_id, NULL FROM p WHERE page_id % 4 = 0),
        e AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY o) - 1 AS place, first_value(url) OVER (PARTITION BY trace, token ORDER BY o) AS first, row_number() OVER (PARTITION BY trace, replace(url, '://www.', '://') ORDER BY o) AS r FROM t)
        SELECT trace, CAST(place AS INTEGER) AS place, token, url, CASE WHEN url IS NULL THEN 'invalid' WHEN r > 1 THEN 'again' ELSE 'pick' END AS kind FROM e"""),
}
