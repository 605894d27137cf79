"""URL resolution, links, next pages and traces."""

import json
import random
from urllib.parse import urldefrag, urljoin

from pyspark.sql import functions as F

from quern.functions import urls
from quern.operators import links

BASE = "http://a/b/c/d;p?q"
#: The examples of the standard of generic syntax.
STANDARD = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y",
    "#s": "http://a/b/c/d;p?q", "g#s": "http://a/b/c/g", "g?y#s": "http://a/b/c/g?y", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y", "": "http://a/b/c/d;p?q",
    ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g",
    "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g",
    "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y",
    "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x",
}


def test_resolution_by_the_standard(spark):
    rows = spark.createDataFrame(list(STANDARD.items()), "r string, want string")
    assert [r["r"] for r in rows.filter(~F.col("want").eqNullSafe(urls.resolve(F.lit(BASE), "r"))).collect()] == []


def test_resolution_equals_the_library(spark):
    r = random.Random(4)
    segments = ["a", "b.c", "..", ".", "x y", "é", "p;q"]
    refs = {("/" if r.random() < 0.3 else "") + "/".join(r.choice(segments) for _ in range(r.randint(0, 5))) + r.choice(["", "/", "?k=v", "#f", "?a=1&b=2#z"]) for _ in range(300)}
    bases = ["https://www.x.org/l/m/n.html?q=1", "https://x.org", "https://x.org/", "http://u@x.org:8080/a/b/"]
    rows = [(b, ref) for b in bases for ref in refs if not ref.startswith("//")]
    got = spark.createDataFrame(rows, "b string, r string").select("b", "r", urls.resolve("b", "r").alias("u")).collect()
    assert [(x["b"], x["r"], x["u"]) for x in got if x["u"] != urldefrag(urljoin(x["b"], x["r"].strip().replace(" ", "%20")))[0]] == []
    none = spark.createDataFrame([("x", "y"), (None, "y"), ("http://a/", None)], "b string, r string").select(urls.resolve("b", "r").alias("u")).collect()
    assert [x["u"] for x in none] == [None, None, None]


def test_listing(spark):
    cases = {
        "https://www.X.org/a/?cat=19&lang=fr&paged=2": ("https://x.org/a?cat=19&lang=fr&paged=2", "https://x.org/a?cat=19&lang=fr", 2),
        "https://x.org/a?paged=3&lang=fr&cat=19": ("https://x.org/a?cat=19&lang=fr&paged=3", "https://x.org/a?cat=19&lang=fr", 3),
        "https://x.org/a/page/4": ("https://x.org/a/page/4", "https://x.org/a", 4),
        "https://x.org/a?page=avis-12&p=16872": ("https://x.org/a?p=16872&page=avis-12", "https://x.org/a?p=16872&page=avis-12", None),
        "https://x.org/a?q=a+b&debut_x=10": ("https://x.org/a?debut_x=10&q=a%20b", "https://x.org/a?q=a%20b", 10),
        "https://x.org/a?ordre=date": ("https://x.org/a?ordre=date", "https://x.org/a?ordre=date", None),
    }
    got = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.listing("u").alias("l")).collect()
    assert {r["u"]: (r["l"]["key"], r["l"]["view"], r["l"]["n"]) for r in got} == cases
    assert spark.range(1).select(urls.listing(F.lit("https://x.org/a?ordre=date&page=2"))["list"]).head()[0] == "https://x.org/a"


def test_scan_keeps_the_outermost_links():
    text = 'x [a](u1) ![img](i.png) [![alt](i) t](u2 "title") [card [inner](u3) more](u4) [no] (u5) [open](u6\n) [p(q)](u(7)) ]( [e](<u8>)'
    assert [(x[2], x[3]) for x in links.scanned(text)] == [("a", "u1"), ("![alt](i) t", "u2"), ("card [inner](u3) more", "u4"), ("p(q)", "u(7)"), ("e", "u8")]
    assert all(text[s] == "[" and text[e - 1] == ")" for s, e, _, _ in links.scanned(text))
    assert links.scanned(None) == [] and links.scanned("]" * 5000 + "[" * 5000) == [] and len(links.scanned("[a](b)" * 3000)) == 3000


def test_links_of_pages(spark):
    html = """<A class=x HREF='../t/1?x=1&amp;y=2'>One <b>two</b></a> <a href=/t/2><img src="i.png">Next</a> <a href="#top">top</a> <a href="http://other.org/">o</a> <a href="f.PDF?x">f</a> <a href="s.css">s</a>
    <a href="/l?page=3">3</a> <a href="/l?page=4">20 avis suivants</a> <a href="/t/9">Acquisition des equipements suivants</a> <a href="/t/2">N</a><script><a href="no">no</a></script>"""
    pages = spark.createDataFrame([(1, "http://www.x.org/l?page=2", html), (2, "http://x.org/", None)], "page long, base string, html string")
    found = links.links(pages.withColumn("md", links.markdown(F.col("html"))), "md")
    rows = {r["url"]: r["text"] for r in links.graph(found, "page", "base").collect()}
    assert rows == {"http://www.x.org/t/1?x=1&y=2": "One two", "http://www.x.org/t/2": "Next", "http://www.x.org/f.PDF?x": "f", "http://www.x.org/l?page=3": "3", "http://www.x.org/l?page=4": "20 avis suivants", "http://www.x.org/t/9": "Acquisition des equipements suivants"}
    nexts = lambda f: {r["page"]: r["url"] for r in links.next_pages(links.graph(f, "page", "base"), "page", "base").collect()}
    assert nexts(found) == {1: "http://www.x.org/t/2"}
    assert nexts(found.filter("target <> '/t/2'")) == {1: "http://www.x.org/l?page=4"}  # a title with the word in it is no later page
    more = spark.createDataFrame([(p, "http://x.org/l", "".join(f"[Read  more](/t/{k if p == 1 else 0}) [tag](/same)" for k in range(4))) for p in (1, 2)], "page long, base string, md string")
    assert [tuple(r) for r in links.silent_labels(links.links(more, "md"), "page", "base").collect()] == [(1, "read more")]


def observed(mark, url, title, shown, following=None, note=None):
    lines = [f"PAGE [{mark}] | {url} | {title}", "TEXT: " + "x" * 400, "REPEATED LABELS: " + ("read more | see" if note else "none")]
    lines += [f"NEXT PAGE: [n1] | {following}"] if following else []
    lines += [f"NOTE: {note}"] if note else []
    return "\n".join(lines + [f"[{i}] {t} | {u}" for i, t, u in shown])


def step(url, text, tool="open_page", wrapped=0):
    given = {"url": url} if wrapped == 0 else json.dumps({"url": url}) if wrapped == 1 else url
    return {"action": {"tool": tool, "toolInput": given}, "observation": text if wrapped == 0 else json.dumps({"result": text}) if wrapped == 1 else json.dumps([{"response": text}])}


def traced(spark, *traces):
    return spark.createDataFrame([(k, t if isinstance(t, str) else json.dumps(t)) for k, t in enumerate(traces)], "trace long, raw string")


L1, L2 = "https://www.x.org/list?q=a&page=1", "https://x.org/list?page=2&q=a"
FIRST = observed("p1", L1, "List | one", [("a1", "Tender A — due soon | late", "https://x.org/t/1"), ("a2", "(no text)", "https://x.org/t/2"), ("n2", "2", L2)], following=L2, note="moved")
SECOND = observed("p2", L2, "List", [("b1", "Tender B", "https://x.org/t/3"), ("back", "1", L1)])


def test_trace_pages_and_links(spark):
    from quern.operators import traces

    t = traced(spark, {"output": "{}", "intermediateSteps": [step(L1, FIRST), step("u", "", tool="other"), step(L2, SECOND, wrapped=1), step("https://z.org", "PAGE ERROR | https://z.org | refused | twice", wrapped=2), step("https://y.org", "junk")]}, "no json", {"output": "x"})
    read = traces.steps(t, "trace", "raw")
    got = [tuple(r) for r in traces.pages(read, "trace").orderBy("step").collect()]
    assert got == [
        (0, 0, "p1", L1, "List | one", None, "x" * 300, ["read more", "see"], L2, "moved", L1), (0, 2, "p2", L2, "List", None, "x" * 300, [], None, None, L2),
        (0, 3, None, "https://z.org", "", "refused | twice", "", [], None, None, "https://z.org"), (0, 4, None, "https://y.org", "", "unreadable tool result", "", [], None, None, "https://y.org"),
    ]
    got = {(r["step"], r["id"]): (r["url"], r["text"], r["context"]) for r in traces.links(read, "trace").collect()}
    assert got == {(0, "a1"): ("https://x.org/t/1", "Tender A", "due soon | late"), (0, "a2"): ("https://x.org/t/2", "", ""), (0, "n2"): (L2, "2", ""), (2, "b1"): ("https://x.org/t/3", "Tender B", ""), (2, "back"): (L1, "1", "")}


def test_trace_picks(spark):
    from quern.operators import traces

    notice = observed("t1", "https://x.org/t/1", "Tender A", [("l1", "list", L1), ("r1", "Corrected", "https://x.org/t/1b")])
    answer = lambda *tokens, **more: "Here: " + json.dumps({"tender_links": tokens, **more})
    both = [step(L1, FIRST), step(L2, SECOND)]
    t = traced(
        spark,
        {"output": answer("a1", "[b1]", "https://www.x.org/t/2/", "zz", "n2", "https://x.org/list?page=9&q=a", "a1"), "intermediateSteps": both},
        {"output": answer("a1", "r1", "t1"), "intermediateSteps": [step(L1, FIRST), step("https://x.org/t/1", notice)]},  # a notice that was opened to check it stays
        {"output": answer("t1"), "intermediateSteps": [step("https://x.org/t/1", notice)]},  # the first page is the one notice
        {"output": answer("t1", "r1"), "intermediateSteps": [step("https://x.org/t/1", notice)]},  # a page whose links are picked is a list
        {"output": "cut {\"tender_links\":", "intermediateSteps": both},
    )
    got = [(r["trace"], r["token"], r["kind"]) for r in traces.picks(t, "trace", "raw").orderBy("trace", "place").collect()]
    assert got == [
        (0, "a1", "pick"), (0, "b1", "pick"), (0, "https://www.x.org/t/2/", "pick"), (0, "zz", "invalid"), (0, "n2", "navigation"), (0, "https://x.org/list?page=9&q=a", "invalid"), (0, "a1", "again"),
        (1, "a1", "pick"), (1, "r1", "pick"), (1, "t1", "invalid"), (2, "t1", "pick"), (3, "t1", "navigation"), (3, "r1", "pick"),
    ]
