"""Links of pages: a scan of markdown by a table function, the link graph, labels that say nothing, and the next page of a list."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import urls as U

#: Longest label and target of a link.
LABEL, TARGET = 600, 2000
#: Labels that lead to the next page of a list, as the whole label or its beginning, and within a short one.
NEXT = "suivant|suivante|page suivante|next|next page|plus anciens|older|التالي|الصفحة التالية|الموالي".split("|")
NEXT_SIGNS = ("»", "›", ">", ">>")
NEXT_WITHIN = "suivant suivante suivants suivantes next older التالي التالية الموالي الموالية".split()
#: Endings of files that are no pages.
FILES = "png jpg jpeg gif svg webp ico bmp css js xml rss zip json".split()


def scanned(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, label, target) of the outermost links of a markdown text, in order. One pass with a stack of open brackets; images are no links, but may
    stand in a label."""
    text = text or ""
    opened: list[int] = []
    found: list[tuple[int, int, str, str]] = []
    for k, c in enumerate(text):
        if c == "[":
            opened.append(k)
        elif c == "]" and opened:
            start = opened.pop()
            if text[k + 1 : k + 2] != "(" or k - start >= LABEL:
                continue
            depth, end = 0, None
            for j in range(k + 1, min(len(text), k + TARGET)):
                if text[j] == "(":
                    depth += 1
                elif text[j] == ")":
                    depth -= 1
                    if not depth:
                        end = j
                        break
                elif text[j] == "\n":
                    break
            if end is None or text[start - 1 : start] == "!":
                continue
            target = text[k + 2 : end].strip()
            if target.endswith('"') and ' "' in target:
                target = target[: target.rindex(' "', 0, -1)].rstrip()
            found.append((start, end + 1, text[start + 1 : k], target.removeprefix("<").removesuffix(">")))
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str, str]] = []
    for link in found:  # a link within another one is part of a card
        if not out or link[0] >= out[-1][1]:
            out.append(link)
    return out


def scanner():
    """The table function, made where a session exists."""

    class Scan:
        def eval(self, text: str) -> Iterator[tuple[int, int, str, str]]:
            yield from scanned(text)

    return F.udtf(Scan, returnType="start int, end int, label string, target string")


def links(pages: DataFrame, markdown: str) -> DataFrame:
    """A row for each outermost link of each page, by a lateral join of the table function."""
    return pages.lateralJoin(scanner()(F.col(markdown).outer()))


def plain(label: Column) -> Column:
    """A label without images, inner links and marks."""
    t = F.regexp_replace(label, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[*_`#>]+", " "), r"\s+", " "))


def markdown(html: Column) -> Column:
    """HTML to the markdown that links are scanned in: anchors and images kept, other tags gone."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"""(?is)<img\b[^>]*?\bsrc\s*=\s*["']?([^"'\s>]*)["']?[^>]*>""", "![]($1)")
    t = F.regexp_replace(t, r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))[^>]*>(.*?)</a\s*>""", "[$4]($1$2$3)")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    return F.replace(F.replace(F.replace(F.replace(t, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))


def graph(found: DataFrame, page: str, base: str) -> DataFrame:
    """(page, base, url, text, pos) of the pages that each page leads to on its own host: references resolved, itself and files left out, one row for each address
    with its first place and its longest label."""
    rows = found.select(page, base, U.resolve(base, "target").alias("url"), plain(F.col("label")).alias("text"), F.col("start").alias("pos"))
    own = F.regexp_replace(F.regexp_replace(F.col(base), "#.*$", ""), r"\s", "%20")
    file = F.regexp_extract(F.lower(F.regexp_replace("url", r"[?#].*$", "")), r"\.([a-z0-9]+)$", 1).isin(FILES)
    kept = rows.filter(F.col("url").rlike("^https?:") & (U.host("url") == U.host(base)) & (F.col("url") != own) & ~file)
    label = F.max_by("text", F.struct(F.length("text"), -F.col("pos")))
    return kept.groupBy(page, base, "url").agg(label.alias("text"), F.min("pos").alias("pos"))


def silent_labels(found: DataFrame, page: str, base: str) -> DataFrame:
    """(page, label): short labels, in lower case, that stand on three or more links of a page to two or more addresses: they say nothing about where a link leads."""
    rows = found.select(page, F.lower(plain(F.col("label"))).alias("label"), U.resolve(base, "target").alias("url"))
    rows = rows.filter((F.col("label") != "") & (F.length("label") < 40))
    return rows.groupBy(page, "label").agg(F.count("*").alias("_n"), F.count_distinct("url").alias("_u")).filter("_n >= 3 and _u >= 2").select(page, "label")


def next_pages(graph: DataFrame, page: str, base: str) -> DataFrame:
    """(page, url) of the next page of the list that a page shows: the first link whose label says so; else the first short label with such a word in it that leads to a
    later page of the same view, that is the same address but for a greater page number."""
    lower = F.lower(F.trim(F.col("text")))
    tail = lambda w: F.substring(lower, len(w) + 1, 1)
    said = lower.isin(*NEXT_SIGNS)
    for w in NEXT:
        said = said | (lower.startswith(w) & (tail(w).isin("", "»", "›", ">") | tail(w).rlike(r"^\s$")))
    within = (F.length("text") <= 60) & F.arrays_overlap(F.split(lower, r"[\s(«»›>).:]+"), F.array(*map(F.lit, NEXT_WITHIN)))
    rows = graph.withColumns({"_here": U.listing(base), "_there": U.listing("url")})
    later = (F.col("_there.view") == F.col("_here.view")) & (F.col("_there.n") > F.coalesce(F.col("_here.n"), F.lit(0)))
    way = F.when(said, 0).when(within & F.coalesce(later, F.lit(False)), 1)
    return rows.withColumn("_way", way).filter("_way is not null").groupBy(page).agg(F.min_by("url", F.struct("_way", "pos")).alias("url"))
