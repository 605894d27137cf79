"""URLs as Column expressions: resolution of relative references, keys of pages and of lists, page numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The generic syntax of a URL: scheme, authority, path, query.
_SYNTAX = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?:(//[^/?#]*))?([^?#]*)(\?[^#]*)?(?:#.*)?$"
#: Parameters that number the pages of a list, and the beginning of others; parameters that order it.
PAGE_NAMES = "page paged pg pagenum pageno page_no pagenumber pageindex currentpage pagina seite start offset skip".split()
PAGE_PREFIX = "debut"
SORT_NAMES = "ordre order orderby sort sortby tri".split()


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _bound(value: Column, body) -> Column:
    """Evaluate a value once for a body that uses it several times."""
    return F.transform(F.array(value), body)[0]


def split(u) -> Column:
    """(scheme, authority with its slashes, path, query with its mark); empty where absent. The fragment goes."""
    part = lambda k: F.regexp_extract(_col(u), _SYNTAX, k)
    return F.struct(part(1).alias("scheme"), part(2).alias("authority"), part(3).alias("path"), part(4).alias("query"))


def without_dots(path: Column) -> Column:
    """A path without dot segments: a fold over its segments with a stack, from which `..` takes the last. The root stays."""
    def step(stack: Column, segment: Column) -> Column:
        up = F.when(F.size(stack) > 1, F.slice(stack, F.lit(1), F.size(stack) - 1)).otherwise(stack)
        return F.when(segment == "..", up).when(segment == ".", stack).otherwise(F.concat(stack, F.array(segment)))

    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda s, x: F.when(F.size(s) == 0, F.array(x)).otherwise(step(s, x)))
    ends = F.when(F.element_at(parts, -1).isin(".", "..") & (F.element_at(kept, -1) != ""), "/").otherwise("")
    out = F.concat(F.array_join(kept, "/"), ends)
    return F.when(path.startswith("/") & ~out.startswith("/"), F.concat(F.lit("/"), out)).otherwise(out)


def resolve(base, reference) -> Column:
    """The URL that a reference on a page names, by the rules of generic syntax, without fragment; spaces are encoded. Null where the base
    has no scheme and the reference neither."""

    def joined(pair: Column) -> Column:
        b, r = pair["b"], pair["r"]
        dir_ = F.when((b["path"] == "") & (b["authority"] != ""), "/").otherwise(F.regexp_extract(b["path"], r"^(.*/)?[^/]*$", 1))
        path = (
            F.when((r["scheme"] != "") | (r["authority"] != ""), without_dots(r["path"]))
            .when(r["path"] == "", b["path"]).when(r["path"].startswith("/"), without_dots(r["path"])).otherwise(without_dots(F.concat(dir_, r["path"])))
        )
        own = (r["scheme"] != "") | (r["authority"] != "") | (r["path"] != "") | (r["query"] != "")
        scheme = F.when(r["scheme"] != "", r["scheme"]).otherwise(b["scheme"])
        authority = F.when((r["scheme"] != "") | (r["authority"] != ""), r["authority"]).otherwise(b["authority"])
        return F.when(scheme != "", F.concat(scheme, F.lit(":"), authority, path, F.when(own, r["query"]).otherwise(b["query"])))

    pair = F.struct(split(base).alias("b"), split(F.regexp_replace(F.trim(_col(reference)), r"\s", "%20")).alias("r"))
    return _bound(pair, joined)


def host(u) -> Column:
    """Host in lower case without user, port and "www."; empty where there is none."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(_col(u), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), ":.*$", ""), r"^www\.", "")


def listing(u) -> Column:
    """(key, view, list, n) of a URL: `key` is one for all spellings of a page (scheme and host in lower case, no "www.", no slash at the end, sorted parameters); `view`
    is the key without page numbers, `list` without the order of the list too; `n` is the page number, null where none is given."""
    s = split(u)

    def made(x: Column) -> Column:
        base = F.concat(F.lower(x["scheme"]), F.lit(":"), F.regexp_replace(F.regexp_replace(F.lower(x["authority"]), r"^//www\.", "//"), ":(80|443)$", ""), F.regexp_replace(x["path"], "/$", ""))
        pairs = F.array_sort(F.filter(F.split(F.replace(F.substring(x["query"], 2, 1 << 30), F.lit("+"), F.lit("%20")), "&"), lambda p: p != ""))

        def named(p: Column) -> Column:
            name = F.regexp_extract(F.lower(F.substring_index(p, "=", 1)), r"([a-z0-9_]+)[^a-z0-9_]*$", 1)
            value = F.when(F.contains(p, F.lit("=")), F.substring_index(F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p)), "=", 1)).otherwise("")
            page = (name.isin(PAGE_NAMES) | name.startswith(PAGE_PREFIX)) & value.rlike("^[0-9]*$")
            return F.struct(p.alias("kv"), page.alias("page"), name.isin(SORT_NAMES).alias("sort"), F.when(page, value.try_cast("long")).alias("n"))

        params = F.transform(pairs, named)
        tail = F.regexp_extract(base, r"(?i)/page/([0-9]+)$", 1)
        short = F.regexp_replace(base, r"(?i)/page/[0-9]+$", "")
        query = lambda kept: F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.transform(kept, lambda p: p["kv"]), "&"))).otherwise("")
        return F.struct(
            F.concat(base, query(params)).alias("key"), F.concat(short, query(F.filter(params, lambda p: ~p["page"]))).alias("view"),
            F.concat(short, query(F.filter(params, lambda p: ~p["page"] & ~p["sort"]))).alias("list"), F.greatest(F.array_max(F.transform(params, lambda p: p["n"])), tail.try_cast("long")).alias("n"),
        )

    return _bound(s, made)
