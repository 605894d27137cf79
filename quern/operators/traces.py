"""Traces of an agent that reads pages: what it saw and what it picked, from semi-structured values without a schema.

A trace is JSON with an answer (`output`) and steps, each with an action (tool and input) and an observation, a text of lines or JSON that
holds one. Values are read by path from VARIANT; nothing is parsed in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import urls as U
from quern.session import stage

#: What lines of an observation begin with, and what stands for a link without text.
PAGE, BAD, EXCERPT, LABELS, NEXT, NOTE, NO_TEXT = "PAGE [", "PAGE ERROR | ", "TEXT: ", "REPEATED LABELS: ", "NEXT PAGE: ", "NOTE: ", "(no text)"
#: Fixed value: the tool that reads a page.
TOOL = "open_page"


def _said(value: Column) -> Column:
    """The text of an observation: as it is, or within JSON the string, the result, response or output of an object, those of an array line by line."""
    one = lambda v: F.coalesce(*[F.try_variant_get(v, f"$.{name}", "string") for name in ("result", "response", "output")], F.try_variant_get(v, "$", "string"))
    raw = F.try_variant_get(value, "$", "string")
    inner = F.try_parse_json(raw)
    many = F.try_variant_get(inner, "$", "array<variant>")
    return F.coalesce(F.array_join(F.transform(many, one), "\n"), one(inner), raw)


def _after(lines: Column, prefix: str) -> Column:
    """What follows the prefix on the first line that has it."""
    return F.substring(F.get(F.filter(lines, lambda x: x.startswith(prefix)), F.lit(0)), len(prefix) + 1, 1 << 30)


def steps(traces: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, step, asked, lines) of the steps that read a page."""
    tvf = traces.sparkSession.tvf
    rows = traces.select(F.col(key), F.try_parse_json(raw).alias("_v"))
    rows = rows.lateralJoin(tvf.variant_explode(F.try_variant_get("_v", "$.intermediateSteps", "variant").outer())).select(key, F.col("pos").alias("step"), F.col("value").alias("_s"))
    given = F.try_variant_get("_s", "$.action.toolInput", "string")
    asked = F.coalesce(F.try_variant_get("_s", "$.action.toolInput.url", "string"), F.try_variant_get(F.try_parse_json(given), "$.url", "string"), given, F.lit(""))
    text = _said(F.try_variant_get("_s", "$.observation", "variant"))
    return rows.filter(F.try_variant_get("_s", "$.action.tool", "string") == TOOL).select(key, "step", asked.alias("asked"), F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"))


def pages(steps: DataFrame, key: str) -> DataFrame:
    """(key, step, id, url, title, error, excerpt, repeated, next, note, asked) of every page that was asked for."""
    head, bad = F.split(_after(F.col("lines"), PAGE), r"\] \| | \| ", 3), F.split(_after(F.col("lines"), BAD), r" \| ", 2)
    fine = F.size(head) == 3
    labels = _after(F.col("lines"), LABELS)
    url = lambda line: F.nullif(F.substring(line, F.locate("] | ", line) + 4, 1 << 30), F.lit(""))
    return steps.select(
        key, "step", F.when(fine, F.get(head, F.lit(0))).alias("id"), F.when(fine, F.get(head, F.lit(1))).otherwise(F.coalesce(F.get(bad, F.lit(0)), "asked")).alias("url"),
        F.when(fine, F.trim(F.get(head, F.lit(2)))).otherwise("").alias("title"), F.when(~F.coalesce(fine, F.lit(False)), F.coalesce(F.get(bad, F.lit(1)), F.lit("unreadable tool result"))).alias("error"),
        F.substring(F.coalesce(_after(F.col("lines"), EXCERPT), F.lit("")), 1, 300).alias("excerpt"),
        F.when(labels.isNotNull() & (labels != "none"), F.split(labels, r" \| ")).otherwise(F.array().cast("array<string>")).alias("repeated"),
        url(_after(F.col("lines"), NEXT)).alias("next"), _after(F.col("lines"), NOTE).alias("note"), "asked",
    )


def links(steps: DataFrame, key: str) -> DataFrame:
    """(key, step, place, id, url, text, context) of the links that an observation lists: an id in brackets, a text with what stands around it, an address."""
    rows = steps.select(key, "step", F.posexplode("lines").alias("place", "_line")).filter(F.col("_line").startswith("["))
    close, last = F.locate("] ", F.col("_line")), F.length("_line") - F.length(F.substring_index("_line", " | ", -1)) - 2
    mark = F.substring("_line", F.lit(2), close - 2)
    said = F.when(last > close + 2, F.substring("_line", close + 2, last - close - 2)).otherwise("")
    text = F.trim(F.substring_index(said, " — ", 1))
    context = F.when(F.contains(said, F.lit(" — ")), F.trim(F.substring(said, F.locate(" — ", said) + 3, 1 << 30))).otherwise("")
    rows = rows.select(key, "step", "place", mark.alias("id"), F.substring_index("_line", " | ", -1).alias("url"), F.when(text == NO_TEXT, "").otherwise(text).alias("text"), context.alias("context"))
    return rows.filter(F.col("id").rlike("^[a-z0-9]+$") & F.col("url").rlike("^https?://."))


def answers(traces: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, place, token, list_url) of the ids or addresses in the answer of each trace."""
    tvf = traces.sparkSession.tvf
    output = F.try_variant_get(F.try_parse_json(raw), "$.output", "string")
    value = F.try_parse_json(F.regexp_extract(output, r"(?s)(\{.*\})", 1))
    rows = traces.select(F.col(key), value.alias("_a"))
    listed = rows.lateralJoin(tvf.variant_explode(F.try_variant_get("_a", "$.tender_links", "variant").outer()))
    token = F.regexp_replace(F.trim(F.try_variant_get("value", "$", "string")), r"^\[|\]$", "")
    return listed.select(key, F.col("pos").alias("place"), token.alias("token"), F.try_variant_get("_a", "$.list_url", "string").alias("list_url"))


def picks(traces: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, place, token, url, text, kind) of everything that an answer names. kind: `pick`; `invalid`, which no page showed; `again`, a page that is named twice; `navigation`: a page that
    the agent went on from, a list that picks were taken from, another page or order of such a list, or the first page where it is not the one notice."""
    read = stage(steps(traces, key, raw), "trace-steps")
    spelled = lambda c: U.listing(c)["key"]
    order = Window.partitionBy(key).orderBy("step")
    ok = pages(read, key).filter("error is null").withColumn("k", F.row_number().over(order) - 1)
    ok = ok.withColumns({"own": spelled("url"), "asked_key": spelled("asked"), "view": U.listing("url")["list"], "next_key": spelled("next")})
    ok = stage(ok, "trace-pages")
    shown = stage(links(read, key).join(ok.select(key, "step", "k"), [key, "step"]).withColumn("own", spelled("url")), "trace-links")
    # what each id or address stands for: the first page, then links as they were shown
    start = ok.filter("k = 0").select(key, F.lit(-1).alias("k"), F.lit(0).alias("place"), "id", "url", F.col("title").alias("text"), "own")
    every = start.unionByName(shown.select(key, "k", "place", "id", "url", "text", "own"))
    names = every.select(key, F.explode(F.array_distinct(F.array("id", "own"))).alias("name"), F.struct("k", "place", "url", "text", "own").alias("e")).filter("name is not null")
    names = names.groupBy(key, "name").agg(F.min_by("e", F.struct(F.col("e.k"), F.col("e.place"))).alias("e"))
    said = answers(traces, key, raw).withColumn("own_token", spelled("token"))
    by = lambda column, name: names.select(F.col(key).alias(f"_{name}"), F.col("name").alias(f"_{name}_n"), F.col("e").alias(name))
    found = said.join(by("token", "e1"), (F.col(key) == F.col("_e1")) & (F.col("token") == F.col("_e1_n")), "left").join(by("own_token", "e2"), (F.col(key) == F.col("_e2")) & (F.col("own_token") == F.col("_e2_n")), "left")
    found = found.select(key, "place", "token", "list_url", F.coalesce("e1", "e2").alias("e"))
    again = F.row_number().over(Window.partitionBy(key, "e.own").orderBy("place"))
    found = stage(found.withColumn("again", F.col("e").isNotNull() & (again > 1)), "trace-found")
    named = found.filter("e is not null and not again")
    # which pages are lists
    first = named.filter("e.k >= 0").select(key, F.col("e.own").alias("own"), F.col("e.k").alias("at"))
    on = first.groupBy(key).agg(F.collect_set("at").alias("shown_on"), F.map_from_entries(F.collect_list(F.struct("own", "at"))).alias("first_at"))
    later = ok.select(F.col(key).alias("_t"), F.col("own").alias("_own"), F.col("k").alias("_k"))
    left = shown.join(later, (F.col(key) == F.col("_t")) & (F.col("own") == F.col("_own")) & (F.col("_k") > F.col("k"))).select(F.col(key).alias("_t"), F.col("k").alias("_from")).distinct()
    gone_on = ok.join(left, (F.col(key) == F.col("_t")) & (F.col("k") == F.col("_from")), "left_semi").groupBy(key).agg(F.collect_set("own").alias("left_keys"))
    about = named.groupBy(key).agg(F.max("list_url").alias("list_url")).withColumn("list_key", spelled("list_url"))
    trace = ok.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "own", "asked_key", "view", "next_key"))).alias("pages")).join(about, key, "left").join(on, key, "left").join(gone_on, key, "left")

    def add(lists: Column, p: Column) -> Column:
        ids = F.array_compact(F.array(p["own"], p["asked_key"]))
        known = F.exists(lists, lambda s: F.coalesce(F.array_contains(ids, s["next_key"]), F.lit(False)) | (s["view"] == p["view"]))
        checked = F.exists(ids, lambda u: F.coalesce(F.try_element_at("first_at", u) < p["k"], F.lit(False))) & ~known
        is_list = (F.coalesce(F.array_contains("shown_on", p["k"]), F.lit(False)) & ~checked) | F.coalesce(F.array_contains("left_keys", p["own"]), F.lit(False)) | F.coalesce(p["own"] == F.col("list_key"), F.lit(False))
        return F.when(is_list, F.concat(lists, F.array(F.struct(p["view"].alias("view"), p["next_key"].alias("next_key"))))).otherwise(lists)

    lists = F.aggregate("pages", F.array().cast("array<struct<view:string,next_key:string>>"), add)
    trace = trace.select(key, lists.alias("lists"))
    from_start = shown.filter("k = 0").select(key, "own").distinct().withColumn("_s", F.lit(True))
    notice = named.select(key, "e.k", "e.own").join(from_start, [key, "own"], "left").groupBy(key).agg((F.bool_or(F.col("k") < 0) & ~F.coalesce(F.bool_or("_s"), F.lit(False))).alias("notice"))
    out = found.join(trace, key, "left").join(notice, key, "left").withColumn("_l", U.listing("e.url")["list"])
    listed = F.exists("lists", lambda s: (s["view"] == F.col("_l")) | F.coalesce(s["next_key"] == F.col("e.own"), F.lit(False)))
    navigation = F.when(F.col("e.k") < 0, ~F.col("notice")).otherwise(F.coalesce(listed, F.lit(False)))
    kind = F.when(F.col("e").isNull(), "invalid").when(F.col("again"), "again").when(navigation, "navigation").otherwise("pick")
    return out.select(key, "place", "token", F.col("e.url").alias("url"), F.col("e.text").alias("text"), kind.alias("kind"))
