"""Awards, partners and comparables: matches across sources, deduplication, medians, filters."""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

#: Legal forms of public bodies.
PUBLIC_FORMS = "gip gie epa epic epst epscp sem spl".split()
#: Words that say the same kind of public body.
BODIES = {"ville": "commune", "mairie": "commune", "municipalite": "commune", "municipality": "commune", "city": "commune", "town": "commune", "cc": "communaute communes", "ca": "communaute agglomeration", "cu": "communaute urbaine", "agglo": "agglomeration", "ministry": "ministere"}
#: Divisions of goods in the procurement vocabulary.
GOODS = (3, 44)


def same_award(partner: DataFrame, awards: DataFrame, days: int = 7, size: int = 40) -> DataFrame:
    """(partner_row, award_row) by the same id, or by another source with the same first `size` characters of the folded title and dates at most `days` apart.
    Titles meet by the key and a date band, so that a common title does not pair all its rows."""
    key = lambda c: F.substring(T.fold(c), 1, size)
    p = partner.select(F.col("row").alias("partner_row"), F.col("id").alias("_pid"), F.col("source").alias("_ps"), F.col("day").alias("_pd"), key("title").alias("_pk"))
    a = awards.select(F.col("row").alias("award_row"), F.col("id").alias("_aid"), F.col("source").alias("_as"), F.col("day").alias("_ad"), key("title").alias("_ak"))
    by_id = p.join(a, F.col("_pid") == F.col("_aid"))
    band = lambda c: F.floor(F.unix_date(c) / max(1, days))
    p = p.withColumn("_pb", F.explode(F.array(band("_pd") - 1, band("_pd"), band("_pd") + 1)))
    a = a.withColumn("_ab", band("_ad"))
    by_title = p.join(a, (F.col("_pk") == F.col("_ak")) & (F.col("_pb") == F.col("_ab")) & (F.col("_ps") != F.col("_as")) & (F.abs(F.datediff("_pd", "_ad")) <= days))
    return by_id.select("partner_row", "award_row").unionByName(by_title.select("partner_row", "award_row")).distinct()


def unique_awards(awards: DataFrame, size: int = 80) -> DataFrame:
    """One row of each id, by row; then, of those with the same title key and two-digit amount, only those of the source of the first one."""
    once = awards.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("row"))).filter("_k = 1").drop("_k")
    amount = F.when(F.col("amount") > 0, F.round(F.col("amount") / F.pow(F.lit(10.0), F.floor(F.log10("amount")) - 1)) * F.pow(F.lit(10.0), F.floor(F.log10("amount")) - 1))
    same = Window.partitionBy(F.substring(T.fold("title"), 1, size), amount)
    first = F.min_by("source", "row").over(same)
    return once.withColumn("_first", first).filter(amount.isNull() | (F.col("source") == F.col("_first"))).drop("_first")


def richest(awards: DataFrame, group: list[str], filled: list[str]) -> DataFrame:
    """Of each group of copies the row with most filled columns, then the first."""
    rich = sum((F.col(c).isNotNull().cast("int") for c in filled), F.lit(0))
    w = Window.partitionBy(*group).orderBy(rich.desc(), "row")
    return awards.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def median_bids(awards: DataFrame, group: str, bids: str) -> DataFrame:
    """The median of the positive bids of each group, from counts of each number of bids, so that no group is gathered."""
    counts = awards.filter(F.col(bids) > 0).groupBy(group, bids).agg(F.count("*").alias("_n"))
    up = Window.partitionBy(group).orderBy(bids)
    counts = counts.select(group, bids, F.sum("_n").over(up).alias("_up"), F.sum("_n").over(Window.partitionBy(group)).alias("_all"))
    low, high = F.floor((F.col("_all") + 1) / 2), F.ceil((F.col("_all") + 1) / 2)
    at = lambda k: F.min(F.when(F.col("_up") >= k, F.col(bids)))
    return counts.groupBy(group).agg(((at(low) + at(high)) / 2).alias("median_bids"), F.max("_all").alias("n"))


def comparable(awards: DataFrame, codes: str, title: str, own_codes: list[str], own_text: str) -> DataFrame:
    """Awards like a tender: a shared division (first two digits of a code), or a word of five letters or more that begins with the same six. Those
    unlike it go, then those mainly for goods where the tender buys none; neither step takes all. codes: an array column, the main one first."""
    stems = lambda c: F.transform(F.filter(F.split(T.fold(c), " "), lambda w: F.length(w) >= 5), lambda w: F.substring(w, 1, 6))
    divisions = lambda c: F.transform(c, lambda x: F.substring(x, 1, 2))
    own = F.array(*map(F.lit, own_codes)).cast("array<string>")
    goods = lambda d: d.try_cast("int").between(*GOODS)
    like = (F.size(own) == 0) | F.arrays_overlap(divisions(F.col(codes)), divisions(own)) | F.arrays_overlap(stems(title), stems(F.lit(own_text)))
    bought = ~F.exists(divisions(own), goods) & F.coalesce(goods(F.substring(F.get(codes, F.lit(0)), 1, 2)), F.lit(False))
    flagged = awards.withColumns({"_like": F.coalesce(like, F.lit(False)), "_goods": bought})
    some = flagged.agg(F.coalesce(F.bool_or("_like"), F.lit(False)).alias("_some"), F.coalesce(F.bool_or(F.col("_like") & ~F.col("_goods")), F.lit(False)).alias("_bare"), F.coalesce(F.bool_or(~F.col("_goods")), F.lit(False)).alias("_any"))
    kept = (F.col("_like") | ~F.col("_some")) & (~F.col("_goods") | ~F.when(F.col("_some"), F.col("_bare")).otherwise(F.col("_any")))
    return flagged.crossJoin(F.broadcast(some)).filter(kept).drop("_like", "_goods", "_some", "_bare", "_any")  # one row is sent


def body_of(name: str) -> Column:
    """Words of a public body's name without what stands in brackets, kinds said one way, legal forms left out."""
    plain = T.fold(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"\([^)]*\)", " "))
    plain = F.regexp_replace(plain, r"\bconseil (departement|region)al\b", "$1")
    kinds = F.create_map(*[F.lit(x) for kv in BODIES.items() for x in kv])
    words = F.flatten(F.transform(F.split(plain, " "), lambda w: F.split(F.coalesce(F.try_element_at(kinds, w), w), " ")))
    return F.array_join(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(T.FIRM_TAIL + T.FIRM_HEAD + PUBLIC_FORMS)), " ")


def expanded(name: Column, other: Column) -> Column:
    """Words of a name, those of two to six letters that are the initials of as many words in a row of the other name replaced by these."""
    def initials(n: Column, i: Column) -> Column:
        return F.array_join(F.transform(F.slice(other, i, n), lambda w: F.substring(w, 1, 1)), "")

    def spelled(w: Column) -> Column:
        n = F.length(w)
        starts = F.when(w.rlike("^[a-z]{2,6}$") & (F.size(other) >= n), F.filter(F.sequence(F.lit(1), F.size(other) - n + 1), lambda i: initials(n, i) == w)).otherwise(F.array().cast("array<int>"))
        return F.when(F.size(starts) > 0, F.slice(other, F.try_element_at(starts, F.lit(1)), n)).otherwise(F.array(w))

    return F.flatten(F.transform(name, spelled))


def name_match(a: Column, b: Column) -> Column:
    """The best Dice similarity of two names' words as they are or with the acronyms of either spelled out."""
    stems = lambda x: F.array_distinct(F.transform(F.filter(x, lambda t: F.length(t) > 2), T.stem))
    return F.greatest(T.dice(stems(a), stems(b)), T.dice(stems(expanded(a, b)), stems(b)), T.dice(stems(a), stems(expanded(b, a))))


def official_domain(notice: Column, encyclopedia: Column, match: Column, title_domain: Column, mail: Column, gate: float = 0.85) -> Column:
    """The first of: the notice's site, the encyclopedia's, that of a page whose title matches well enough, and the domain of an e-mail address."""
    return F.coalesce(notice, encyclopedia, F.when(match >= gate, title_domain), F.nullif(F.regexp_extract(mail, r"@([a-z0-9.-]+)$", 1), F.lit("")))


def first_titles(history: DataFrame, contracts: DataFrame, group: str, most: int = 10) -> DataFrame:
    """Past projects of each group: history before contracts, one for each folded title, digital ones first, at most `most`."""
    both = history.withColumn("_lane", F.lit(0)).unionByName(contracts.withColumn("_lane", F.lit(1)))
    once = Window.partitionBy(group, T.fold("title")).orderBy("_lane", "row")
    order = Window.partitionBy(group).orderBy(F.desc("digital"), "_lane", "row")
    out = both.withColumn("_k", F.row_number().over(once)).filter("_k = 1")
    return out.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("_k", "_lane")


def award_search(awards: DataFrame, prefixes: list[str], keyword: str, since: str) -> DataFrame:
    """One row of each contract uid among awards on or after a day, with a code in one of the prefixes and the keyword in the folded title: its winners, last day and greatest amount."""
    wanted = F.lit(False)
    for p in prefixes:
        wanted = wanted | F.col("code").startswith(p)
    found = awards.filter(wanted & (F.col("day") >= F.lit(since).cast("date")) & T.fold("title").contains(keyword))
    return found.groupBy("uid").agg(F.array_sort(F.collect_set("winner")).alias("winners"), F.max("day").alias("day"), F.max("amount").alias("amount"))


def registry_lookup(asked: DataFrame, registry: DataFrame, most: int = 5) -> DataFrame:
    """(ask, id, name, band): registry rows of the asked number, or whose folded name begins with the same two words, at most `most`, by number first, then by name and id. Names meet by an equi-join."""
    key = lambda c: F.array_join(F.slice(F.split(T.fold(c), " "), 1, 2), " ")
    rows = registry.select("id", "name", "staff", key("name").alias("_key"))
    by_id = asked.filter("number is not null").join(rows, F.col("number") == F.col("id")).select("ask", "id", "name", "staff", F.lit(0).alias("_way"))
    by_name = asked.withColumn("_own", key("called")).join(rows, F.col("_own") == F.col("_key")).select("ask", "id", "name", "staff", F.lit(1).alias("_way"))
    best = by_id.unionByName(by_name).groupBy("ask", "id").agg(F.min("_way").alias("_way"), F.first("name").alias("name"), F.first("staff").alias("staff"))
    place = F.row_number().over(Window.partitionBy("ask").orderBy("_way", "name", "id"))
    band = F.when(F.col("staff") < 50, "small").when(F.col("staff") < 1000, "medium").when(F.col("staff").isNotNull(), "large")
    return best.withColumns({"place": place, "band": band}).filter(F.col("place") <= most).select("ask", "place", "id", "band")


def without_copies(awards: DataFrame, share: float = 0.02, days: int = 90) -> DataFrame:
    """(row, copy_of) of every award (row, source, winners, amount, day, buyer, bids, framework, others), copy_of null where it stays. Awards of the same winners, legal forms aside, are
    copies across sources when their amounts differ by at most `share` and their days by at most `days`; within one source when buyer, day and amount are equal. From the last award
    to the first, each that is still there meets the first other one it copies, and the one that says less goes; where both say as much, the other. What is dropped may have
    been dropped in favour of an award that goes later, so copies of copies are settled in order.

    Decisions depend on order only among awards of the same winners without a gap in their days, and then in their amounts, that no copy spans: these are folded in sequence,
    and no others. There, an award meets only those of its cell of day and amount and of the cells around it, and stops at the first copy. No pairs are made."""
    keys = F.array_join(F.array_sort(F.filter(F.transform("winners", lambda w: T.firm_key(w)), lambda w: w != "")), "|")
    own = awards.withColumns({
        "_win": F.nullif(keys, F.lit("")), "_buyer": T.fold("buyer"), "_amount": F.when(F.col("amount") > 0, F.col("amount").cast("double")),
        "_info": F.when(F.col("amount") > 0, 2).otherwise(0) + F.when(F.col("bids") > 0, 1).otherwise(0) + F.coalesce(F.col("framework"), F.lit(False)).cast("int") + F.coalesce(F.size("others"), F.lit(0)),
    })
    wide = -1.001 * math.log(1 - share) + 1e-9
    rows = own.select("row", "source", "_win", "_buyer", F.nanvl("_amount", F.lit(None).cast("double")).alias("_amount"), F.unix_date("day").alias("_day"), "_info")
    rows = rows.filter("_win is not null and _day is not null")

    def parted(rows: DataFrame, by: list[str], value: Column, gap: float, name: str) -> DataFrame:
        """rows with the number of the run of values, without a greater gap, that they are in."""
        w = Window.partitionBy(*by).orderBy(value)
        new = rows.withColumn("_new", F.coalesce((value - F.lag(value).over(w) > gap).cast("long"), F.lit(0)))
        return new.withColumn(name, F.sum("_new").over(w)).drop("_new")

    rows = parted(rows, ["_win"], F.col("_day"), days, "_p1")
    rows = parted(rows, ["_win", "_p1"], F.log("_amount"), wide, "_p2").withColumn("_p2", F.when(F.col("_amount").isNotNull(), F.col("_p2")).otherwise(-1))
    kind = dict(awards.dtypes)["row"]

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row", ignore_index=True)
        n = len(frame)
        amount, day, info = (frame[c].to_numpy() for c in ("_amount", "_day", "_info"))
        sources = pd.factorize(frame["source"])[0].tolist()
        same = frame.groupby(["source", "_buyer", "_amount", "_day"], sort=False, dropna=False).ngroup().to_numpy()
        known = bool(n) and not np.isnan(amount[0])
        levels = np.floor(np.log(amount) / wide).tolist() if known else [0] * n
        spans = (day // max(1, days)).tolist()
        amount, day, info, same = amount.tolist(), day.tolist(), info.tolist(), same.tolist()
        there: dict[tuple, dict[int, list[int]]] = {}  # by cell and source, in order
        equal: dict[int, list[int]] = {}
        for k in range(n):
            there.setdefault((levels[k], spans[k]), {}).setdefault(sources[k], []).append(k)
            equal.setdefault(same[k], []).append(k)
        around = [(a, d) for a in ((0, -1, 1) if known else (0,)) for d in (0, -1, 1)]
        copy_of: dict[int, int] = {}
        for x in range(n - 1, -1, -1):
            if x in copy_of:
                continue
            first, mine, ax, dx = n, sources[x], amount[x], day[x]
            if known:
                first = next((y for y in equal[same[x]] if y != x), n)
            for a, d in around:
                for source, ids in there.get((levels[x] + a, spans[x] + d), {}).items():
                    if source == mine:
                        continue
                    for y in ids:
                        if y >= first:
                            break
                        if abs(dx - day[y]) <= days and (not known or abs(ax - amount[y]) <= share * max(ax, amount[y])):
                            first = y
                            break
            if first < n:
                out, stays = (first, x) if info[x] >= info[first] else (x, first)
                copy_of[out] = stays
                for ids in (there[levels[out], spans[out]][sources[out]], equal[same[out]]):
                    del ids[bisect_left(ids, out)]
        ids = frame["row"]
        return pd.DataFrame({"row": ids.iloc[list(copy_of)].to_numpy(), "copy_of": ids.iloc[list(copy_of.values())].to_numpy()})

    shared = rows.withColumn("_n", F.count("*").over(Window.partitionBy("_win", "_p1", "_p2"))).filter("_n > 1").drop("_n")
    found = shared.groupBy("_win", "_p1", "_p2").applyInPandas(fold, f"row {kind}, copy_of {kind}")
    return awards.select("row").join(found, "row", "left")
