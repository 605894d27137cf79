"""Operators of the document side: adapters, roll-ups, input shaping, tables, ordering and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def roll_up(rows: DataFrame, items: str, holder: str) -> DataFrame:
    """Explode held items: distinct holders of each, as a count and an ordered list."""
    long = rows.select(holder, F.explode(items).alias("item"))
    return long.groupBy("item").agg(F.count_distinct(holder).alias("holders"), F.array_join(F.slice(F.array_sort(F.collect_set(holder)), 1, 5), ",").alias("first_holders"))


def budget_gate(ok: Column, confidence: Column, comparables: Column) -> Column:
    return ok & (confidence != "very low") & (comparables >= 3)


def asset_groups(rows: DataFrame, asset: str, row: str, weak: Column) -> DataFrame:
    """Rows that each asset proves, and those it only supports weakly."""
    return rows.groupBy(asset).agg(F.count_if(~weak).alias("proves"), F.count_if(weak).alias("weak"), F.min(row).alias("first_row"))


def first_values(rows: DataFrame, key: str, order: str, columns: list[str], lists: str) -> DataFrame:
    """Merge rows by key: the first value of each column that isn't null, and all snippets in order."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return rows.groupBy(key).agg(*firsts, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, lists))), lambda x: x[lists]), " / ").alias(lists))


def staff_band(band: Column) -> Column:
    first = F.regexp_extract(band, r"(\d+)", 1).try_cast("int")
    return F.when(first < 50, "small").when(first < 1000, "medium").when(first.isNotNull(), "large").otherwise("unknown")


def legal_type(name: Column, rules: list[tuple[str, str]], other: str = "company") -> Column:
    """Type of the first rule whose pattern begins the name."""
    out = F.lit(other)
    for pattern, kind in reversed(rules):
        out = F.when(name.rlike(f"(?i)^({pattern})"), kind).otherwise(out)
    return out


def contacts(lists: list[str], most: int) -> Column:
    """Distinct values of several lists in order, cut to `most`."""
    return F.slice(F.array_distinct(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists])), 1, most)


def chunks(rows: DataFrame, part: str, order: str, size: int) -> DataFrame:
    """Table rows in pages of `size`: page, place, and whether more follow."""
    k = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(part))
    return rows.withColumn("page", F.floor(k / size)).withColumn("place", k % size).withColumn("pages", F.ceil(n / size))


def ordered(rows: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Fixed order by a left join; a missing element becomes a placeholder."""
    return order.join(rows.withColumn("_there", F.lit(True)), key, "left").withColumn("placeholder", F.col("_there").isNull()).drop("_there")


def sync(cache: DataFrame, server: DataFrame, key: str) -> DataFrame:
    """What a client must do to hold the server's rows: (action, key and columns), `delete` for its own rows that the server lacks, with
    null columns, and `upsert` for rows that it lacks or holds otherwise. Rows that are equal don't appear."""
    rest = [c for c in server.columns if c != key]
    old, new = cache.select(key, F.struct(*rest).alias("_old")), server.select(key, F.struct(*rest).alias("_new"))
    both = old.join(new, key, "full").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    action = F.when(F.col("_new").isNull(), "delete").otherwise("upsert")
    return both.select(action.alias("action"), key, *[F.col("_new")[c].alias(c) for c in rest])


def apply_sync(cache: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The client's rows after the changes of sync."""
    kept = cache.join(changes.select(key), key, "left_anti")
    return kept.select(cache.columns).unionByName(changes.filter("action = 'upsert'").select(cache.columns))


def delete_with_links(rows: DataFrame, gone: DataFrame, key: str, links: str) -> DataFrame:
    """Rows without the deleted ones, their ids taken out of the link lists; `unlinked` counts what was taken."""
    dead = gone.select(F.col(key).alias("_dead"))
    long = rows.join(dead, rows[key] == F.col("_dead"), "left_anti").select(key, F.posexplode_outer(links).alias("_p", "_l"))
    marked = long.join(dead, F.col("_l") == F.col("_dead"), "left")
    return marked.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_dead").isNull() & F.col("_l").isNotNull(), F.struct("_p", "_l")))), lambda x: x["_l"]).alias(links), F.count("_dead").alias("unlinked"),
    )


def unmatched_claims(text: Column, allowed: Column) -> Column:
    """Numbers of a text that its source doesn't hold."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1)), allowed)


def scrub(text: Column, bad: Column, placeholder: str = "[removed]") -> Column:
    return F.when(bad, F.lit(placeholder)).otherwise(text)
