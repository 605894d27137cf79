"""Dates and spans: reading dates in several forms, months, islands of overlapping spans, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

#: Month names in English and French, folded, by number.
MONTHS = {
    name: k
    for k, names in enumerate(
        ("january janvier jan janv", "february fevrier feb fev", "march mars mar", "april avril apr avr", "may mai", "june juin jun", "july juillet jul juil", "august aout aug", "september septembre sep sept", "october octobre oct", "november novembre nov", "december decembre dec"), 1
    )
    for name in names.split()
}


def parse_date(x: str) -> Column:
    """ISO, day-first and month-name dates of a text; null where the calendar has no such day."""
    t = T.fold(x)
    names = "|".join(sorted(MONTHS, key=len, reverse=True))
    months = F.create_map(*[F.lit(v) for kv in MONTHS.items() for v in kv])
    part = lambda pattern, g: F.regexp_extract(t, pattern, g)
    iso, dmy, named = r"\b(\d{4}) (\d{1,2}) (\d{1,2})\b", r"\b(\d{1,2}) (\d{1,2}) (\d{4})\b", rf"\b(\d{{1,2}}) ({names}) (\d{{4}})\b"
    first_named = rf"\b({names}) (\d{{1,2}}) (\d{{4}})\b"
    date = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    month = lambda p, g: F.try_element_at(months, part(p, g)).cast("string")
    return F.coalesce(
        F.when(part(iso, 1) != "", date(part(iso, 1), part(iso, 2), part(iso, 3))), F.when(part(dmy, 1) != "", date(part(dmy, 3), part(dmy, 2), part(dmy, 1))),
        F.when(part(named, 1) != "", date(part(named, 3), month(named, 2), part(named, 1))), F.when(part(first_named, 1) != "", date(part(first_named, 3), month(first_named, 1), part(first_named, 2))),
    )


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def island_months(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Months covered by the union of [start, end] month spans of each key: spans merge when the next starts no later than the running end."""
    order = Window.partitionBy(key).orderBy(start, end)
    before = F.max(F.col(end) + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    islands = marked.withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(key, "_i").agg(F.min(start).alias("_s"), F.max(F.col(end) + 1).alias("_e"))
    total = F.sum(F.col("_e") - F.col("_s"))
    return merged.groupBy(key).agg(total.cast("long").alias("months"), F.floor(total / 12).cast("long").alias("years"), F.count("*").alias("islands"))


def sessions(events: DataFrame, key: str, ts: str, minutes: int) -> DataFrame:
    """Adds session, counted from 1: a gap of more than `minutes` begins a new one."""
    order = Window.partitionBy(key).orderBy(ts, "event_id")
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(order)
    new = F.when(gap.isNull() | (gap > minutes * 60_000_000), 1).otherwise(0)
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def seniority(written: Column, years: Column) -> Column:
    return F.when(written.rlike(r"\b(senior|lead|principal|expert)\b"), "senior").when(written.rlike(r"\b(junior|trainee|intern)\b"), "junior").when(years >= 5, "senior").when(years >= 3, "confirmed").otherwise("junior")
