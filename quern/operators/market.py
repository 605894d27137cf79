"""Market study: percentiles with outliers set aside, competitors, duplicate awards by band joins, buyer signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import half_up


def budget(rows: DataFrame, group: list[str], amount: str) -> DataFrame:
    """Exact p25, p50 and p75 of each group after amounts over 10 times or under a tenth of the median are set aside (from three amounts on)."""
    pct = lambda: F.percentile(amount, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    middle = rows.groupBy(*group).agg(F.percentile(amount, F.lit(0.5)).alias("_m"), F.count(amount).alias("_n"))
    joined = rows.join(middle, group)
    out = (F.col("_n") >= 3) & ((F.col(amount) > 10 * F.col("_m")) | (F.col(amount) < F.col("_m") / 10))
    kept = joined.withColumn("_out", out)
    stats = kept.groupBy(*group).agg(F.count(F.when(F.col("_out"), 1)).alias("n_outliers"))
    found = kept.filter(~F.col("_out")).groupBy(*group).agg(pct().alias("_p"), F.min(amount).alias("_min"), F.max(amount).alias("_max"), F.count("*").alias("n_used"))
    spread = F.col("_p")[2] / F.col("_p")[0]
    base = F.when(F.col("n_used") >= 5, 2).when(F.col("n_used") >= 2, 1).otherwise(0)
    level = F.greatest(F.lit(0), base - F.when((spread > 5) | (F.col("_max") / F.col("_min") > 50), 1).otherwise(0))
    confidence = F.element_at(F.array(F.lit("very low"), F.lit("low"), F.lit("medium")), level + 1)
    return found.join(stats, group).select(*group, *[half_up(F.col("_p")[k]).cast("long").alias(n) for k, n in enumerate(("low", "median", "high"))], "n_used", "n_outliers", confidence.alias("confidence"))


def dominant(rows: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value of each group, ties to the one seen first."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return counts.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "first_seen"))).filter("_r = 1").drop("_r", "first_seen")


def competitors(awards: DataFrame, group: str, winner: str, amount: str, date: str, k: int = 8) -> DataFrame:
    """The k firms of each group with most wins, then most won, then by key: wins, total, average of priced wins, last win."""
    stats = awards.groupBy(group, winner).agg(
        F.count("*").alias("wins"), F.sum(amount).alias("won"), F.avg(F.when(F.col(amount) > 0, F.col(amount))).alias("average"), F.max(date).alias("last_win"),
    )
    w = Window.partitionBy(group).orderBy(F.desc("wins"), F.desc(F.round("won", 2)), winner)
    return stats.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def near_copies(awards: DataFrame, keys: list[str], date: str, key: str, days: int) -> DataFrame:
    """(key, copy_of): rows of equal keys at most `days` after an earlier one, marked as its copy. A date band of `days` is part of the
    join key, so that a pair meets in one of two neighbouring bands and no key's rows all meet each other."""
    band = F.floor(F.unix_date(F.col(date)) / days)
    a = awards.select(*keys, key, date, band.alias("_b"))
    b = awards.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(key).alias("_key"), F.col(date).alias("_date"), F.explode(F.array(band, band + 1)).alias("_band"))
    on = F.col("_b") == F.col("_band")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    gap = F.datediff(F.col(date), F.col("_date"))
    pairs = a.join(b, on).filter((gap >= 0) & (gap <= days) & ((gap > 0) | (F.col("_key") < F.col(key))))
    return pairs.groupBy(key).agg(F.min("_key").alias("copy_of"))


def near_amounts(a: DataFrame, b: DataFrame, keys: list[str], amount: str, date: str, share: float, days: int) -> DataFrame:
    """Cross-source matches: equal keys, amounts within a share of the larger, dates within days; joined on neighbouring date bands."""
    band = lambda d: F.floor(F.unix_date(F.col(d)) / days)
    left = a.withColumn("_band", F.explode(F.array(band(date) - 1, band(date), band(date) + 1))).alias("a")
    right = b.withColumn("_band", band(date)).alias("b")
    on = F.col("a._band") == F.col("b._band")
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    x, y = F.col(f"a.{amount}"), F.col(f"b.{amount}")
    close = (x.isNull() & y.isNull()) | (F.abs(x - y) <= share * F.greatest(x, y))
    return left.join(right, on & close & (F.abs(F.datediff(f"a.{date}", f"b.{date}")) <= days))


def buyer_signals(rows: DataFrame, group: str, amount: str) -> DataFrame:
    counts = rows.filter(F.col(amount).isNotNull()).groupBy(group, amount).agg(F.count("*").alias("_n"))
    up = Window.partitionBy(group).orderBy(amount).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"_up": F.sum("_n").over(up), "_all": F.sum("_n").over(Window.partitionBy(group))})
    middle = F.min(F.when(F.col("_up") > F.floor(F.col("_all") / 2), F.col(amount)))  # the element at half the number, rounded down, from 0
    out = counts.groupBy(group).agg(F.sum("_n").alias("n"), F.min(amount).alias("low"), middle.alias("middle"), F.max(amount).alias("high"))
    none = rows.groupBy(group).agg(F.count(amount).alias("_any")).filter("_any = 0")
    return out.unionByName(none.select(group, F.lit(0).cast("long").alias("n"), *[F.lit(None).cast(dict(rows.dtypes)[amount]).alias(c) for c in ("low", "middle", "high")]))
