"""Ordering: ranking, slots, running budgets, retention, project scores. Every order is total, with an id as the last key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T


def tender_order(too_late: Column, fit: Column, coverage: Column, deadline: Column, key: Column) -> list[Column]:
    level = F.when(fit == "high", 3).when(fit == "medium", 2).otherwise(0)
    return [too_late.asc(), level.desc(), F.coalesce(coverage, F.lit(0.0)).desc(), deadline.asc_nulls_last(), key.asc()]


def slots(rows: DataFrame, part: str, order: list[Column], eligible: Column, most: int) -> DataFrame:
    """Adds slot: running count of eligible rows in order; chosen while it is at most `most`."""
    run = F.sum(F.when(eligible, 1).otherwise(0)).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("slot", run).withColumn("chosen", eligible & (F.col("slot") <= most))


def within_budget(rows: DataFrame, part: str, order: list[Column], size: Column, most: int) -> DataFrame:
    """Rows from the top while their cumulative size is at most the budget."""
    run = F.sum(size).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", run).filter(F.col("used") <= most)


def project_score(own: Column, wanted: Column, age_years: Column, kind: Column, wanted_kind: Column) -> Column:
    """50 x Jaccard of keywords + up to 30 for recency (full to 2 years, none from 5) + 20 for the same kind, 15 for a sibling."""
    recency = F.when(age_years <= 2, 30.0).when(age_years <= 5, 30.0 * (1 - (age_years - 2) / 3)).otherwise(0.0)
    sibling = F.array_sort(F.array(kind, wanted_kind)) == F.array(F.lit("saas"), F.lit("software"))
    same = F.when(kind == wanted_kind, 20).when(sibling, 15).otherwise(0)
    return F.round(50 * T.jaccard(own, wanted) + recency + same, 2)


def newest(rows: DataFrame, part: str, order: list[Column], keep: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(part).orderBy(*order))).withColumn("kept", F.col("_r") <= keep).drop("_r")
