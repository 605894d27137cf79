"""Cleaning of notices: corrections merged into their originals, twins by reference, attempts to give instructions, joined and pruned lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T

#: What texts say that try to give instructions, and claims that are planted in them.
INSTRUCTIONS = (
    "ignore previous", "ignore above", "ignore all previous", "ignore all above", "system prompt", "reveal", "you are now", "disregard", "jailbreak", "base64", "<script", "javascript:", "onclick=", "onerror=", "onload=",
)
PLANTED = ("50 awards", "number one", "best in the world", "guaranteed success", "award-winning")


def rectified(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """(row, deadline, corrected_by) of originals (row, source, external_id, pair_key, deadline). A correction (row, source, supersedes, pair_key, deadline, published) belongs to the notices of its source
    that it names, or, where it names none that is there, to those of its pair; the newest one with a deadline moves it. Equi-joins on both keys; the named ones come first."""
    c = corrections.select(F.col("row").alias("c_row"), F.col("source").alias("c_source"), "supersedes", F.col("pair_key").alias("c_pair"), F.struct(F.col("published").alias("p"), F.col("row").alias("r"), F.col("deadline").alias("d")).alias("c"))
    o = rows.select("row", "source", "external_id", "pair_key")
    named = c.withColumn("_id", F.explode(F.array_distinct("supersedes"))).join(o, (F.col("c_source") == F.col("source")) & (F.col("_id") == F.col("external_id"))).select("c_row", "c", "row")
    rest = c.join(named.select("c_row").distinct(), "c_row", "left_anti").join(o, F.col("c_pair") == F.col("pair_key")).select("c_row", "c", "row")
    newest = named.unionByName(rest).filter("c.d is not null and c_row <> row").groupBy("row").agg(F.max("c").alias("c"))
    out = rows.select("row", "deadline").join(newest, "row", "left")
    return out.select("row", F.coalesce("c.d", "deadline").alias("deadline"), F.col("c.r").alias("corrected_by"))


def reference(title) -> Column:
    """A number and a year after a mark of reference in a title, as `n/yyyy`; a period of months is none."""
    t = F.translate(F.col(title) if isinstance(title, str) else title, "٠١٢٣٤٥٦٧٨٩", "0123456789")
    found = F.regexp_extract(T.fold(t), r"\b(?:n|no|num|numero|ref|reference|ao|aon|aoi|aoo|رقم|عدد) (\d{1,5}) ((?:19|20)\d{2})(?! \d)\b", 0)
    parts = F.split(found, " ")
    return F.when(found != "", F.concat(F.element_at(parts, -2), F.lit("/"), F.element_at(parts, -1)))


def same_reference(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """(row, twin): rows (row, reference, buyer, deadline) without a deadline and the first one with a deadline that has the same reference and a buyer that is alike or unknown on either
    side. Buyers of a reference meet once each, whatever their rows."""
    known = rows.filter("reference is not null").withColumn("buyer", F.coalesce(F.trim("buyer"), F.lit("")))
    dated = known.filter("deadline is not null").groupBy("reference", "buyer").agg(F.min("row").alias("first"))
    asked = known.filter("deadline is null")
    a, b = asked.select("reference", "buyer").distinct().alias("a"), dated.alias("b")
    alike = (F.col("a.buyer") == "") | (F.col("b.buyer") == "") | (F.col("a.buyer") == F.col("b.buyer")) | (T.dice(T.name_tokens(F.col("a.buyer")), T.name_tokens(F.col("b.buyer"))) >= least)
    twins = a.join(b, (F.col("a.reference") == F.col("b.reference")) & alike).groupBy(F.col("a.reference").alias("reference"), F.col("a.buyer").alias("buyer")).agg(F.min("first").alias("twin"))
    return asked.join(twins, ["reference", "buyer"]).select("row", "twin")


def injections(rows: DataFrame, key: str, fields: DataFrame) -> DataFrame:
    """(key, path, found) of the instructions and planted claims in the text values of records: fields has (key, path, value) of every leaf, at any depth."""
    plain = F.regexp_replace(F.lower(F.col("value")), r"\s+", " ")
    said = F.filter(F.array(*map(F.lit, INSTRUCTIONS + PLANTED)), lambda p: F.contains(F.col("_v"), p))
    found = fields.filter("value is not null").withColumn("_v", plain).select(key, "path", F.explode(said).alias("found"))
    return found.join(rows.select(key).distinct(), key, "left_semi")


def union_of(first: Column, second: Column) -> Column:
    """Requirements of both lists, once each by their folded text, in order; nulls and empty ones go."""
    every = F.filter(F.concat(F.coalesce(first, F.array().cast("array<string>")), F.coalesce(second, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (F.trim(x) != ""))
    keys = F.transform(every, lambda x: T.fold(x))
    return F.filter(every, lambda x, i: F.array_position(keys, T.fold(x)) == i + 1)


def summary(profile: Column) -> Column:
    """A profile's map without empty values."""
    return F.map_filter(profile, lambda k, v: v.isNotNull() & (F.trim(v) != "") & ~v.isin("[]", "{}"))
