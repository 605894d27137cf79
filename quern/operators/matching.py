"""Matching in full: status from reranker scores, similarity thresholds, real documents first, citations, checks of results, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.decide import logit_percent
from quern.session import small, stage

#: Scores from which a document counts, alone and with half of the words found; how much lower a real document may score and still come first.
STRONG, FLOOR, ABOUT_SAME = 0.0, -6.0, 1.0
#: Rows up to which a list of words is broadcast.
SENT = 200_000


def good_documents(candidates: DataFrame, need: str) -> DataFrame:
    """candidates: (need, doc_id, score, support, qualified, equivalent, named, demo, plain_words). Those that count, with `weight` 0 (rules or a naming line),
    1 (equivalent certificate) or 2 (weak), `rescued` where only the rules speak for them, and `place`: by weight, then score, but the first real
    document that is no weaker and scores about the same stands before a demo record."""
    alone = (F.col("score") >= STRONG) | ((F.col("support") >= 0.5) & (F.col("score") >= FLOOR))
    ruled = F.col("qualified") | F.col("equivalent")
    any_good = F.max(alone.cast("int")).over(Window.partitionBy(need)) == 1
    rescued = ~any_good & ruled & F.col("plain_words")
    good = candidates.withColumns({"rescued": rescued, "weight": F.when(F.col("equivalent"), 1).when(F.col("qualified") | F.col("named"), 0).otherwise(2)}).filter(alone | F.col("rescued"))
    order = Window.partitionBy(need).orderBy("weight", F.desc("score"), "doc_id")
    good = good.withColumns({"_k": F.row_number().over(order), "_top": F.first(F.struct("demo", "weight", "score")).over(order)})
    near = F.col("_top.demo") & ~F.col("demo") & (F.col("weight") <= F.col("_top.weight")) & (F.col("score") >= F.col("_top.score") - ABOUT_SAME)
    first = F.min(F.when(near, F.col("_k"))).over(Window.partitionBy(need))
    bumped = F.when(F.col("_k") == first, 0).otherwise(F.col("_k"))
    return good.withColumn("_b", bumped).withColumn("place", F.row_number().over(Window.partitionBy(need).orderBy("_b"))).drop("_k", "_top", "_b")


def judged(good: DataFrame, needs: DataFrame, need: str) -> DataFrame:
    """needs: (need, needed). Status, percent and the number found: covered by as many strong documents as needed; at most half where the rules alone or a weak line speak."""
    strong = F.count_if((F.col("score") >= STRONG) & (F.col("weight") == 0))
    top = F.min_by(F.struct("score", "weight", "rescued"), "place")
    by = good.groupBy(need).agg(strong.alias("_strong"), F.count("*").alias("found"), top.alias("_top"))
    out = needs.select(need, "needed").join(by, need, "left")
    share = 100.0 * F.col("found") / F.col("needed")
    percent = F.least(logit_percent(F.col("_top.score") + 0.0), share)
    percent = F.when(F.col("_top.rescued"), F.least(F.lit(50.0), share)).when(F.col("_top.weight") == 2, F.least(percent, F.lit(50.0))).otherwise(percent)
    status = F.when(F.col("found").isNull(), "missing").when(F.col("_strong") >= F.col("needed"), "covered").otherwise("partial")
    return out.select(need, status.alias("status"), F.coalesce(percent, F.lit(0.0)).alias("percent"), F.coalesce("found", F.lit(0)).cast("long").alias("found"))


def by_similarity(best: Column, low: float, high: float) -> tuple[Column, Column]:
    """Status and percent of a best similarity between two thresholds."""
    status = F.when(best >= high, "covered").when(best >= low, "partial").otherwise("missing")
    return status, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (best - low) / ((high - low) or 1)))


def closest(candidates: DataFrame, statuses: DataFrame, need: str) -> DataFrame:
    """For each missing need the candidate with the highest score, then the smaller id."""
    missing = statuses.filter("status = 'missing'").select(need)
    return candidates.join(missing, need, "left_semi").groupBy(need).agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("closest"))


def citations(matches: DataFrame) -> DataFrame:
    """Of each document its best match over all needs, by score and similarity together, and the order of documents."""
    key = F.coalesce("score", F.lit(5.0)) + F.coalesce("sim", F.lit(0.0))
    best = matches.groupBy("doc_id").agg(F.max_by(F.struct("need", key.alias("key")), F.struct(key, -F.col("need"))).alias("b")).select("doc_id", "b.*")
    return best


def result_checks(results: DataFrame, wanted: DataFrame, need: str) -> DataFrame:
    """results: (need, status, found, docs); wanted: (need, expect, allowed, least). Whether status, documents and count are as expected."""
    both = wanted.join(results, need, "left")
    status = F.when(F.col("expect") == "found", F.coalesce(F.col("status") != "missing", F.lit(False))).otherwise(F.col("status").eqNullSafe(F.col("expect")))
    wrong = F.when(F.size("allowed") > 0, F.array_except(F.coalesce("docs", F.array().cast("array<bigint>")), "allowed")).otherwise(F.array().cast("array<bigint>"))
    return both.select(need, status.alias("status_ok"), F.size(wrong).alias("n_wrong"), (F.coalesce("found", F.lit(0)) >= F.col("least")).alias("count_ok"))


def row_scores(rows: DataFrame, group: str) -> DataFrame:
    """Shares of rows that claim too much, too little, or what was expected; status order: missing, partial, covered."""
    rank = lambda c: F.array_position(F.array(F.lit("missing"), F.lit("partial"), F.lit("covered")), F.col(c))
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(rank("got") > rank("expect")).alias("over"), F.count_if(rank("got") < rank("expect")).alias("under"), F.count_if(rank("got") == rank("expect")).alias("right"))


def word_coverage(needs: DataFrame, evidence: DataFrame, need: str, text: str, item: str) -> DataFrame:
    """Status of each need by the most distinct words that it shares with one item of evidence: two covered, one partial, none to_clarify. What counts is whether
    one item has some word of the need, and some two; so needs meet the distinct words and pairs of words of all items, each of which is there once, and never the items. Texts with
    the same words count once, and only words of both sides make pairs."""
    words = F.filter(F.split(T.fold(text), " "), lambda w: (F.length(w) >= 3) & ~w.isin(T.STOPWORDS))
    sets = lambda frame, key: frame.select(key, F.explode(F.array_distinct(words)).alias("_word")).groupBy(key).agg(F.array_sort(F.collect_set("_word")).alias("_w"))
    own = sets(needs, need)
    asked, told = own.select("_w").distinct(), sets(evidence, item).select("_w").distinct()
    long = lambda frame: frame.select("_w", F.explode("_w").alias("_word"))
    shared = stage(long(asked).select("_word").distinct().intersect(long(told).select("_word").distinct()), "shared-words")

    def pairs(frame: DataFrame) -> DataFrame:
        """The texts' shared words, and every two of them, in order."""
        kept = long(frame).join(small(shared, SENT), "_word").groupBy("_w").agg(F.array_sort(F.collect_list("_word")).alias("_s"))
        two = F.flatten(F.transform("_s", lambda x, i: F.transform(F.slice("_s", i + 2, F.size("_s")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
        return kept.withColumn("_two", two)

    known = pairs(told).select(F.explode("_two").alias("_pair")).distinct()
    mine = stage(pairs(asked), "shared-pairs")
    two = mine.select("_w", F.explode("_two").alias("_pair")).join(known, "_pair", "left_semi").select("_w").distinct().withColumn("_hits", F.lit(2))
    best = mine.select("_w").join(two, "_w", "left").select("_w", F.coalesce("_hits", F.lit(1)).alias("hits"))
    status = F.when(F.col("hits") >= 2, "covered").when(F.col("hits") == 1, "partial").otherwise("to_clarify")
    return needs.select(need).join(own.join(best, "_w"), need, "left").select(need, status.alias("status"))


def from_score(score: Column) -> Column:
    return F.when(score >= 0.75, "covered").when(score >= 0.4, "partial").otherwise("to_clarify")


def with_status(table: DataFrame, statuses: DataFrame, text: str) -> DataFrame:
    """A table's rows with the status of their requirement text; rows without one are to_clarify."""
    known = statuses.select(F.col(text).alias("_text"), "status")
    return table.join(known, F.col(text) == F.col("_text"), "left").drop("_text").withColumn("status", F.coalesce("status", F.lit("to_clarify")))


def uncovered(sentences: DataFrame, needs: DataFrame, group: str, least: float = 0.6, most: int = 10) -> DataFrame:
    """sentences: (group, no, text); needs: (group, text). The first `most` sentences of each group that oblige, aren't procedural, and share less than `least` of their
    words with every need of the group and of the need's words with them."""
    must = T.fold("text").rlike(r"\b(must|shall|required|mandatory|doit|doivent|devra|devront|obligatoire|souhaite|souhaitee|preferred|should)\b")
    own = sentences.filter(must & ~T.fold("text").rlike(r"\b(attestation|candidature|signed|signature|insurance|date limite)\b")).select(group, "no", T.toks("text").alias("_s"))
    asked = needs.select(group, T.toks("text").alias("_n"))
    sets = own.select(group, "_s").distinct().join(asked.distinct(), group)  # what is said twice meets the needs once
    near = sets.filter((T.coverage(F.col("_s"), F.col("_n")) >= least) | (T.coverage(F.col("_n"), F.col("_s")) >= least)).select(group, "_s").distinct()
    left = own.join(near, [group, "_s"], "left_anti").withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("no")))
    return left.filter(F.col("place") <= most).select(group, "no", "place")
