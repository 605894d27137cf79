"""Decisions: rule matching, status, fit, recommendation, gaps, risks and the smallest team."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import sorted_groups


def rule_match(needs: DataFrame, held: DataFrame, need_id: str, doc_id: str, item: str, all_of: str) -> DataFrame:
    """(need_id, doc_id, matched, wanted, qualified): documents that hold any, or where `all_of` is true all, of a need's items.
    Needs and documents meet by item, not by a cross join; a need without items matches nothing."""
    wanted = needs.groupBy(need_id).agg(F.count_distinct(item).alias("wanted"), F.bool_or(all_of).alias("_all"))
    hits = needs.select(need_id, item).distinct().join(held.select(doc_id, item).distinct(), item).groupBy(need_id, doc_id).agg(F.count("*").alias("matched"))
    out = hits.join(wanted, need_id)
    return out.withColumn("qualified", F.when(F.col("_all"), F.col("matched") == F.col("wanted")).otherwise(F.col("matched") > 0)).drop("_all")


def groups_met(groups: Column, held: Column) -> Column:
    """One certificate of every group is held."""
    return F.forall(groups, lambda g: F.arrays_overlap(g, held))


def with_equivalents(asked: Column, equivalent: dict[str, str]) -> Column:
    """Each asked certificate beside what may stand for it."""
    pairs = F.create_map(*[F.lit(x) for kv in equivalent.items() for x in kv])
    return F.transform(asked, lambda c: F.array_compact(F.array(c, F.try_element_at(pairs, c))))


def status(qualified: Column, equivalent: Column, needed: Column) -> Column:
    """Equivalents fill up to partial only."""
    return F.when((qualified + equivalent >= needed) & (qualified >= needed), "covered").when(qualified + equivalent > 0, "partial").otherwise("missing")


def percent(qualified: Column, equivalent: Column, needed: Column) -> Column:
    return 100 * F.least(qualified + 0.5 * equivalent, needed) / needed


def logit_percent(score: Column) -> Column:
    """Linear from -8 (0) to 0 (100)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (score + 8) / 8))


def fit_score(rows: DataFrame, tender: str, category: str) -> DataFrame:
    """Weighted means (optional rows at half weight), halves to even, for each category and their mean over the categories present."""
    w = F.when(F.col("mandatory"), 1.0).otherwise(0.5)
    by = rows.groupBy(tender, category).agg(F.bround(F.sum(F.col("percent") * w) / F.sum(w)).alias("fit"))
    return by.groupBy(tender).agg(F.bround(F.avg("fit")).cast("long").alias("overall"), F.count("*").alias("categories"), F.min("fit").cast("long").alias("weakest"))


def recommendation(rows: DataFrame, tender: str) -> DataFrame:
    """First rule that holds: nothing open, bid; a mandatory technical gap and under half of the technical rows covered, no bid; gaps but no
    technical one, bid with a partner; else review."""
    gap, tech = F.col("status") == "missing", F.col("category") == "technical"
    stats = rows.groupBy(tender).agg(
        F.count_if(gap).alias("gaps"), F.count_if(F.col("status") == "partial").alias("partials"), F.count_if(gap & tech & F.col("mandatory")).alias("hard_gaps"), F.count_if(gap & tech).alias("tech_gaps"),
        F.avg(F.when(tech, F.when(F.col("status") == "covered", 1.0).when(F.col("status") == "partial", 0.5).otherwise(0.0))).alias("tech"),
    )
    out = F.when((F.col("gaps") == 0) & (F.col("partials") == 0), "bid").when((F.col("hard_gaps") > 0) & (F.col("tech") < 0.5), "no_bid").when((F.col("gaps") > 0) & (F.col("tech_gaps") == 0), "bid_with_partner").otherwise("review")
    return stats.select(tender, "gaps", "partials", out.alias("recommendation"))


def gap_report(rows: DataFrame, tender: str) -> DataFrame:
    """(tender, cause, n): open rows by what is missing."""
    cause = F.when(F.col("category") == "team", "people").when(F.col("category") == "experience", "project").when(F.size("certs") > 0, "certification").when(F.col("found") == 0, "technology").otherwise("evidence")
    return rows.filter("status <> 'covered'").groupBy(tender, cause.alias("cause")).agg(F.count("*").alias("n"))


def risks(rows: DataFrame, tender: str) -> DataFrame:
    """Risk codes of each tender in a fixed order."""
    flags = {"mandatory_gap": F.bool_or((F.col("status") == "missing") & F.col("mandatory")), "many_partials": F.count_if(F.col("status") == "partial") > 2, "no_team": F.count_if(F.col("category") == "team") == 0}
    return rows.groupBy(tender).agg(F.array_join(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in flags.items()])), ",").alias("risks"))


def _clusters(roles: dict[str, tuple[int, frozenset]]) -> list[dict[str, tuple[int, frozenset]]]:
    """Roles split so that no person can serve two of the parts."""
    parts: list[dict[str, tuple[int, frozenset]]] = []
    for name, (open_, able) in roles.items():
        linked = [p for p in parts if any(able & other for _, other in p.values())]
        parts = [p for p in parts if p not in linked] + [{k: v for p in linked for k, v in p.items()} | {name: (open_, able)}]
    return parts


def _cover(roles: dict[str, tuple[int, frozenset]], order: dict, most: int) -> tuple[list, bool]:
    """Persons that fill the open places of every role, and whether none fewer do. Persons are taken up one by one; of all choices that
    leave the same places open the smallest, then the best ranked, is kept, so there are no more states than ways to leave places open. Where these
    exceed `most`, persons who fill most open places are taken instead."""
    names = sorted(roles)
    people = sorted({p for _, able in roles.values() for p in able}, key=order.__getitem__)
    serves = {p: tuple(p in roles[n][1] for n in names) for p in people}
    start = tuple(roles[n][0] for n in names)
    states: dict[tuple, tuple] = {start: ()}
    better = lambda team: (len(team), sum(order[p][0] for p in team), team)
    for k, p in enumerate(people):
        later = [sum(serves[q][r] for q in people[k + 1 :]) for r in range(len(names))]
        for left, team in list(states.items()):
            after = tuple(max(0, n - s) for n, s in zip(left, serves[p], strict=True))
            if after != left and (after not in states or better((*team, p)) < better(states[after])):
                states[after] = (*team, p)
        states = {left: team for left, team in states.items() if all(n <= m for n, m in zip(left, later, strict=True))}
        if len(states) > most:
            break
    else:
        return list(states[tuple(0 for _ in names)]), True
    team, left = [], list(start)
    while any(left):
        pick = min((p for p in people if p not in team), key=lambda p: (-sum(s and n > 0 for s, n in zip(serves[p], left, strict=True)), order[p]))
        team.append(pick)
        left = [max(0, n - s) for n, s in zip(left, serves[pick], strict=True)]
    return team, False


def smallest_team(slots: DataFrame, tender: str, most: int = 200_000) -> DataFrame:
    """slots: (tender, role, person, rank, needed). The fewest persons that fill every role, each as far as it has candidates; `exact` is false
    where a part of the problem exceeds `most` states (it is NP-hard; its input is one tender's candidates). Of equal teams the one with the least sum of
    best ranks is taken, then the first in order. Roles without a choice fix their persons; the rest falls into parts that share no person."""

    def solve(key: int, rows: list[tuple]) -> list[tuple]:
        order: dict = {}
        able: dict[str, set] = {}
        needed: dict[str, int] = {}
        for role, person, rank, n in rows:
            if role is None or person is None:
                continue
            rank = math.inf if rank is None else rank
            order[person] = (min(rank, order.get(person, (rank,))[0]), person)
            able.setdefault(role, set()).add(person)
            needed.setdefault(role, n)
        places = {role: min(int(needed[role]), len(able[role])) for role in sorted(able)}
        team = {p for role, n in places.items() if n == len(able[role]) for p in able[role]}
        roles = {role: (n - len(able[role] & team), frozenset(able[role] - team)) for role, n in places.items() if n > len(able[role] & team)}
        exact = True
        for part in _clusters(roles):
            chosen, whole = _cover(part, order, most)
            team, exact = team | set(chosen), exact and whole
        return [(key, len(team), ",".join(map(str, sorted(team))), exact)]

    rows = slots.select(tender, "role", "person", "rank", "needed")
    return sorted_groups(rows, tender, [F.col("role"), F.col("person")], solve, f"{tender} long, size long, team string, exact boolean")


def proof(evidence: DataFrame, need: str, most: Column) -> DataFrame:
    """Real evidence before demo, then by score; `proves` only where real."""
    w = Window.partitionBy(need).orderBy(F.col("demo").asc(), F.desc("score"), "doc_id")
    return evidence.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).withColumn("proves", ~F.col("demo")).drop("_r")
