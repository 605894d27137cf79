"""Checks of what texts claim against the facts of their tender: numbers, names and superlatives that no fact holds.

Numbers meet facts by an anti-join on cents. Names and superlatives are looked for by automata that are built from a tender's facts where its texts
are: the facts of a tender are one row, which joins all its texts, so the texts of a large tender may lie in many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Superlatives that need a fact, by language; capitalised words that name nobody.
SUPERLATIVES = {
    "en": ("best", "leader", "number one", "#1", "top", "one of a kind", "only provider", "guaranteed", "award-winning", "premier", "leading", "unmatched", "unrivalled"),
    "fr": ("meilleur", "leader", "numéro un", "n°1", "premier acteur", "premier fournisseur", "seul acteur", "unique en son genre", "inégalé", "sans égal", "garanti", "primé", "excellence"),
}
COMMON = frozenset(
    "synthèse compréhension solution conformité prochaines étapes notre équipe avantage atelier plan démarrage projet service entreprise client besoin réponse preuve "
    "summary understanding compliance next steps our team advantage workshop start project company need response evidence fill to todo tbd".split()
)
#: Endings that a superlative may have.
ENDINGS = ("", "e", "s", "es")
#: What is still to be written is no claim.
TO_FILL = re.compile(r"\[to fill:[^\]]*\]", re.I)
_CAPITALISED = re.compile(r"(?<![\w'’-])[^\W\d_a-zà-ÿ][\w'’-]*(?: [^\W\d_a-zà-ÿ][\w'’-]*)*")
_NUMBER = r"(?<![\w.,])(\d+(?:[   .]\d{3})*(?:[.,]\d+)?)(?: ?(k|M)(?:€|EUR))?"


def numbers(text: Column) -> Column:
    """Numbers of a text: groups of three digits may be set apart, a comma is a decimal sign, thousands and millions of euros are spelled out."""
    def value(found: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(found, _NUMBER, 1), r"[   ]", "")
        plain = F.when(F.contains(digits, F.lit(",")), F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.regexp_replace(digits, r"\.(?=\d{3}\.)|(?<=\.\d{3})\.", ""))
        unit = F.regexp_extract(found, _NUMBER, 2)
        return plain.try_cast("double") * F.when(unit == "k", 1e3).when(unit == "M", 1e6).otherwise(1.0)

    return F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), 0), value)))


def unknown_numbers(texts: DataFrame, facts: DataFrame, tender: str) -> DataFrame:
    """(tender, path, found) of numbers that are not within a hundredth of a number of the tender's facts (tender, number)."""
    cents = lambda c: F.floor(F.col(c) * 100).cast("long")
    said = texts.select(tender, "path", F.explode(numbers(F.col("text"))).alias("n")).withColumn("_c", cents("n"))
    held = facts.filter("number is not null").select(F.col(tender).alias("_t"), F.col("number").cast("double").alias("_n"))
    held = held.withColumn("_k", cents("_n")).select("_t", "_n", F.explode(F.array(F.col("_k") - 1, F.col("_k"), F.col("_k") + 1)).alias("_k"))
    same = (F.col(tender) == F.col("_t")) & (F.col("_c") == F.col("_k")) & (F.abs(F.col("n") - F.col("_n")) < 0.01)
    return said.join(held, same, "left_anti").select(tender, "path", F.col("n").cast("string").alias("found"))


def automaton(words) -> ahocorasick.Automaton | None:
    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, w)
    if not len(out):
        return None
    out.make_automaton()
    return out


@lru_cache
def _superlatives(language: str) -> ahocorasick.Automaton:
    return automaton(SUPERLATIVES.get(language, SUPERLATIVES["fr"]))


def superlatives(text: str, language: str) -> set[str]:
    """Superlatives that stand in a lower-case text as whole words, endings aside."""
    out = set()
    for end, word in _superlatives(language).iter(text):
        rest = re.match(r"\w*", text[end + 1 :])[0]
        if rest in ENDINGS and not re.match(r"\w", text[end - len(word) : end - len(word) + 1] if end >= len(word) else ""):
            out.add(word)
    return out


def named(text: str) -> list[str]:
    """Runs of capitalised words: of two or more, or of one of four letters or more that doesn't begin a sentence."""
    out = []
    for m in _CAPITALISED.finditer(text):
        opens = re.search(r"(^|[.!?:;\n]\s*|[-•]\s)$", text[: m.start()]) is not None
        words = m[0].split(" ")
        if len(words) > 1 or (len(m[0]) >= 4 and not opens):
            if not all(w.lower() in COMMON for w in words):
                out.append(m[0])
    return out


class Facts:
    """Automata over the names and claims of one tender."""

    def __init__(self, names: tuple[str, ...], claims: tuple[str, ...]):
        self.names = sorted({n.lower() for n in names if n})
        self.all = "\n".join(self.names)
        self.known, self.long = automaton(self.names), automaton(n for n in self.names if len(n) > 3)
        self.claims = tuple(c.lower() for c in claims)

    def unknown(self, text: str) -> list[str]:
        """Names of a text that hold no name of the facts and that none of them holds."""
        found = [n for n in named(TO_FILL.sub(" ", text)) if n.lower() not in self.all]
        return [n for n in found if self.known is None or next(self.known.iter(n.lower()), None) is None]

    def unsupported(self, text: str, language: str) -> list[str]:
        """Superlatives of a text, its names aside, that no claim of the facts makes."""
        lower = list(text.lower())
        if self.long is not None:
            for end, name in self.long.iter(text.lower()):
                lower[end - len(name) + 1 : end + 1] = " " * len(name)
        said = superlatives("".join(lower), language)
        return sorted(said - {s for c in self.claims for s in superlatives(c, language)})


def unknown_words(texts: DataFrame, facts: DataFrame, tender: str) -> DataFrame:
    """(tender, path, kind, found) of names and superlatives (kind name, claim) of texts (tender, path, language, text) without a fact (tender, name, claim)."""
    lists = [F.array_sort(F.collect_set(c)).alias(f"_{c}s") for c in ("name", "claim")]
    held = facts.groupBy(F.col(tender).alias("_t")).agg(*lists)
    kind = dict(texts.dtypes)[tender]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = lru_cache(256)(Facts)
        for frame in frames:
            rows = []
            for one, path, language, text, names, claims in frame.itertuples(index=False):
                own = made(tuple(names) if names is not None else (), tuple(claims) if claims is not None else ())
                rows += [(one, path, "name", x) for x in dict.fromkeys(own.unknown(text))] + [(one, path, "claim", x) for x in own.unsupported(text, language)]
            yield pd.DataFrame(rows, columns=[tender, "path", "kind", "found"]).astype({tender: frame[tender].dtype})

    both = texts.filter("text is not null").join(held, F.col(tender) == F.col("_t"), "left").select(tender, "path", "language", "text", "_names", "_claims")
    return both.mapInPandas(run, f"{tender} {kind}, path string, kind string, found string")


def violations(texts: DataFrame, facts: DataFrame, tender: str) -> DataFrame:
    """(tender, path, kind, found) of everything that texts claim and facts (tender, number, name, claim) don't hold."""
    return unknown_numbers(texts, facts, tender).select(tender, "path", F.lit("number").alias("kind"), "found").unionByName(unknown_words(texts, facts, tender))
