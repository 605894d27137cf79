"""Records: visibility, validation, search, links, names against a vocabulary, and statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.session import small


def visible(records: DataFrame, index: DataFrame, mode: str) -> DataFrame:
    """Records of the mode's origin (demo, else user_entered) whose status is indexed and whose digest is the one in the index (id, digest)."""
    own = records.filter((F.col("origin") == ("demo" if mode == "demo" else "user_entered")) & (F.col("status") == "indexed"))
    return own.join(index.select("id", "digest"), ["id", "digest"], "left_semi")


def routed(needs: DataFrame, types: dict[str, list[str]]) -> DataFrame:
    """needs (category, text, sectors) with the document types that may answer, one row each; experience that names projects or a sector is answered by past projects only."""
    names_projects = T.normalize("text").rlike(r"\b(projects?|projets?|deliveries|realisations?)\b") | (F.size("sectors") > 0)
    by_category = F.create_map(*[x for k, v in types.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    allowed = F.when((F.col("category") == "experience") & names_projects, F.array(F.lit("past_project"))).otherwise(F.try_element_at(by_category, F.col("category")))
    return needs.withColumn("doc_type", F.explode(allowed))


def searched(rows: DataFrame, columns: list[str], asked: str) -> DataFrame:
    """Rows whose columns, one after the other, hold the text asked for, in any case."""
    return rows.filter(F.lower(F.concat_ws(" ", *columns)).contains(asked.strip().lower()))


def errors(records: DataFrame, required: list[str], links: str, budget: str, currency: str) -> DataFrame:
    """id and a map of field to error: empty required fields, a budget without currency, links to unknown ids, and a second record of the same
    (type, title). Links meet ids by a join, one row a link."""
    again = records.select("id", F.count("*").over(Window.partitionBy("type", T.normalize("title"))).alias("_same"))
    dangling = records.select("id", F.explode(links).alias("_link")).join(records.select(F.col("id").alias("_link")), "_link", "left_anti").select("id").distinct().withColumn("_dangling", F.lit(True))
    found = records.join(again, "id").join(dangling, "id", "left")
    checks = {c: F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", "required") for c in required}
    checks[currency] = F.when(F.col(budget).isNotNull() & F.col(currency).isNull(), "currency is missing")
    checks[links] = F.when(F.col("_dangling"), "unknown link")
    checks["title"] = F.coalesce(checks["title"], F.when(F.col("_same") > 1, "duplicate")) if "title" in checks else F.when(F.col("_same") > 1, "duplicate")
    every = F.map_from_arrays(F.array(*map(F.lit, checks)), F.array(*checks.values()))
    return found.select("id", F.map_filter(every, lambda k, v: v.isNotNull()).alias("errors"))


def members_projects(projects: DataFrame, project: str, members: str) -> DataFrame:
    """Each member of a project's team with its projects in order."""
    return projects.select(F.explode(members).alias("member"), project).groupBy("member").agg(F.sort_array(F.collect_set(project)).alias("projects"))


# names against a vocabulary
def tagged(texts: DataFrame, aliases: DataFrame, key: str, text: str, longest: int = 4) -> DataFrame:
    """(key, name) of the vocabulary names that a text holds. aliases: (alias, name), an alias of at most `longest` words. Runs of the text's words meet
    aliases by an equi-join, so the vocabulary may be of any size; an alias stands between characters other than letters and digits."""
    words = F.array_remove(F.split(F.regexp_replace(T.normalize(text), r"[^a-z0-9+#]+", " "), " "), "")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))).otherwise(F.array().cast("array<string>"))))
    long = texts.select(key, words.alias("_w")).select(key, F.explode(F.array_distinct(runs)).alias("_run"))
    names = aliases.select(F.trim(F.regexp_replace(T.normalize("alias"), r"[^a-z0-9+#]+", " ")).alias("_run"), "name").distinct()
    return long.join(small(names, 200_000), "_run").select(key, "name").distinct()


def closure(implies: DataFrame, most: int = 16) -> DataFrame:
    """(name, implied) for every chain of (name, implied) pairs, in rounds that end when nothing is new; a vocabulary's chains are short."""
    pairs = implies.select("name", "implied").distinct()
    known, fresh = pairs, pairs
    for _ in range(most):
        fresh = fresh.alias("a").join(pairs.alias("b"), F.col("a.implied") == F.col("b.name")).select(F.col("a.name").alias("name"), F.col("b.implied").alias("implied")).distinct()
        fresh = fresh.join(known, ["name", "implied"], "left_anti")
        if not fresh.head(1):
            break
        known = known.unionByName(fresh)
    return known


def word_forms(word: Column) -> Column:
    """A word with its plural and -ing and -ed forms; only suffixes are added."""
    plain = F.regexp_replace(word, r"^[./-]+|[./-]+$", "")
    stem = F.substring(plain, F.lit(1), F.length(plain) - 1)
    more = F.array(F.when(plain.endswith("e"), F.concat(stem, F.lit("ing"))), F.when(plain.endswith("y") & (F.length(plain) > 2), F.concat(stem, F.lit("ies"))), F.when(plain.endswith("y") & (F.length(plain) > 2), F.concat(stem, F.lit("ied"))))
    return F.array_distinct(F.concat(F.transform(F.array(*map(F.lit, ("", "s", "es", "ing", "ed", "d"))), lambda s: F.concat(plain, s)), F.array_compact(more)))


def leftover(words: Column, known: Column, generic: Column) -> Column:
    """Words of more than one character that neither the known names nor the generic words explain; repeats stay."""
    return F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(known, w) & ~F.array_contains(generic, w))


def support(words: Column, text_words: Column) -> Column:
    """Share of the words that a text's words hold, by word forms to both sides of a plain plural; 1 where there is none to check."""
    there = F.filter(words, lambda w: F.arrays_overlap(word_forms(w), text_words))
    return F.when(F.size(words) == 0, F.lit(1.0)).otherwise(F.size(there) / F.size(words))


def names_line(terms: Column, left: Column, line_words: Column) -> Column:
    """A line names a requirement by a known term, or by more than half of the words left over; one with neither is named by every line."""
    by_term = F.arrays_overlap(terms, line_words)
    by_words = F.size(F.filter(left, lambda w: F.arrays_overlap(word_forms(w), line_words))) * 2 > F.size(left)
    return ((F.size(terms) == 0) & (F.size(left) == 0)) | by_term | ((F.size(left) > 0) & by_words)


def unknown_names(words: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """(key, word) of words that look like a product's name: a digit or sign, a capital inside or at the start, or never written in lower case in the corpus (word)."""
    looks = F.col("word").rlike(r"[0-9+#]|[A-Z]")
    plain = words.filter(~looks).join(corpus.select("word"), "word", "left_anti")
    return words.filter(looks).select(key, "word").unionByName(plain.select(key, "word")).distinct()


def translated(text: Column, glossary: dict[str, str]) -> Column:
    """Glossary words replaced, longest first, between characters other than letters and digits."""
    for word in sorted(glossary, key=lambda w: (-len(w), w)):
        text = F.regexp_replace(text, rf"(?<![a-z0-9]){word}(?![a-z0-9])", glossary[word])
    return text


def statements(fields: dict[str, str]) -> Column:
    """Labelled lines of a record's filled fields, in order."""
    return F.array_compact(F.array(*[F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))) for label, c in fields.items()]))


def shortened(items: Column, most: int, size: int) -> Column:
    """At most `most` items of at most `size` characters each."""
    return F.transform(F.slice(items, 1, most), lambda s: F.substring(s, 1, size))
