"""Notices, CVs and deck inputs: criteria, contacts, counts, sections, spans, durations, roles, facts, slide names, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import parsing as P
from quern.functions import text as T
from quern.operators.dates import MONTHS, parse_date

#: Typographic ligatures and their letters.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Roles in the order in which they are shown.
ROLES = ("Backend", "Frontend", "DevOps", "PM", "Designer", "QA")

#: Fixed values, in the order in which roles are asked for: role, its words, and what names it within a word or over several.
ROLE_WORDS = (
    ("PM", ("pmp",), ("project manager", "chef de projet", "scrum master")),
    ("Designer", ("ux", "designer"), ()),
    ("DevOps", (), ("devops", "sre", "cloud engineer", "kubernetes")),
    ("QA", ("qa",), ("test engineer", "testeur", "quality")),
    ("Backend", (), ("backend", "back-end", "java", "spring")),
    ("Frontend", (), ("front", "react", "angular", "vue", "mobile", "full-stack", "fullstack")),
)
#: Words between the years of a span, and for its open end, folded.
JOINERS = ("-", "–", "—", "to", "a", "au")
NOW = ("present", "current", "now", "today", "ongoing", "aujourd'hui", "actuel", "en cours")
#: Results of a test.
RESULTS = ("PASSED", "FAILED", "ERROR", "SKIPPED")


def criteria(text: str) -> Column:
    """(name, weight) of the lines of a text that give a weight of at most 100: in brackets, or after a colon or dash, with a unit."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"[\n;]"), F.trim), lambda s: s != "")
    bracket, after = r"^(\S.{0,80}?)\s*\(\s*(\d{1,3}(?:[.,]\d+)?)\s*(?:%|points?|pts?)\s*\)", r"^(\S.{0,80}?)\s*(?::|\s[-–—])\s*(\d{1,3}(?:[.,]\d+)?)\s*(?:%|points?|pts?)"

    def read(s: Column) -> Column:
        name = lambda p: F.regexp_extract(s, p, 1)
        weight = lambda p: F.replace(F.regexp_extract(s, p, 2), F.lit(","), F.lit(".")).try_cast("double")
        return F.when(name(bracket) != "", F.struct(name(bracket).alias("name"), weight(bracket).alias("weight"))).when(name(after) != "", F.struct(name(after).alias("name"), weight(after).alias("weight")))

    return F.filter(F.transform(lines, read), lambda c: c.isNotNull() & (c["weight"] <= 100))


def contact(blocks: DataFrame, group: str, buyer: str, name: str) -> DataFrame:
    """Of each group the contact block whose name is most like the buyer's, at a similarity of a half or more, or the only block; ties to the first."""
    sim = T.overlap_coefficient(T.toks(name), T.toks(buyer))
    order = Window.partitionBy(group).orderBy(F.desc("_sim"), "row")
    ranked = blocks.withColumn("_sim", sim).withColumns({"_k": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy(group))})
    return ranked.filter((F.col("_k") == 1) & ((F.col("_sim") >= 0.5) | (F.col("_n") == 1))).drop("_sim", "_k", "_n")


def required_count(text: str) -> Column:
    """The number of a requirement: after minimum or at least, before a plus sign, or at its start; else 1."""
    t = T.normalize(text)
    first = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit("")).try_cast("int")
    return F.coalesce(first(r"(?:minimum|at least|au moins|min\.?)\s*(\d+)"), first(r"(\d+)\s*\+"), first(r"^\s*(\d+)\s+\w"), F.lit(1))


def sections(texts: DataFrame, key: str, text: str, headings: dict[str, list[str]]) -> DataFrame:
    """(key, section, line_no, line): lines below a line that is a heading, up to the next one; what stands before the first has the section `top`."""
    names = F.create_map(*[x for section, said in headings.items() for h in said for x in (F.lit(h), F.lit(section))])
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    lines = lines.withColumn("_head", F.try_element_at(names, F.trim(F.regexp_replace(T.fold("line"), r"\s+", " "))))
    here = F.last("_head", ignorenulls=True).over(Window.partitionBy(key).orderBy("line_no"))
    return lines.withColumn("section", F.coalesce(here, F.lit("top"))).filter("_head is null").select(key, "section", "line_no", "line")


def field(text: str, *names: str) -> Column:
    """What follows the first of these names and a colon at the start of a line; empty where there is none."""
    out = F.lit("")
    for name in reversed(names):
        found = F.trim(F.regexp_extract(text, rf"(?im)^\s*{name}\s*:\s*(.+)$", 1))
        out = F.when(found != "", found).otherwise(out)
    return out


def unligated(text: Column) -> Column:
    for sign, letters in LIGATURES.items():
        text = F.replace(text, F.lit(sign), F.lit(letters))
    return text


def job_span(line: str, this_month: int) -> Column:
    """(first, last) month of the first span of years in a line, as year times twelve and month; null where there is none or it runs backwards. A span is, token by
    token, a year, a joiner, and a year or a word for now; a word before a year is its month if it names one. Without months a span has
    whole years; it ends this month at the latest."""
    months = F.create_map(*[F.lit(v) for kv in MONTHS.items() for v in kv])
    tokens = F.split(F.regexp_replace(T.normalize(line), r"([\u2013\u2014-])|[\s.]+", " $1 "), " +")

    def spans(t: Column) -> Column:
        at = lambda k: F.coalesce(F.get(t, k), F.lit(""))
        year = lambda k: F.when((F.length(at(k)) == 4) & F.substring(at(k), 1, 2).isin("19", "20"), at(k).try_cast("int"))
        month = lambda k, default: F.coalesce(F.try_element_at(months, at(k)), F.lit(default))

        def span(k: Column) -> Column:
            now = at(k + 2).isin(*NOW) | F.concat_ws(" ", at(k + 2), at(k + 3)).isin(*NOW)
            end = F.when(now, this_month).when(year(k + 2).isNotNull(), year(k + 2) * 12 + 12).otherwise(year(k + 3) * 12 + month(k + 2, 12))
            return F.when(at(k + 1).isin(*JOINERS), F.struct((year(k) * 12 + month(k - 1, 1)).alias("first"), F.least(end, F.when(end.isNotNull(), this_month)).cast("int").alias("last")))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(t) - 1), span), lambda x: x["first"].isNotNull() & x["last"].isNotNull())

    first = F.get(F.transform(F.array(tokens), spans)[0], F.lit(0))  # tokens are bound once
    return F.when(first["last"] >= first["first"], first)


def months_of(text: str) -> Column:
    """A duration in days, weeks, months or years, as months."""
    pattern = r"(\d+(?:[.,]\d+)?)\s*(day|jour|week|semaine|month|mois|year|an)"
    n = F.replace(F.regexp_extract(T.normalize(text), pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
    unit = F.regexp_extract(T.normalize(text), pattern, 2)
    return n * F.when(unit.isin("day", "jour"), 12 / 365).when(unit.isin("week", "semaine"), 84 / 365).when(unit.isin("month", "mois"), 1.0).when(unit.isin("year", "an"), 12.0)


def role(text: Column) -> Column:
    """The first role of the table of which a text has a word as its own, or a part anywhere."""
    lower = F.lower(text)
    tokens = F.split(lower, r"\W+")
    out = F.lit(None).cast("string")
    for name, words, inside in reversed(ROLE_WORDS):
        named = F.lit(False)
        for part in inside:
            named = named | F.contains(lower, F.lit(part))
        if words:
            named = named | F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
        out = F.when(named, name).otherwise(out)
    return out


def role_counts(people: DataFrame, group: str, text: str) -> DataFrame:
    """Number of people of each role that someone has, with the role's place in the fixed order."""
    named = people.select(group, role(F.col(text)).alias("role")).filter("role is not null")
    place = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    return named.groupBy(group, "role").agg(F.count("*").alias("n")).withColumn("place", place)


def diagram_facts(projects: DataFrame, group: str, stack: str, months: str, most: int = 10) -> DataFrame:
    """Of each group's similar projects the first distinct technologies, in the order of row and place, and the mean of the durations given, else six months."""
    long = projects.select(group, "row", F.posexplode_outer(stack).alias("_i", "_tech"))
    once = long.filter("_tech is not null").groupBy(group, "_tech").agg(F.min(F.struct("row", "_i")).alias("_at"))
    ranked = once.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("_at"))).filter(F.col("_k") <= most)
    techs = ranked.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_tech"))), lambda x: x["_tech"]).alias("technologies"))
    mean = projects.groupBy(group).agg(F.coalesce(F.floor(F.avg(F.when(F.col(months) > 0, F.col(months))) + 0.5).cast("long"), F.lit(6)).alias("months"))
    return mean.join(techs, group, "left").withColumn("technologies", F.coalesce("technologies", F.array().cast("array<string>")))


def checked_days(rows: DataFrame, catalogue: DataFrame, key: str, days: str) -> DataFrame:
    """Budget lines with their fault: a key that the catalogue lacks, a number of days that isn't whole and positive, or a key given twice; null where fine."""
    known = catalogue.select(F.col(key).alias("_key")).distinct()
    out = rows.join(known, F.col(key) == F.col("_key"), "left").withColumn("_n", F.count("*").over(Window.partitionBy(*[c for c in ("budget", key) if c in rows.columns])))
    whole = (F.col(days) > 0) & (F.col(days) == F.floor(days))
    return out.withColumn("fault", F.when(F.col("_key").isNull(), "unknown key").when(~F.coalesce(whole, F.lit(False)), "bad days").when(F.col("_n") > 1, "twice")).drop("_key", "_n")


def slide_of(titles: DataFrame, slides: DataFrame, deck: str, title: str) -> DataFrame:
    """Which slide of the plan (slide, title) each page of a deck shows: by the first 25 letters of the title in lower case, without a mark `(k/n)`; the first page is the cover
    and the last the end; pages that match none are null."""
    plain = lambda c: F.substring(F.trim(F.lower(F.regexp_replace(c, r"\s*\(\d+/\d+\)\s*$", ""))), 1, 25)
    plan = slides.select("slide", plain(F.col("title")).alias("_key"))
    part = F.nullif(F.regexp_extract(title, r"\((\d+)/\d+\)\s*$", 1), F.lit("")).try_cast("int")
    ends = F.max("page").over(Window.partitionBy(deck))
    out = titles.withColumns({"_own": plain(F.col(title)), "part": part, "_last": ends}).join(F.broadcast(plan), F.col("_own") == F.col("_key"), "left")  # a plan has some tens of slides
    return out.withColumn("slide", F.when(F.col("page") == 1, "cover").when(F.col("page") == F.col("_last"), "end").otherwise(F.col("slide"))).drop("_own", "_key", "_last")


def test_report(output: DataFrame, key: str, text: str) -> DataFrame:
    """(key, test, result) of the lines of a test run's output: a path below tests, two colons and a name, then a status word."""
    lines = output.select(key, F.explode(F.split(text, "\n")).alias("_line"))
    words = lines.withColumn("_words", F.split(F.trim(F.regexp_replace("_line", r"\s+", " ")), " ")).filter(F.startswith(F.get("_words", F.lit(0)), F.lit("tests/")))
    place = F.filter(F.transform(F.array(*map(F.lit, RESULTS)), lambda r: F.array_position("_words", r)), lambda k: k > 1)
    found = words.withColumn("_at", F.array_min(place).cast("int")).filter("_at is not null")
    whole = F.array_join(F.slice("_words", F.lit(1), F.col("_at") - 1), " ")
    test = F.substring(whole, F.locate("::", whole) + 2, F.length(whole))
    return found.filter((F.locate("::", whole) > 0) & (test != "")).select(key, test.alias("test"), F.get("_words", F.col("_at") - 1).alias("result"))


def section_cut(lines: DataFrame, key: str, unwanted: str) -> DataFrame:
    """Lines (key, no, line) without those under an unwanted heading, up to a heading of the same or a higher level; levels are leading number signs, one to six. For each
    level the last heading of that level or above is found in one ordered pass; a line is cut if for some level that one is of the level and unwanted."""
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    order = Window.partitionBy(key).orderBy("no")
    marks = lines.withColumn("_level", F.when(level > 0, level)).withColumn("_bad", F.coalesce(F.col("_level").isNotNull() & F.lower("line").rlike(unwanted), F.lit(False)))
    under = [F.last(F.when(F.col("_level") <= k, F.col("_bad") & (F.col("_level") == k)), ignorenulls=True).over(order) for k in range(1, 7)]
    cut = F.lit(False)
    for u in under:
        cut = cut | F.coalesce(u, F.lit(False))
    return marks.withColumn("_cut", cut).filter("not _cut").select(key, "no", "line", F.row_number().over(order).alias("place"))


def studio_rows(evidence: DataFrame, group: str) -> DataFrame:
    """Evidence that may be shown: not demo, proving, and CVs only of team members; with it, for each group, how many rows went."""
    fine = ~F.col("demo") & F.col("proves") & ((F.col("kind") != "cv") | F.col("in_team"))
    return evidence.groupBy(group).agg(F.count_if(fine).alias("shown"), F.count_if(~fine).alias("dropped"), F.count_if(F.col("demo")).alias("demo"))


def input_form(raw: Column) -> Column:
    """A simple JSON input with type-checked defaults: title, language (fr or en), score as a share, and counts of known roles above zero."""
    parsed = F.from_json(raw, "title string, language string, score double, team map<string,int>")
    share = F.when(parsed["score"] > 1, parsed["score"] / 100).otherwise(parsed["score"])
    team = F.map_filter(parsed["team"], lambda k, v: k.isin(list(ROLES)) & (v > 0))
    return F.struct(
        F.coalesce(F.nullif(F.trim(parsed["title"]), F.lit("")), F.lit("Untitled")).alias("title"), F.when(parsed["language"] == "en", "en").otherwise("fr").alias("language"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0)))).alias("score"), F.coalesce(F.aggregate(F.map_values(team), F.lit(0), lambda a, v: a + v), F.lit(0)).alias("people"),
    )


def notice(rows: DataFrame, key: str, raw: str, rules: dict[str, str], most: int = 15, without: str | None = None) -> DataFrame:
    """(key, field, values) of structured notices, whatever their layout: each rule names a field and a pattern of its paths; values are distinct, in order. Paths
    that match `without` (lots, which are not the notice's own) are left out."""
    leaves = rows.select(key, F.posexplode(P.json_leaves(raw)).alias("_at", "_leaf")).select(key, "_at", "_leaf.*")
    if without:
        leaves = leaves.filter(~F.col("path").rlike(without))
    named = leaves.select(key, "_at", "value", F.explode(F.array_compact(F.array(*[F.when(F.col("path").rlike(p), F.lit(name)) for name, p in rules.items()]))).alias("field"))
    first = named.groupBy(key, "field", "value").agg(F.min("_at").alias("_at"))
    return first.groupBy(key, "field").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]), 1, most).alias("values"))


def new_deadline(text: str) -> Column:
    """The first date of a correction whose clause is neither about the old deadline nor about another event."""
    clauses = F.split(F.coalesce(F.col(text), F.lit("")), r"[;.\n]+\s*")
    other = r"\b(old|initial|initially|previous|instead of|anciennement|au lieu|visit|visite|opening|ouverture|questions)\b"
    return F.get(F.array_compact(F.transform(F.filter(clauses, lambda c: ~T.fold(c).rlike(other)), parse_date)), F.lit(0))


def date_in(page: Column, day: Column) -> Column:
    """A page says a date: year, month and day, or day, month by number or name and year, in order with only signs between."""
    numbers = {name: [k for k in MONTHS if MONTHS[k] == name] for name in range(1, 13)}
    said = F.create_map(*[x for m, ks in numbers.items() for x in (F.lit(m), F.lit("|".join(ks)))])
    y, m, d = F.year(day).cast("string"), F.month(day), F.dayofmonth(day).cast("string")
    month = F.concat(F.lit("(?:0?"), m.cast("string"), F.lit("|"), F.try_element_at(said, m), F.lit(")"))
    pattern = F.concat(F.lit(r"\b(?:"), y, F.lit(r"\W+"), month, F.lit(r"\W+0?"), d, F.lit(r"|0?"), d, F.lit(r"\W+"), month, F.lit(r"\W+"), y, F.lit(r")\b"))
    return F.regexp_like(T.fold(page), pattern)


def verified_requirements(rows: DataFrame, group: str) -> DataFrame:
    """rows: (group, no, text, quote, page): requirements whose quote stands in the page and whose own numbers the quote holds, once for each folded text of a group."""
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(r"(\d+)"), 1))
    fine = P.quote_in_text(T.fold("quote"), T.fold("page")) & (F.size(F.array_except(numbers("text"), numbers("quote"))) == 0)
    first = F.row_number().over(Window.partitionBy(group, T.fold("text")).orderBy("no"))
    return rows.withColumn("_ok", fine).filter("_ok").withColumn("_k", first).filter("_k = 1").select(group, "no")


def unwrapped(lines: DataFrame, key: str) -> DataFrame:
    """Lines (key, no, line) joined to paragraphs: a line goes on where the one before is at least four fifths of the 90th percentile of the text's line lengths and ends no sentence."""
    width = lines.groupBy(key).agg(F.percentile(F.length("line"), F.lit(0.9)).alias("_width"))
    order = Window.partitionBy(key).orderBy("no")
    before = F.lag("line").over(order)
    wide = lines.join(width, key)
    new = F.coalesce(before.isNull() | (F.length(before) < 0.8 * F.col("_width")) | before.rlike(r"[.!?:]\s*$"), F.lit(True))
    numbered = wide.withColumn("_new", new.cast("int")).withColumn("paragraph", F.sum("_new").over(order))
    return numbered.groupBy(key, "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), " ").alias("text"))


def reviewed(slides: DataFrame, needs: DataFrame, prices: DataFrame, deck: str, language: str) -> DataFrame:
    """(deck, finding, n) of decks: requirements (deck, word) that no slide says, slides in another language, and decks whose priced lines (deck, amount, total) don't add up to a total."""
    said = slides.select(deck, F.explode(F.array_distinct(F.split(T.fold("text"), " "))).alias("word"))
    missing = needs.join(said, [deck, "word"], "left_anti").groupBy(deck).agg(F.count("*").alias("n")).select(deck, F.lit("requirement not said").alias("finding"), "n")
    other = slides.filter(F.col("lang") != language).groupBy(deck).agg(F.count("*").alias("n")).select(deck, F.lit("language").alias("finding"), "n")
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    off = prices.groupBy(deck).agg(F.sum(cents("amount")).alias("_sum"), F.max(cents("total")).alias("_total")).filter("_sum <> _total").select(deck, F.lit("total").alias("finding"), F.lit(1).cast("long").alias("n"))
    return missing.unionByName(other).unionByName(off)
