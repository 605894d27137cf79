"""Quality rules: base rules, then robust multivariate outliers by minimum-covariance-determinant estimates. DataFrame functions only.

Statistics of each text are turned into four features: log of the mean word length, and the arcsine square roots of the
shares of symbols, repeated lines and repeated words. Texts that pass the base rules are grouped by language and source.
A pair of fewer than LEAST texts is judged by the estimate of all texts of its language, and one whose language has fewer by
that of all texts, however few they are; judged_by says so. For each group, concentration steps start at three estimates
(medians and absolute deviations, all texts, all texts drawn in to their medians) and keep the HALF of the texts nearest by
Mahalanobis distance, with the mean and covariance of which the next step goes on as long as the determinant falls. The
result with the least determinant, with the consistency factor and a floor for each feature, is the estimate. Texts whose squared
distance is over CUT are rejected. Every text that passes the base rules is judged.

Medians and the nearest share come from counts in fine bins, so a group of any size costs a few hundred rows, and texts
that tie at the edge of the nearest share are all in it.

A null text has no words and fails the base rules; null languages and sources are groups of their own; rows are judged one by
one, so repeated rows, and null ids, get their own verdict; a text of any length is one row, read whole; columns of any name
beside doc_id, text, lang and source are kept aside; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common
from quern.llm.common import let

LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = r"[#*$%&|<>]+"
FEATURES = ("f0", "f1", "f2", "f3")
#: Least deviation of each feature that counts as one; texts from which a group has an estimate of its own; share kept by the concentration steps, after how many they end in any case, by how much the logarithm of the determinant must fall for another, and the factor that makes that share's covariance consistent for four normal features; squared distance of the 1 - 1e-4 quantile of chi-square with four degrees.
FLOORS, LEAST, HALF, STEPS, FALL, CONSISTENT, CUT = (0.04, 0.05, 0.2, 0.12), 40, 0.75, 30, 1e-4, 1.486, 23.51
#: Bins a unit of a feature, and of the logarithm of a distance; rows up to which estimates are broadcast.
FINE, COARSE, SENT = 256, 64, 20_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, common.GAP), "")


def repeated_words(found: Column) -> Column:
    """Words in three-word windows that occur twice or more in the text, the first time included."""
    last = {"prev": F.lit(-3), "total": F.lit(0)}

    def covered(places: Column) -> Column:
        start = F.struct(*[v.alias(k) for k, v in last.items()])
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("prev"), (a["total"] + F.least(F.lit(3), p - a["prev"])).alias("total")), lambda a: a["total"])

    def by_sorting(hashes: Column) -> Column:
        """Places of repeated windows, from windows sorted with their places."""
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def places(hashes: Column) -> Column:
        twice = let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda h, j: (j > 0) & (F.get(s, j - 1) == h))))
        indices = F.sequence(F.lit(0), F.size(hashes) - 1)
        return let(twice, lambda d: F.when(F.size(d) <= 48, F.filter(indices, lambda i: F.array_contains(d, F.get(hashes, i)))).otherwise(by_sorting(hashes)))

    def counted(ws: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
        return F.when(F.size(ws) < 3, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(places(h)))))

    return let(found, counted)


def statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(common.WORD))
    out = docs.withColumns({"_words": words(text), "_lines": lines})
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.regexp_replace(text, common.GAP, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
    }).drop("_words", "_lines")
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def features(stats: DataFrame) -> DataFrame:
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))))
    mean = F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1)))
    return stats.withColumns({"f0": mean, "f1": share("n_symbols", "word_chars"), "f2": share("n_dup_lines", "n_lines"), "f3": share("n_repeat_words", "n_words")})


def _middle(rows: DataFrame, value, share: float = 0.5) -> DataFrame:
    """For each group and start, the smallest bin with at least `share` of the rows at or below it. value: bin of a row."""
    key = ["part", "start"]
    counts = rows.groupBy(*key, value.alias("bin")).agg(F.count("*").alias("n"))
    up = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_of = Window.partitionBy(*key)
    return counts.select(*key, "bin", F.sum("n").over(up).alias("up"), F.sum("n").over(all_of).alias("n")).filter(F.col("up") >= share * F.col("n")).groupBy(*key).agg(F.min("bin").alias("middle"))


def _named(rows: DataFrame, prefix: str, value) -> DataFrame:
    """The middle of each feature, of one scan."""
    long = rows.select("part", F.posexplode(F.array(*[value(k) for k in range(len(FEATURES))])).alias("k", "bin"))
    counts = long.groupBy("part", "k", "bin").agg(F.count("*").alias("n"))
    up = Window.partitionBy("part", "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select("part", "k", "bin", F.sum("n").over(up).alias("up"), F.sum("n").over(Window.partitionBy("part", "k")).alias("n"))
    low = counts.filter(2 * F.col("up") >= F.col("n")).groupBy("part", "k").agg(F.min("bin").alias("bin"))
    return low.groupBy("part").agg(*[(F.max(F.when(F.col("k") == k, F.col("bin"))) / float(FINE)).alias(f"{prefix}{k}") for k in range(len(FEATURES))])


def _lower(cov) -> dict[str, Column]:
    """Cholesky factor, entry by entry; cov(i, j) is an entry's column."""
    out: dict[str, Column] = {}
    for i in range(len(FEATURES)):
        for j in range(i + 1):
            rest = cov(i, j)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out[f"l{i}{j}"] = F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2))) if i == j else rest / F.col(f"l{j}{j}")
    return out


def _with(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    for name, value in columns.items():
        frame = frame.withColumn(name, value)
    return frame


def distance(rows: DataFrame) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance to the location c and factor l that they carry."""
    for i, f in enumerate(FEATURES):
        rest = F.col(f) - F.col(f"c{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"_y{j}")
        rows = rows.withColumn(f"_y{i}", rest / F.col(f"l{i}{i}"))
    total = sum((F.col(f"_y{i}") ** 2 for i in range(1, len(FEATURES))), F.col("_y0") ** 2)
    return rows.withColumn("d2", total).drop(*[f"_y{i}" for i in range(len(FEATURES))])


def parts(rows: DataFrame) -> DataFrame:
    """(lang, source, judged_by, part, fits) for the sources of the rows: the group that judges each, its kind, and those whose estimates its texts are part of."""
    counts = rows.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("of_lang", F.sum("n").over(Window.partitionBy("lang")))
    level = F.when(F.col("n") >= LEAST, 2).when(F.col("of_lang") >= LEAST, 1).otherwise(0)
    pair, lang, whole = (F.to_json(F.struct(F.lit(k).alias("level"), *names)) for k, names in ((2, ["lang", "source"]), (1, ["lang"]), (0, [])))
    counts = common.stage(counts.withColumn("level", level), "quality-sizes")
    pooled = F.max(F.col("level") == 1).over(Window.partitionBy("lang"))
    any_small = bool(counts.filter("level = 0").head(1))
    fits = F.array_compact(F.array(F.when(F.col("level") == 2, pair), F.when(pooled, lang), F.when(F.lit(any_small), whole)))
    names = F.element_at(F.array(F.lit("all"), F.lit("language"), F.lit("own")), F.col("level") + 1)
    return counts.select("lang", "source", names.alias("judged_by"), F.when(F.col("level") == 2, pair).when(F.col("level") == 1, lang).otherwise(whole).alias("part"), fits.alias("fits"))


def fit(stats: DataFrame) -> DataFrame:
    """The estimate (c0.., l00..) for each (lang, source) that has texts past the base rules."""
    rows = features(stats.filter(~F.col("base_failed"))).select("lang", "source", *FEATURES)
    rows = common.stage(rows, "quality-features")
    groups = common.stage(parts(rows), "quality-groups")
    known = common.small(groups.drop("part", "judged_by"), SENT).alias("g")
    rows = rows.alias("r").join(known, F.col("r.lang").eqNullSafe(F.col("g.lang")) & F.col("r.source").eqNullSafe(F.col("g.source"))).select(F.explode("fits").alias("part"), *FEATURES)
    centre = common.stage(_named(rows, "c", lambda k: F.round(F.col(FEATURES[k]) * FINE)), "quality-centre")
    spread = _named(rows.join(common.small(centre, SENT), "part"), "s", lambda k: F.round(F.abs(F.col(FEATURES[k]) - F.col(f"c{k}")) * FINE))
    first = common.stage(centre.join(spread, "part"), "quality-spread")
    model = common.stage(starts(rows, first), "quality-starts")
    model = common.stage(concentrated(rows, model), "quality-model")
    ended = model.limit(0)
    for _ in range(STEPS):
        columns = [*_model_columns(), "log_det"]
        both = concentrated(rows, model).alias("n").join(model.alias("w"), ["part", "start"])
        falls = F.col("n.log_det") < F.col("w.log_det") - FALL
        both = both.select("part", "start", *[F.when(falls, F.col(f"n.{c}")).otherwise(F.col(f"w.{c}")).alias(c) for c in columns], falls.alias("falls"))
        both = common.stage(both, "quality-step")
        ended, model = ended.unionByName(both.filter("not falls").drop("falls")), both.filter("falls").drop("falls")
        if not model.head(1):
            break
    best = Window.partitionBy("part").orderBy(F.round("log_det", 6), "start")
    model = ended.unionByName(model).withColumn("_best", F.row_number().over(best)).filter("_best = 1").drop("_best")
    return common.stage(groups.drop("fits").join(model, "part"), "quality-estimates")


def _model_columns() -> list[str]:
    return [*[f"c{i}" for i in range(len(FEATURES))], *[f"l{i}{j}" for i in range(len(FEATURES)) for j in range(i + 1)]]


def _estimate(moments: DataFrame, factor: float) -> DataFrame:
    """Location and Cholesky factor from means and covariances (c.., v..), with a floor for each feature."""
    return _with(moments, _lower(lambda i, j: F.col(f"v{i}{j}") * factor + (FLOORS[i] ** 2 if i == j else 0.0))).select("part", "start", *_model_columns())


def _moments(values) -> list[Column]:
    pairs = [F.covar_pop(values[i], values[j]).alias(f"v{i}{j}") for i in range(len(FEATURES)) for j in range(i + 1)]
    return [*[F.avg(v).alias(f"c{i}") for i, v in enumerate(values)], *pairs]


def starts(rows: DataFrame, first: DataFrame) -> DataFrame:
    """Three estimates of each group to start from: medians and absolute deviations; means and covariances of all its texts; and those of the
    texts with each feature drawn in to two deviations from its median."""
    deviation = [F.greatest(F.col(f"s{i}") * 1.4826, F.lit(FLOORS[i])) for i in range(len(FEATURES))]
    columns = {f"l{i}{j}": deviation[i] if i == j else F.lit(0.0) for i in range(len(FEATURES)) for j in range(i + 1)}
    middle = _with(first.withColumn("start", F.lit(0)), columns).select("part", "start", *_model_columns())
    whole = _estimate(rows.groupBy("part").agg(*_moments([F.col(f) for f in FEATURES])).withColumn("start", F.lit(1)), 1.0)
    near = rows.join(common.small(first, SENT), "part")
    drawn = [F.greatest(F.col(f"c{i}") - 2 * deviation[i], F.least(F.col(f"c{i}") + 2 * deviation[i], F.col(f))) for i, f in enumerate(FEATURES)]
    near = near.select("part", *[d.alias(f) for d, f in zip(drawn, FEATURES, strict=True)])
    inner = _estimate(near.groupBy("part").agg(*_moments([F.col(f) for f in FEATURES])).withColumn("start", F.lit(2)), 1.0)
    return middle.unionByName(whole).unionByName(inner)


def concentrated(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One concentration step: the estimate from the HALF of each group's texts that are nearest by the model, with the logarithm of its determinant."""
    near = distance(rows.join(common.small(model, SENT).drop("log_det"), "part")).select("part", "start", *FEATURES, F.floor(F.log1p("d2") * COARSE).alias("bin"))
    edge = common.stage(_middle(near, F.col("bin"), HALF), "quality-edge")
    near = near.join(common.small(edge, SENT), ["part", "start"]).filter("bin <= middle")
    size = sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(1, len(FEATURES))), 2 * F.log(F.col("l00")))
    return _estimate(near.groupBy("part", "start").agg(*_moments([F.col(f) for f in FEATURES])), CONSISTENT).withColumn("log_det", size)


def judge(stats: DataFrame, model: DataFrame, cut: float = CUT) -> DataFrame:
    """stats with d2 (null where no text of the language and source passes the base rules), judged_by (own, language or all) and kept."""
    m = common.small(model.drop("part", "log_det").withColumnsRenamed({"lang": "_lang", "source": "_source"}), SENT)
    out = features(stats).join(m, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    out = distance(out)
    kept = ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= cut))
    return out.withColumn("kept", kept).drop("_lang", "_source", *[c for c in model.columns if c[0] in "cl" and c[1:].isdigit()])


def keep(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of docs. They are written once with their statistics, which costs less than to measure the texts twice."""
    used = ["doc_id", "text", "lang", "source"]
    stats = common.stage(statistics(common.aside(docs, used)), "quality-statistics")
    return common.back(judge(stats, fit(stats)).filter("kept"), docs, used)


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    stats = common.stage(statistics(docs).drop("text"), "quality-statistics")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judge(stats, fit(stats)).select("doc_id", *counts, "base_failed", "kept", "d2", "judged_by")


