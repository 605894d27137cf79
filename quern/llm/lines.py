"""Line deduplication by an exact set-similarity join. DataFrame functions only.

A line (between line feeds) with at least one word is the set of its words. A line is removed if an earlier one, in the order
of doc_id, text hash and line number, has a Jaccard similarity of at least 80 % with it, whether or not that one stays.

1. Words are ordered by rarity: common words last, by the corpus counts of 2^18 hash buckets in half powers of 2, then by hash. A word
   becomes one long whose high bits are this level and whose low ones are its hash, so that sorting longs sorts by rarity.
2. Lines with the same set are one set, at the position of the first; all others of them go. Its first
   n - ceil(0.8 n) + 1 words are its prefix. Of two sets that match, the smaller shares a word of its first
   n - ceil(8/9 n) + 1 with the prefix of the larger: its short prefix.
3. Sets whose words after the prefix, as many as in it, have the same two least or two greatest hashes are alike (words that
   edits put in are mostly rare, and so in the prefix); where DENSE or more are, they are dealt into HEADS slots
   and each is compared with two of every slot, the earliest and the one whose rarest word is least rare, which is hardly
   edited. What matches an earlier one goes, so that of a group of near copies few sets are left to be paired.
4. Prefixes meet short prefixes by word and length class. A pair whose later set has gone already, or that fails the
   length filter, the positional filter (from this word on, both must have as many words as the overlap needed) or
   the parity filter (bits that differ between maps are words of one set only) is no candidate.
5. Candidates are verified on their whole sets, read from the texts again.

Lines without words stay. A null text has no lines and stays null. A null doc_id comes first in the order. Exactly repeated
rows are one document and keep the same lines. A document that loses every line keeps its row, with an empty text. Ties of doc_id
are ordered by the text's hash. A line of any length is one set; its prefix, a fifth of its words, is one row until it is
exploded. Columns of any name beside doc_id and text are kept aside. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

PERCENT = 80
#: Bits of a word's hash that choose its bucket; alike sets from whose number on two of each slot are asked first, and slots; powers of 1.25 that a length class spans; words up to which a set has a map of 64 bits, not 128; passes over the words; rows up to which a list is broadcast.
BITS, DENSE, HEADS, CLASS, MAP, PASSES, SENT = 18, 8, 4, 2, 64, 2, 200_000


def spaced(text: Column, breaks: bool) -> Column:
    """A text with spaces for other white space, and for line feeds if breaks."""
    odd = text.contains("\t") | text.contains("\x0b") | text.contains("\f") | text.contains("\r")
    plain = F.when(odd, F.translate(text, "\t\x0b\f\r", "    ")).otherwise(text)
    return F.replace(plain, F.lit("\n"), F.lit(" ")) if breaks else plain


def bucket(word: Column) -> Column:
    """The bucket in which a word is counted."""
    return F.hash(word).bitwiseAND(F.lit((1 << BITS) - 1))


def ranks(docs: DataFrame) -> Column:
    """The level of each bucket, which grows with its count by half powers of 2, from -64, as an array of fixed size."""
    spaces = F.split(spaced(F.col("text"), True), " ")
    buckets = docs.select(F.explode(spaces).alias("w")).filter("w <> ''").select(bucket(F.col("w")).alias("bucket"))
    # four buckets are counted in a row, so that a task's rows fit Spark's fast map
    rows = 1 << (BITS - 2)
    counts = [F.count_if(F.shiftright("bucket", BITS - 2) == k) for k in range(4)]
    level = [F.when(n > 0, F.floor(2 * F.log2(n))).otherwise(0).cast("long") for n in counts]
    bits = sum((F.shiftleft(x, 8 * k) for k, x in enumerate(level[1:], 1)), level[0])
    found = {r["at"]: r["bits"] for r in buckets.groupBy(F.col("bucket").bitwiseAND(F.lit(rows - 1)).alias("at")).agg(bits.alias("bits")).collect()}  # 2^(BITS - 2) rows at most
    # numbers of a byte are shared objects of the JVM, so that the array takes no more than its references
    return F.from_json(F.lit(str([(found.get(k % rows, 0) >> 8 * (k // rows) & 255) - 64 for k in range(1 << BITS)])), "array<long>")


def keys(line: Column, rank: Column, plain: bool = False) -> Column:
    """The set of a line's words as longs, rarest first. plain: it has single spaces between words and no other white space."""

    def key(w: Column) -> Column:
        g = F.shiftleft(F.get(rank, bucket(w)), 57).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 7))
        return F.coalesce(g, F.lit(0).cast("long"))  # never null, so that the array is of plain longs

    # one pass over the words; what stands around it is compiled
    words = F.split(line, " ") if plain else F.array_remove(F.split(spaced(line, True), " "), "")
    return F.sort_array(F.array_distinct(F.transform(words, key)))


def parity(keys: Column) -> list[Column]:
    """Both halves of a map of 128 bits with the bit of each word flipped; sets of at most 64 words have a map of 64 in the first half."""
    bit = lambda on, k: F.call_function("shiftleft", on, k.bitwiseAND(F.lit(63)).cast("int"))
    flipped = lambda on: F.aggregate(keys, F.lit(0).cast("long"), lambda m, k: m.bitwiseXOR(bit(on(k), k)))
    second = F.when(F.size(keys) > MAP, flipped(lambda k: F.shiftrightunsigned(k, 6).bitwiseAND(F.lit(1)))).otherwise(F.lit(0).cast("long"))
    return [flipped(lambda k: F.lit(1).cast("long")).alias("m"), second.alias("m1")]


def exploded(docs: DataFrame) -> DataFrame:
    """(pos, line) of every line with a word, with single spaces between its words; pos is (doc_id, text hash, line number)."""
    rows = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(spaced(F.col("text"), False), "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.trim("line")).filter("line <> ''")
    single = F.when(F.contains("line", F.lit("  ")), F.regexp_replace("line", " +", " ")).otherwise(F.col("line"))
    return rows.select(F.struct("doc_id", "th", "line_no").alias("pos"), single.alias("line"))


class Side:
    """One side of a join of prefix rows: w (32 bits of a hash of word and length class; a clash only adds a candidate), sid, doc, m0, m1 and `at`,
    which holds n, i and whether the set is open. These rows are very many and are kept as narrow as can be."""

    columns = ("w", "sid", "doc", "at", "m0", "m1")

    def __init__(self, name: str):
        self.n = F.shiftrightunsigned(F.col(f"{name}.at"), 32)
        self.i = F.shiftrightunsigned(F.col(f"{name}.at").bitwiseAND(F.lit(2**32 - 1)), 1)
        self.open = F.col(f"{name}.at").bitwiseAND(F.lit(1)) == 1
        self.w, self.sid, self.doc, self.m0, self.m1 = (F.col(f"{name}.{c}") for c in ("w", "sid", "doc", "m0", "m1"))


def classes(n: Column, percent: int) -> list[Column]:
    """Of a set of n words: length class, the next one if a larger set that may match is in it, last place of the short prefix, and last place
    from which a set of the next class has words enough for the overlap needed (-1: none)."""
    step = lambda more: F.floor((F.log(n) / F.log(F.lit(100.0 / percent)) + more) / CLASS).cast("int")
    least = n - F.ceil(n * 2 * percent / (100 + percent))
    starts = F.pow(F.lit(100.0 / percent), step(1) * CLASS) * (1 - 1e-9)  # the least length of the next class, or less
    far = F.when(step(1) == step(0), -1).otherwise(F.floor((100 * n - percent * starts) / (100 + percent) + 1e-9))
    return [step(0).alias("own"), step(1).alias("next"), least.cast("int").alias("least"), far.cast("int").alias("far")]


def prefix_rows(sets: DataFrame) -> DataFrame:
    """The rows of each set's prefix, with the word's key and its place i."""
    head = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("open").cast("long"))
    rows = sets.select("sid", "doc", "m0", "m1", head.alias("head"), "own", "next", "least", "far", F.posexplode("prefix").alias("i", "key"))
    return rows.withColumn("at", F.col("head").bitwiseOR(F.shiftleft(F.col("i").cast("long"), 1)))


def alike(an: Column, am0: Column, am1: Column, bn: Column, bm0: Column, bm1: Column, percent: int) -> Column:
    """The length filter and the parity filter let two sets pass. Sets that match differ by (100 - percent) / (100 + percent) of both their words at most."""
    m0, m1, most = am0.bitwiseXOR(bm0), am1.bitwiseXOR(bm1), (an + bn) * (100 - percent)
    return (
        (100 * bn >= percent * an) & (100 * an >= percent * bn)
        & ((100 + percent) * F.bit_count(m0.bitwiseXOR(m1)) <= most)  # both halves together are a map of 64
        & ((an <= MAP) | (bn <= MAP) | ((100 + percent) * (F.bit_count(m0) + F.bit_count(m1)) <= most))
    )


def may_match(a: Side, b: Side, percent: int) -> Column:
    """Two sets that share this word can have the overlap needed, percent / (100 + percent) of both their words."""
    return (a.w == b.w) & ((100 + percent) * F.least(a.n - a.i, b.n - b.i) >= (a.n + b.n) * percent) & alike(a.n, a.m0, a.m1, b.n, b.m0, b.m1, percent)


def verified(docs: DataFrame, rank: Column, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """sid of the later set of each pair (a, b) that is similar."""
    asked = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    wanted = common.stage(sets.select("sid", "first").join(common.small(asked, SENT), "sid"), "line-wanted")
    if wanted.count() <= SENT:
        wanted = F.broadcast(wanted)
        ids = F.broadcast(wanted.select(F.col("first.doc_id").alias("_id")).distinct())
        docs = docs.join(ids, F.col("_id").eqNullSafe(F.col("doc_id")), "left_semi")
    whole = exploded(docs).join(wanted, F.col("pos") == F.col("first")).select("sid", "first", keys(F.col("line"), rank, True).alias("keys"))
    whole = common.stage(whole.dropDuplicates(["sid"]), "line-whole")  # a repeated row has the same lines
    x, y = (whole.select(F.col("sid").alias(k), F.col("first").alias(f"{k}f"), F.col("keys").alias(f"{k}k")) for k in "ab")
    both = pairs.join(x, "a").join(y, "b").withColumn("n_both", F.size(F.array_intersect("ak", "bk")))
    links = both.filter(100 * F.col("n_both") >= percent * (F.size("ak") + F.size("bk") - F.col("n_both")))
    found = common.stage(links.select(F.when(F.col("af") < F.col("bf"), F.col("b")).otherwise(F.col("a")).alias("sid")).distinct(), "line-near")
    for used in (wanted, whole):
        common.discard(used)
    return found


def near(docs: DataFrame, rank: Column, sets: DataFrame, percent: int) -> DataFrame:
    """sid of the sets that an earlier set matches."""
    a, b = Side("a"), Side("b")
    sets = sets.withColumn("doc", F.coalesce("first.doc_id", F.lit(-(2**63))))
    likes = sets.select("sid", "doc", F.get("prefix", F.lit(0)).alias("rarest"), "n", "m0", "m1", F.explode(F.array_distinct(F.array("e0", "e1"))).alias("end")).filter("end is not null")
    dense = common.stage(likes.groupBy("end").agg(F.count("*").alias("c")).filter(F.col("c") >= DENSE).select("end"), "line-dense")
    likes = common.stage(likes.join(common.small(dense, SENT), "end"), "line-likes")
    head = F.struct("sid", "n", "m0", "m1")
    heads = likes.groupBy("end", F.pmod(F.xxhash64("sid"), F.lit(HEADS)).alias("slot")).agg(F.array(F.min_by(head, F.struct("doc", "sid")), F.max_by(head, F.struct("rarest", "sid"))).alias("heads"))
    met = likes.join(heads.select("end", F.explode("heads").alias("h")), "end").filter((F.col("sid") != F.col("h.sid")) & alike(F.col("n"), F.col("m0"), F.col("m1"), F.col("h.n"), F.col("h.m0"), F.col("h.m1"), percent))
    met = common.stage(met.select(F.col("sid").alias("a"), F.col("h.sid").alias("b")).distinct(), "line-met")
    gone = verified(docs, rank, met, sets, percent)
    common.discard(likes)
    # those left, as the later of a pair; the smaller set's short prefix meets the other's prefix
    closed = common.small(gone.withColumn("closed", F.lit(True)), SENT)
    rows = prefix_rows(sets.join(closed, "sid", "left").withColumn("open", F.col("closed").isNull()))
    # a larger set that may match is in the class of n or of 1.25 n, of which only the first places see the latter
    steps = F.when(F.col("i") > F.col("far"), F.array("own")).otherwise(F.array("own", "next"))
    larger = rows.withColumn("w", F.hash("key", "own"))
    smaller = rows.filter("i <= least").withColumn("step", F.explode(steps)).withColumn("w", F.hash("key", "step"))
    order = (b.n < a.n) | ((b.n == a.n) & (b.sid < a.sid))
    later = (a.open & (b.doc <= a.doc)) | (b.open & (a.doc <= b.doc))
    found = None
    for k in range(PASSES):  # a share of the words at a time, so that the shuffled rows take less disk
        mine = [side.filter(F.pmod("key", F.lit(PASSES)) == k).select(*Side.columns) for side in (larger, smaller)]
        pairs = mine[0].alias("a").join(mine[1].alias("b").hint("shuffle_hash"), order & may_match(a, b, percent) & later)
        pairs = common.stage(pairs.select(a.sid.alias("a"), b.sid.alias("b")).distinct(), "line-pairs")
        found = pairs if found is None else found.unionByName(pairs)
        common.sweep(docs.sparkSession)
    return gone.unionByName(verified(docs, rank, common.stage(found.distinct(), "line-candidates"), sets, percent))


def later(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """pos of the lines to remove."""
    rank = ranks(docs)
    lines = exploded(docs).select("pos", keys(F.col("line"), rank, True).alias("keys"))
    size = F.size("keys")
    ids = [F.xxhash64("keys").alias("s1"), F.xxhash64(F.lit(1), "keys").alias("s2")]
    most = size - F.ceil(size * percent / 100).cast("int") + 1
    after = F.sort_array(F.transform(F.slice("keys", most + 1, most), lambda k: F.shiftleft(k, 7)))
    lines = lines.select("pos", *ids, size.alias("n"), *parity(F.col("keys")), after.alias("after"), F.slice("keys", F.lit(1), most).alias("prefix"))
    end = lambda *at: F.when(F.size("after") > 1, F.xxhash64(*[F.try_element_at("after", F.lit(k)) for k in at]))
    lines = lines.select("pos", "s1", "s2", "n", F.col("m").bitwiseXOR(F.col("m1")).alias("m0"), "m1", end(1, 2).alias("e0"), end(-1, -2).alias("e1"), "prefix")
    lines = common.stage(lines, "lines")
    sets = lines.groupBy("s1", "s2").agg(F.min("pos").alias("first"), F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("n", "m0", "m1", "e0", "e1", "prefix")])
    sets = common.stage(sets.select("*", F.monotonically_increasing_id().alias("sid"), *classes(F.col("n"), percent)), "line-sets")
    whole, lines = lines, common.stage(lines.select("pos", "s1", "s2"), "line-ids")
    common.discard(whole)
    common.sweep(docs.sparkSession)
    gone = near(docs, rank, sets, percent).withColumn("near", F.lit(True))
    found = sets.select("sid", "s1", "s2", "first", "times").join(gone, "sid", "left").filter("times > 1 or near").select("s1", "s2", "first", "near")
    found = common.small(common.stage(found, "line-found"), SENT)
    common.discard(sets)
    return lines.join(found, ["s1", "s2"]).filter("near or first < pos").select("pos")


def removed(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, th, gone): numbers of the lines to remove, of each document that has any."""
    out = later(docs, percent).select("pos.*").groupBy("doc_id", "th")
    return common.stage(out.agg(F.sort_array(F.collect_set("line_no")).alias("gone")), "lines-removed")  # a set, as rows may be repeated


def dedupe(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without the lines that match an earlier one, with the same columns."""
    used = ["doc_id", "text"]
    own = common.aside(docs, used)
    out = common.small(removed(own.select(used), percent).withColumnRenamed("doc_id", "_id"), SENT)
    own = own.withColumn("_th", F.xxhash64("text"))
    own = own.join(out, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_th") == F.col("th")), "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    kept = lambda n: F.array_except(F.sequence(F.lit(0), n - 1), "gone")
    rest = common.let(F.split("text", "\n"), lambda s: F.array_join(F.transform(kept(F.size(s)), lambda i: F.get(s, i)), "\n"))
    own = own.withColumn("text", F.when(F.size("gone") == 0, F.col("text")).otherwise(rest))
    return common.back(own, docs, used)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (before), n_removed and the removed lines' numbers, between commas, of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = common.small(removed(docs).withColumnRenamed("doc_id", "_id"), SENT)
    lines = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    rows = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.when(F.col("text").isNull(), 0).otherwise(lines).cast("long").alias("n_lines"))
    rows = rows.join(out, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_th") == F.col("th")), "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"), F.array_join(gone.cast("array<string>"), ",").alias("removed"))


#: All pairs of sets of like size that share a word. Ids of documents are taken to be unique.
OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, line_no, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS s FROM l),
k AS (SELECT doc_id, line_no, s, dense_rank() OVER (ORDER BY s) AS sid FROM w WHERE len(s) > 0),
f AS (SELECT sid, any_value(s) AS s, len(any_value(s)) AS n, min({'d': doc_id, 'l': line_no}) AS first FROM k GROUP BY sid),
x AS (SELECT sid, n, unnest(s) AS word FROM f),
p AS (SELECT a.sid AS a, b.sid AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS n_both FROM x a JOIN x b ON a.word = b.word AND a.sid < b.sid AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY 1, 2),
m AS (SELECT a, b FROM p WHERE 100 * n_both >= 80 * (an + bn - n_both)),
near AS (SELECT DISTINCT CASE WHEN fa.first < fb.first THEN b ELSE a END AS sid FROM m JOIN f fa ON fa.sid = a JOIN f fb ON fb.sid = b),
g AS (SELECT doc_id, line_no FROM k JOIN f USING (sid) WHERE sid IN (SELECT sid FROM near) OR f.first < {'d': k.doc_id, 'l': k.line_no}),
r AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS removed FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id
"""
