"""Brute-force comparisons, edge cases and round trips of the training-data operators."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chat, html, jaccard, language, licences, lines, mixing, packing, quality, queries, topk
from tests.conftest import SF
from tests.llm import pages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, th string, target double, kept string"
LONG = " ".join(f"w{k % 977}" for k in range(30_000))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def frame(spark, texts):
    rows = [(k, t, "en" if k % 2 else None, None if k % 7 == 0 else f"s{k % 2}", 1, 5, "x", "y", 1.0, "z") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[-1:], SCHEMA)  # the last row twice


@pytest.fixture(scope="module")
def odd(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twenty1 twenty2"
    texts = [None, "", "   ", "a", base, base.upper().replace(" ", "  "), base + " extra", base.replace("ten", "TEN"), LONG, LONG + " end", "a\n\nb\nc c c", "é　ü\tß", base]
    return frame(spark, texts).cache()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    theirs = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert names == sorted(columns)
    pick = lambda rows, order: sorted(tuple(str(r[order.index(c)]) for c in names) for r in rows)
    assert pick([tuple(r) for r in df.collect()], df.columns) == pick(theirs.fetchall(), columns)


def test_quality_statistics(odd):
    for r in quality.statistics(odd).collect():
        w, t = words(r["text"]), r["text"] or ""
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        marked = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        full = [x for x in t.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(marked), len(full) - len(set(full)))


def test_quality_verdicts(spark, odd):
    assert quality.keep(odd).columns == odd.columns
    assert quality.keep(odd.limit(0)).count() == 0
    r = random.Random(1)
    clean = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(60, 200))) for _ in range(300)]
    junk = [" ".join("ab###$$$" for _ in range(3)).join(["x%d &&& *** $$$" % k for k in range(40)]) for _ in range(10)]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    kept = {x["doc_id"] for x in quality.keep(docs).collect()}
    assert len(kept & set(range(300))) >= 297 and not kept & set(range(300, 310))


def test_quality_small_groups(spark):
    r = random.Random(2)
    text = lambda low, high: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(low, high))) for _ in range(r.randint(60, 200)))
    junk = " ".join("x%d&&&*** $$$%d" % (k, k) for k in range(40))
    sizes = {("en", "own"): 60, ("en", "few"): 12, ("en", None): 60, ("xx", "rare"): 6, (None, None): 5}
    rows = [(lang, source, text(2, 8)) for (lang, source), n in sizes.items() for _ in range(n)]
    docs = [(k, *x, True) for k, x in enumerate(rows)] + [(1000 + k, *x, junk, False) for k, x in enumerate(sizes)]
    for part in (docs, [x for x in docs if x[1] == "xx"]):  # the second has 7 texts in all
        stats = quality.statistics(spark.createDataFrame(part, "doc_id long, lang string, source string, text string, clean boolean"))
        got = quality.judge(stats, quality.fit(stats)).collect()
        assert all(x["d2"] is not None for x in got if not x["base_failed"]) and not any(x["base_failed"] for x in got)
        assert {x["doc_id"] for x in got if not x["kept"]} == {x["doc_id"] for x in got if not x["clean"]}
    groups = quality.fit(quality.statistics(spark.createDataFrame(docs, "doc_id long, lang string, source string, text string, clean boolean"))).collect()
    own = {(x["lang"], x["source"]): x["part"] for x in groups}
    assert len(set(own.values())) == 4 and own["xx", "rare"] == own[None, None]


def test_packing(spark, odd):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    got = packing.pack(odd).toPandas()
    order = got.sort_values(["sequence_id", "offset"])
    assert (order.groupby("sequence_id")["length"].cumsum() - order["length"] == order["offset"]).all()
    assert order.groupby("sequence_id")["length"].sum().max() <= 2048
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for doc_id, own in got.drop_duplicates(["doc_id", "piece"]).groupby("doc_id"):
        ids = np.array([*tok.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        own = own.sort_values("piece")
        assert own["length"].sum() == len(ids) and (own["length"].iloc[1:] == 2048).all()
        for start, length, crc in zip(own["start"], own["length"], own["ids_crc32"], strict=True):
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc
    assert packing.pack(odd.limit(0)).count() == 0


def test_packing_plan():
    r = random.Random(3)
    for _ in range(40):
        counts = collections.Counter(r.randint(1, 64) for _ in range(200))
        plan, n_exact = packing.plan(dict(counts), 64)
        assert n_exact > 0
        for parts, times in plan:  # exact fills stand first in the plan, and nothing else is among them
            if n_exact > 0:
                assert sum(parts) == 64 and 1 <= len(parts) <= 4
                n_exact -= times
        assert n_exact == 0
        used = collections.Counter()
        for parts, times in plan:
            assert sum(parts) <= 64
            for p in parts:
                used[p] += times
        assert used == counts
        bins = []  # best-fit decreasing, piece by piece
        for p in sorted(counts.elements(), reverse=True):
            fits = [k for k, room in enumerate(bins) if room >= p]
            if fits:
                bins[min(fits, key=lambda k: bins[k])] -= p
            else:
                bins.append(64 - p)
        assert -(-sum(counts.elements()) // 64) <= sum(t for _, t in plan) <= len(bins)
    left = np.zeros(9, np.int64)
    left[[3, 5]] = 1, 1
    assert packing.fill(left, 8) == (5, 3) and packing.fill(left, 7) is None
    left[[1, 2]] = 2, 1
    assert packing.fill(left, 6) == (5, 1) and packing.fill(left, 4) == (3, 1) and packing.fill(left, 7) == (5, 2)
    left[2] = 0
    assert packing.fill(left, 7) == (5, 1, 1)


def test_encoder_equals_tokenizer():
    import pyarrow.parquet as pq

    w = packing.encoder()
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    assert len(texts) >= 1000
    for t in texts:  # real texts of all local languages
        assert w.encode(t or "") == w.exact(t or "")
    r = random.Random(8)
    plain = "".join(map(chr, [9, 10, 13, *range(32, 127), *range(0xA1, 0x180)])) + "     \n\n'''sstdm"
    other = plain + "\x0b\x0c\x1c\x85\xa0\u1680\u180e\u2003\u200b\u3000字е\u0301😀"
    for k in range(4000):
        t = "".join(r.choice(other if k % 2 else plain) for _ in range(r.randint(0, 40))) + ("<|endoftext|>" if k % 50 == 0 else "")
        assert w.encode(t) == w.exact(t)


def test_chat(spark):
    rows = [(0, 0, 0, 1, "user", "hi"), (0, 0, 0, 2, "assistant", "yes"), (0, 1, 1, 1, "user", "hi"), (0, 1, 1, 2, "assistant", None), (1, 0, 2, None, None, "x")]
    turns = spark.createDataFrame(rows, "pair_id long, side int, conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in chat.format_pairs(turns).collect()}
    assert (got[0]["n_prompt_turns"], got[0]["prompt"], got[0]["chosen"]) == (1, "<|user|>\nhi\n", "<|assistant|>\nyes\n")
    assert got[0]["rejected_mask"] == f"{len('<|assistant|>') + 1}:0,1:1" and got[0]["chosen_mask"] == f"{len('<|assistant|>') + 1}:0,4:1"
    assert (got[1]["n_prompt_turns"], got[1]["rejected"]) == (0, "")


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=6)]) for k in range(400)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (None, [1.0] * 6), (403, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 7).collect()
    whole = {k: np.floor(np.array(v, np.float32).astype(float) * 1024).astype(int) for k, v in rows[:400]}
    for q in range(0, 400, 50):
        best = sorted((-int(whole[q] @ v), k) for k, v in whole.items() if k != q)[:7]
        assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == best
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_top_k_repeated_queries(spark):
    import duckdb

    r = random.Random(7)
    rows = [(k, [r.gauss(0, 1) for _ in range(n)]) for k, n in [(0, 6), (0, 6), (0, 5), (100, 6), *((k, 5 + k % 2) for k in range(1, 90))]]
    vectors = spark.createDataFrame(rows + rows[3:5], "vec_id long, embedding array<float>")
    got = topk.top_k(vectors, vectors.filter("vec_id % 100 = 0")).collect()
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    c.executemany("INSERT INTO embeddings VALUES (?, ?)", [[x["vec_id"], list(x["embedding"])] for x in vectors.collect()])
    theirs = c.execute(topk.OP4_SQL).fetchall()
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got) == sorted(theirs) and len(theirs) == 20


def test_lines(spark, odd):
    r = random.Random(5)
    base = [[r.choice("abcdefghijklmnopqrst") * r.randint(1, 3) for _ in range(r.randint(1, 14))] for _ in range(60)]
    texts = ["\n".join(" ".join(w if r.random() < 0.93 else "zz" for w in r.choice(base)) for _ in range(6)) for _ in range(40)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    seen, gone = [], set()
    for k, t in enumerate(texts):
        for i, line in enumerate(t.split("\n")):
            s = set(words(line))
            if any(100 * len(s & x) >= 80 * len(s | x) for x in seen):
                gone.add((k, i))
            seen.append(s)
    got = lines.removed(docs).collect()
    assert {(x["doc_id"], i) for x in got for i in x["gone"]} == gone
    out = {x["doc_id"]: x["text"] for x in lines.dedupe(docs).collect()}
    assert all(out[k] == "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in enumerate(texts))
    again = lines.dedupe(odd)
    assert again.columns == odd.columns and again.count() == odd.count()
    assert lines.dedupe(odd.limit(0)).count() == 0


def test_licences(spark, odd):
    mit = licences.TEMPLATES["MIT"]
    texts = [f"x y z {mit.upper()} and more", " ".join(mit.split()[:12]), "filler " * 500 + "Released under the MIT License.", None]
    got = {(x["doc_id"], x["licence"]) for x in licences.scan(frame(spark, texts)).collect()}
    assert got == {(0, "MIT"), (2, "MIT-notice")}
    assert licences.scan(odd).count() == 0
    assert 1 - (1 - 14 / (64 + 17 - 14)) ** licences.bands(64, 17) >= 0.999  # 14 of 17 shingles in a window of 64


def test_mixing(odd):
    got = mixing.mix(odd, mixing.words())
    rows = got.collect()
    assert len(rows) == odd.count() and all(0 <= r["times_taken"] <= 2 for r in rows)
    assert mixing.mix(odd.limit(0), mixing.words()).count() == 0


def test_mixing_of_null_ids(spark):
    """Rows without an id are dealt by their texts, not taken or left together."""
    rows = [(None if k % 3 else k, " ".join(f"w{k}x{j}" for j in range(10)), f"s{k % 2}") for k in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.words()).groupBy("source").agg(F.sum(F.col("size") * F.col("times_taken")).alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 2 and all(abs(r["taken"] - r["target"]) <= 0.02 * r["target"] for r in got)


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.op8_rank_order_language(spark, SF).join(docs, "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    blank = spark.createDataFrame([(1, True, None), (2, True, "12 34"), (3, True, "")], "doc_id long, held_out boolean, text string")
    profiles = language.learn(docs.select("lang", "text"))
    assert {(r["lang_pred"], r["score"]) for r in language.predict(blank, profiles).collect()} == {("und", 0.0)}
    assert {r["lang_pred"] for r in language.predict(blank, {}).collect()} == {"und"}


def test_html():
    page = '<html><script>var a="</p>";</script><nav><a href="/">Home</a></nav><article><h1>A &amp; B</h1><p>First   one.<br>Two<p>Last &lt;x&gt; one.</article><footer>&copy; c</footer>'
    assert html.texts([page, None, "", "<!-- only"]) == ["A & B First one. Two Last <x> one.", "", "", ""]
    from quern.llm import train_html

    assert train_html.accuracy(html.labeller().w, 60) > 0.97


def test_html_unclosed():
    story = '<nav><a href="/">Home</a></nav><article><h1>A &amp; B</h1><p>First   one.<br>Two<p>Last &lt;x&gt; one.</article><footer>&copy; c</footer>'
    for start in ("<html><head><title>x</title><body>", "<head><title>x<body>", "<svg><path>", "<noscript><img src=x>", "<template>", "<math>"):
        assert html.texts([start + story, start + story + "<svg><title>t</title></svg><noscript>n</noscript>"]) == ["A & B First one. Two Last <x> one."] * 2
    assert [b[1] for b in html.blocks("<p>a</p><svg><svg></svg><text>b</text></svg><svg-icon>c</svg-icon><p>d</p>")] == ["a", "c", "d"]


def test_pipeline_documents(spark):
    import corpus_pipeline

    r = random.Random(4)
    a, b, c = (" ".join(f"{x}{r.randint(0, 400)}" for _ in range(40)) for x in "abc")
    rows = [(1, a), (2, a + " end"), (3, b), (3, b.upper()), (3, c), (3, None), (2, "  "), (4, None), (4, None), (None, a), (None, a), (None, None), (5, "one"), (6, b + " end")]

    def kept(rows):
        text = lambda t: tuple((t or "").lower().split())
        grams = [{w[i : i + 5] for i in range(len(w) - 4)} if len(w) > 4 else {w} if w else set() for w in (text(t) for _, t in rows)]
        label = {k: k for k, _ in rows if k}
        for (x, s), (y, t) in itertools.permutations([(k, g) for (k, _), g in zip(rows, grams, strict=True) if k and g], 2):
            if 100 * len(s & t) >= 80 * len(s | t):
                label = {k: min(label[x], label[y]) if v in (label[x], label[y]) else v for k, v in label.items()}
        out, seen = [], set()
        for k, t in sorted(rows, key=lambda x: (x[0] or 0, x[1] or "")):
            if k and text(t):
                if label[k] < k or (k, text(t)) in seen:
                    continue
                seen.add((k, text(t)))
            out.append((k, t))
        return sorted(out, key=str)

    for own in (rows, [x for x in rows if x[0] not in (2, 3, 4)]):  # the second has no repeated id
        docs = spark.createDataFrame([(k, t, len(t or "")) for k, t in own], "doc_id long, text string, n_chars int")
        got = corpus_pipeline.dedupe_documents(spark, docs, SF)
        assert got.columns == docs.columns
        assert sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=str) == kept(own)


def test_jaccard(spark, odd):
    r = random.Random(9)
    base = [[f"t{r.randint(0, 400)}" for _ in range(r.randint(3, 60))] for _ in range(12)]
    texts = [" ".join(w if r.random() < 0.985 else f"q{r.randint(0, 9)}" for w in r.choice(base)) for _ in range(150)] + ["", None, "one", "ONE", "one two"]
    docs = frame(spark, texts)
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    got = {(x["doc_id"], x["n_shingles"], x["component_id"]) for x in jaccard.join(docs).collect()}
    assert got == {(k, len(s), label[k]) for k, s in enumerate(sets)}
    assert jaccard.join(odd.limit(0)).count() == 0


def exact_features(text):
    w, t = words(text), text or ""
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    full = [x for x in t.split("\n") if words(x)]
    chars = sum(map(len, w))
    share = lambda a, b: np.arcsin(np.sqrt(min(1.0, a / max(b, 1))))
    f = [np.log(max(chars, 1) / max(len(w), 1)), share(sum(t.count(c) for c in "#*$%&|<>"), chars), share(len(full) - len(set(full)), len(full)), share(len(marked), len(w))]
    return len(w) < 50 or 100 * len(marked) > 50 * len(w), f


def brute_estimate(x):
    """Location and covariance of one group, step by step in numpy."""
    floors = np.array(quality.FLOORS)
    half_up = lambda v: np.where(v < 0, -np.floor(-v + 0.5), np.floor(v + 0.5))
    low_median = lambda v: np.sort(v, axis=0)[-(-len(v) // 2) - 1]
    centre = low_median(half_up(x * 256)) / 256
    deviation = np.maximum(1.4826 * low_median(half_up(np.abs(x - centre) * 256)) / 256, floors)
    drawn = np.clip(x, centre - 2 * deviation, centre + 2 * deviation)

    def factored(c, v):
        c = c + np.diag(floors**2)
        low = np.zeros_like(c)
        for i in range(4):
            for j in range(i + 1):
                rest = c[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = np.sqrt(max(rest, floors[i] ** 2)) if i == j else rest / low[j, j]
        return v, low

    cov = lambda y: np.cov(y.T, bias=True)
    found = []
    for at, low in ((centre, np.diag(deviation)), factored(cov(x), x.mean(0)), factored(cov(drawn), drawn.mean(0))):
        last = None
        for _ in range(100):
            d2 = (np.linalg.solve(low, (x - at).T) ** 2).sum(0)
            bins = np.floor(np.log1p(d2) * 64)
            kept = x[bins <= np.sort(bins)[int(np.ceil(0.75 * len(x) - 1e-9)) - 1]]
            new = factored(cov(kept) * quality.CONSISTENT, kept.mean(0))
            size = 2 * np.log(np.diag(new[1])).sum()
            if last is not None and size >= last - quality.FALL:
                break
            (at, low), last = new, size
        found.append((round(last, 6), len(found), at, low))
    return min(found, key=lambda f: f[:2])


def test_quality_equals_brute_force(spark):
    r = random.Random(12)
    word = lambda low, high: "".join(r.choice("abcdefghij") for _ in range(r.randint(low, high)))
    rows = []
    for lang, source, n, (low, high) in (("en", "a", 120, (2, 8)), ("en", None, 70, (4, 11)), (None, "a", 60, (1, 5)), ("de", "b", 30, (5, 9)), ("de", "c", 35, (5, 9)), ("xx", "z", 4, (2, 8))):
        for _ in range(n):
            kind = r.random()
            w = [word(low, high) for _ in range(r.randint(40, 160))]
            lines = [" ".join(w[k : k + 12]) for k in range(0, len(w), 12)]
            if kind < 0.05:
                lines = [x + " $$$ ### %%%" for x in lines]
            elif kind < 0.1:
                lines += lines[: r.randint(1, len(lines))]
            rows.append((lang, source, "\n".join(lines)))
    rows += [rows[0]] * 3 + [("en", "a", None), ("en", "a", "")]
    docs = [(k if k % 50 else None, *x) for k, x in enumerate(rows)]
    stats = quality.statistics(spark.createDataFrame([(*x, k) for k, x in enumerate(docs)], "doc_id long, lang string, source string, text string, row long"))
    got = {x["row"]: x for x in quality.judge(stats, quality.fit(stats)).collect()}
    f = [exact_features(x[3]) for x in docs]
    good = [k for k in range(len(docs)) if not f[k][0]]
    pair = collections.Counter(docs[k][1:3] for k in good)
    lang = collections.Counter(docs[k][1] for k in good)
    models, near_cut = {}, 0
    for k, x in enumerate(docs):
        if f[k][0]:
            assert not got[k]["kept"] and got[k]["base_failed"]
            continue
        level = "own" if pair[x[1:3]] >= 40 else "language" if lang[x[1]] >= 40 else "all"
        key = {"own": (level, *x[1:3]), "language": (level, x[1]), "all": (level,)}[level]
        if key not in models:
            own = [j for j in good if level == "all" or docs[j][1] == x[1] and (level == "language" or docs[j][2] == x[2])]
            models[key] = brute_estimate(np.array([f[j][1] for j in own]))
        _, _, at, low = models[key]
        d2 = float((np.linalg.solve(low, np.array(f[k][1]) - at) ** 2).sum())
        assert got[k]["judged_by"] == level and got[k]["d2"] == pytest.approx(d2, rel=1e-6, abs=1e-9)
        assert got[k]["kept"] == (d2 <= quality.CUT) or abs(d2 - quality.CUT) < 1e-6
        near_cut += d2 > quality.CUT
    assert near_cut > 5 and {m[0] for m in models} == {"own", "language", "all"}
    # no random start ends in a clearly smaller determinant
    x = np.array([f[j][1] for j in good if docs[j][1:3] == ("en", "a")])
    rng, floors = np.random.default_rng(4), np.diag(np.array(quality.FLOORS) ** 2)
    least = np.inf
    for _ in range(200):
        kept = x[rng.choice(len(x), 6, replace=False)]
        for _ in range(30):
            at, c = kept.mean(0), np.cov(kept.T, bias=True) * quality.CONSISTENT + floors
            d2 = np.einsum("ij,jk,ik->i", x - at, np.linalg.inv(c), x - at)
            kept = x[np.argsort(d2, kind="stable")[: int(np.ceil(0.75 * len(x)))]]
        least = min(least, np.linalg.slogdet(c)[1])
    assert models["own", "en", "a"][0] <= least + 0.25


def test_chat_edges(spark):
    schema = "pair_id long, side int, conv_id long, turn long, role string, text string, prompt string"
    long = "w " * 100_000
    rows = [(0, 0, 0, 1, "user", long, "x"), (0, 0, 0, 1, "user", long, "x"), (0, 1, 1, 1, "user", long, "x"), (1, 0, 2, 1, "user", "a <|assistant|> b", None), (2, 1, 5, None, None, None, None)]
    got = {r["pair_id"]: r for r in chat.format_pairs(spark.createDataFrame(rows, schema)).collect()}
    assert got[0]["n_prompt_turns"] == 1 and got[0]["chosen"] == f"<|user|>\n{long}\n" and got[0]["rejected"] == ""  # a repeated row is a turn
    assert got[1]["chosen"] == "<|user|>\na <\\|assistant|> b\n" and got[1]["chosen_mask"] == "9:0,19:0" and got[1]["rejected"] == ""
    assert got[2]["rejected"] == "<|unknown|>\n\n" and got[2]["chosen"] == ""
    assert chat.format_pairs(spark.createDataFrame([], schema)).count() == 0
    for r in got.values():
        for side in ("chosen", "rejected"):
            assert sum(int(x.split(":")[0]) for x in r[f"{side}_mask"].split(",") if x) == len(r[side])


def test_top_k_edges(spark):
    rows = [(0, [0.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (1, [1.0, 0.0], "b"), (2, [-1.0, 2.0], "c"), (3, [], "d"), (100, [0.5, 0.5], "e")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(vectors, vectors.filter("vec_id % 100 = 0")).collect())
    assert got == [(0, 1, 1, 0), (0, 2, 1, 0), (0, 3, 2, 0), (0, 4, 100, 0), (100, 1, 1, 524288), (100, 2, 1, 524288), (100, 3, 2, 524288), (100, 4, 0, 0)]


def test_top_k_of_large_components(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0]), (3, [0.5, 0.25]), (100, [1.0, 3e9])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(vectors, vectors.filter("vec_id % 100 = 0")).collect()}
    most = 2**63 - 1
    assert [got[0, k] for k in (1, 2, 3, 4)] == [(1, most), (3, most), (100, most), (2, -most - 1)]
    assert [got[100, k][0] for k in (1, 2, 3, 4)] == [0, 1, 3, 2]


def test_licences_equal_brute_force(spark, odd):
    r = random.Random(10)
    texts, sets = [], {n: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for n, t in licences.TEMPLATES.items() for w in [licences.words(t).decode().split()]}
    for name in sorted(licences.TEMPLATES):
        for share in (0.0, 0.01, 0.03, 0.06, 0.15):
            w = ["edited" if r.random() < share else x for x in licences.TEMPLATES[name].split()]
            texts.append(" ".join([*(f"x{r.randint(0, 999)}" for _ in range(r.randint(0, 700))), *w, *(f"y{r.randint(0, 999)}" for _ in range(r.randint(0, 700)))]))
    index = licences.Index(licences.TEMPLATES)
    size = {index.names[k]: w for w, _, minima, _ in index.classes for k in minima}
    want = set()
    for k, t in enumerate(texts):
        w = licences.words(t).decode().split()
        grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
        for name, s in sets.items():
            if any(100 * len(s & set(grams[at : at + size[name]])) >= 80 * len(s) for at in range(0, len(grams), max(1, size[name] // 2))):
                want.add((k, name))
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, licence string")
    rows = licences.scan(docs).collect()
    got = {(x["doc_id"], x["licence"]) for x in rows}
    assert got <= want and len(got) >= 0.995 * len(want) and len(want) > 60
    assert all(100 * x["containment"] >= 80 for x in rows) and licences.scan(odd.limit(0)).count() == 0
    five = " ".join(f"v{k}" for k in range(9))  # five shingles: four of them are exactly 80 %
    got = licences.Index({"five": five}).scan("a " + " ".join(five.split()[:8]) + " b")
    assert got and got[0][1] == 0.8 and not licences.Index({"five": five}).scan("a " + " ".join(five.split()[:7]) + " b")


def slow_grams(text):
    out, w = collections.Counter(), "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    padded = " " + " ".join(w) + " "
    for k in range(len(padded)):
        for n in (1, 2, 3):
            g = padded[k : k + n]
            if len(g) == n and g != " " and not (n == 3 and g[1] == " "):
                out[g] += 1
    return out if w else collections.Counter()


def slow_order(counts, n):
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:n]]


def test_language_equals_brute_force(spark, odd):
    r = random.Random(11)
    letters = {"aa": "abcdeé ", "bb": "cdefgß ", "cc": "aeghçi  "}
    rows = [(k, "".join(r.choice(letters[lang]) for _ in range(r.randint(0, 90))) + r.choice(["", " 12!", "\n", " Ä", " 語"]), lang) for k in range(150) for lang in [r.choice(sorted(letters))]]
    rows += [rows[3], (None, "abc dé", "aa"), (200, LONG, None), (201, None, "bb"), (202, "", "bb"), (203, "34 ?", "cc")]
    docs = spark.createDataFrame([(*x, k % 3 == 1, "und") for k, x in enumerate(rows)], "doc_id long, text string, lang string, held_out boolean, lang_pred string")
    trained = docs.filter("not held_out and lang is not null and text is not null")
    profiles = {}
    for lang in sorted(letters):
        total = collections.Counter()
        for k, x in enumerate(rows):
            if k % 3 != 1 and x[2] == lang and x[1] is not None:
                total += slow_grams(x[1])
        profiles[lang] = slow_order(total, language.PROFILE)
    want = collections.Counter()
    for k, x in enumerate(rows):
        own = slow_order(slow_grams(x[1]), language.OWN)
        far = {lang: sum(abs(p.index(g) - i) if g in p else language.PROFILE for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        want[(x[0], k % 3 == 1, best if own else "und", round(max(0.0, 1 - far[best] / (language.PROFILE * len(own))), 9) if own else 0.0)] += 1
    got = language.predict(docs, language.learn(trained)).collect()
    assert collections.Counter((x["doc_id"], x["held_out"], x["lang_pred"], round(x["score"], 9)) for x in got) == want
    assert language.predict(docs.limit(0), language.learn(trained.limit(0))).count() == 0


@pytest.mark.parametrize("name", sorted(pages.PAGES))
def test_html_of_hand_labelled_pages(name):
    """Each page by itself: nothing where there is no article, never empty where there is one, and nearly all words right."""
    raw = pages.PAGES[name]
    want = re.findall("⟦(.*?)⟧", raw, re.S)
    want = re.sub(r"<[^>]*>", " ", " ".join(want)).split()
    got = html.texts([raw.replace("⟦", "").replace("⟧", "")])[0].split()
    both = sum((collections.Counter(got) & collections.Counter(want)).values())
    assert bool(got) == bool(want)
    assert not want or 2 * both / (len(got) + len(want)) >= 0.9


def test_html_table(spark):
    page = '<nav><a href="/">Home</a></nav><article><h1>A &amp; B</h1><p title=don\'t>First   one.<p>Last one.</article><footer>&copy; c</footer>'
    long = "<article>" + "".join(f"<p>Sentence number {k} of a long story, told in full.</p>" for k in range(20_000)) + "</article>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, None), (2, "v", "", "y"), (3, "w", long, "z"), (4, "w", "<p", "z"), (5, "w", "a" * 300_000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(pages).collect()
    assert len(got) == len(rows) and sorted({x["text"] for x in got if x["page_id"] in (1, 2, None)}) == ["", "A & B First one. Last one."]
    text = next(x["text"] for x in got if x["page_id"] == 3)
    assert text.count("Sentence number") > 19_900
    assert html.extract(pages.limit(0)).count() == 0


def test_html_other_layouts():
    """Words found and words right on hand-written pages of layouts that the training pages don't have."""
    story = ["The council approved a new tram line on Monday after two years of debate.", "Work on the eastern section will start in spring, the mayor said, and should last four years.", "Residents had asked for a stop near the hospital, which the new plan includes."]
    body = "".join(f"<p>{x}</p>" for x in story)
    side = '<ul><li><a href="/a">Sports</a></li><li><a href="/b">Weather</a></li><li><a href="/c">Contact us</a></li></ul>'
    pages = [
        f'<!doctype html><html><head><title>t</title></head><body><header><div class="logo">News</div>{side}</header><main><h1>Tram line approved</h1>{body}</main><aside>{side}</aside><footer>All rights reserved.</footer></body></html>',
        f'<body><table><tr><td>{side}</td><td><h1>Tram line approved</h1>{body}</td></tr></table></body>',
        f'<body><div id="top">{side}</div><div class="post"><div class="entry-content"><h1>Tram line approved</h1>{body}</div></div><div class="comments"><p>Nice!</p><p>First!</p></div></body>',
        f'<body><section><article itemprop="articleBody"><h1>Tram line approved</h1>{body}</article></section><form><label>Mail</label><input><button>Subscribe</button></form></body>',
    ]
    want = collections.Counter(" ".join(["Tram line approved", *story]).split())
    found = right = total = 0
    for text in html.texts(pages):
        got = collections.Counter(text.split())
        found, right, total = found + sum(got.values()), right + sum((got & want).values()), total + sum(want.values())
    assert right / total > 0.85 and right / max(1, found) > 0.85


def test_jaccard_hash_of_thue_morse():
    t = "a"
    for _ in range(11):
        t += t.translate(str.maketrans("ab", "ba"))
    both = [f"x y z w {t}".encode(), f"x y z w {t.translate(str.maketrans('ab', 'ba'))}".encode()]
    h, bounds = jaccard.windows_of(both)
    assert list(bounds) == [0, 1, 2] and h[0] != h[1]


def test_jaccard_windows():
    r = random.Random(13)
    texts = [" ".join(r.choice(["a", "bb", "ccc", "é"]) for _ in range(r.randint(0, 40))).encode() for _ in range(300)]
    h, bounds = jaccard.windows_of(texts)
    seen = {}
    for t, a, b in zip(texts, bounds, bounds[1:]):
        w = t.split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) > 4 else [tuple(w)] if w else []
        assert len(grams) == b - a and (h[a:b] == jaccard.windows(t)).all()
        for g, x in zip(grams, h[a:b].tolist(), strict=True):
            assert seen.setdefault(g, x) == x
    assert len(set(seen.values())) == len(seen)


def test_mixing_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 7, "x"), (2, "c", None, 8, "y")], "doc_id long, text string, source string, _size int, size string")
    got = {r["doc_id"]: r["_rest"] for r in mixing.mix(docs, mixing.words()).collect()}
    assert (got[1]["_size"], got[1]["size"], got[2]["_size"]) == (7, "x", 8)


def test_mixing_equals_sql(spark, odd):
    import duckdb

    rows = [(x["doc_id"], x["text"], x["source"]) for x in odd.collect()] + [(None, "n m", "s1"), (None, None, None), (77, "", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, mixing.words()).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times_taken")).alias("taken")).collect()
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    theirs = c.execute(mixing.OP7_SQL).fetchall()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(theirs, key=key)


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept, against a slow version of its own."""
    import duckdb

    import corpus_pipeline
    from tokenizers import Tokenizer
    import public_tokenizers

    r = random.Random(15)
    vocabulary = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 9))) for _ in range(700)]
    line = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(8, 20)))
    shared, texts = [line() for _ in range(4)], []
    for _ in range(90):
        texts.append("\n".join([line() for _ in range(r.randint(5, 12))] + r.sample(shared, r.randint(0, 2))))
    texts += [texts[5], texts[6] + " more", texts[7].replace(" ", "  "), "$$ ## " * 40 + texts[8], None, "", "short", "a a a " * 60, LONG]
    rows = [(k if k != 11 else None, t, "en", None if k % 9 == 0 else f"s{k % 3}", len(t or ""), f"tag{k}") for k, t in enumerate(texts)] + [(30, "another text under the same id " + line() + line() + line() + line() + line(), "en", "s0", 1, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gone string")
    done = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{len(done)}")
        was, docs = docs, spark.read.parquet(f"{tmp_path}/{len(done)}")
        done.append((name, was.collect(), docs.collect()))
        if name != "best-fit packing":
            assert docs.columns == was.columns
    by = {name: (was, now) for name, was, now in done}
    # quality rules
    was, now = by["quality rules"]
    assert {x["gone"] for x in was} - {x["gone"] for x in now} >= {f"tag{k}" for k in range(94, 98)} and len(now) > 80
    # line dedup
    was, now = by["line dedup"]
    seen, want = [], {}
    order = spark.createDataFrame([(x["gone"], x["text"]) for x in was], "gone string, text string").select("gone", F.xxhash64("text").alias("h")).collect()
    h = {x["gone"]: x["h"] for x in order}
    for x in sorted(was, key=lambda x: (x["doc_id"] is not None, x["doc_id"] or 0, h[x["gone"]])):
        kept = []
        for own in x["text"].split("\n"):
            s = set(words(own))
            if not s or not any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                kept.append(own)
            if s:
                seen.append(s)
        want[x["gone"]] = "\n".join(kept)
    assert {x["gone"]: x["text"] for x in now} == want and all(x["n_chars"] == len(x["text"]) for x in now)
    assert any(len(x["text"]) < len(next(y["text"] for y in was if y["gone"] == x["gone"])) for x in now)
    # n-gram Jaccard join
    was, now = by["n-gram Jaccard join"]
    grams = {}
    for x in was:
        w = words(x["text"].lower())
        grams[x["gone"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    links = [(a, b) for a, b in itertools.combinations(was, 2) if None not in (a["doc_id"], b["doc_id"]) and grams[a["gone"]] and 100 * len(grams[a["gone"]] & grams[b["gone"]]) >= 80 * len(grams[a["gone"]] | grams[b["gone"]])]
    label = {x["doc_id"]: x["doc_id"] for x in was if x["doc_id"] is not None}
    for _ in range(len(links)):
        for a, b in links:
            label[a["doc_id"]] = label[b["doc_id"]] = min(label[a["doc_id"]], label[b["doc_id"]])
    assert {x["gone"] for x in now} == {x["gone"] for x in was if x["doc_id"] is None or not grams[x["gone"]] or label[x["doc_id"]] == x["doc_id"]}
    # mixing
    was, now = by["mixing"]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", [[x["doc_id"], x["text"], x["source"]] for x in was])
    want = collections.Counter()
    for one, size, _, _, taken in c.execute(mixing.OP7_SQL).fetchall():
        want[one] += taken
    got = collections.Counter()
    for x in now:
        got[x["doc_id"]] += len(words(x["text"]))
    assert +got == +want
    # best-fit packing
    was, now = by["best-fit packing"]
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    n = [len(tok.encode(x["text"] or "", add_special_tokens=False).ids) + 1 for x in was]
    assert sum(x["length"] for x in now) == sum(n) and len(now) == sum(-(-k // 2048) for k in n)
    full = collections.Counter()
    for x in now:
        full[x["sequence_id"]] += x["length"]
    bins = []
    for p in sorted((x["length"] for x in now), reverse=True):  # best fit, piece by piece
        fits = [k for k, room in enumerate(bins) if room >= p]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= p
        else:
            bins.append(2048 - p)
    assert max(full.values()) <= 2048 and len(full) <= len(bins)


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_on_odd_rows(spark, odd, k):
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    docs = odd.withColumns({"bucket": F.lit(1), "near": F.lit("x"), "_th": F.lit("y"), "part": F.lit(2)})
    out = stage(spark, docs, SF)
    assert stage(spark, docs.limit(0), SF).count() == 0
    if k < 4:
        assert out.columns == docs.columns
    assert out.count() > 0 or k == 0  # none of these texts passes the base rules


def test_pipeline_deletes_its_own_frames_only(spark):
    import corpus_pipeline
    from quern import plans
    from quern.llm import common

    with common.scratch() as run:
        lazy = plans.QUERIES["bm25_search"](spark, SF)
        before = set(run.written)
        out = corpus_pipeline.run(spark, SF)
        assert lazy.count() > 0 and out.count() > 0
        left = set(run.written) - before
        assert len(left) == 1 and "pipeline-best-fit-packing" in left.pop()  # nothing but the result is left of the pipeline
