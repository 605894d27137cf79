"""String functions as Column expressions: folding, tokens, set similarities, ids, URLs, names."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> dict[str, str]:
    """Each accented small letter of the Latin blocks with the letter that it decomposes to, from the Unicode tables."""
    out = {}
    for code in (*range(0xE0, 0x250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFKD", chr(code))
        if marks and all(unicodedata.combining(m) for m in marks) and chr(code) == chr(code).lower():
            out[chr(code)] = base
    return out


#: Arabic letters and digits that are written in several ways, and the one that stands for them.
ARABIC = ("أإآٱىةؤئ٠١٢٣٤٥٦٧٨٩", "اااايهوي0123456789")
#: Letters to replace, then combining marks, Arabic vowel signs and invisible characters, which have no replacement and go.
ACCENTS = (
    "".join(_plain_letters()) + ARABIC[0] + "".join(map(chr, (*range(0x300, 0x370), *range(0x64B, 0x660), 0x640, 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF))),
    "".join(_plain_letters().values()) + ARABIC[1],
)
#: Stop words of two languages; name particles; legal forms after and before a firm's name.
STOPWORDS = (
    "a an the of for in on with and or to at by as is are be was from this that it its our your "
    "au aux de des du le la les un une et ou en pour sur avec dans par ce ces cette son sa ses "
    "leur leurs l d qui que est sont plus ne pas se"
).split()
PARTICLES = "de du des la le les of the and et pour en au aux for".split()
FIRM_TAIL = "sa sas sasu sarl eurl sl slu srl spa se sca scop scic gmbh ag bv nv ltd limited inc llc plc sprl".split()
FIRM_HEAD = "ste societe ets etablissements".split()


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unaccent(x) -> Column:
    return F.translate(F.lower(_col(x)), *ACCENTS)


def normalize(x) -> Column:
    """Lower case without accents, one kind of apostrophe, single spaces."""
    return F.trim(F.regexp_replace(F.replace(unaccent(F.coalesce(_col(x), F.lit(""))), F.lit("’"), F.lit("'")), r"\s+", " "))


def tokenize(x) -> Column:
    """Runs of a-z and 0-9 of the normalised text without stop words; repeats stay."""
    return F.filter(F.regexp_extract_all(normalize(x), F.lit(r"([a-z0-9]+)"), 1), lambda t: ~t.isin(STOPWORDS))  # a set in the JVM


def fold(x) -> Column:
    """Script-agnostic: lower case without accents; everything but letters and digits becomes a space."""
    return F.trim(F.regexp_replace(unaccent(F.coalesce(_col(x), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def toks(x) -> Column:
    return F.filter(F.split(fold(x), " "), lambda t: F.length(t) > 1)


def stem(t: Column) -> Column:
    return F.when(F.length(t) > 4, F.regexp_replace(t, "[sx]$", "")).otherwise(t)


def name_tokens(x) -> Column:
    return F.array_distinct(F.transform(F.filter(toks(x), lambda t: F.length(t) > 2), stem))


def _ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def coverage(part: Column, whole: Column) -> Column:
    """Share of the tokens of part, repeats counted, that whole has."""
    return _ratio(F.size(F.filter(part, lambda t: F.array_contains(whole, t))), F.size(part))


def dice(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def overlap_coefficient(a: Column, b: Column) -> Column:
    return _ratio(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def jaccard(a: Column, b: Column) -> Column:
    return _ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def containment(name, text) -> Column:
    """Share of a name's stemmed words, particles aside, found in a text."""
    particles = F.array(*[F.lit(w) for w in PARTICLES])
    own = F.transform(F.filter(toks(name), lambda t: ~F.array_contains(particles, t)), stem)
    return coverage(own, F.transform(toks(text), stem))


def firm_key(x) -> Column:
    """A firm's folded name with dotted initials joined and legal forms taken off; one word always stays."""
    joined = F.regexp_replace(fold(x), r"(?<=\b[a-z]) (?=[a-z]\b)", "")
    tail = F.regexp_replace(joined, rf"(?<=\S)( ({'|'.join(FIRM_TAIL)}))+$", "")
    return F.regexp_replace(tail, rf"^(({'|'.join(FIRM_HEAD)}) )+(?=\S)", "")


def fnv(x) -> Column:
    """32-bit FNV-1a over code points, base 36."""
    points = F.transform(F.filter(F.split(_col(x), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    hashed = F.aggregate(points, F.lit(0x811C9DC5), lambda h, c: (h.bitwiseXOR(c) * F.lit(0x01000193)) % F.lit(1 << 32))
    return F.lower(F.conv(hashed.cast("string"), 10, 36))


def url_host(x) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(F.lower(_col(x)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), r":(80|443)$", ""), r"^www\.", "")


def normal_url(x) -> Column:
    """No fragment, host in lower case without a default port, no slash at the end."""
    u = F.regexp_replace(_col(x), "#.*$", "")
    head = F.regexp_replace(F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)), r":(80|443)$", "")
    return F.regexp_replace(F.concat(head, F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1)), "/$", "")


def without_parameters(x, names: list[str]) -> Column:
    """A URL without the named query parameters."""
    u = normal_url(x)
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    drop = F.array(*[F.lit(n) for n in names])
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.array_contains(drop, F.lower(F.split(p, "=")[0]))), "&")
    return F.concat(F.regexp_replace(u, r"\?.*$", ""), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def url_key(x) -> Column:
    """Path without "www." and trailing slash, with sorted parameters."""
    u = F.regexp_replace(normal_url(x), r"://www\.", "://")
    params = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: p != "")), "&")
    return F.concat(F.regexp_replace(F.regexp_replace(u, r"\?.*$", ""), "/$", ""), F.when(params == "", "").otherwise(F.concat(F.lit("?"), params)))


def strip_markup(x) -> Column:
    """HTML to text: scripts, styles and tags out, five references decoded, single spaces."""
    t = F.regexp_replace(_col(x), r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def money(x) -> Column:
    """Number with European or English separators: the last mark before one or two digits is the decimal one."""
    digits = F.regexp_replace(_col(x), r"[^0-9.,-]", "")
    decimal = F.regexp_extract(digits, r"[.,]([0-9]{1,2})$", 1)
    whole = F.regexp_replace(F.when(decimal == "", digits).otherwise(F.regexp_replace(digits, r"[.,][0-9]{1,2}$", "")), "[.,]", "")
    return F.when(decimal == "", whole).otherwise(F.concat(whole, F.lit("."), decimal)).try_cast("double")


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))
