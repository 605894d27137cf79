"""DuckDB fragments that state the string functions of quern.functions.text for the oracles."""

from quern.functions import text as T


def unaccent(x: str) -> str:
    """By the database's own table of accents."""
    return f"strip_accents(lower({x}))"


def normalize(x: str) -> str:
    return f"trim(regexp_replace(replace({unaccent(f"coalesce({x}, '')")}, '’', ''''), '\\s+', ' ', 'g'))"


def tokens(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.STOPWORDS)
    return f"list_filter(regexp_extract_all({normalize(x)}, '[a-z0-9]+'), lambda t: NOT list_contains([{stop}], t))"


def fold(x: str) -> str:
    return f"trim(regexp_replace({unaccent(f"coalesce({x}, '')")}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_filter(string_split({fold(x)}, ' '), lambda t: length(t) > 1)"


def stem(x: str) -> str:
    return f"(CASE WHEN length({x}) > 4 THEN regexp_replace({x}, '[sx]$', '') ELSE {x} END)"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '\\s+'), lambda w: w <> '')"


#: Chunks of documents: 200 words every 150.
CHUNKS = f"""
w AS (SELECT *, {words('text')} AS w FROM documents),
chunks AS (
  SELECT doc_id, lang, source, c AS chunk_no, array_to_string(w[c * 150 + 1 : c * 150 + 200], ' ') AS chunk
  FROM (SELECT *, unnest(range(CAST(CASE WHEN len(w) <= 200 THEN 1 ELSE ceil((len(w) - 200) / 150.0) + 1 END AS BIGINT))) AS c FROM w))"""

#: BM25 of queries q(query_id, text) over chunks; scores rounded to 6 decimals.
BM25 = f"""
{CHUNKS},
tok AS (SELECT doc_id, lang, chunk_no, {tokens('chunk')} AS t FROM chunks),
stat AS (SELECT count(*) AS n, avg(len(t)) AS avglen FROM tok),
post AS (SELECT doc_id, lang, chunk_no, len, term, count(*) AS tf FROM (SELECT doc_id, lang, chunk_no, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY ALL),
idf0 AS (SELECT term, ln((SELECT n FROM stat) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post GROUP BY term),
idf AS (SELECT term, CASE WHEN idf < 0 THEN (SELECT avg(idf) * 0.25 FROM idf0) ELSE idf END AS idf FROM idf0),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens('text')}) AS term FROM q) GROUP BY ALL),
hits AS (
  SELECT query_id, doc_id, lang, chunk_no,
         round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avglen FROM stat)))), 6) AS score
  FROM post JOIN idf USING (term) JOIN asked USING (term) GROUP BY ALL),
pos AS (SELECT * FROM hits WHERE score > 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_no) AS r FROM pos) WHERE r = 1)"""
