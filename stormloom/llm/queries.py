"""The operators' queries over whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, jaccard, line_dedup, mixing, packing, quality, ranked, runs, sharding, simhash, tokens, toxicity, urls
from .common import WORD, read_table


#: The vocabulary that token counts and packing use.
VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
SEQUENCE_TOKENS = 4096
END_ID = 1


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, public_tokenizers.path(VOCABULARY), TOKEN_LIMIT)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: whole records go through the external shuffle; the digests are taken from what arrives."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long"))
    out = sharding.external_shuffle(docs, n_shards=40, size="size", keys=["doc_id", "text"])
    return out.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host of a document is its source."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.quality_rules(docs)


OP3_SQL = rf"""
WITH page AS (SELECT *, row_number() OVER () AS page_no, coalesce(text, '') AS t FROM documents),
word AS (SELECT page_no, t, source, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS ls FROM page),
places AS (SELECT page_no, unnest(range(1, len(w) - 1)) AS i, w FROM word WHERE len(w) >= 3),
gram AS (SELECT page_no, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM places),
twice AS (SELECT page_no, i FROM gram QUALIFY count(*) OVER (PARTITION BY page_no, g) > 1),
repeated AS (SELECT page_no, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY page_no),
line AS (SELECT page_no, source, line, trim(regexp_replace(lower(line), '[ 	-
]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT page_no, source, unnest(ls) AS line FROM word) WHERE regexp_matches(line, '[^ 	-
]')),
dup AS (SELECT page_no, count(*) - count(DISTINCT line) AS n FROM line GROUP BY page_no),
total AS (SELECT source, count(*) AS pages FROM page GROUP BY source),
bad AS (SELECT l.source, l.norm FROM (SELECT source, norm, count(DISTINCT page_no) AS n FROM line GROUP BY source, norm) l
  JOIN total t ON l.source IS NOT DISTINCT FROM t.source WHERE l.n > greatest({quality.MAX_DOCS}, {quality.MAX_SHARE} * t.pages)),
gone AS (SELECT page_no, sum(len(regexp_extract_all(line, '[^ 	-
]+'))) AS n FROM line l JOIN bad b ON l.norm = b.norm AND l.source IS NOT DISTINCT FROM b.source GROUP BY page_no),
counted AS (SELECT p.doc_id, len(w.w) AS n_words, len(array_to_string(w.w, '')) AS word_chars, len(p.t) - len(regexp_replace(p.t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_frequent_words
  FROM page p JOIN word w USING (page_no) LEFT JOIN repeated r USING (page_no) LEFT JOIN dup d USING (page_no) LEFT JOIN gone g USING (page_no))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_frequent_words) >= {quality.MIN_LEFT} * n_words AS kept FROM counted
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs, carried=[]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY), SEQUENCE_TOKENS, END_ID)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host of a document is its source."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.site_line_dedup(docs).select("doc_id", "source", "n_lines", "n_dropped", "text")


LINE_DEDUP_SQL = """
WITH page AS (SELECT *, row_number() OVER () AS page_no FROM {docs}),
line AS (SELECT page_no, source, generate_subscripts(string_split(text, chr(10)), 1) AS at, unnest(string_split(text, chr(10))) AS line FROM page WHERE text IS NOT NULL),
total AS (SELECT source, count(*) AS pages FROM page GROUP BY source),
bad AS (SELECT l.source, l.line FROM (SELECT source, line, count(DISTINCT page_no) AS n FROM line WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY source, line) l
  JOIN total t ON l.source IS NOT DISTINCT FROM t.source WHERE l.n >= {min_pages} AND l.n > {ratio} * t.pages),
kept AS (SELECT l.page_no, count(*) AS n_lines, count(*) FILTER (b.line IS NOT NULL) AS n_dropped,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.at) FILTER (b.line IS NULL), '') AS text
  FROM line l LEFT JOIN bad b ON l.line = b.line AND l.source IS NOT DISTINCT FROM b.source GROUP BY l.page_no)
SELECT {columns} FROM page p LEFT JOIN kept k ON p.page_no = k.page_no
"""

OP7_SQL = LINE_DEDUP_SQL.format(docs="documents", min_pages=line_dedup.MIN_PAGES, ratio=line_dedup.RATIO, columns="p.doc_id, p.source, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped, k.text")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the fifth of documents that is held out aren't learnt from."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    scored = toxicity.score_toxicity(docs, read_table(spark, sf_dir, "labels"), fold != 0)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


def repeat_endings(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the endings of a tenth of the texts made periodic, as their ids' checksums say. A null id
    changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.withColumn("h", h).withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))))
    docs = docs.withColumn("n", F.size("words")).withColumns({"a": F.expr("CASE WHEN n > 0 THEN (h DIV 10) % n END"), "g": F.expr("h DIV 10")})
    docs = docs.withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    repeated = F.expr("array_join(transform(words, (x, i) -> get(words, cast(CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS int))), ' ')")
    return docs.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of four periods and six words or more, and digests of them and of what is left of the text."""
    found = runs.word_runs(repeat_endings(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.expr("aggregate(runs, get(runs, 0), (y, x) -> CASE WHEN x.length * y.period > y.length * x.period THEN x ELSE y END)")
    found = found.withColumn("best", best)
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: A run of period q covers two whole blocks that begin at a multiple of q and the block behind them, so few words of each
#: block tell which periods to look at.
OP11_SQL = r"""
WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS h FROM documents),
plan AS (SELECT d, n, h % 10 = 0 AS planted, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM (SELECT d, len(w) AS n, h FROM doc WHERE len(w) > 0)),
original AS (SELECT d, unnest(range(len(w))) AS i, unnest(w) AS x FROM doc),
place AS (SELECT o.d, o.i, CASE WHEN p.planted AND o.i >= p.a THEN p.a + (o.i - p.a) % p.p ELSE o.i END AS j FROM original o JOIN plan p ON p.d = o.d),
word AS MATERIALIZED (SELECT l.d, l.i, o.x FROM place l JOIN original o ON o.d = l.d AND o.i = l.j),
step AS (SELECT d, q, unnest(range(n // q - 2)) * q AS i FROM (SELECT d, n, unnest(range(1, n // 4 + 1)) AS q FROM plan)),
first AS MATERIALIZED (SELECT s.*, x FROM step s JOIN word w ON w.d = s.d AND w.i = s.i),
second AS MATERIALIZED (SELECT s.* FROM first s JOIN word w ON w.d = s.d AND w.i = s.i + s.q AND w.x = s.x),
third AS MATERIALIZED (SELECT s.d, s.q, s.i FROM second s JOIN word w ON w.d = s.d AND w.i = s.i + 2 * s.q AND w.x = s.x),
middle AS MATERIALIZED (SELECT s.*, w.x FROM third s JOIN word w ON w.d = s.d AND w.i = s.i + s.q // 2),
period AS MATERIALIZED (SELECT DISTINCT s.d, s.q FROM middle s JOIN word w ON w.d = s.d AND w.i = s.i + s.q // 2 + s.q AND w.x = s.x),
every AS MATERIALIZED (SELECT p.d, p.q, w.i, w.x FROM period p JOIN word w ON w.d = p.d),
same AS (SELECT e.d, e.q, e.i, e.i - row_number() OVER (PARTITION BY e.d, e.q ORDER BY e.i) AS island FROM every e JOIN word w ON w.d = e.d AND w.i = e.i + e.q AND w.x = e.x),
stretch AS (SELECT d, q, min(i) AS start, count(*) + q AS length FROM same GROUP BY d, q, island),
run AS (SELECT d, start, length, min(q) AS period FROM stretch WHERE length >= greatest(6, 4 * q) GROUP BY d, start, length),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY d ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
listed AS (SELECT d, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM run GROUP BY d),
gone AS (SELECT DISTINCT d, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT w.d, string_agg(w.x, ' ' ORDER BY w.i) AS t FROM word w LEFT JOIN gone g ON g.d = w.d AND g.i = w.i WHERE g.d IS NULL GROUP BY w.d)
SELECT doc.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM doc LEFT JOIN best b ON b.d = doc.d LEFT JOIN listed l ON l.d = doc.d LEFT JOIN kept k ON k.d = doc.d
"""


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.jaccard_components(docs)


OP12_SQL = r"""
WITH RECURSIVE doc AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
gram AS MATERIALIZED (SELECT DISTINCT d, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM doc),
size AS MATERIALIZED (SELECT d, count(*) AS n FROM gram GROUP BY d),
shared AS (SELECT a.d AS x, b.d AS y, count(*) AS k FROM gram a JOIN gram b ON a.g = b.g AND a.d <> b.d GROUP BY a.d, b.d),
link AS MATERIALIZED (SELECT x, y FROM shared JOIN size a ON a.d = x JOIN size b ON b.d = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
reach AS (SELECT d, d AS r FROM doc UNION SELECT reach.d, y FROM reach JOIN link ON x = r)
SELECT any_value(doc.doc_id) AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other.doc_id) AS component_id
FROM doc JOIN reach ON reach.d = doc.d JOIN doc other ON other.d = reach.r LEFT JOIN size ON size.d = doc.d GROUP BY doc.d
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark passage."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked.ranked_search(docs, read_table(spark, sf_dir, "benchmark"), k=50)


OP13_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
corpus AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM doc WHERE len(w) > 0),
size AS (SELECT d, doc_id, 50 + (50 * len(w) * corpus.n) // corpus.l AS m FROM doc, corpus WHERE len(w) > 0),
posting AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM doc) GROUP BY d, t),
term AS (SELECT t, CAST(floor(1000 * ln((2 * max(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posting, corpus GROUP BY t),
score AS (SELECT i.q, i.item_id, s.doc_id, s.d, CAST(sum(t.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * s.m))) AS BIGINT) AS score
  FROM (SELECT q, item_id, unnest(w) AS t FROM item) i JOIN term t ON t.t = i.t JOIN posting p ON p.t = i.t JOIN size s ON s.d = p.d GROUP BY i.q, i.item_id, s.doc_id, s.d)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, d) AS INTEGER) AS rank, doc_id, score FROM score WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, d) <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_sharding, op3_quality, op4_exact_dedup, op5_mixing, op6_packing, op7_line_dedup, op8_simhash, op9_url_filter, op10_toxicity, op11_runs, op12_jaccard_join, op13_ranked_search)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op7_line_dedup": OP7_SQL, "op11_runs": OP11_SQL, "op12_jaccard_join": OP12_SQL, "op13_ranked_search": OP13_SQL}
