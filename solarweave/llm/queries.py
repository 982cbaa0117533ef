"""The queries of this subpackage, each a thin use of its operator over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import public_tokenizers

from solarweave.llm import audit, bpe, divergence, lines, media, mixing, neardup, quality, secretscan, substring, topk, toxicity, urls
from solarweave.storage import stored, table


def op1_top_k(spark, sf_dir):
    """The 5 highest integer inner products of each vector whose vec_id is divisible by 50, with all others: query_id, rank, vec_id, score.

    Vectors that are null or hold null, NaN or infinite components take no part, nor do null ids; of a
    repeated id the least vector counts. Ties go to the smaller vec_id. An empty table gives no row.
    """
    vectors = stored(topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return topk.top_k(vectors, vectors.filter("id % 50 = 0"), 5)


def op2_bpe(spark, sf_dir):
    """Every document's n_tokens, ids_sha256 and decoded_sha256, as the tokenizers library encodes and decodes the whole text.

    Null and empty texts have no tokens and decode to nothing. Repeated rows come out repeated, null ids
    stay null, an empty table gives no row.
    """
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op3_quality(spark, sf_dir):
    """Every document's held_out, score and predicted (score >= 0.3) for quality.

    Empty and null texts have a score too. Null ids aren't held out; null labels teach nothing. Repeated
    rows come out repeated; without labels every score is 0.5.
    """
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_url_filter(spark, sf_dir):
    """Every page's host, path, rule and verdict: that of its longest rule, else that of the pages it is linked with.

    Null urls and those without :// have empty host and path and are allowed; null html has no links.
    Repeated rows come out repeated.
    """
    return urls.judged(table(spark, sf_dir, "pages"))


def op5_toxicity(spark, sf_dir):
    """Every document's held_out, score and predicted (score >= 0.5) for toxicity.

    Empty and null texts have the score of no feature, below 0.5. Null ids aren't held out; null labels
    count for nothing. Repeated rows come out repeated; without confirmed examples every score is 0.
    """
    docs = table(spark, sf_dir, "documents")
    return toxicity.fitted_and_scored(docs, table(spark, sf_dir, "labels"))


def op6_near_duplicates(spark, sf_dir):
    """Every document's n_shingles, component_id and kept, by links of similarity 0.75 or more.

    Null and empty texts have no shingles and stand alone; null ids are nobody's component_id. Repeated
    rows come out repeated. Very long texts count whole.
    """
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_repeated_substrings(spark, sf_dir):
    """Passages of 200 bytes or more that another document, of smaller id, holds as well: doc_id, th, start, stop, n_chunks, first_doc_ids.

    What a text repeats in itself alone is left to the operator (within). Null and empty texts have no
    passage; a null id comes after all others; repeated rows count once.
    """
    return substring.repeats(table(spark, sf_dir, "documents"), within=False)


def op8_secrets(spark, sf_dir):
    """Every document's counts and spans of secrets: fixed patterns and, besides, what the network finds.

    Null and empty texts have none and the digest of nothing. Repeated rows come out repeated; null ids stay null.
    """
    docs = table(spark, sf_dir, "documents")
    return secretscan.found_secrets(docs, secretscan.fit(docs))


def op9_jpeg(spark, sf_dir):
    """Every document's text as a JPEG and back: sizes, digests of payload and file, and the thumbnail's hash.

    Null and empty texts are 192 spaces. Repeated rows come out repeated; equal texts have equal values.
    """
    return media.media_columns(table(spark, sf_dir, "documents"), media=False)


def op10_mixing(spark, sf_dir):
    """Every document's size, its source's size and target, and the words that the mix takes of it.

    Null texts have size 0, null sources are one source, the last in order. Repeated rows are taken
    alike; reruns agree; an empty table gives no row.
    """
    out = mixing.rates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_line_dedup(spark, sf_dir):
    """Every document's n_lines, n_dropped and kept_sha256, without the lines that 5 documents or more hold.

    Keys have 40 code points or more; the largest doc_id that holds one keeps it. Null and empty texts
    are one empty line. Rows of one id are one document, and so are all rows without id. Repeated rows
    come out repeated; an empty table gives no row.
    """
    out = lines.deduped(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op12_filter_audit(spark, sf_dir):
    """What each of five filters keeps, removes and shares with others, in all 120 orders, step by step, for each source.

    Null texts are empty, null sources the empty string. Null ids have no smaller id, so E keeps them;
    of several labels of an id each 1 counts. Repeated rows count each; an empty table gives no row.
    """
    return audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_divergence(spark, sf_dir):
    """Each source's divergence from each other source of its language, and its 200 most distinctive terms: lang, source, part, item, value, rank.

    Null lang, source and text are empty; a source without terms is compared too. Repeated rows count
    each; an empty table gives no row.
    """
    return divergence.audited(table(spark, sf_dir, "documents"))


def _resolved(name: str, source: str, target: str, base: str, keep: str) -> str:
    """SQL of a table name with t: target as a full url from base, . and .. folded; keep are its other columns."""
    part = lambda x, pattern: f"regexp_extract({x}, '{pattern}', 1)"
    start, query = r"^([^?#]*)", r"^[^?#]*(\?[^#]*)"
    root, page = part(base, "^([^:/?#]+://[^/?#]*)"), part(base, start)
    own = f"regexp_replace(substr({page}, length({root}) + 1), '[^/]*$', '')"
    way = f"CASE WHEN {target} LIKE '/%' THEN '' WHEN {own} = '' THEN '/' ELSE {own} END || {part(target, start)}"
    steps = "list_reduce(list_concat([''], string_split(way, '/')[2:]), lambda o, s: CASE WHEN s = '..' THEN regexp_replace(o, '/[^/]*$', '') WHEN s = '.' THEN o ELSE o || '/' || s END)"
    return rf"""{name}_way AS (SELECT {keep}, {target} AS x, {base} AS y, {way} AS way FROM {source}),
{name}_folded AS (SELECT *, {steps} || CASE WHEN regexp_matches(way, '/\.\.?$') THEN '/' ELSE '' END AS fold FROM {name}_way),
{name} AS (SELECT * EXCLUDE (x, y, way, fold), CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN x WHEN x LIKE '//%' THEN {part("y", "^([^:/?#]+:)")} || x WHEN x LIKE '?%' THEN {part("y", start)} || x
  WHEN x LIKE '#%' THEN {part("y", start)} || {part("y", query)} ELSE {part("y", "^([^:/?#]+://[^/?#]*)")} || fold || {part("x", "^[^?#]*(.*)$")} END AS t FROM {name}_folded)"""


QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_url_filter": op4_url_filter,
    "op5_toxicity": op5_toxicity,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_repeated_substrings": op7_repeated_substrings,
    "op8_secrets": op8_secrets,
    "op9_jpeg": op9_jpeg,
    "op10_mixing": op10_mixing,
    "op11_line_dedup": op11_line_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_divergence": op13_divergence,
}

SQL = {
    "op1_top_k": """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
one AS (SELECT vec_id, min(v) AS v FROM ints GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM one q JOIN one c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op4_url_filter": rf"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
rest AS (SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (SELECT page_id, url, html, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
page AS (SELECT *, CASE WHEN host <> '' THEN host || path || regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) END AS node FROM split),
tags AS (SELECT node, url, regexp_extract(html, '(?is)<base\b[^>]*>') AS base, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM page WHERE node IS NOT NULL AND regexp_matches(html, '(?i)canonical|http-equiv')),
named AS (SELECT *, unnest(['base', 'rel', 'http-equiv', 'href', 'content']) AS name FROM tags),
found AS (SELECT node, url, tag, name, trim(regexp_replace(regexp_extract(CASE WHEN name = 'base' THEN base ELSE tag END, '(?is)\s' || CASE WHEN name = 'base' THEN 'href' ELSE name END || '\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g'), ' ') AS raw FROM named),
plain AS (SELECT * REPLACE (replace(replace(replace(replace(replace(replace(replace(raw, '&quot;', '"'), '&#39;', ''''), '&#x2F;', '/'), '&#47;', '/'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS raw) FROM found),
wide AS (SELECT node, url, max(raw) FILTER (name = 'base') AS base, max(raw) FILTER (name = 'rel') AS rel, max(raw) FILTER (name = 'http-equiv') AS equiv, max(raw) FILTER (name = 'href') AS href, max(raw) FILTER (name = 'content') AS content
  FROM plain GROUP BY node, url, tag),
refs AS (SELECT node, url AS page_url, base, CASE WHEN regexp_matches(' ' || lower(rel) || ' ', '\scanonical\s') THEN href
  WHEN lower(equiv) = 'refresh' THEN trim(regexp_replace(regexp_extract(content, '(?is)url\s*=\s*(.*)$', 1), '^["'']|["'']$', '', 'g'), ' ') END AS target FROM wide),
asked AS (SELECT node, page_url, target, CASE WHEN base <> '' THEN base ELSE page_url END AS own FROM refs WHERE target <> ''),
{_resolved("base", "asked", "own", "page_url", "node, target")},
{_resolved("full_target", "base", "target", "t", "node")},
target AS (SELECT node AS a, translate(regexp_extract(substr(t, instr(t, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(t, instr(t, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(t, '^[^?#]*(\?[^#]*)', 1) AS query FROM full_target WHERE regexp_matches(t, '(?i)^https?://')),
edge AS (SELECT DISTINCT a, host, path, host || path || query AS b FROM target),
places AS (SELECT DISTINCT host, path, node FROM page UNION SELECT host, path, b FROM edge),
fits AS (SELECT host, path, node, verdict, h || p AS rule, row_number() OVER (PARTITION BY host, path ORDER BY length(h || p) DESC, verdict) AS n
         FROM places JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
ruled AS (SELECT * FROM fits WHERE n = 1),
pairs AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT DISTINCT node AS a, node AS b FROM places UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
shared AS (SELECT r.a AS node, bool_and(x.verdict = 'block') AS blocked FROM reach r JOIN ruled x ON r.b = x.node GROUP BY r.a)
SELECT p.page_id, p.host, p.path, x.rule, coalesce(x.verdict, CASE WHEN s.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM page p LEFT JOIN ruled x ON p.host = x.host AND p.path = x.path LEFT JOIN shared s ON p.node = s.node
""",
    "op6_near_duplicates": """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS met FROM items x JOIN items y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met WHERE 100 * met >= 75 * (na + nb - met)),
pairs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN pairs l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN least l USING (doc_id)
""",
    "op10_mixing": """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         sha256(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(source, '') || ':' || coalesce(text, '')) AS h1, h1 || sha256(h1) AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM src),
steps AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM ranked),
level AS (SELECT max(((total - capped)::DOUBLE / free::DOUBLE)) AS v FROM steps WHERE ((total - capped)::DOUBLE / free::DOUBLE) * weight <= 3 * source_size),
goal AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, v * weight) AS target FROM ranked, level),
rate AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM goal),
drawn AS (
  SELECT s.doc_id, s.source, s.size, r.source_size, r.target, floor(r.rate)::BIGINT AS base, k,
         ('0x' || substr(s.h, 8 * k + 1, 8))::BIGINT / 4294967296.0::DOUBLE < r.rate - floor(r.rate) AS extra,
         row_number() OVER () AS n
  FROM sized s JOIN rate r ON s.source IS NOT DISTINCT FROM r.source, (SELECT unnest(range(16))::BIGINT AS k)),
best AS (
  SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY abs(any_value(base * source_size) + sum(CASE WHEN extra THEN size ELSE 0 END) - any_value(target)), k) AS place
  FROM drawn GROUP BY source, k)
SELECT d.doc_id, d.size, d.source_size, d.target, d.size * (d.base + extra::BIGINT) AS taken
FROM drawn d JOIN best b ON d.source IS NOT DISTINCT FROM b.source AND d.k = b.k AND b.place = 1
""",
    "op11_line_dedup": """
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT n, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM docs),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
repeated AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40 GROUP BY key
  HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INTEGER) >= 5),
judged AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.holder AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY n
""",
    "op12_filter_audit": """
WITH doc AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
judged AS (
  SELECT doc_id, part, (len(w) < 200)::INTEGER + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INTEGER + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INTEGER
         + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INTEGER AS mask FROM doc),
label AS (SELECT doc_id, max(coalesce(quality = 1, false)::INTEGER) AS good, max(coalesce(toxic = 1, false)::INTEGER) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
cell AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM judged LEFT JOIN label USING (doc_id) GROUP BY part, mask),
letter(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letter a, letter b, letter c, letter d, letter e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, s::INTEGER AS s, (SELECT bit FROM letter WHERE f = o[s]) AS bit, coalesce((SELECT sum(bit) FROM letter WHERE instr(o, f) < s), 0)::INTEGER AS before FROM orders, range(1, 6) AS r(s)),
met AS (
  SELECT part, o, s, any_value(bit) AS bit, sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS removed,
         sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
         sum(good) FILTER (mask & before = 0 AND mask & bit <> 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0) AS toxic_lost
  FROM cell, steps GROUP BY part, o, s)
SELECT part, o AS filter_order, s AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM met
""",
    "op13_divergence": """
WITH doc AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
word AS (SELECT d, lang, source, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS n FROM word GROUP BY ALL HAVING count(DISTINCT d) >= 3),
own AS (SELECT lang, source, term, count(*) AS n FROM word SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM doc),
size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
words AS (SELECT lang, source, sum(n) AS n FROM own GROUP BY ALL),
cell AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(o.n, 0) + 1) // (coalesce(w.n, 0) + s.v))::HUGEINT AS p,
         (1 + 1000000000::HUGEINT * (k.n + 1) // (s.n + s.v))::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term LEFT JOIN words w ON w.lang = g.lang AND w.source = g.source),
met AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM cell x JOIN cell y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pair AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(m.value, 0) AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN met m ON m.lang = g.lang AND m.source = g.source AND m.item = h.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM cell WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
}
