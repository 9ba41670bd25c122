"""SQL for DuckDB that gives the rows of the queries, where SQL can."""

from __future__ import annotations

from effectgrid.llm.url_rules import url_sql

#: A-Z to a-z and nothing else.
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def classes_sql(source: str) -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, {SPACE_WORDS.format(LOW)} AS w FROM {source}),
sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i+4], ' ') ELSE array_to_string(w, ' ') || ' ' || len(w) END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM {source}
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
),
classes AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1),
alike AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY members) AS class_id
  FROM (SELECT doc_id, string_agg(s, chr(10) ORDER BY s) AS members FROM sets GROUP BY 1)),
degree AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id,
  coalesce(a.class_id, d.doc_id) AS class_id, coalesce(g.n_links, 0) AS n_links
FROM {source} d JOIN classes c USING (doc_id) LEFT JOIN n USING (doc_id)
LEFT JOIN alike a USING (doc_id) LEFT JOIN degree g USING (doc_id)"""


def copies_sql(source: str) -> str:
    return f"""
WITH t AS (SELECT doc_id, {LOW} AS low FROM {source})
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(low) AS text_sha256
FROM t WINDOW w AS (PARTITION BY low)"""


def contamination_sql(source: str) -> str:
    words = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(LOW)
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM {source}),
b AS (SELECT item_id, {words} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i+12], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
found AS (SELECT doc_id, item_id, i, n FROM places JOIN windows USING (n, s)),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _unit(*parts: str) -> str:
    return "(CAST('0x' || substr(md5(" + " || '/' || ".join(parts) + "), 1, 8) AS BIGINT) / 4294967296.0)"


def mixing_sql(source: str, block_words: int = 50_000) -> str:
    """Targets by raising the level source by source; blocks and documents by their md5; all copies that fit, in their order."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len({SPACE_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size, {_unit("'block'", "doc_id")} AS u FROM {source}
),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (k - 1) % 3] AS weight, 3.0 * source_size AS lim FROM s),
levels AS (  -- the level is where the sum of min(limit, level * weight) is the whole
  SELECT a.lim / a.weight AS level, sum(least(b.lim, a.lim / a.weight * b.weight)) AS given,
    sum(CASE WHEN b.lim / b.weight <= a.lim / a.weight THEN b.lim ELSE 0 END) AS stopped,
    sum(CASE WHEN b.lim / b.weight <= a.lim / a.weight THEN 0 ELSE b.weight END) AS open
  FROM w a, w b GROUP BY a.k, a.lim, a.weight
),
below AS (
  SELECT coalesce(max_by(stopped, level), 0) AS stopped, coalesce(max_by(open, level), (SELECT sum(weight) FROM w)) AS open
  FROM levels WHERE given <= (SELECT sum(source_size) FROM w)
),
t AS (
  SELECT source, source_size,
    least(lim, CASE WHEN open > 0 THEN ((SELECT sum(source_size) FROM w) - stopped) / open * weight ELSE lim END) AS target
  FROM w, below
),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-9) AS INTEGER) ELSE 0 END AS passes,
    greatest(1, CAST(ceil(source_size / {block_words}.0) AS BIGINT)) AS blocks FROM t
),
x AS (
  SELECT d.*, source_size, target, passes, greatest(0, target - passes * source_size) AS part, CAST(floor(u * blocks) AS BIGINT) AS block
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
),
e AS (  -- a place for every copy that may fill what is missing after whole passes
  SELECT doc_id, source, size, u, copy, floor(part + 1e-6)::BIGINT AS room, row_number() OVER (PARTITION BY source ORDER BY copy, block, u, doc_id) AS pos
  FROM (SELECT *, unnest(range(passes, 3)) AS copy FROM x WHERE size > 0)
),
f AS (  -- every document that still fits is taken: up to the first that does not, and on from there
  SELECT doc_id, source, size, pos, room AS gap, FALSE AS took FROM e
  UNION ALL
  SELECT doc_id, source, size, pos, gap - coalesce(sum(size) FILTER (new) OVER (PARTITION BY source), 0)::BIGINT, new
  FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY pos) <= gap AS new FROM f WHERE NOT took AND size <= gap)
),
k AS (SELECT doc_id, count(*) AS n, sum(size) AS used FROM f WHERE took GROUP BY doc_id),
h AS (
  SELECT x.*, coalesce(k.n, 0) AS n, floor(part + 1e-6)::BIGINT - coalesce(sum(k.used) OVER (PARTITION BY x.source), 0) AS gap
  FROM x LEFT JOIN k USING (doc_id)
),
r AS (
  SELECT *, n = 0 AND passes < 3 AND abs(size - gap) < gap AS may,
    row_number() OVER (PARTITION BY source, n = 0 AND passes < 3 AND abs(size - gap) < gap ORDER BY abs(size - gap), u, doc_id) AS near FROM h
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(size * (passes + n + CASE WHEN may AND near = 1 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r"""


RECORDS = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
f AS (SELECT *, sha256(payload) AS d, octet_length(payload) AS n, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM f"""


DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
),
words AS (SELECT n, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY 1, 2 HAVING count(DISTINCT n) >= 10),
c AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
g AS (
  SELECT lang, source, (SELECT count(*) FROM kept k WHERE k.lang = x.lang) AS v,
    coalesce((SELECT sum(c.c) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) x
),
l AS (SELECT lang, max(v) AS v, sum(n) AS n FROM g GROUP BY lang),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (g.n + 2 * g.v)::HUGEINT AS p
  FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
),
q AS (
  SELECT l.lang, term, 1 + (1000000000::HUGEINT * (t.c + 2)) // (l.n + 2 * l.v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(c.c) AS c FROM c GROUP BY ALL) t JOIN l USING (lang)
),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
),
terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10"""


ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": classes_sql("documents"),
    "op4_warc": RECORDS,
    "op5_decontamination": contamination_sql("documents"),
    "op8_exact_dedup": copies_sql("documents"),
    "op9_mixing": mixing_sql("documents"),
    "op11_url_filters": url_sql(),
    "op13_source_divergence": DIVERGENCE,
}
