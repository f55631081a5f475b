"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def source_divergence(min_docs: int = 10, top: int = 10) -> str:
    """Twin of ``op11``: shares and distances as wide integers."""
    share = "1 + (1000000000::HUGEINT * ({n} + 2)) // ({whole} + 2 * v)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all({_LOWER.format('text')}, '{_LETTERS}')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= {min_docs}),
used AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS whole FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN used USING (lang, source) GROUP BY lang, source),
cells AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, {share.format(n='coalesce(n, 0)', whole='whole')} AS p
  FROM g JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN used ON used.lang = g.lang AND used.source = g.source AND used.term = kept.term),
whole AS (SELECT lang, term, {share.format(n='n', whole='whole')} AS q FROM (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS whole FROM used GROUP BY lang, term) JOIN size USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM cells JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""


def vector_codes(entries: int = 256, parts: int = 4, rounds: int = 4) -> str:
    """Twin of ``op12``: every round compares every part with every entry."""
    ctes = [f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS k, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            f"p AS (SELECT k, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) r(part))",
            f"book0 AS (SELECT part, k AS entry, x AS e FROM p WHERE k < {entries})"]
    near = """SELECT k, part, min((far, entry)).entry AS entry, min((far, entry)).far AS far FROM (
  SELECT k, p.part, entry, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i])))::BIGINT AS far FROM p JOIN book{r} b ON b.part = p.part) GROUP BY k, part"""
    near = near.replace("min((far, entry)).entry", "arg_min(entry, (far, entry))").replace("min((far, entry)).far", "min(far)")
    for r in range(rounds):
        ctes.append(f"near{r} AS MATERIALIZED ({near.format(r=r)})")
        ctes.append(f"""mean{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM (
  SELECT part, entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM p JOIN near{r} USING (k, part), unnest(range(1, len(x) + 1)) u(i) GROUP BY part, entry, i) GROUP BY part, entry)""")
        ctes.append(f"book{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.e, b.e) AS e FROM book{r} b LEFT JOIN mean{r} m USING (part, entry))")
    ctes.append(f"last AS MATERIALIZED ({near.format(r=rounds)})")
    ctes.append("coded AS (SELECT k, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM last GROUP BY k)")
    ctes.append(f"sha AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS h FROM book{rounds})")
    return "WITH " + ",\n".join(ctes) + """
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (k), sha"""


def contamination(window: int = 10) -> str:
    """Twin of ``op13``: windows as strings."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark),
items AS (SELECT item_id, w, least({window}, len(w)) AS size FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM items, unnest(range(1, len(w) - size + 2)) u(i)),
runs AS (SELECT k, i, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM d, (SELECT DISTINCT size FROM items) s, unnest(range(1, len(w) - size + 2)) u(i) WHERE len(w) >= size),
hits AS (SELECT k, i, size, item_id FROM runs JOIN windows USING (size, win)),
words AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT k, i, size FROM hits), unnest(range(i, i + size)) u(j) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN named USING (k)"""


def repeated_windows(size: int = 13) -> str:
    """Twin of ``op10``: windows as strings, ids that are NULL before all others."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(doc_id, -9223372036854775808) AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT k, id, i, array_to_string(w[i:i + {size - 1}], ' ') AS g FROM d, unnest(range(1, len(w) - {size - 2})) u(i) WHERE len(w) >= {size}),
hit AS (SELECT k, i FROM win JOIN (SELECT g, min(id) AS lo FROM win GROUP BY g) USING (g) WHERE id > lo),
gone AS (SELECT DISTINCT k, j FROM hit, unnest(range(i, i + {size})) u(j)),
words AS (SELECT k, j, w[j] AS word FROM d, unnest(range(1, len(w) + 1)) u(j)),
marked AS (SELECT words.*, gone.j IS NOT NULL AS out, coalesce(lag(gone.j IS NOT NULL) OVER (PARTITION BY words.k ORDER BY words.j), FALSE) AS before FROM words LEFT JOIN gone USING (k, j)),
per AS (SELECT k, count(CASE WHEN out THEN 1 END) AS n_removed, count(CASE WHEN out AND NOT before THEN 1 END) AS n_spans, string_agg(CASE WHEN NOT out THEN word END, ' ' ORDER BY j) AS kept FROM marked GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0)::BIGINT AS n_spans FROM d LEFT JOIN per USING (k)"""


def near_duplicates(size: int = 3, percent: int = 90) -> str:
    """Twin of ``op8``: all pairs that share a shingle and may be alike by size."""
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT k, array_to_string(w[i:i + {size - 1}], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - {size - 2}, 2))) u(i) WHERE len(w) > 0),
z AS MATERIALIZED (SELECT k, count(*) AS n, sum(hash(g)) AS h FROM s GROUP BY k),
one AS MATERIALIZED (SELECT h, n, min(k) AS r FROM z GROUP BY h, n),
c AS (SELECT s.k, g, n FROM s JOIN one ON s.k = one.r),
p AS (SELECT a.k AS a, b.k AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM c a JOIN c b ON a.g = b.g AND a.k < b.k AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * shared >= {percent} * (na + nb - shared) UNION ALL SELECT r, k FROM z JOIN one USING (h, n) WHERE r <> k),
t AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(k, r) AS (SELECT k, k FROM d UNION SELECT t.b, reach.r FROM reach JOIN t ON t.a = reach.k)
SELECT any_value(d.doc_id) AS doc_id, coalesce(any_value(z.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN d USING (k) JOIN d o ON o.k = reach.r LEFT JOIN z ON z.k = d.k GROUP BY d.k"""


SQL = {"op8_jaccard": near_duplicates(), "op10_windows": repeated_windows(),
       "op11_divergence": source_divergence(), "op12_codes": vector_codes(), "op13_decontaminate": contamination()}
