"""DuckDB SQL with the same results as the queries, written without their methods."""

from __future__ import annotations

from cohortkit.llm.secret_scan import BASE_RULES, RULES


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def secret_scan_sql() -> str:
    """Every rule scans every text; match positions add up the pieces between matches."""
    parts = []
    for rank, r in enumerate(RULES):
        p = _quoted(r.pattern)
        keep = f"WHERE length(regexp_extract(value, {p}, {r.group})) >= {r.min_len}" if r.min_len else ""
        parts.append(f"""
SELECT doc_id, '{r.kind}' AS kind, {rank} AS rank, s AS "start", s + length(value) AS "end" FROM (
  SELECT doc_id, matches[i] AS value,
         list_sum(list_transform(pieces[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(matches[1:i-1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, matches, pieces, unnest(range(1, len(matches) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {p}) AS matches,
                     string_split_regex(coalesce(text, ''), {p}) AS pieces FROM documents))) {keep}""")
    base = len(BASE_RULES)
    show = "string_agg(kind || ':' || \"start\"::BIGINT || ':' || \"end\"::BIGINT, ',' ORDER BY \"start\", rank)"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH spans AS ({' UNION ALL '.join(parts)}),
found AS (SELECT doc_id, {counts}, sha256(coalesce({show} FILTER (rank < {base}), '')) AS base_sha256,
                 {show} AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE_RULES)},
       coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN found USING (doc_id)"""


def url_filter_sql(rules, default: str = "allow") -> str:
    rows = ", ".join(f"({_quoted(h)}, {_quoted(p)}, {_quoted(v)})" for h, p, v in rules)
    return f"""
WITH rules(rh, rp, rv) AS (VALUES {rows}),
urls AS (SELECT page_id,
           coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                              'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
best AS (SELECT page_id, arg_max(rh || rp, length(rh) * 10000 + length(rp)) AS rule,
                arg_max(rv, length(rh) * 10000 + length(rp)) AS verdict
         FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
         GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict
FROM urls u LEFT JOIN best USING (page_id)"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = (r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

DECONTAMINATE = f"""
WITH items AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, len(w) AS len_all, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS gram
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
docs AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
          FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, windows.n FROM grams JOIN windows USING (n, gram)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
              FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY doc_id),
-- proximity: the two rarest places of a window stand within 5 words of their places, but not at them
tokens AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM docs),
places AS (SELECT gram, unnest(string_split(gram, ' ')) AS term, unnest(range(n)) AS off FROM (SELECT DISTINCT gram, n FROM windows)),
rarest AS (SELECT gram, term, off, row_number() OVER (PARTITION BY gram ORDER BY coalesce(df, 0), off) AS rank
           FROM places LEFT JOIN (SELECT term, count(*) AS df FROM tokens GROUP BY term) USING (term) QUALIFY rank <= 2),
starts AS (SELECT doc_id, gram, rank, pos - 1 - off AS s FROM tokens JOIN rarest USING (term) WHERE pos - 1 - off >= 0),
met AS (SELECT a.doc_id, a.gram, a.s, min(abs(a.s - b.s)) AS gap FROM starts a JOIN starts b
        ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.rank = 1 AND b.rank = 2 GROUP BY ALL),
near AS (SELECT doc_id, count(DISTINCT gram) AS n_near FROM met WHERE gap BETWEEN 1 AND 5 GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0) AS n_near
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id) LEFT JOIN near USING (doc_id)"""

MIX = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight
  FROM docs GROUP BY source),
-- reshare by rounds: sources at their cap drop out, the rest share what is left by weight
rounds AS (
  SELECT 0 AS round, source, source_size, weight, false AS done, 0.0::DOUBLE AS target FROM sources
  UNION ALL
  SELECT round + 1, source, source_size, weight, done OR share >= 2.0 * source_size,
         CASE WHEN done OR share >= 2.0 * source_size THEN 2.0 * source_size ELSE share END
  FROM (SELECT *, coalesce(weight * ((1.5 * sum(source_size) OVER ())::DOUBLE
                    - coalesce(sum(CASE WHEN done THEN 2.0 * source_size END) OVER (), 0)::DOUBLE)
                  / nullif(sum(CASE WHEN NOT done THEN weight END) OVER (), 0), 0)::DOUBLE AS share FROM rounds)
  WHERE round <= (SELECT count(*) FROM sources)),
targets AS (SELECT source, source_size, target FROM rounds WHERE round = (SELECT max(round) FROM rounds)),
placed AS (
  SELECT doc_id, size, t.source_size, target,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto,
         CASE WHEN t.source_size > 0 THEN round(target)::BIGINT // t.source_size ELSE 0 END AS epochs
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN upto <= rest OR (upto - size < rest AND upto - rest < rest - (upto - size))
                              THEN 1 ELSE 0 END))::BIGINT AS taken
FROM (SELECT *, round(target)::BIGINT - epochs * source_size AS rest FROM placed)"""

EXACT_DEDUP = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)"""

NEAR_DEDUP = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
-- of two sets that share 4/5 of their union, the smaller shares one of its rarest fifth
rare AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS r
         FROM shingles JOIN (SELECT s, count(*) AS df FROM shingles GROUP BY s) USING (s)),
heads AS (SELECT doc_id, s, n FROM rare JOIN sizes USING (doc_id) WHERE r <= n - ceil(0.8 * n) + 1),
pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM heads a JOIN heads b USING (s)
          WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (
  SELECT a, b FROM pairs JOIN shingles x ON x.doc_id = a JOIN shingles y ON y.doc_id = b AND y.s = x.s
  JOIN sizes na ON na.doc_id = a JOIN sizes nb ON nb.doc_id = b
  GROUP BY a, b, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, a FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
       coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM words d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)"""


SUBSTRING_DEDUP = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS seq
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY seq) AS first FROM windows)
         WHERE first < doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hits)
         GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS kept
         FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM words)
         ANTI JOIN (SELECT doc_id, unnest(gone) AS p FROM gone) USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

SOURCE_AUDIT = f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
              FROM documents),
words AS (SELECT d, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
lang_sums AS (SELECT lang, (SELECT count(*) FROM kept k WHERE k.lang = l.lang) AS v,
                (SELECT coalesce(sum(n), 0) FROM kept k WHERE k.lang = l.lang) AS total
              FROM (SELECT DISTINCT lang FROM docs) l),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
group_sums AS (SELECT lang, source, coalesce(sum(n), 0) AS total
               FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * s.v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (k.n + 2)) // (s.total + 2 * s.v)::HUGEINT AS q
           FROM group_sums g JOIN lang_sums s USING (lang) JOIN kept k USING (lang)
           LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
            (SELECT 0)::BIGINT + coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
          LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
          WHERE x.term IS NULL OR y.term IS NOT NULL GROUP BY ALL),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
          FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, r::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR r <= 10"""


def clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """Plain arithmetic on one row a component; every round is a table of centroids."""
    text = ["""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
flat AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS j, unnest(v) AS x FROM kept),
c0 AS MATERIALIZED (
  SELECT c, unnest(range(1, 65)) AS j, unnest(v) AS x
  FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept)
  WHERE c < %d)""" % k]
    for i in range(rounds + 1):
        text.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, arg_min(c, d * {k} + c) AS c, min(d) AS d
  FROM (SELECT r, c, sum((flat.x - c{i}.x) * (flat.x - c{i}.x))::BIGINT AS d FROM flat JOIN c{i} USING (j) GROUP BY r, c)
  GROUP BY r)""")
        if i < rounds:
            text.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT c, j, coalesce(m.x, c{i}.x) AS x FROM c{i} LEFT JOIN
    (SELECT a{i}.c, j, (sum(flat.x) - ((sum(flat.x) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS x
     FROM flat JOIN a{i} USING (r) GROUP BY a{i}.c, j) m USING (c, j))""")
    return ",".join(text) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r)
JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c) USING (c)"""
