"""The same results in ANSI-style SQL (DuckDB), for the problems SQL can express over whole tables."""

P1_ADDRESSES = r"""
raw AS (SELECT id AS tab_id, trim(COALESCE(canonical_url, url), E' \t\n\r ') AS a FROM tabs),
cut AS (
  SELECT tab_id, lower(regexp_extract(a, '^([^:/?#]*)://', 1)) AS scheme,
    lower(regexp_replace(regexp_extract(a, '^[^:/?#]*://([^/?#]*)', 1), '^.*@', '')) AS authority,
    regexp_extract(a, '^[^:/?#]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(a, '^[^?#]*\?([^#]*)', 1) AS query
  FROM raw WHERE regexp_matches(a, '^[Hh][Tt][Tt][Pp][Ss]?://')),
parts AS (
  SELECT tab_id, scheme,
    regexp_replace(regexp_replace(regexp_replace(authority, ':[0-9]*\s*$', ''), '[\s.]+$', ''), '^www\.', '') AS host,
    CASE WHEN scheme || ':' || regexp_extract(authority, ':([0-9]+)\s*$', 1) IN ('http:80', 'https:443') THEN '' ELSE regexp_extract(authority, ':([0-9]+)\s*$', 1) END AS port,
    list_filter(list_transform(string_split(path, '/'), lambda s: trim(regexp_replace(lower(url_decode(s)), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS segments,
    list_transform(string_split(query, '&'), lambda p: [
      trim(regexp_replace(lower(url_decode(regexp_extract(p, '^([^=]*)', 1))), '[^a-z0-9]+', ' ', 'g')),
      trim(regexp_replace(lower(url_decode(regexp_extract(p, '^[^=]*=(.*)$', 1))), '[^a-z0-9]+', ' ', 'g'))]) AS pairs
  FROM cut),
forms AS (
  SELECT tab_id, scheme || '|' || host || '|' || port || '|' || array_to_string(segments, '/') || '|' || array_to_string(list_sort(list_transform(
    list_filter(pairs, lambda p: (p[1] <> '' OR p[2] <> '') AND NOT starts_with(p[1], 'utm ')
      AND p[1] NOT IN ('fbclid', 'gclid', 'igshid', 'mc cid', 'mc eid', 'msclkid', 'ref', 'ref src')), lambda p: p[1] || '=' || p[2])), '&') AS form
  FROM parts)
"""

P1_FOUND = f"""
WITH {P1_ADDRESSES}, firsts AS (SELECT form, min(tab_id) AS first_id FROM forms GROUP BY form)
SELECT first_id, tab_id FROM forms JOIN firsts USING (form) WHERE first_id < tab_id
"""

P1_PAGES = f"""
WITH {P1_ADDRESSES} SELECT min(tab_id) AS first_id, count(*)::BIGINT AS copies FROM forms GROUP BY form
"""

P2_PAIRS = r"""
words AS (
  SELECT DISTINCT id, lower(trim(k, E' \t\n\r ')) AS k FROM (SELECT id, unnest(keywords) AS k FROM tabs WHERE id IS NOT NULL)
  WHERE k IS NOT NULL AND trim(k, E' \t\n\r ') <> ''),
sizes AS (SELECT id, count(*) AS n, array_to_string(list_sort(list(k)), chr(1)) AS form FROM words GROUP BY id),
shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS s FROM words a JOIN words b ON a.k = b.k AND a.id < b.id GROUP BY 1, 2),
pairs AS (
  SELECT id_a, id_b, x.form AS form_a, y.form AS form_b FROM shared JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b
  WHERE s * 10 >= 6 * (x.n + y.n - s))
"""

P2_FOUND = f"WITH {P2_PAIRS} SELECT id_a, id_b FROM pairs"

P2_LINKS = f"""
WITH {P2_PAIRS},
ends AS (SELECT id_a AS id FROM pairs WHERE form_a <> form_b UNION ALL SELECT id_b FROM pairs WHERE form_a <> form_b),
links AS (SELECT id, count(*) AS links FROM ends GROUP BY id),
classes AS (SELECT form, min(id) AS class_id, count(*) AS copies FROM sizes GROUP BY form)
SELECT s.id, class_id, copies::BIGINT AS copies, COALESCE(links, 0)::BIGINT AS links
FROM sizes s JOIN classes USING (form) LEFT JOIN links ON links.id = s.id
"""

P3_FOUND = """
WITH RECURSIVE links AS (
  SELECT source AS a, target AS b FROM edges WHERE reason <> 'navigation' UNION SELECT id, duplicate_of FROM tabs WHERE duplicate_of IS NOT NULL),
valid AS (SELECT a, b FROM links WHERE a <> b AND a IN (SELECT id FROM tabs) AND b IN (SELECT id FROM tabs)),
both_ways AS (SELECT a, b FROM valid UNION SELECT b, a FROM valid),
reach(tab_id, root) AS (SELECT a, a FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.tab_id WHERE r.root < e.b)
SELECT min(root) AS component_id, tab_id FROM reach GROUP BY tab_id
"""

P5_PAIRS = """
words AS (SELECT DISTINCT id, t FROM (SELECT id, unnest(tokens) AS t FROM tabs WHERE id IS NOT NULL) WHERE t IS NOT NULL),
sizes AS (SELECT id, count(*) AS n FROM words GROUP BY id HAVING count(*) >= 10),
kept AS (SELECT id, t, n FROM words JOIN sizes USING (id)),
shared AS (
  SELECT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS s FROM kept a JOIN kept b ON a.t = b.t AND a.id < b.id AND a.n * 10 >= 7 * b.n AND b.n * 10 >= 7 * a.n
  GROUP BY 1, 2, 3, 4),
pairs AS (SELECT id_a, id_b FROM shared WHERE s * 10 >= 7 * (na + nb - s))
"""

P5_FOUND = f"WITH {P5_PAIRS} SELECT id_a, id_b FROM pairs"

P5_GROUPS = f"""
WITH RECURSIVE {P5_PAIRS}, ways AS (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
forms AS (SELECT id, min(id) OVER (PARTITION BY list_sort(list(t))) AS class_id FROM kept GROUP BY id),
reach(node, root) AS (SELECT id, id FROM sizes UNION SELECT w.b, r.root FROM reach r JOIN ways w ON w.a = r.node WHERE r.root < w.b)
SELECT f.id, class_id, min(root) AS group_id FROM forms f JOIN reach r ON r.node = f.id GROUP BY 1, 2
"""

P6_VECTORS = """
usable AS (
  SELECT id, embedding AS v FROM tabs WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
"""

P6_FOUND = f"""
WITH {P6_VECTORS},
scored AS (
  SELECT probe_id, u.id AS neighbor_id, row_number() OVER (PARTITION BY probe_id ORDER BY round(list_cosine_similarity(q.v, u.v), 12) DESC, u.id) AS r
  FROM knn_probes p JOIN usable q ON q.id = p.tab_id JOIN usable u ON u.id <> p.tab_id)
SELECT probe_id, neighbor_id FROM scored WHERE r <= 5
"""

P6_EVERY_TWENTIETH = f"""
WITH {P6_VECTORS},
scored AS (
  SELECT q.id AS query_id, u.id AS neighbor_id, list_cosine_similarity(q.v, u.v) AS c,
    row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, u.v), 12) DESC, u.id) AS r
  FROM usable q JOIN usable u ON u.id <> q.id WHERE q.id % 20 = 0)
SELECT query_id, neighbor_id, round(c, 6) AS cosine, r::INTEGER AS rank FROM scored WHERE r <= 5
"""

# What every packing and every mixture has to keep, whatever it chooses.
P7_FAULTS = """
SELECT plan_id, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL AND text <> '')::BIGINT AS documents, 0::BIGINT AS overfull, 0::BIGINT AS misplaced, 0::BIGINT AS split FROM pack_plans
"""

P8_FAULTS = r"""
SELECT DISTINCT lower(trim(m.source, E' \t\n\r ')) AS source, FALSE AS short, FALSE AS repeated FROM mix_targets m JOIN documents d ON lower(trim(d.source, E' \t\n\r ')) = lower(trim(m.source, E' \t\n\r '))
WHERE d.doc_id IS NOT NULL AND d.text <> '' AND m.target_share > 0
"""

ORACLE = {
    "p1_found": P1_FOUND, "p1_pages": P1_PAGES, "p2_found": P2_FOUND, "p2_links": P2_LINKS, "p3_found": P3_FOUND,
    "p5_found": P5_FOUND, "p5_groups": P5_GROUPS, "p6_found": P6_FOUND, "p6_every_twentieth": P6_EVERY_TWENTIETH,
    "p7_faults": P7_FAULTS, "p8_faults": P8_FAULTS,
}
