"""The same results in SQL (DuckDB), over whole tables."""

from __future__ import annotations

import re

from ..functions.text import LIVE_STOPWORDS, STOPWORDS
from ..functions.urls import _WITH_AUTHORITY, _WITH_PARAMETERS, TRACKING_PARAMETERS


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _tokens(c: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(lower(COALESCE({c}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: len(t) >= 3 AND NOT list_contains({_list(STOPWORDS)}, t))"


def _live_tokens(c: str) -> str:
    code = "regexp_matches(t, '^[0-9]+$') OR (regexp_matches(t, '^[0-9a-f]+$') AND len(t) >= 6) OR len(regexp_replace(t, '[^0-9]', '', 'g')) > len(t) * 0.4 OR t = repeat(t[1], len(t))"
    return f"list_filter(string_split(trim(regexp_replace(lower(COALESCE({c}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: len(t) >= 4 AND NOT list_contains({_list(STOPWORDS + LIVE_STOPWORDS)}, t) AND NOT ({code}))"


_PARTS = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?"


def _canonical(source: str, live: bool = False) -> str:
    """CTEs ending in canon(k, canonical) for a query that yields (k, url)."""
    cut_user = "regexp_replace(n, '^.*@', '')" if live else "n"
    params = "p" if live else f"CASE WHEN g IN {_in(_WITH_PARAMETERS)} THEN regexp_replace(p, ';[^/]*$', '') ELSE p END"
    decode = lambda x: f"url_decode(replace({x}, '+', ' '))"
    name, value = decode("regexp_extract(x, '^([^=]*)', 1)"), decode("regexp_extract(x, '(?s)^[^=]*=(.*)$', 1)")
    if live:
        swap = "translate(z.k, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')"
        order = f"list_transform(list_sort(list_transform(ps, lambda z, i: struct_pack(a := lower(z.k), b := {swap}, i := i, k := z.k, v := z.v))), lambda z: struct_pack(k := z.k, v := z.v))"
        enc = lambda x: f"replace(replace(replace(replace(url_encode({x}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')')"
        build = "CASE WHEN g = '' THEN u ELSE s || '://' || h || p3 || qs END"
    else:
        order = "list_sort(ps)"
        enc = lambda x: f"replace(url_encode({x}), '%20', '+')"
        build = f"s || ':' || CASE WHEN h <> '' OR (s IN {_in(_WITH_AUTHORITY)} AND starts_with(p3, '/')) THEN '//' ELSE '' END || h || p3 || qs"
    return rf"""
cu0 AS (SELECT k, regexp_replace(ltrim(url), '[\t\r\n]', '', 'g') AS u FROM ({source})),
cu1 AS (SELECT k, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS g, lower(regexp_extract(u, '{_PARTS}', 2)) AS n,
  regexp_extract(u, '{_PARTS}', 3) AS p, regexp_extract(u, '{_PARTS}', 5) AS q FROM cu0),
cu2 AS (SELECT k, u, g, CASE WHEN g = '' THEN 'https' ELSE g END AS s, {cut_user} AS n1, {params} AS p1,
  list_filter(list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x: struct_pack(k := {name}, v := {value})),
    lambda z: NOT (lower(z.k) IN {_in(TRACKING_PARAMETERS)} OR starts_with(lower(z.k), 'utm_'))) AS ps FROM cu1),
cu3 AS (SELECT *, CASE WHEN (s = 'http' AND n1 LIKE '%:80') OR (s = 'https' AND n1 LIKE '%:443') THEN regexp_replace(n1, ':[0-9]+$', '') ELSE n1 END AS n2,
  CASE WHEN p1 = '' THEN '/' ELSE p1 END AS p2 FROM cu2),
cu4 AS (SELECT *, regexp_replace(n2, '^www\.', '') AS h, CASE WHEN p2 <> '/' THEN regexp_replace(p2, '/$', '') ELSE p2 END AS p3,
  array_to_string(list_transform({order}, lambda z: {enc("z.k")} || '=' || {enc("z.v")}), '&') AS q1 FROM cu3),
cu5 AS (SELECT *, CASE WHEN q1 <> '' THEN '?' || q1 ELSE '' END AS qs FROM cu4),
canon AS (SELECT k, {build} AS canonical FROM cu5)"""


_DOMAIN = r"regexp_replace(split_part(lower(regexp_extract(ltrim(url), '(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)), ':', 1), '^www\.', '')"
_LIVE_DOMAIN = r"regexp_replace(split_part(regexp_replace(lower(regexp_extract(ltrim(url), '(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)), '^.*@', ''), ':', 1), '^www\.', '')"
_HTTP = "(starts_with(url, 'http://') OR starts_with(url, 'https://'))"
_DOC_TOKENS = f"doc AS (SELECT doc_id AS id, {_tokens('text')} AS tokens FROM documents)"
_TERMS = f"{_DOC_TOKENS}, term AS (SELECT id, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM doc)"
_BIT_SUMS = ", ".join(f"sum(CASE WHEN (h >> {k}) & 1 = 1 THEN c ELSE -c END) AS b{k}" for k in range(64))
_BIT_OR = " | ".join(f"(CASE WHEN b{k} > 0 THEN {1 << k}::UBIGINT ELSE 0::UBIGINT END)" for k in range(64))

_TABS_CANON = _canonical("SELECT id AS k, url FROM tabs") + """,
ct AS (SELECT t.id, t.url, t.domain, t.simhash, t.keywords, t.group_id, COALESCE(CASE WHEN t.canonical_url <> '' THEN t.canonical_url END, c.canonical) AS canonical_url FROM tabs t JOIN canon c ON c.k = t.id)"""
_NEAR = """near AS (SELECT a.id AS id_a, b.id AS id_b, bit_count(xor(a.simhash, b.simhash))::INTEGER AS distance FROM ct a JOIN ct b ON a.domain = b.domain AND a.id < b.id
  WHERE a.domain <> '' AND bit_count(xor(a.simhash, b.simhash)) <= 3)"""
_STARS = "stars AS (SELECT min(id) OVER (PARTITION BY canonical_url) AS a, id AS b FROM ct WHERE canonical_url <> '')"
_DEDUPE = f"""{_TABS_CANON}, {_NEAR}, {_STARS},
dl AS (SELECT a, b FROM stars WHERE a < b UNION SELECT id_a, id_b FROM near),
dw AS (SELECT a, b FROM dl UNION SELECT b, a FROM dl),
dr(node, root) AS (SELECT id, id FROM tabs UNION SELECT e.b, r.root FROM dr r JOIN dw e ON e.a = r.node WHERE r.root < e.b),
prim AS (SELECT node AS id, min(root) AS "primary" FROM dr GROUP BY node)"""

_DIMS = "CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN len(embedding) ELSE 0 END"
_MAIN_COLUMNS = f"id, COALESCE(domain, '') AS domain, list_distinct(list_filter(COALESCE(keywords, []), lambda k: k IS NOT NULL)) AS kw, embedding AS e, COALESCE({_DIMS}, 0) AS dims"
_MAINS = f"mains AS (SELECT {_MAIN_COLUMNS} FROM tabs WHERE duplicate_of IS NULL AND id IS NOT NULL)"
# Scores from their definition: the cosine, the keywords where there is none, and the bonus; then the pairs of a domain that have neither.
_SCORES = """
cosines AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.e, y.e) AS s, x.domain AS da, y.domain AS db FROM mains x JOIN mains y ON x.dims = y.dims AND x.id < y.id WHERE x.dims > 0),
zeros AS (SELECT a, b FROM cosines WHERE s = 0),
kws AS (SELECT id, domain, dims, unnest(kw) AS k, len(kw) AS n FROM mains),
sh AS (SELECT a.id AS a, b.id AS b, count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS s, any_value(a.domain) AS da, any_value(b.domain) AS db FROM kws a JOIN kws b ON a.k = b.k AND a.id < b.id
  WHERE a.dims = 0 OR a.dims <> b.dims OR EXISTS (SELECT 1 FROM zeros z WHERE z.a = a.id AND z.b = b.id) GROUP BY 1, 2),
sc AS (SELECT a, b, s + CASE WHEN da = db AND da <> '' THEN 0.25 ELSE 0 END AS score, da = db AS same FROM (FROM cosines WHERE s <> 0 UNION ALL FROM sh))"""
_SCORED = f"{_MAINS},{_SCORES}"
_PLAINS = """
plain AS (SELECT x.id AS a, y.id AS b FROM mains x JOIN mains y ON x.domain = y.domain AND x.id < y.id AND x.domain <> '' WHERE (x.dims = 0 OR x.dims <> y.dims OR EXISTS (SELECT 1 FROM zeros z WHERE z.a = x.id AND z.b = y.id)) AND NOT list_has_any(x.kw, y.kw)),
allp AS (SELECT a, b, score, same FROM sc UNION ALL SELECT a, b, 0.25, TRUE FROM plain)"""
_PLAIN = f"{_SCORED},{_PLAINS}"
_NEAREST = """
dir AS (SELECT a, b, score FROM allp WHERE score >= {{t}} UNION ALL SELECT b, a, score FROM allp WHERE score >= {{t}}),
knn AS (SELECT a, b, score, r FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(score, 12) DESC, b) AS r FROM dir) WHERE r <= 6),
mut AS (SELECT a, b FROM knn x WHERE a < b AND EXISTS (SELECT 1 FROM knn y WHERE y.a = x.b AND y.b = x.a))""".replace("{{t}}", "{t}")
_KNN = _PLAIN.replace("{", "{{").replace("}", "}}") + "," + _NEAREST
_GROUPS = """{knn},
ge AS (SELECT a, b FROM mut {stars}),
gw AS (SELECT a, b FROM ge UNION SELECT b, a FROM ge),
gr(node, root) AS (SELECT id, id FROM mains UNION SELECT e.b, r.root FROM gr r JOIN gw e ON e.a = r.node WHERE r.root < e.b),
roots AS (SELECT node AS id, min(root) AS root FROM gr GROUP BY node)
SELECT id, (dense_rank() OVER (ORDER BY root) - 1)::BIGINT AS group_id FROM roots"""
_DOMAIN_STARS = "UNION SELECT first, id FROM (SELECT id, min(id) OVER (PARTITION BY domain) AS first FROM mains WHERE domain <> '') WHERE first < id"

_OWN = "own AS (SELECT group_id, id, COALESCE(domain, '') AS domain, COALESCE(tokens, []) AS tokens FROM tabs WHERE id IS NOT NULL AND group_id >= 0)"
_SHARE = f"""{_OWN},
whole AS (SELECT group_id, count(*) AS w FROM own GROUP BY 1),
dc AS (SELECT group_id, domain, count(*) AS c, min(id) AS f FROM own WHERE domain <> '' GROUP BY 1, 2),
share AS (SELECT group_id, domain, c::DOUBLE / w AS share FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY c DESC, f) AS r FROM dc) JOIN whole USING (group_id) WHERE r = 1)"""
_TOP3 = """
tt AS (SELECT group_id, id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos FROM own),
td AS (SELECT term, count(DISTINCT id) AS df FROM tt GROUP BY 1),
tn AS (SELECT count(*) AS n FROM own),
tf AS (SELECT group_id, term, count(*) AS tf, min(id * 100000 + pos) AS first FROM tt GROUP BY 1, 2),
ts AS (SELECT group_id, term, row_number() OVER (PARTITION BY group_id ORDER BY tf * (ln((1 + n) / (1 + df)) + 1.0) DESC, first) AS r FROM tf JOIN td USING (term) CROSS JOIN tn),
top3 AS (SELECT group_id, string_agg(term, ' / ' ORDER BY r) AS terms FROM ts WHERE r <= 3 GROUP BY 1)"""

_LISTED = "gl AS (SELECT id AS group_id, label, unnest(tab_ids) AS tab_id, generate_subscripts(tab_ids, 1) - 1 AS pos FROM tab_groups)"
_OF_TAB = f"{_LISTED}, ot AS (SELECT t.id, COALESCE(m.g, t.group_id) AS group_id FROM tabs t LEFT JOIN (SELECT tab_id, max(group_id) AS g FROM gl GROUP BY 1) m ON m.tab_id = t.id)"
_ADJ = f"""{_OF_TAB},
gp AS (SELECT least(a.group_id, b.group_id) AS ga, greatest(a.group_id, b.group_id) AS gb, sum(COALESCE(weight, 0.0)) AS weight
  FROM edges e JOIN ot a ON a.id = e.source JOIN ot b ON b.id = e.target WHERE a.group_id <> b.group_id GROUP BY 1, 2),
gd AS (SELECT ga AS group_id, gb AS neighbor_id, weight FROM gp UNION ALL SELECT gb, ga, weight FROM gp),
adj AS (SELECT *, (row_number() OVER (PARTITION BY group_id ORDER BY round(weight, 9) DESC, neighbor_id))::INTEGER AS rank FROM gd)"""
_META = f"""{_LISTED},
gt AS (SELECT g.group_id, g.pos, t.domain, t.keywords, COALESCE(CASE WHEN t.title <> '' THEN t.title END, CASE WHEN t.url <> '' THEN t.url END) AS shown FROM gl g JOIN tabs t ON t.id = g.tab_id),
md AS (SELECT group_id, domain FROM (SELECT group_id, domain, row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, min(pos)) AS r FROM gt WHERE domain <> '' GROUP BY 1, 2) WHERE r = 1),
mw AS (SELECT group_id, pos, unnest(keywords) AS k, generate_subscripts(keywords, 1) AS kp FROM gt),
mk AS (SELECT group_id, list(k ORDER BY r) AS ks FROM (SELECT group_id, k, row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, min(pos * 1000 + kp)) AS r FROM mw WHERE k IS NOT NULL GROUP BY 1, 2) WHERE r <= 12 GROUP BY 1),
mt AS (SELECT group_id, list(shown ORDER BY r) AS ts FROM (SELECT group_id, shown, row_number() OVER (PARTITION BY group_id ORDER BY pos) AS r FROM gt WHERE shown IS NOT NULL) WHERE r <= 10 GROUP BY 1),
meta0 AS (SELECT g.id AS group_id, COALESCE(g.label, '') AS label, COALESCE(len(g.tab_ids), 0)::INTEGER AS size, COALESCE(md.domain, '') AS domain, COALESCE(ks, []) AS ks, COALESCE(ts, []) AS ts
  FROM tab_groups g LEFT JOIN md ON md.group_id = g.id LEFT JOIN mk ON mk.group_id = g.id LEFT JOIN mt ON mt.group_id = g.id),
meta AS (SELECT *, lower(group_id::VARCHAR || ' ' || label || ' ' || domain || ' ' || array_to_string(ks, ' ') || ' ' || array_to_string(ts, ' ')) AS blob FROM meta0)"""

_VISITS = _canonical("SELECT DISTINCT url AS k, url FROM browser_events WHERE url IS NOT NULL") + f""",
once AS (SELECT DISTINCT event, tab_id, ts, url, title, frame_id, transition_type, qualifiers, status FROM browser_events WHERE tab_id IS NOT NULL AND ts IS NOT NULL),
vis AS (SELECT tab_id, ts, event, CASE WHEN event <> 'removed' THEN canonical END AS canonical, transition_type, event = 'removed' AS closed FROM once LEFT JOIN canon ON k = url
  WHERE event = 'removed' OR ({_HTTP} AND (event = 'updated' OR (event = 'committed' AND frame_id = 0 AND transition_type IN ('link', 'typed', 'form_submit', 'auto_bookmark', 'generated')
    AND NOT COALESCE(list_contains(qualifiers, 'forward_back'), FALSE))))),
epo AS (SELECT *, sum(closed::BIGINT) OVER (PARTITION BY tab_id ORDER BY ts NULLS FIRST, event, canonical NULLS FIRST, transition_type NULLS FIRST ROWS UNBOUNDED PRECEDING) - closed::BIGINT AS session FROM vis),
lagd AS (SELECT *, lag(canonical) OVER (PARTITION BY tab_id, session ORDER BY ts, event, canonical, transition_type NULLS FIRST) AS prev,
  row_number() OVER (PARTITION BY tab_id, session, canonical ORDER BY ts, event, canonical, transition_type NULLS FIRST) AS rn FROM epo WHERE NOT closed),
nav AS (SELECT tab_id, session::BIGINT AS session, prev AS source_url, canonical AS target_url, ts, CASE WHEN event = 'committed' THEN transition_type ELSE 'spa_navigation' END AS transition_type
  FROM lagd WHERE rn = 1 AND prev IS NOT NULL AND prev <> canonical)"""

_LIVE_HASH = """(list_reduce(list_prepend(2166136261::BIGINT, cs), lambda h, c: (CASE WHEN xor(h, c) >= 2147483648 THEN xor(h, c) - 4294967296 ELSE xor(h, c) END::DOUBLE * 16777619.0)::BIGINT & 4294967295)::UBIGINT << 32)
  | list_reduce(list_prepend(5381::BIGINT, cs), lambda h, c: xor((h * 33) & 4294967295, c))::UBIGINT"""
_SIGNED = "(CASE WHEN u >= 9223372036854775808 THEN (u::HUGEINT - 18446744073709551616)::BIGINT ELSE u::BIGINT END)"
_PRIMARIES = f"""mains AS (SELECT {_MAIN_COLUMNS} FROM tabs WHERE id IN (SELECT id FROM prim WHERE "primary" = id))"""
_BUILD = f"""WITH RECURSIVE {_DEDUPE}, {_PRIMARIES},{_SCORES},{_PLAINS},{_NEAREST.format(t=0.25)},
ge AS (SELECT a, b FROM mut {_DOMAIN_STARS}),
gw AS (SELECT a, b FROM ge UNION SELECT b, a FROM ge),
gr(node, root) AS (SELECT id, id FROM mains UNION SELECT e.b, r.root FROM gr r JOIN gw e ON e.a = r.node WHERE r.root < e.b),
num AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS group_id FROM (SELECT node AS id, min(root) AS root FROM gr GROUP BY node)),
mem AS (SELECT p.id, n.group_id FROM prim p JOIN num n ON n.id = p."primary"),
own AS (SELECT num.group_id, t.id, COALESCE(t.domain, '') AS domain, COALESCE(tokens, []) AS tokens FROM num JOIN tabs t USING (id)),
{_SHARE[len(_OWN) + 1 :]}, {_TOP3},
listed AS (SELECT group_id, array_to_string(list_sort(list(id)), ',') AS members, count(*)::INTEGER AS size FROM mem GROUP BY 1)
SELECT group_id::BIGINT AS id, COALESCE(s.domain, t.terms, 'group') AS label, size, members FROM listed LEFT JOIN (SELECT * FROM share WHERE share >= 0.55) s USING (group_id) LEFT JOIN top3 t USING (group_id)"""
_LIVE_TABS = _TABS_CANON.replace(_canonical("SELECT id AS k, url FROM tabs"), _canonical("SELECT id AS k, url FROM tabs", True))
_OTHER_VISITS = re.sub(r"\bcanon\b", "vanon", re.sub(r"\bcu(\d)\b", r"vu\1", _VISITS))
_MERGED = """r AS (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY reason <> 'navigation', ts NULLS FIRST, source, target, reason, COALESCE(weight, 0) DESC) AS r
  FROM al WHERE source IS NOT NULL AND target IS NOT NULL AND source <> target) SELECT source, target, weight, reason FROM r WHERE r = 1"""
_REBUILD = f"""WITH RECURSIVE {_DEDUPE.replace(_TABS_CANON, _LIVE_TABS)}, {_PRIMARIES},{_SCORES},{_PLAINS}, {_OTHER_VISITS},
um0 AS (SELECT COALESCE(canonical_url, url) AS address, id FROM ct UNION ALL SELECT url, id FROM ct), um AS (SELECT address, max(id) AS tab_id FROM um0 WHERE address IS NOT NULL GROUP BY 1),
al AS (SELECT a AS source, b AS target, round(score, 3)::DOUBLE AS weight, CASE WHEN same THEN 'similarity+domain' ELSE 'similarity' END AS reason, NULL::TIMESTAMP AS ts FROM allp WHERE score >= 0.2 UNION ALL
  SELECT a.tab_id, b.tab_id, 1.0, 'navigation', ts::TIMESTAMP FROM nav JOIN um a ON a.address = source_url JOIN um b ON b.address = target_url WHERE a.tab_id <> b.tab_id), {_MERGED}"""

_SEEDED = _VISITS.replace("AND (event = 'updated' OR", "AND (event = 'updated' OR (event = 'before_navigate' AND COALESCE(frame_id, 0) = 0) OR").replace(
    "lagd AS (SELECT *,", """kept AS (SELECT * FROM epo WHERE NOT closed QUALIFY event <> 'before_navigate' OR row_number() OVER (PARTITION BY tab_id, session ORDER BY ts, event, canonical, transition_type NULLS FIRST) = 1),
lagd AS (SELECT *,""").replace("FROM epo WHERE NOT closed)", "FROM kept)")
_SENTENCES = r"array_to_string(list_filter(list_transform(string_split(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')[1:3], ' ')"
_CLIPPED = """CASE WHEN len(text) <= 6000 THEN text WHEN contains(substr(text, 1, 5999), ' ') AND 5999 - instr(reverse(substr(text, 1, 5999)), ' ') > 200
  THEN substr(text, 1, 5999 - instr(reverse(substr(text, 1, 5999)), ' ')) ELSE substr(text, 1, 5999) END"""
_ENRICHED = f"""WITH pages AS (SELECT url, min(text) AS text FROM documents WHERE url IS NOT NULL AND text IS NOT NULL GROUP BY 1),
t0 AS (SELECT id, tabs.url, COALESCE(title, '') AS title, COALESCE({_HTTP.replace('url', 'tabs.url')}, FALSE) AS http, COALESCE(text, '') AS text FROM tabs LEFT JOIN pages ON pages.url = tabs.url WHERE id IS NOT NULL),
t1 AS (SELECT *, {_CLIPPED} AS body FROM t0),
t2 AS (SELECT *, {_SENTENCES} AS summary, substr(body, 1, 400) AS excerpt FROM t1),
kt AS (SELECT id, unnest(x) AS term, generate_subscripts(x, 1) AS pos FROM (SELECT id, {_tokens("title || ' ' || summary")} AS x FROM t2 WHERE http)),
kr AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(pos)) AS r FROM kt GROUP BY id, term),
kw AS (SELECT id, string_agg(term, ' ' ORDER BY r) AS keywords FROM kr WHERE r <= 8 GROUP BY 1),
st AS (SELECT id, unnest({_tokens("title || ' ' || summary || ' ' || excerpt")}) AS term FROM t2 WHERE http), ct AS (SELECT id, term, count(*) AS c FROM st GROUP BY 1, 2),
hs AS (SELECT id, c, ('0x' || substr(md5(term), 1, 16))::UBIGINT AS h FROM ct), b AS (SELECT id, {_BIT_SUMS} FROM hs GROUP BY id), v AS (SELECT id, {_BIT_OR} AS u FROM b)
SELECT t2.id, summary, CASE WHEN http THEN 'fallback' END AS summary_source, CASE WHEN http THEN excerpt END AS text_excerpt, CASE WHEN NOT http THEN 'unsupported_url' END AS error,
  COALESCE(keywords, '') AS keywords, {_SIGNED} AS simhash FROM t2 LEFT JOIN kw USING (id) LEFT JOIN v USING (id)"""

ORACLE: dict[str, str] = {
    "simhash_live": f"""WITH doc AS (SELECT doc_id AS id, {_live_tokens('text')} AS tokens FROM documents), ct AS (SELECT id, term, count(*) AS c FROM (SELECT id, unnest(tokens) AS term FROM doc) GROUP BY 1, 2),
        words AS (SELECT term, list_transform(string_split(term, ''), lambda x: ascii(x)::BIGINT) AS cs FROM (SELECT DISTINCT term FROM ct)),
        hs AS (SELECT id, c, {_LIVE_HASH} AS h FROM ct JOIN words USING (term)), b AS (SELECT id, {_BIT_SUMS} FROM hs GROUP BY id), v AS (SELECT id, {_BIT_OR} AS u FROM b)
        SELECT d.doc_id, {_SIGNED} AS simhash FROM documents d LEFT JOIN v ON v.id = d.doc_id""",
    "graph_build": _BUILD,
    "graph_rebuild_live": _REBUILD,
    "cache_overlay": f"""WITH {_canonical('SELECT id AS k, url FROM tabs')}, own AS (SELECT t.*, c.canonical AS own FROM tabs t JOIN canon c ON c.k = t.id),
        keyed AS (SELECT *, unnest(list_distinct([COALESCE(canonical_url, own), own])) AS cache_key FROM own WHERE error IS NULL),
        cache AS (SELECT cache_key, COALESCE(summary, '') AS summary, COALESCE(summary_source, '') AS summary_source, keywords, simhash FROM keyed WHERE cache_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY id DESC) = 1)
        SELECT o.id, u.cache_key IS NOT NULL OR c.cache_key IS NOT NULL AS cached, CASE WHEN u.cache_key IS NOT NULL THEN u.summary ELSE c.summary END AS summary,
          CASE WHEN u.cache_key IS NOT NULL THEN u.summary_source ELSE c.summary_source END AS summary_source,
          CASE WHEN u.cache_key IS NOT NULL THEN array_to_string(u.keywords, ' ') ELSE array_to_string(c.keywords, ' ') END AS keywords, CASE WHEN u.cache_key IS NOT NULL THEN u.simhash ELSE c.simhash END AS simhash
        FROM own o LEFT JOIN cache u ON u.cache_key = o.url LEFT JOIN cache c ON c.cache_key = o.own""",
    "open_pages": f"""WITH {_canonical("SELECT DISTINCT url AS k, url FROM browser_events WHERE url IS NOT NULL")},
        once AS (SELECT DISTINCT event, tab_id, ts, url, title, frame_id, transition_type, qualifiers, status FROM browser_events WHERE tab_id IS NOT NULL AND ts IS NOT NULL),
        shown AS (SELECT o.*, canonical FROM once o JOIN canon ON k = url WHERE event = 'updated' AND status = 'complete' AND {_HTTP}),
        last AS (SELECT canonical, url, tab_id, ts FROM shown QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY ts DESC, tab_id DESC, url DESC, COALESCE(title, '') DESC) = 1),
        named AS (SELECT canonical, title FROM shown WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY ts DESC, tab_id DESC, url DESC, title DESC) = 1),
        born AS (SELECT canonical, min(ts) AS created_at FROM shown GROUP BY 1),
        now AS (SELECT tab_id, canonical AS here FROM shown QUALIFY row_number() OVER (PARTITION BY tab_id ORDER BY ts DESC, url DESC, COALESCE(title, '') DESC) = 1),
        gone AS (SELECT tab_id, max(ts) AS gone FROM once WHERE event = 'removed' GROUP BY 1)
        SELECT canonical AS canonical_url, COALESCE(title, '') AS title, COALESCE({_DOMAIN}, '') AS domain, epoch_us(created_at) AS created_at, epoch_us(CASE WHEN gone >= ts AND here = canonical THEN gone END) AS closed_at,
          CASE WHEN here = canonical AND (gone IS NULL OR gone < ts) THEN tab_id END AS browser_tab
        FROM last LEFT JOIN named USING (canonical) JOIN born USING (canonical) LEFT JOIN now USING (tab_id) LEFT JOIN gone USING (tab_id)""",
    "url_canonical": f"WITH {_canonical('SELECT id AS k, url FROM tabs')} SELECT k AS id, canonical FROM canon",
    "url_canonical_live": f"WITH {_canonical('SELECT id AS k, url FROM tabs', True)} SELECT k AS id, canonical FROM canon",
    "url_domain": f"SELECT id, COALESCE({_DOMAIN}, '') AS domain, COALESCE({_LIVE_DOMAIN}, '') AS live_domain FROM tabs",
    "http_filter": rf"SELECT id, url, 'https://www.google.com/s2/favicons?domain=' || regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) || '&sz=32' AS favicon FROM tabs WHERE {_HTTP}",
    "tokenize": f"SELECT doc_id, array_to_string({_tokens('text')}, ' ') AS tokens FROM documents",
    "tokenize_live": f"SELECT doc_id, array_to_string({_live_tokens('text')}, ' ') AS tokens FROM documents",
    "term_frequency": f"WITH {_TERMS} SELECT id, term, count(*)::BIGINT AS tf, min(pos)::INTEGER AS first_pos FROM term GROUP BY id, term",
    "doc_keywords": f"""WITH {_TERMS}, r AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(pos)) AS r FROM term GROUP BY id, term)
        SELECT id AS doc_id, string_agg(term, ' ' ORDER BY r) AS keywords FROM r WHERE r <= 8 GROUP BY id""",
    "simhash": f"""WITH {_TERMS}, ct AS (SELECT id, term, count(*) AS c FROM term GROUP BY id, term),
        hs AS (SELECT id, c, ('0x' || substr(md5(term), 1, 16))::UBIGINT AS h FROM ct), b AS (SELECT id, {_BIT_SUMS} FROM hs GROUP BY id), v AS (SELECT id, {_BIT_OR} AS u FROM b)
        SELECT d.doc_id, (CASE WHEN u >= 9223372036854775808 THEN (u::HUGEINT - 18446744073709551616)::BIGINT ELSE u::BIGINT END) AS simhash FROM documents d LEFT JOIN v ON v.id = d.doc_id""",
    "truncate_words": """SELECT doc_id, CASE WHEN len(text) <= 600 THEN text WHEN contains(substr(text, 1, 599), ' ') AND 599 - instr(reverse(substr(text, 1, 599)), ' ') > 200
        THEN substr(text, 1, 599 - instr(reverse(substr(text, 1, 599)), ' ')) ELSE substr(text, 1, 599) END AS clipped FROM documents WHERE text IS NOT NULL""",
    "strip_tags": r"""SELECT id, trim(regexp_replace(regexp_replace('<p class=''x''>' || COALESCE(title, '') || '</p>' || chr(10) || ' <b>' || COALESCE(summary, '') || '</b>', '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS stripped
        FROM tabs WHERE error IS NULL""",
    "fallback_summary": r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(COALESCE(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents)
        SELECT doc_id, array_to_string(parts[1:3], ' ') AS summary FROM s""",
    "summary_prompt": """SELECT doc_id, 'Summarize the page in 2-3 sentences. Focus on what it is about and why it matters.' || chr(10) || 'Title: ' || CASE WHEN COALESCE(title, '') = '' THEN 'Untitled' ELSE title END
        || chr(10) || 'Content:' || chr(10) || COALESCE(text, '') || chr(10) || chr(10) || 'Summary:' AS prompt FROM documents""",
    "embedding_text": """WITH x AS (SELECT id, text_excerpt, concat_ws(chr(10), CASE WHEN title <> '' THEN 'Title: ' || title END, CASE WHEN summary <> '' THEN 'Summary: ' || summary END, CASE WHEN domain <> '' THEN 'Domain: ' || domain END) AS l FROM tabs)
        SELECT id, CASE WHEN l <> '' THEN l ELSE COALESCE(text_excerpt, '') END AS text FROM x""",
    "fuzzy_words": r"""WITH w AS (SELECT id, lower(COALESCE(title, '')) AS t, list_filter(string_split(regexp_replace(lower(COALESCE(title, '')), '\s+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM tabs)
        SELECT id, CASE WHEN t = '' THEN 0.0 WHEN contains(t, 'stale trigger ideas') THEN 1.0 ELSE len(list_filter(['stale', 'trigger', 'ideas'],
          lambda q: len(list_filter(ws, lambda x: contains(x, q) OR contains(q, x))) > 0)) / 3.0 END::DOUBLE AS score FROM w""",
    "idf": f"WITH {_TERMS}, n AS (SELECT count(*) AS n FROM doc), df AS (SELECT term, count(DISTINCT id)::BIGINT AS df FROM term GROUP BY 1) SELECT term, df, round(ln((1 + n) / (1 + df)) + 1.0, 9) AS idf FROM df CROSS JOIN n",
    "enrich_columns": f"""SELECT id, substr(COALESCE(text_excerpt, ''), 1, 100) AS excerpt, len({_tokens("COALESCE(title, '') || ' ' || COALESCE(summary, '') || ' ' || COALESCE(text_excerpt, '')")})::INTEGER AS n_tokens,
        CASE WHEN NOT COALESCE({_HTTP}, FALSE) THEN 'unsupported_url' END AS error_found FROM tabs WHERE id IS NOT NULL""",
    "canonical_duplicates": f"WITH {_TABS_CANON}, {_STARS} SELECT a AS first_id, b AS id FROM stars WHERE a < b",
    "near_dup_pairs": f"WITH {_TABS_CANON}, {_NEAR} SELECT * FROM near",
    "dedupe_primary": f'WITH RECURSIVE {_DEDUPE} SELECT id, "primary" FROM prim',
    "dedupe_aliases": f"""WITH RECURSIVE {_DEDUPE} SELECT p."primary", count(*)::BIGINT AS duplicates, array_to_string(list_sort(list_distinct(list(url) FILTER (WHERE url <> ''))), chr(10)) AS aliases
        FROM prim p JOIN tabs t ON t.id = p.id WHERE p."primary" <> p.id GROUP BY 1""",
    "jaccard_pairs": """WITH kw AS (SELECT id, list_distinct(list_filter(keywords, lambda k: k IS NOT NULL)) AS kw FROM tabs WHERE id IS NOT NULL), k AS (SELECT id, unnest(kw) AS k, len(kw) AS n FROM kw),
        s AS (SELECT a.id AS a, b.id AS b, count(*)::INTEGER AS shared, any_value(a.n) + any_value(b.n) AS t FROM k a JOIN k b ON a.k = b.k AND a.id < b.id GROUP BY 1, 2)
        SELECT a, b, shared, round(shared::DOUBLE / (t - shared), 9) AS jaccard FROM s WHERE shared * 2 >= t - shared""",
    "similarity_edges": f"WITH {_PLAIN} SELECT a AS source, b AS target, round_even(score, 3)::DOUBLE AS weight, CASE WHEN same THEN 'similarity+domain' ELSE 'similarity' END AS reason FROM allp WHERE score >= 0.2",
    "similarity_edges_compact": f"WITH {_SCORED} SELECT a AS source, b AS target, round_even(score, 3)::DOUBLE AS weight, CASE WHEN same THEN 'similarity+domain' ELSE 'similarity' END AS reason FROM sc WHERE score >= 0.2",
    "domain_cliques": "SELECT domain, count(*)::BIGINT AS members, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs, 0.25::DOUBLE AS weight FROM tabs WHERE duplicate_of IS NULL AND id IS NOT NULL AND domain <> '' GROUP BY 1 HAVING count(*) > 1",
    "knn_neighbors": f"WITH {_KNN.format(t=0.25)} SELECT a, b, round(score, 9) AS score, r::INTEGER AS rank FROM knn",
    "mutual_knn": f"WITH {_KNN.format(t=0.25)} SELECT a, b FROM mut",
    "cosine_topk": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id AND len(a.e) = len(b.e)),
        r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) AS r FROM s) SELECT a, b, round(c, 6) AS cosine, r::INTEGER AS rank FROM r WHERE r <= 6""",
    "domain_counts": "SELECT domain, count(*)::BIGINT AS tabs FROM tabs WHERE domain <> '' GROUP BY 1 HAVING count(*) >= 2",
    "groups": "WITH RECURSIVE " + _GROUPS.format(knn=_KNN.format(t=0.25), stars=_DOMAIN_STARS),
    "groups_without_domains": "WITH RECURSIVE " + _GROUPS.format(knn=_KNN.format(t=0.5), stars=""),
    "domain_share": f"WITH {_SHARE} SELECT group_id, domain, round(share, 9) AS share FROM share",
    "tfidf_top3": f"WITH {_OWN}, {_TOP3} SELECT group_id, terms FROM top3",
    "group_labels": f"WITH {_SHARE}, {_TOP3} SELECT DISTINCT o.group_id, COALESCE(s.domain, t.terms, 'group') AS label FROM own o LEFT JOIN (SELECT * FROM share WHERE share >= 0.55) s USING (group_id) LEFT JOIN top3 t USING (group_id)",
    "group_adjacency": f"WITH {_ADJ} SELECT group_id, neighbor_id, round(weight, 6) AS weight, rank FROM adj",
    "mini_map": f"WITH {_ADJ} SELECT group_id, rank, neighbor_id, CASE WHEN weight >= 0.8 THEN '#' WHEN weight >= 0.6 THEN '+' WHEN weight >= 0.4 THEN '-' ELSE '.' END AS mark FROM adj WHERE rank <= 8",
    "group_meta": f"WITH {_META} SELECT group_id, size, domain, array_to_string(ks, ',') AS keywords, blob FROM meta",
    "group_details": f"""WITH {_META}, {_ADJ.replace(_LISTED + ', ', '')}, ac AS (SELECT group_id, count(*) AS c FROM adj GROUP BY 1)
        SELECT group_id, label, size AS tabs, COALESCE(c, 0)::BIGINT AS neighbors, CASE WHEN domain = '' THEN '(none)' ELSE domain END AS domain,
          CASE WHEN len(ks) = 0 THEN '(none)' ELSE array_to_string(ks[1:6], ', ') END AS keywords, COALESCE(array_to_string(ts[1:5], ' | '), '') AS sample FROM meta LEFT JOIN ac USING (group_id)""",
    "group_list": "SELECT id AS group_id, '[' || id || '] ' || COALESCE(label, 'group') || ' (' || COALESCE(len(tab_ids), 0) || ')' AS shown FROM tab_groups",
    "group_members": f"""WITH {_LISTED} SELECT gl.group_id, pos::INTEGER AS pos, tab_id, COALESCE(CASE WHEN title <> '' THEN title END, CASE WHEN url <> '' THEN url END, '(untitled)') AS shown FROM gl JOIN tabs t ON t.id = gl.tab_id""",
    "group_urls": f"WITH {_LISTED} SELECT gl.group_id, pos::INTEGER AS pos, url FROM gl JOIN tabs t ON t.id = gl.tab_id WHERE url <> '' AND browser = 'firefox'",
    "tab_details": """SELECT t.id, COALESCE(CASE WHEN title <> '' THEN title END, CASE WHEN url <> '' THEN url END, '(untitled)') AS title, COALESCE(CASE WHEN summary <> '' THEN summary END, '(no summary)') AS summary,
        COALESCE(array_to_string(keywords, ', '), '') AS keywords, COALESCE(g.label, 'Ungrouped') AS group_label FROM tabs t LEFT JOIN tab_groups g ON g.id = t.group_id""",
    "render_nodes": """WITH t AS (SELECT id, group_id, COALESCE(CASE WHEN title <> '' THEN title END, url, '') AS s FROM tabs WHERE duplicate_of IS NULL)
        SELECT id, CASE WHEN len(s) > 30 THEN substr(s, 1, 30) || '...' ELSE s END AS shown, CASE WHEN group_id >= 0 THEN group_id % 10 END AS color FROM t""",
    "visible_edges": """SELECT source, target, weight, reason, CASE WHEN reason = 'navigation' THEN 2 ELSE 1 END AS width FROM edges
        WHERE source IN (SELECT id FROM tabs WHERE duplicate_of IS NULL) AND target IN (SELECT id FROM tabs WHERE duplicate_of IS NULL)""",
    "graph_stats": """WITH t AS (SELECT count(*)::BIGINT AS tab_count, count(*) FILTER (WHERE starts_with(error, 'fetch_failed'))::BIGINT AS errors, count(embedding_error)::BIGINT AS embed_errors, count(duplicate_of)::BIGINT AS duplicates,
          count(*) FILTER (WHERE duplicate_of IS NULL)::BIGINT AS primary_tabs, (count(DISTINCT COALESCE(domain, '')) FILTER (WHERE duplicate_of IS NULL))::INTEGER AS domains FROM tabs),
        g AS (SELECT count(*)::BIGINT AS group_count FROM tab_groups),
        e AS (SELECT count(*)::BIGINT AS edge_count, count(*) FILTER (WHERE reason = 'navigation')::BIGINT AS navigation_edges, count(*) FILTER (WHERE reason <> 'navigation')::BIGINT AS similarity_edges FROM edges)
        SELECT * FROM t CROSS JOIN g CROSS JOIN e""",
    "search_tags_domains": f"""WITH {_META} SELECT group_id, size, 1.0::DOUBLE AS score FROM meta WHERE (contains(domain, 'example') OR contains(blob, 'example') OR contains(domain, 'fen') OR contains(blob, 'fen'))
        AND len(list_filter(ks, lambda k: contains(k, 'guide'))) > 0 AND len(list_filter(ks, lambda k: contains(k, 're'))) > 0""",
    "search_panel_groups": f"""WITH {_LISTED}, m AS (SELECT gl.group_id, t.* FROM gl JOIN tabs t ON t.id = gl.tab_id)
        SELECT g.id AS group_id, COALESCE(len(tab_ids), 0)::INTEGER AS size FROM tab_groups g WHERE EXISTS (SELECT 1 FROM m WHERE m.group_id = g.id AND contains(m.domain, 'example'))
          AND EXISTS (SELECT 1 FROM m WHERE m.group_id = g.id AND len(list_filter(m.keywords, lambda k: contains(k, 'guide'))) > 0)
          AND (contains(lower(COALESCE(g.label, '')), 'the') OR EXISTS (SELECT 1 FROM m WHERE m.group_id = g.id AND (contains(lower(COALESCE(m.title, '')), 'the') OR contains(lower(COALESCE(m.url, '')), 'the'))))""",
    "search_panel_tabs": """SELECT id FROM tabs WHERE duplicate_of IS NULL AND contains(domain, 'test') AND len(list_filter(keywords, lambda k: contains(k, 'review'))) > 0
        AND (contains(lower(COALESCE(title, '')), 'review') OR contains(lower(COALESCE(url, '')), 'review'))""",
    "nav_first_visits": f"WITH {_VISITS} SELECT * REPLACE (epoch_us(ts) AS ts) FROM nav",
    "nav_seeded": f"""WITH {_SEEDED} SELECT * REPLACE (epoch_us(ts) AS ts) FROM nav""",
    "export_groups": """WITH p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS p FROM tabs WHERE duplicate_of IS NULL AND id IS NOT NULL),
        m AS (SELECT g.id, label, unnest(tab_ids) AS t, generate_subscripts(tab_ids, 1) AS pos FROM tab_groups g), k AS (SELECT m.id, string_agg(p.p::VARCHAR, ',' ORDER BY pos) AS tab_ids FROM m JOIN p ON p.id = m.t GROUP BY 1)
        SELECT (row_number() OVER (ORDER BY g.id) - 1)::BIGINT AS id, label, COALESCE(k.tab_ids, '') AS tab_ids FROM tab_groups g LEFT JOIN k ON k.id = g.id""",
    "escaped_titles": """SELECT id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#039;') AS shown FROM tabs WHERE title IS NOT NULL""",
    "enrich": _ENRICHED,
    "page_ids": f"WITH {_canonical('SELECT id AS k, url FROM tabs WHERE ' + _HTTP, True)} SELECT count(DISTINCT canonical)::BIGINT AS pages, count(DISTINCT canonical)::BIGINT AS ids FROM canon",
    "nav_edges": f"""WITH {_VISITS}, um0 AS (SELECT COALESCE(canonical_url, url) AS address, id FROM tabs UNION ALL SELECT url, id FROM tabs), um AS (SELECT address, max(id) AS tab_id FROM um0 WHERE address IS NOT NULL GROUP BY 1)
        SELECT a.tab_id AS source, b.tab_id AS target, 1.0::DOUBLE AS weight, 'navigation' AS reason, epoch_us(ts) AS ts FROM nav JOIN um a ON a.address = source_url JOIN um b ON b.address = target_url WHERE a.tab_id <> b.tab_id""",
    "edge_merge": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY reason <> 'navigation', ts NULLS FIRST, source, target, reason, COALESCE(weight, 0) DESC) AS r
          FROM edges WHERE source IS NOT NULL AND target IS NOT NULL AND source <> target) SELECT source, target, weight, reason FROM r WHERE r = 1""",
    "nav_stream": f"WITH {_VISITS} SELECT tab_id, source_url, target_url, epoch_us(ts) AS ts, transition_type FROM nav",
    "run_cache_fill": f"""WITH {_TABS_CANON} SELECT id, first_value(simhash IGNORE NULLS) OVER (PARTITION BY canonical_url ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS simhash FROM ct""",
    "import_rekey": """SELECT 'import_' || source AS source, 'import_' || target AS target, reason, max(weight) AS weight FROM edges WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY ALL""",
    "export_reindex": """WITH p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS p FROM tabs WHERE duplicate_of IS NULL AND id IS NOT NULL)
        SELECT a.p::BIGINT AS source, b.p::BIGINT AS target, weight, reason FROM edges e JOIN p a ON a.id = e.source JOIN p b ON b.id = e.target""",
    "upsert_tabs": """SELECT id, url, CASE WHEN duplicate_of IS NOT NULL THEN 'again: ' || COALESCE(title, '') ELSE title END AS title, group_id FROM tabs WHERE error IS NULL OR error <> 'unsupported_url'""",
    "props_json": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
    "windows_flatten": f"""WITH w AS (SELECT *, min(id) OVER (PARTITION BY browser, window_id) AS wp FROM tabs WHERE id IS NOT NULL),
        k AS (SELECT regexp_replace(COALESCE(url, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS url, regexp_replace(COALESCE(title, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS title, browser, window_id, wp, id AS i FROM w WHERE regexp_replace(COALESCE(url, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') <> '')
        SELECT row_number() OVER (ORDER BY wp, i) - 1 AS id, url, title, browser, window_id, COALESCE({_DOMAIN}, '') AS domain FROM k""",
    "html_pages": r"""SELECT doc_id, trim(regexp_replace(COALESCE(title, ''), '[\s\p{Z}\x1c-\x1f\x85]+', ' ', 'g')) AS title, trim(regexp_replace(COALESCE(text, ''), '[\s\p{Z}\x1c-\x1f\x85]+', ' ', 'g')) AS readable, url AS canonical
        FROM documents WHERE url IS NOT NULL""",
    "session_tabs": "SELECT url, COALESCE(title, '') AS title, count(*)::BIGINT AS times FROM tabs WHERE id IS NOT NULL AND url <> '' GROUP BY ALL",
    "backup_round_trip": f"""WITH k AS (SELECT regexp_replace(COALESCE(url, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS url, regexp_replace(COALESCE(title, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS title, browser, window_id FROM tabs WHERE id IS NOT NULL)
        SELECT url, title, browser, window_id, COALESCE({_DOMAIN}, '') AS domain, count(*)::BIGINT AS times FROM k WHERE url <> '' GROUP BY ALL""",
    "graph_document": "SELECT id, url, summary, simhash, group_id FROM tabs WHERE id IS NOT NULL",
    "graph_tables": "SELECT (SELECT count(*) FROM tabs)::BIGINT AS tabs, 0::BIGINT AS groups, (SELECT count(*) FROM edges)::BIGINT AS edges, (SELECT sum(weight) FROM edges) AS weight",
    "model_summaries": f"""WITH t0 AS (SELECT doc_id AS id, title, COALESCE(text, '') AS text FROM documents), t1 AS (SELECT *, {_CLIPPED} AS body FROM t0),
        p AS (SELECT *, len('Summarize the page in 2-3 sentences. Focus on what it is about and why it matters.' || chr(10) || 'Title: ' || CASE WHEN COALESCE(title, '') = '' THEN 'Untitled' ELSE title END || chr(10) || 'Content:' || chr(10) || body || chr(10) || chr(10) || 'Summary:') AS n FROM t1)
        SELECT id, CASE WHEN n % 2 = 0 THEN n || ' characters' ELSE {_SENTENCES} END AS summary, CASE WHEN n % 2 = 0 THEN 'llm' ELSE 'fallback' END AS summary_source, CASE WHEN n % 2 = 1 THEN 'summary_failed: odd' END AS error FROM p""",
    "model_embeddings": """WITH x AS (SELECT id, embedding, text_excerpt, concat_ws(chr(10), CASE WHEN title <> '' THEN 'Title: ' || title END, CASE WHEN summary <> '' THEN 'Summary: ' || summary END, CASE WHEN domain <> '' THEN 'Domain: ' || domain END) AS l FROM tabs),
        y AS (SELECT id, embedding, CASE WHEN l <> '' THEN l ELSE COALESCE(text_excerpt, '') END AS t FROM x)
        SELECT id, CASE WHEN embedding IS NOT NULL THEN len(embedding) WHEN t <> '' THEN 1 END::INTEGER AS dims, CASE WHEN embedding IS NULL AND t <> '' THEN len(t)::DOUBLE WHEN len(embedding) = 1 THEN embedding[1] END AS characters, NULL::VARCHAR AS embedding_error FROM y""",
    "tab_totals": "WITH w AS (SELECT browser, window_id, count(*) AS n FROM tabs WHERE id IS NOT NULL GROUP BY ALL) SELECT browser, sum(n)::BIGINT AS tabs, count(*)::BIGINT AS windows FROM w GROUP BY 1",
    "input_limit": "SELECT id, url FROM tabs WHERE id IS NOT NULL ORDER BY id LIMIT 100",
    "lookup_by_address": "SELECT canonical_url, min(id) AS id, arg_min_null(title, id) AS title FROM tabs WHERE id IS NOT NULL AND canonical_url IS NOT NULL GROUP BY 1",
    "update_groups": "SELECT id, CASE WHEN group_id = -1 THEN id ELSE group_id END AS group_id FROM tabs",
    "non_duplicates": "SELECT id, domain FROM tabs WHERE duplicate_of IS NULL",
    "union_edges": f"""WITH {_VISITS}, um0 AS (SELECT COALESCE(canonical_url, url) AS address, id FROM tabs UNION ALL SELECT url, id FROM tabs), um AS (SELECT address, max(id) AS tab_id FROM um0 WHERE address IS NOT NULL GROUP BY 1),
        al AS (SELECT source, target, weight, reason, ts FROM edges WHERE reason <> 'navigation' UNION ALL
          SELECT a.tab_id, b.tab_id, 1.0, 'navigation', ts FROM nav JOIN um a ON a.address = source_url JOIN um b ON b.address = target_url WHERE a.tab_id <> b.tab_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY reason <> 'navigation', ts NULLS FIRST, source, target, reason, COALESCE(weight, 0) DESC) AS r
          FROM al WHERE source IS NOT NULL AND target IS NOT NULL AND source <> target) SELECT source, target, weight, reason FROM r WHERE r = 1""",
    "tracking_parameters": f"""WITH p AS (SELECT lower(split_part(unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')), '=', 1)) AS name FROM tabs)
        SELECT name, count(*)::BIGINT AS times FROM p WHERE name IN {_in(TRACKING_PARAMETERS)} OR starts_with(name, 'utm_') GROUP BY 1""",
}
