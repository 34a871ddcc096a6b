"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

import string

_LOW = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

ARCHIVES = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to, url
FROM p LEFT JOIN k USING (h)"""

SET_JOIN = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + 2], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 90 * (nx.n + ny.n - shared)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.y)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id"""

_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OVERLAP = f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[p : p + n - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS p FROM b)),
dw AS (SELECT doc_id, n, p, array_to_string(ws[p : p + n - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
h AS (SELECT doc_id, n, p, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)"""

_ROUNDS = 10


def _assigned(centroids: str) -> str:
    """Every kept vector with its nearest centroid."""
    return f"""SELECT vec_id, v, cluster, distance FROM (
  SELECT vec_id, v, c AS cluster, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance,
         row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) AS place FROM kept CROSS JOIN {centroids}) WHERE place = 1"""


def _centroids_sql() -> str:
    """The rounds written out; ids of the given table are unique."""
    x = "list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)"
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, {x} AS v FROM embeddings WHERE len(embedding) = 64 AND list_count(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v AS w FROM kept ORDER BY c LIMIT 8)",
    ]
    for r in range(1, _ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED ({_assigned(f'c{r - 1}')})")
        parts.append(f"""c{r} AS MATERIALIZED (SELECT c, coalesce(n, w) AS w FROM c{r - 1} LEFT JOIN (
  SELECT cluster, list((s - ((s % k) + k) % k) // k ORDER BY i) AS n FROM (
    SELECT cluster, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS k FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i
  ) GROUP BY cluster) ON cluster = c)""")
    parts.append(f"z AS ({_assigned(f'c{_ROUNDS}')})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM z JOIN c{_ROUNDS} ON c = cluster"""


_TERMS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
RANKED = f"""WITH d AS (SELECT doc_id, t, len(t)::BIGINT AS n FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE len(t) > 0),
s AS (SELECT count(*)::BIGINT AS N_, sum(n)::BIGINT AS L FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
f AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(t) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2.0::DOUBLE * any_value(N_) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f CROSS JOIN s GROUP BY t),
p AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * N_) // L)))))::BIGINT AS score
      FROM q JOIN f USING (t) JOIN w USING (t) CROSS JOIN s GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM p WHERE score > 0) WHERE rank <= 50"""


def _tree(name: str, text: str) -> str:
    """Common tables that end in ``name``: doc_id, fp (fingerprint), lv (its leaves), ss (sections of digests) and sh (their hashes) of ``text`` in e."""
    return f"""{name}1 AS MATERIALIZED (SELECT doc_id, regexp_extract_all({text}, '[^.!?\n]+[.!?\n]?|[.!?\n]') AS ls FROM e),
{name}2 AS MATERIALIZED (SELECT doc_id, ls, list_transform(ls, lambda x: sha256(x)) AS ds FROM {name}1),
{name}3 AS MATERIALIZED (SELECT doc_id, ds, list_filter(range(1, len(ds) + 1), lambda i: i = len(ds) OR ds[i][-1:] = '0' OR ls[i] = chr(10)) AS es FROM {name}2),
{name}4 AS MATERIALIZED (SELECT doc_id, ds, list_transform(list_zip(list_concat([0], es[:-2]), es), lambda p: ds[p[1] + 1 : p[2]]) AS ss FROM {name}3),
{name}5 AS MATERIALIZED (SELECT doc_id, ds, ss, list_transform(ss, lambda s: sha256(array_to_string(s, ''))) AS sh FROM {name}4),
{name} AS MATERIALIZED (SELECT doc_id, list_transform(ds, lambda x: x[:8]) AS lv, ss, sh, sha256(array_to_string(sh, '')) || array_to_string(list_transform(
  list_zip(sh, ss), lambda p: '/' || p[1][:16] || '.' || array_to_string(list_transform(p[2], lambda x: x[:8]), '')), '') AS fp FROM {name}5)"""


MERKLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first(t) OVER (ORDER BY doc_id)) AS nx FROM d),
e AS MATERIALIZED (SELECT doc_id, length(t) AS n, t[: length(t) - length(t) // 4] || nx[: length(t) // 4] AS et, t FROM n),
{_tree("a", "t")},
{_tree("b", "et")},
x AS (SELECT doc_id, fp, lv, sh, coalesce(lead(fp) OVER o, first(fp) OVER o) AS nfp, coalesce(lead(lv) OVER o, first(lv) OVER o) AS nlv FROM a WINDOW o AS (ORDER BY doc_id)),
y AS (SELECT x.doc_id, b.fp, b.lv, sum(CASE WHEN list_contains(list_transform(x.sh, lambda h: h[:16]), p[1][:16]) THEN 0
        ELSE len(list_filter(p[2], lambda q: NOT list_contains(x.lv, q[:8]))) END) AS k
      FROM x JOIN (SELECT *, unnest(CASE WHEN len(sh) > 0 THEN list_zip(sh, ss) ELSE [NULL] END) AS p FROM b) b USING (doc_id) GROUP BY ALL)
SELECT e.doc_id, e.n::BIGINT AS n_chars, sha256(e.et) AS edited_sha256, x.fp AS fingerprint, y.fp AS edited_fingerprint,
  CASE WHEN x.fp = y.fp THEN 1.0 ELSE len(list_intersect(x.lv, y.lv)) / greatest(len(list_distinct(list_concat(x.lv, y.lv))), 1) END::DOUBLE AS near_edited,
  CASE WHEN x.fp = nfp THEN 1.0 ELSE len(list_intersect(x.lv, nlv)) / greatest(len(list_distinct(list_concat(x.lv, nlv))), 1) END::DOUBLE AS near_next,
  CASE WHEN x.fp = y.fp THEN 0 ELSE coalesce(k, 0) END::BIGINT AS n_differing
FROM e JOIN x USING (doc_id) JOIN y USING (doc_id)"""

ORACLES = {"op11_threshold_centroids": _centroids_sql(), "op12_automaton_rank": RANKED, "op13_merkle_fingerprints": MERKLE} | {"op3_boundary_chain": ARCHIVES, "op5_shingle_join": SET_JOIN, "op6_winnowed_overlap": OVERLAP}
