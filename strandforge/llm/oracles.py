"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

OP3 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     n AS (SELECT doc_id, t, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') AS norm FROM d),
     g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-length(t)::BIGINT, doc_id)) AS keep_id FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""

OP9 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * v.c[i])) AS BIGINT) AS score
           FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


OP11 = """
WITH t AS (SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n
           FROM conversations WHERE conv_id IS NOT NULL),
     own AS (SELECT conv_id, list(x ORDER BY n) AS turns FROM t GROUP BY conv_id),
     crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))) AS tab),
     h AS (SELECT conv_id, turns, CAST(xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT)),
                  lambda a, b: xor(a >> 8, tab[CAST((xor(a, b) & 255) + 1 AS BIGINT)])), 4294967295) % 9 AS BIGINT) AS h FROM own, crc),
     path AS (SELECT h.conv_id, list_filter(coalesce(b.turns, []), lambda x, i: i <= h.h) || list_filter(h.turns, lambda x, i: i > h.h) AS p
              FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
     occ AS (SELECT conv_id, d, list_filter(p, lambda x, i: i <= d) AS p, len(p) = d AS ends, CASE WHEN d > 0 THEN strlen(p[d].t) ELSE 0 END AS b
             FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM path)),
     node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
                     sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM occ GROUP BY p, d),
     child AS (SELECT list_filter(p, lambda x, i: i < d) AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
     whole AS (SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN child USING (p, d)),
     below AS (SELECT list_filter(p, lambda x, i: i <= k) AS p, k AS d, sum((n_convs - 1) * b) AS saved, count(*) FILTER (n_children = 0) AS leaves
               FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM whole) GROUP BY ALL)
SELECT w.conv_id, w.d AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, below.leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM whole w JOIN below ON below.p = w.p AND below.d = w.d LEFT JOIN whole up ON up.d = w.d - 1 AND up.p = list_filter(w.p, lambda x, i: i < w.d)
"""


def op13(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round as two tables: the nearest entry of each part, the entries after it."""
    steps = []
    for n in range(rounds + 1):
        apart = f"SELECT p.uid, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS d FROM p JOIN b{n} b USING (part, pos) GROUP BY ALL"
        steps.append(f"a{n} AS MATERIALIZED (SELECT uid, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM ({apart}) GROUP BY ALL)")
        mean = f"SELECT part, entry, pos, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM p JOIN a{n} USING (uid, part) GROUP BY ALL"
        steps.append(f"b{n + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN ({mean}) m USING (part, entry, pos))")
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS uid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     p AS MATERIALIZED (SELECT uid, i // (n // {parts}) AS part, i % (n // {parts}) AS pos, c[i + 1] AS x FROM (SELECT uid, c, len(c) AS n, unnest(range(len(c))) AS i FROM v)),
     b0 AS MATERIALIZED (SELECT part, uid AS entry, pos, x FROM p WHERE uid < {entries}),
     {", ".join(steps[:-1])},
     e AS (SELECT uid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d) AS error FROM a{rounds} GROUP BY uid),
     l AS (SELECT label, sum(error) AS label_error FROM v JOIN e USING (uid) GROUP BY label)
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(label_error AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
FROM v JOIN e USING (uid) JOIN l ON l.label IS NOT DISTINCT FROM v.label
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3, "op9_exact_top_k": OP9, "op11_prefix_trie": OP11, "op13_vector_codes": op13()}
