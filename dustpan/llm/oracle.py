"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from dustpan.llm import centroids, mixing, warc

_WORD = r"'[^\x20\x09-\x0D]+'"

OP7 = f"""
WITH chars AS (
    SELECT source, sum(coalesce(length(text), 0))::BIGINT AS chars FROM documents GROUP BY source),
whole AS (SELECT sum(chars)::DOUBLE AS chars, sum(pow(chars::DOUBLE, 0.5)) AS weight FROM chars WHERE chars > 0),
rates AS (
    SELECT source, CASE WHEN c.chars = 0 THEN 1.0
                        ELSE pow(c.chars::DOUBLE, 0.5) / w.weight * w.chars / c.chars END AS rate
    FROM chars c, whole w),
parts AS (SELECT *, greatest(ceil(rate / {mixing.PART}), 1)::INT AS parts FROM rates),
steps AS (
    WITH RECURSIVE s AS (
        SELECT source, rate / parts AS mean, 0 AS k, exp(-rate / parts) AS p, exp(-rate / parts) AS total FROM parts
        UNION ALL
        SELECT source, mean, k + 1, p * mean / (k + 1), total + p * mean / (k + 1) FROM s WHERE k < 64)
    SELECT source, list(total) AS tbl FROM s GROUP BY source),
drawn AS (
    SELECT d.doc_id, d.source, sum(len(list_filter(s.tbl, lambda t: t <=
        ((('0x' || substr(md5(concat_ws(':', d.doc_id, {mixing.SEED}, j.j)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)))) AS n
    FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
    JOIN steps s ON d.source IS NOT DISTINCT FROM s.source,
    LATERAL (SELECT unnest(range(1, p.parts + 1)) AS j) j
    GROUP BY d.doc_id, d.source)
SELECT doc_id, source, copy, md5(concat_ws(':', doc_id, copy, {mixing.SEED})) AS order_key
FROM (SELECT doc_id, source, unnest(range(1, n::BIGINT + 1)) AS copy FROM drawn)
"""




def _op12(k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64) -> str:
    """Every round as two common table expressions: assignments a<r> and centroids c<r>."""
    steps = [f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda v: floor({centroids.SCALE} * v::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
cells AS MATERIALIZED (SELECT vec_id, unnest(x) AS v, unnest(range(1, {size} + 1)) AS i FROM kept),
drawn AS (SELECT x, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS c FROM kept),
c0 AS MATERIALIZED (SELECT c, unnest(x) AS v, unnest(range(1, {size} + 1)) AS i FROM drawn WHERE c < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS (SELECT s.vec_id, c.c, sum((s.v - c.v) * (s.v - c.v))::BIGINT AS distance
         FROM cells s JOIN c{r} c ON s.i = c.i GROUP BY s.vec_id, c.c),
a{r} AS MATERIALIZED (SELECT vec_id, first(c ORDER BY distance, c) AS c, min(distance) AS distance FROM d{r} GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT a.c, s.i, sum(s.v)::BIGINT AS total, count(*) AS n FROM a{r} a JOIN cells s ON a.vec_id = s.vec_id GROUP BY a.c, s.i),
c{r + 1} AS MATERIALIZED (
    SELECT c.c, c.i, CASE WHEN m.n IS NULL THEN c.v ELSE (m.total - ((m.total % m.n) + m.n) % m.n) // m.n END AS v
    FROM c{r} c LEFT JOIN m{r} m ON c.c = m.c AND c.i = m.i)""")
    return ",".join(steps) + f"""
SELECT a.vec_id, a.c::INTEGER AS cluster, a.distance,
       (sum(a.distance) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia,
       p.digest AS centroid_sha256
FROM a{rounds} a JOIN (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS digest FROM c{rounds} GROUP BY c) p ON a.c = p.c
"""


OP13 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, max(page_id) AS top FROM p WHERE octet_length(encode(html)) >= {warc.LEAST_REVISIT} GROUP BY html)
SELECT p.page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN f.top <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.top <> p.page_id THEN f.top END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""


def all_oracles() -> dict[str, str]:
    return {"op7_mixing": OP7, "op12_centroids": _op12(), "op13_warc": OP13}
