"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

EXACT = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
  FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY plain ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""

MIXING = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, source_size * 3.0::DOUBLE AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
v AS (SELECT *, max(CASE WHEN level * weight <= most THEN level END) OVER () AS found FROM l),
t AS (SELECT source, source_size, least(coalesce(found * weight, most), most) AS target FROM v),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target,
       (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) * d.size AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""


def _centroids(clusters: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Rounds of assignment and update as one chain of tables, component by component."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        f"q AS MATERIALIZED (SELECT r, vec_id, i, floor(1024 * x[i])::BIGINT AS q FROM v, range(1, {dims + 1}) t(i))",
        f"seed AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k FROM v ORDER BY sha256('3:' || vec_id) LIMIT {clusters})",
        "c0 AS MATERIALIZED (SELECT k, i, q AS c FROM q JOIN seed USING (r))",
    ]
    best = "(SELECT r, k, d FROM (SELECT r, k, sum((q - c) * (q - c))::BIGINT AS d FROM q JOIN {c} USING (i) GROUP BY r, k) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)"
    for n in range(rounds):
        parts.append(f"a{n} AS MATERIALIZED {best.format(c=f'c{n}')}")
        moved = f"SELECT k, i, floor(sum(q)::DOUBLE / count(*))::BIGINT AS c FROM q JOIN a{n} USING (r) GROUP BY k, i"
        parts.append(f"c{n + 1} AS MATERIALIZED (SELECT k, i, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN ({moved}) m USING (k, i))")
    parts.append(f"a AS MATERIALIZED {best.format(c=f'c{rounds}')}")
    parts.append(f"names AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM v JOIN a USING (r) JOIN names USING (k)"""


NEIGHBOURS = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, q.r AS of, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - c.x[i]) * (q.x[i] - c.x[i])), lambda a, b: a + b)) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.x) = len(c.x))
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY of ORDER BY score, vec_id NULLS LAST))::INTEGER AS rank FROM p) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": MIXING, "op5_exact": EXACT, "op11_centroids": _centroids(), "op13_neighbours": NEIGHBOURS}
