"""DuckDB queries of the training-data operators that SQL can express."""


def clustering(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """Clusters of quantised vectors, each round as two common table expressions."""
    square = "list_sum(list_transform(range(1, %d), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT" % (dims + 1)
    parts = [
        f"""v AS (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1 AS cluster, q FROM v WHERE vec_id IS NOT NULL QUALIFY cluster < {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS (SELECT v.row_id, v.vec_id, v.q, c.cluster, {square} AS distance FROM v, c{n} c QUALIFY row_number() OVER (PARTITION BY v.row_id ORDER BY distance, c.cluster) = 1)")
        if n < rounds:
            parts.append(f"m{n} AS (SELECT cluster, i, sum(q[i])::HUGEINT AS s, count(*) AS n FROM a{n}, range(1, {dims + 1}) r(i) GROUP BY ALL)")
            parts.append(f"n{n} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM m{n} GROUP BY ALL)")
            parts.append(f"c{n + 1} AS (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{n} c LEFT JOIN n{n} m USING (cluster))")
    ctes = ",\n".join(parts)
    return f"""WITH {ctes}
SELECT a.vec_id, a.cluster::INT AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""


FILTER_AUDIT = r"""WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
fails AS (SELECT doc_id, part, concat(
    CASE WHEN len(w) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' END) AS f FROM words),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, FALSE))::INT AS good, bool_or(coalesce(toxic = 1, FALSE))::INT AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM fails LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
met AS (SELECT part, f, n, good, toxic, filter_order, list_min(list_filter(range(1, 6), lambda i: contains(f, substr(filter_order, i::BIGINT, 1)))) AS first FROM masks, orders),
steps AS (SELECT part, filter_order, step::INT AS step, substr(filter_order, step::BIGINT, 1) AS x,
    coalesce(sum(n) FILTER (first IS NULL OR first > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (first = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (first < step AND contains(f, substr(filter_order, step::BIGINT, 1))), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (f = substr(filter_order, step::BIGINT, 1)), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (first = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (first = step), 0)::BIGINT AS toxic_lost
  FROM met, range(1, 6) r(step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM steps"""
