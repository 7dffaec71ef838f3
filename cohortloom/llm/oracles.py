"""DuckDB SQL for those text queries that SQL can express."""

from __future__ import annotations


def op11(k: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds written out: every vector against every centroid."""
    parts = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x FROM kept QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), x) <= {k})",
    ]
    for r in range(rounds + 1):
        d = "CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
        parts.append(f"a{r} AS MATERIALIZED (SELECT v.rid, min({d} * {k} + c.c) AS best FROM kept v CROSS JOIN c{r} c GROUP BY v.rid)")
        if r < rounds:
            parts.append(f"u{r} AS (SELECT a.best % {k} AS c, unnest(v.x) AS y, unnest(range(len(v.x))) AS i FROM a{r} a JOIN kept v USING (rid))")
            parts.append(f"m{r} AS (SELECT c, i, sum(y) AS s, count(*) AS n FROM u{r} GROUP BY c, i)")
            parts.append(f"n{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM m{r} GROUP BY c)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN n{r} n ON n.c = c.c)")
    return (
        "WITH " + ", ".join(parts) + f" SELECT v.vec_id, CAST(a.best % {k} AS INTEGER) AS cluster, CAST(a.best // {k} AS BIGINT) AS distance,"
        f" CAST(sum(a.best // {k}) OVER (PARTITION BY a.best % {k}) AS BIGINT) AS cluster_inertia, CAST(sum(a.best // {k}) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN kept v USING (rid) JOIN c{rounds} c ON c.c = a.best % {k}"
    )


def _crc(hexed: str) -> str:
    """crc32 of bytes in hexadecimal: each byte is added to the register, then shifted out bit by bit."""
    steps = f"flatten(list_transform(range(1, len({hexed}) // 2 + 1), lambda i: list_concat([CAST('0x' || substr({hexed}, 2 * i - 1, 2) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce(list_concat([4294967295], {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"


def op12() -> str:
    """Turn after turn in each conversation, by a recursion that carries all deliveries so far."""
    tries = " ".join(f"WHEN s + {after} >= repaired AND h{a + 2} % 3 <> 0 THEN {a}" for a, after in enumerate((0, 20, 60, 140, 300, 620), 1))
    return (
        "WITH RECURSIVE raw AS (SELECT conv_id, turn, hex(encode(coalesce(text, ''))) AS hexed, coalesce(CAST(conv_id AS VARCHAR), 'null') || ':' || coalesce(CAST(turn AS VARCHAR), 'null') AS own FROM conversations),"
        f" summed AS MATERIALIZED (SELECT conv_id, turn, {_crc('hexed')} AS crc, own FROM raw),"
        " placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, crc) - 1 AS p FROM summed),"
        " keyed AS (SELECT DISTINCT own, k, hex(encode(k || ':' || own)) AS hexed FROM placed, range(9) AS r(k)),"
        f" hashed AS (SELECT own, k, {_crc('hexed')} AS h FROM keyed),"
        f" wide AS MATERIALIZED (SELECT own, {', '.join(f'max(h) FILTER (k = {k}) AS h{k}' for k in range(9))} FROM hashed GROUP BY own),"
        " turns AS MATERIALIZED (SELECT conv_id, turn, crc, p, h0 % 5 AS back, h1 % 101 < 50 AS faulty, 7 * p + h2 % 101 AS repaired, h3, h4, h5, h6, h7, h8 FROM placed JOIN wide USING (own)),"
        " walk AS (SELECT conv_id, -1 AS p, CAST(NULL AS BIGINT) AS turn, CAST(0 AS BIGINT) AS crc, CAST(NULL AS BIGINT) AS x, CAST(NULL AS BIGINT) AS s, 0 AS a, CAST([] AS BIGINT[]) AS came FROM (SELECT DISTINCT conv_id FROM turns)"
        " UNION ALL SELECT conv_id, p, turn, crc, x, s, a, list_append(came, CASE WHEN x = -2 OR a = 7 THEN -2 ELSE s + [0, 20, 60, 140, 300, 620][a] END) FROM"
        f" (SELECT *, CASE WHEN NOT faulty THEN 1 {tries} ELSE 7 END AS a FROM (SELECT *, greatest(7 * p, x) AS s FROM"
        " (SELECT t.*, w.came, CASE WHEN t.back = 0 OR t.back > t.p THEN -1 ELSE w.came[t.p - t.back + 1] END AS x FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.p = w.p + 1)))),"
        " done AS (SELECT conv_id, turn, p, crc, CASE WHEN x = -2 THEN 'blocked' WHEN a = 7 THEN 'dead' ELSE 'delivered' END AS status, CASE WHEN x = -2 THEN 0 ELSE least(a, 6) END AS attempts,"
        " CASE WHEN x <> -2 THEN s END AS first_at, CASE WHEN x <> -2 THEN s + [0, 20, 60, 140, 300, 620][least(a, 6)] END AS last_at FROM walk WHERE p >= 0),"
        " ranked AS (SELECT *, CASE WHEN status = 'delivered' THEN row_number() OVER (PARTITION BY conv_id, status ORDER BY last_at, turn NULLS LAST, p) END AS release_no FROM done)"
        " SELECT conv_id, turn, status, CAST(attempts AS INTEGER) AS attempts, first_at, last_at, release_no,"
        " CASE WHEN status = 'delivered' THEN CAST(sum(release_no * crc) OVER (PARTITION BY conv_id, status ORDER BY release_no) AS BIGINT) END AS state FROM ranked"
    )


def op13() -> str:
    """All pairs that share a shingle, counted, and the closure of their links."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (
        f"WITH RECURSIVE split AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),"
        " sets AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]"
        " ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM split),"
        " one AS MATERIALIZED (SELECT r, len(s) AS n, unnest(s) AS x FROM sets),"
        " met AS (SELECT a.r AS a, b.r AS b, a.n + b.n AS n, count(*) AS c FROM one a JOIN one b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r, a.n + b.n),"
        " links AS MATERIALIZED (SELECT a, b FROM met WHERE 100 * c >= 85 * (n - c)),"
        " edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),"
        " reach AS (SELECT r AS a, r AS b FROM sets UNION SELECT q.a, e.b FROM reach q JOIN edges e ON q.b = e.a)"
        " SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least.d AS component_id FROM sets s"
        " JOIN (SELECT q.a, min(t.doc_id) AS d FROM reach q JOIN sets t ON t.r = q.b GROUP BY q.a) least ON least.a = s.r"
    )
