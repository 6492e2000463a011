"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {
    "op1_suffix_dedup": """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM b)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE least < doc_id),
n AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS first FROM g),
r AS (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
s AS (SELECT doc_id, run, min(i) AS s, max(i) + 50 AS e FROM r GROUP BY ALL),
p AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM s),
k AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS kept FROM p JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM b LEFT JOIN k USING (doc_id)
""",
    "op10_chat_format": """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'),
o AS (SELECT *, row_number() OVER w - 1 AS i, lag(role) OVER w AS p, replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') AS e,
replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), chr(92) || 'n') AS r FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
v AS (SELECT *, CASE WHEN p IS NULL THEN role NOT IN ('system', 'user') WHEN role = 'user' THEN p = 'user' OR p NOT IN ('system', 'assistant') WHEN role = 'assistant' THEN p IN ('system', 'assistant')
WHEN role = 'tool' THEN p = 'system' ELSE true END AS bad FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(12 + length(r) + 1 + length(e) + 10 + 1) AS BIGINT) AS formatted_chars, NOT bool_or(bad) AND arg_max(role, i) = 'assistant' AS valid,
CAST(coalesce(min(i) FILTER (bad), CASE WHEN arg_max(role, i) <> 'assistant' THEN max(i) END) AS INTEGER) AS first_bad FROM v GROUP BY conv_id
""",
}

ORACLE["op11_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 100 AND page_id > least THEN least END AS refers_to FROM f
"""


def _clustering(k: int = 8, rounds: int = 10) -> str:
    """k-means, one step a round: a rounds' vectors (a) and centroids (c)."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS j, v AS c FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(struct_pack(d := d, j := j)) AS best FROM
(SELECT vec_id, v, j, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{r}) GROUP BY vec_id)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS MATERIALIZED (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM
(SELECT j, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT best.j AS j, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY j, i) GROUP BY j),
c{r + 1} AS MATERIALIZED (SELECT o.j, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (j))"""
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT vec_id, CAST(best.j AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.j) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON j = best.j"""
    )


ORACLE["op12_centroids"] = _clustering()

#: The CRC-32 of a decimal number, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(8 * length(s)), lambda k: CAST((ascii(substr(s, CAST(k // 8 + 1 AS BIGINT), 1)) >> CAST(k % 8 AS INTEGER)) & 1 AS BIGINT))),
lambda c, b: xor(c >> 1, 3988292384 * xor(c & 1, b))))"""


def _tree(name: str, base: str, levels: int) -> list[str]:
    """Of base (t, i, node): name_n{l} nodes of level l, name_s{l} with the siblings on both sides of each; a finished tree has no more levels."""
    steps = [f"{name}_n0 AS MATERIALIZED (SELECT t, i, node, count(*) OVER (PARTITION BY t) AS w FROM {base})"]
    for k in range(levels):
        side = lambda op, level=k: f"coalesce((SELECT string_agg(o.node, '' ORDER BY o.i) FROM {name}_n{level} o WHERE o.t IS NOT DISTINCT FROM n.t AND o.i // 8 = n.i // 8 AND o.i {op} n.i), '')"
        steps.append(f"{name}_s{k} AS MATERIALIZED (SELECT t, i, {side('<')} AS before, {side('>')} AS after FROM {name}_n{k} n WHERE w > 1)")
        steps.append(f"{name}_n{k + 1} AS MATERIALIZED (SELECT t, i // 8 AS i, sha256(string_agg(node, '' ORDER BY i)) AS node, any_value((w + 7) // 8) AS w FROM {name}_n{k} WHERE w > 1 GROUP BY t, i // 8)")
    every = " UNION ALL ".join(f"SELECT t, node FROM {name}_n{k} WHERE w = 1" for k in range(levels + 1))
    return [*steps, f"{name}_root AS MATERIALIZED ({every})"]


def _merkle(levels: int = 7, top: int = 3) -> str:
    """Trees of up to 8 ** levels leaves and 8 ** top languages."""
    field = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {field(text)})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"x AS MATERIALIZED (SELECT doc_id, lang AS t, {leaf('text')} AS node, CASE WHEN {_CRC} % 3 = 0 THEN {leaf(lower)} END AS now FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents))",
        "l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, node) - 1 AS i FROM x)",
        *_tree("a", "l", levels),
        "g AS MATERIALIZED (SELECT 0 AS t, t AS lang, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS i, node FROM a_root)",
        *_tree("b", "g", top),
        "f0 AS MATERIALIZED (SELECT doc_id, t, i AS leaf_i, i, node, coalesce(now, node) AS d, '' AS proof FROM l)",
    ]
    for k in range(levels):
        steps.append(f"f{k + 1} AS MATERIALIZED (SELECT doc_id, f.t, leaf_i, f.i // 8 AS i, node, CASE WHEN s.i IS NULL THEN d ELSE sha256(before || d || after) END AS d, proof || coalesce(before || after, '') AS proof FROM f{k} f LEFT JOIN a_s{k} s ON s.t IS NOT DISTINCT FROM f.t AND s.i = f.i)")
    steps.append(f"h0 AS MATERIALIZED (SELECT doc_id, f.node, g.node AS subroot, g.i, d, proof FROM f{levels} f JOIN g ON g.lang IS NOT DISTINCT FROM f.t)")
    for k in range(top):
        steps.append(f"h{k + 1} AS MATERIALIZED (SELECT doc_id, node, subroot, h.i // 8 AS i, CASE WHEN s.i IS NULL THEN d ELSE sha256(before || d || after) END AS d, proof || coalesce(before || after, '') AS proof FROM h{k} h LEFT JOIN b_s{k} s ON s.i = h.i)")
    return (
        "WITH "
        + ",\n".join(steps)
        + f"\nSELECT doc_id, h.node AS leaf, subroot, r.node AS root, sha256(proof) AS proof_sha256, d AS folded_root, d = r.node AS verified FROM h{top} h CROSS JOIN b_root r"
    )


ORACLE["op13_merkle"] = _merkle()
