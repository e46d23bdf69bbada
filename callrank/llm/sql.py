"""DuckDB twins of this package's queries, where SQL can express them over whole tables.

None is given for the learned and hashed operators (2, 4, 5, 6, 7, 8, 9, 10 and 1) nor for the search of periods (13); their
tests hold them against brute force.
"""

from __future__ import annotations

from callrank.llm.mixing import ipf_sql

TOP_PRODUCTS = """
WITH v AS (
    SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS query_id, a.row AS query_row, b.vec_id,
        CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.row <> b.row
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored
) WHERE rank <= 5
"""

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def crc32(text: str) -> str:
    """The unsigned check sum of ASCII text, bit by bit; the long number is the fixed polynomial."""
    octets = f"list_transform(range(1, len({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    turned = "list_reduce(range(8), lambda r, k: xor(r >> 1, 3988292384 * (r & 1)), xor(c, b))"
    return f"xor(list_reduce({octets}, lambda c, b: {turned}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


def _climb(name: str, levels: int) -> list[str]:
    """From ``{name}0`` (tree, idx, n, digest): the runs of each level, and the nodes above them."""
    steps = []
    for k in range(levels):
        steps += [
            f"{name}_run{k} AS MATERIALIZED (SELECT tree, idx // 16 AS idx, (n + 15) // 16 AS n, string_agg(digest, '' ORDER BY idx) AS run "
            f"FROM {name}{k} WHERE n > 1 GROUP BY tree, idx // 16, (n + 15) // 16)",
            f"{name}{k + 1} AS MATERIALIZED (SELECT tree, idx, n, sha256(run) AS digest FROM {name}_run{k})",
        ]
    steps.append(
        f"{name}_done AS MATERIALIZED ({' UNION ALL '.join(f'SELECT tree, digest FROM {name}{k} WHERE n = 1' for k in range(levels + 1))})"
    )
    return steps


def _fold(source: str, name: str, levels: int) -> list[str]:
    """Each row's siblings and digest, taken up level by level from ``source`` (row, tree, idx, proof, folded)."""
    steps = []
    for k in range(levels):
        before, after = "substr(run, 1, 64 * (p.idx % 16))", "substr(run, 64 * (p.idx % 16) + 65)"
        steps.append(
            f"{name}{k} AS MATERIALIZED (SELECT p.row, p.tree, p.idx // 16 AS idx, p.proof || coalesce({before} || {after}, '') AS proof, "
            f"CASE WHEN run IS NULL THEN folded ELSE sha256({before} || folded || {after}) END AS folded "
            f"FROM {source} p LEFT JOIN {name[:-5]}_run{k} r ON r.tree = p.tree AND r.idx = p.idx // 16)"
        )
        source = f"{name}{k}"
    return steps


def merkle_sql(levels: int = 6) -> str:
    """The manifest for up to 16^levels documents a source and sources."""

    def leaf(text: str) -> str:
        values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"

    lower = f"translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}')"
    drawn = f"{crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0"
    steps = [
        f"leaves AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {drawn} THEN {leaf(lower)} END AS changed FROM documents)",
        "placed AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf, changed) AS row, "
        "dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source "
        "ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaves)",
        "node0 AS MATERIALIZED (SELECT tree, idx, n, leaf AS digest FROM placed)",
        *_climb("node", levels),
        "top0 AS MATERIALIZED (SELECT 0 AS tree, tree AS idx, (SELECT count(*) FROM node_done) AS n, digest FROM node_done)",
        *_climb("top", levels),
        "start AS MATERIALIZED (SELECT row, tree, idx, '' AS proof, coalesce(changed, leaf) AS folded FROM placed)",
        *_fold("start", "node_fold", levels),
        f"start_top AS MATERIALIZED (SELECT row, 0 AS tree, tree AS idx, proof, folded FROM node_fold{levels - 1})",
        *_fold("start_top", "top_fold", levels),
    ]
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, "
        f"folded AS folded_root, folded = r.digest AS verified FROM placed p JOIN top_fold{levels - 1} f ON f.row = p.row "
        "JOIN node_done s ON s.tree = p.tree CROSS JOIN top_done r"
    )


ALL: dict[str, str] = {
    "op3_mixing": ipf_sql()
    + "\nSELECT doc_id, source, lang, topic, n_words, round(weight, 6) AS weight, round(probability, 6) AS probability, sampled FROM mixed",
    "op11_bitslice": TOP_PRODUCTS,
    "op12_merkle": merkle_sql(),
}
