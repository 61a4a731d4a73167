"""SQL for the queries that SQL can express. The others rest on models, tokenizers or rules; tests hold them against
brute force, an exact round trip or held-out accuracy."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr(digest, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '')"""


def _components(links: str) -> str:
    """CTEs that end in `roots` (node, root) over the symmetric links (a, b)."""
    return f"""links AS ({links}),
        reach AS (SELECT a, a AS b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        roots AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a)"""


ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": f"""
        WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
        starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM docs),
        ranked AS (SELECT doc_id, p, row_number() OVER (
                PARTITION BY array_to_string(w[p : p + 19], ' ') ORDER BY doc_id, p) AS place FROM starts),
        gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM ranked WHERE place > 1),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS body
            FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
            sha256(coalesce(body, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (doc_id)""",
    "op4_embedding_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
        {_components("SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id "
                     "AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.98")}
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id,
            vec_id = coalesce(root, vec_id) AS kept
        FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = vec_id LEFT JOIN roots ON node = vec_id""",
    "op6_warc": f"""
        WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY digest, n) AS first FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f""",
    "op7_ngram_jaccard": f"""
        WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, {_LOWER} AS text
            FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))),
        sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
            list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM docs),
        tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
        {_components("SELECT x.doc_id AS a, y.doc_id AS b FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id <> y.doc_id "
                     "GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))")}
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id
        FROM sets LEFT JOIN roots ON node = doc_id""",
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT a.vec_id AS anchor_id, v.vec_id AS other_id, a.label = v.label AS same,
                CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
            FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id AND len(a.q) = len(v.q)),
        near AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (
                PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
            other_id AS negative_id, positive_score, score AS negative_score
        FROM near JOIN scored USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY rank <= 5""",
}
