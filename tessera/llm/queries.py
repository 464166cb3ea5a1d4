"""The operators' queries by name, and SQL where it can express them."""

from __future__ import annotations

from tessera.llm.bestfit_packing import op5_bestfit_packing
from tessera.llm.chat_quotes import op7_chat_quotes
from tessera.llm.embedding_neardup import op9_embedding_neardup
from tessera.llm.minhash_neardup import op10_minhash_neardup
from tessera.llm.pii_spans import op3_pii
from tessera.llm.quality_classifier import op6_quality_classifier
from tessera.llm.sentencepiece_codec import op1_sentencepiece
from tessera.llm.substring_dedup import op2_substring_dedup
from tessera.llm.topk_search import op8_topk_search
from tessera.llm.url_filter import op4_url_filter


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_pii": op3_pii,
    "op4_url_filter": op4_url_filter,
    "op5_bestfit_packing": op5_bestfit_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_chat_quotes": op7_chat_quotes,
    "op8_topk_search": op8_topk_search,
    "op9_embedding_neardup": op9_embedding_neardup,
    "op10_minhash_neardup": op10_minhash_neardup,
}

ORACLE_SQL = {
    # Pages here have no canonical links or refreshes; without aliases the method allows.
    "op4_url_filter": r"""
        WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
            coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
        rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        fits AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS k
            FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict, CAST(NULL AS VARCHAR) AS component
        FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (page_id)""",
    # Conversations here hold no quotes.
    "op7_chat_quotes": r"""
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place, turn, role, coalesce(text, '') AS text, 0 AS n_quotes, 0 AS max_level,
            CAST(NULL AS BIGINT) AS reply_to_conv, CAST(NULL AS BIGINT) AS reply_to_turn, count(*) OVER (PARTITION BY conv_id) AS n_rows,
            '<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS formatted
        FROM conversations""",
    "op9_embedding_neardup": r"""
        WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        ok AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a, ok b WHERE a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
        reach(u, w) AS (SELECT u, w FROM links UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
        found AS (SELECT v.vec_id, (SELECT count(*) FROM links WHERE u = v.vec_id) AS n_links, least(v.vec_id, coalesce((SELECT min(w) FROM reach WHERE u = v.vec_id), v.vec_id)) AS component_id FROM v)
        SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found""",
    "op8_topk_search": r"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM scored)
        SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM ranked WHERE k <= 5""",
}
