"""DuckDB SQL of the training-data operators that SQL can express."""

from __future__ import annotations

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

DIVERGENCE = rf"""
    WITH d AS (
        SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents
    ), c AS (
        SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs
        FROM (SELECT id, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL
    ), k AS (
        SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 10
    ), g AS (
        SELECT DISTINCT lang, source FROM d
    ), v AS (
        SELECT lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS n FROM (SELECT DISTINCT lang FROM g) LEFT JOIN k USING (lang) GROUP BY lang
    ), every AS (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS own
        FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    ), p AS (
        SELECT e.lang, source, term, e.n,
            1 + (CAST(1000000000 AS HUGEINT) * (e.n + 2)) // CAST(own + 2 * v.v AS HUGEINT) AS p,
            1 + (CAST(1000000000 AS HUGEINT) * (e.lang_n + 2)) // CAST(v.n + 2 * v.v AS HUGEINT) AS q
        FROM every e JOIN v ON v.lang = e.lang
    ), pairs AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), both_parts AS (
        SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
        FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
        LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
        UNION ALL
        SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
    )
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
        CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM both_parts
    QUALIFY part = 'pair' OR rank <= 10
"""

COLLOCATIONS = rf"""
    WITH pieces AS (
        SELECT lang, row_number() OVER () AS piece, regexp_extract_all(text, '[^\x20\x09]+') AS w FROM (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {LOWER}), '[.,;:!?\x0A-\x0D]')) AS text
            FROM documents
        )
    ), grams AS (
        SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
        FROM pieces, range(1, 6) AS sizes(size) WHERE len(w) >= size
    ), f AS (
        SELECT lang, CAST(size AS INTEGER) AS size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
    ), totals AS (
        SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang
    ), cuts AS (
        SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, size, unnest(range(1, size)) AS k FROM f WHERE size > 1
    ), scored AS (
        SELECT c.lang, c.phrase, c.a, c.size, c.k, x.f AS l, y.f AS r, n, CAST(1000 AS HUGEINT) * c.a * n // (CAST(x.f AS HUGEINT) * y.f) AS score
        FROM cuts c JOIN totals t ON t.lang = c.lang
        JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
        JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
        QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1
    ), kept AS (
        SELECT s.* FROM scored s WHERE NOT EXISTS (
            SELECT 1 FROM f g WHERE g.lang = s.lang AND g.size > s.size AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * g.f >= 100 * s.a
        )
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM kept QUALIFY rank <= 2000
"""

NEAR_EMBEDDINGS = """
    WITH RECURSIVE usable AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), unit AS (
        SELECT vec_id, len(e) AS length, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM usable
    ), links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND a.length = b.length
        WHERE list_dot_product(a.e, b.e) >= 0.9
    ), reach(a, b) AS (
        SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
    ), counted AS (
        SELECT a, count(*) AS n FROM links GROUP BY a
    ), smallest AS (
        SELECT a, min(b) AS b FROM reach GROUP BY a
    )
    SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(s.b, e.vec_id)) AS component_id, e.vec_id <= coalesce(s.b, e.vec_id) AS kept
    FROM embeddings e LEFT JOIN counted c ON c.a = e.vec_id LEFT JOIN smallest s ON s.a = e.vec_id
"""
