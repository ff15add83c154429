"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""

ORACLE: dict[str, str] = {
    "op11_negatives": """
WITH rows_ AS (
    SELECT vec_id,
        CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS alike,
        CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM rows_ a JOIN rows_ c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.v) = len(c.v)
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike
    AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 5
""",
    "op12_phrases": r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
numbered AS (SELECT lang, row_number() OVER () AS piece_no, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
listed AS (SELECT lang, piece_no, unnest(words) AS w1, generate_subscripts(words, 1) AS pos FROM numbered),
following AS (
    SELECT lang, w1, lead(w1, 1) OVER piece AS w2, lead(w1, 2) OVER piece AS w3
    FROM listed WINDOW piece AS (PARTITION BY piece_no ORDER BY pos)
),
counted AS (
    SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM following GROUP BY ALL
    UNION ALL
    SELECT lang, 2, w1 || ' ' || w2, count(*) FROM following WHERE w2 IS NOT NULL GROUP BY ALL
    UNION ALL
    SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM following WHERE w3 IS NOT NULL GROUP BY ALL
),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang),
whole AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= 10),
cuts AS (
    SELECT c.lang, c.k, c.phrase, c.a, cut, x.f AS l, y.f AS r,
        CAST(1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM whole c JOIN (VALUES (1), (2)) AS places(cut) ON cut < c.k
    JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ')
    JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')
),
scored AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
),
inside AS (
    SELECT lang, part, max(a) AS longest
    FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part
          FROM whole WHERE k = 3)
    GROUP BY ALL
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank,
    phrase, a, l, r, n, score
FROM scored s JOIN totals USING (lang) LEFT JOIN inside i ON i.lang = s.lang AND i.part = s.phrase
WHERE longest IS NULL OR 100 * longest < 50 * a
QUALIFY row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) <= 2000
""",
}
