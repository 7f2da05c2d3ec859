"""The results of the queries of this subpackage as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_decontamination"] = r"""
WITH words AS (
    SELECT doc_id, row_number() OVER () AS r,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), items AS (
    SELECT item_id::VARCHAR AS item,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), sizes AS (
    SELECT item, w, least(len(w), 13) AS n FROM items WHERE len(w) > 0
), windows AS (
    SELECT item, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT item, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM sizes)
), lengths AS (
    SELECT DISTINCT n FROM windows
), hits AS (
    SELECT r, i, d.n, item FROM (
        SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
        FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)
    ) d JOIN windows USING (win) WHERE d.n = windows.n
), covered AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), named AS (
    SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

ORACLES["op5_warc"] = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), m AS (
    SELECT h, max(page_id) AS top FROM p GROUP BY h
)
SELECT page_id, n::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to,
    NULL::VARCHAR AS problem
FROM p JOIN m USING (h)
"""

ORACLES["op10_line_dedup"] = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS k, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), h AS (
    SELECT *, list_transform(ls, lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT) AS hs FROM d
), r AS (
    SELECT *, list_transform(range(1, len(ls)), lambda i: (31 * hs[i] + hs[i + 1]) % 65521 % 16) AS rs FROM h
), o AS (
    SELECT doc_id, k, ls, rs, unnest(range(1, len(ls))) AS i FROM r
), e AS (
    SELECT doc_id, k, ls, i, list_filter(range(i, least(i + 7, len(ls))), lambda q: rs[q] <> 1 AND trim(ls[q + 1], ' ') <> '')[1] + 1 AS fin
    FROM o WHERE rs[i] <> 0 AND trim(ls[i], ' ') <> ''
), c AS (
    SELECT doc_id, k, i, fin, array_to_string(ls[i : fin], chr(10)) AS body FROM e WHERE fin IS NOT NULL
), f AS (
    SELECT *, first_value(struct_pack(a := doc_id, b := k, c := i, d := fin))
        OVER (PARTITION BY body ORDER BY doc_id NULLS FIRST, k, i) AS o FROM c
), gone AS (
    SELECT DISTINCT doc_id, k, unnest(range(i, fin + 1)) AS at FROM f
    WHERE doc_id IS DISTINCT FROM o.a OR k <> o.b OR i > o.d
), l AS (
    SELECT doc_id, t, k, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS at FROM d
)
SELECT l.doc_id, CASE WHEN t = '' THEN 0 ELSE count(*) END::BIGINT AS n_lines, count(gone.at)::BIGINT AS n_removed,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY l.at) FILTER (WHERE gone.at IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone ON l.doc_id IS NOT DISTINCT FROM gone.doc_id AND l.k = gone.k AND l.at = gone.at
GROUP BY l.doc_id, l.k, t
"""

ORACLES["op3_phrases"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), repeated AS (
    SELECT r, i FROM windows SEMI JOIN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1) USING (h)
), gone AS (
    SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM repeated
), words AS (
    SELECT r, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
    SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS body FROM words ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

ORACLES["op9_ngram_join"] = r"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), s AS (
    SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS grams
    FROM d
), g AS (
    SELECT r, unnest(grams) AS gram FROM s
), shared AS (
    SELECT a.r AS x, b.r AS y, count(*) AS n FROM g a JOIN g b USING (gram) WHERE a.r <> b.r GROUP BY a.r, b.r
), links AS (
    SELECT x, y FROM shared JOIN s p ON p.r = x JOIN s q ON q.r = y WHERE 100 * n >= 90 * (len(p.grams) + len(q.grams) - n)
), reach AS (
    SELECT r AS x, r AS y FROM s UNION SELECT x, l.y FROM reach JOIN (SELECT x AS m, y FROM links) l ON reach.y = l.m
), named AS (
    SELECT x, min(doc_id) AS component_id FROM reach JOIN s ON s.r = reach.y GROUP BY x
), degrees AS (
    SELECT x, count(*) AS n FROM links GROUP BY x
)
SELECT s.doc_id, len(grams)::BIGINT AS n_shingles, component_id, coalesce(n, 0)::BIGINT AS n_links
FROM s JOIN named ON named.x = s.r LEFT JOIN degrees ON degrees.x = s.r
"""

ORACLES["op11_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), grams AS (
    SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) AS g
    FROM words, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k
), f AS (
    SELECT lang, g, count(*)::HUGEINT AS a FROM grams GROUP BY lang, g
), cuts AS (
    SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1 AND a >= 10
), scores AS (
    SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a * y.a) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1 :]
), candidates AS (
    SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), longer AS (
    SELECT lang, part, max(a) AS a FROM (
        SELECT lang, unnest([g[1:2], g[2:3]]) AS part, a FROM candidates WHERE len(g) = 3
    ) GROUP BY lang, part
), kept AS (
    SELECT c.lang, array_to_string(c.g, ' ') AS phrase, c.a, c.l, c.r, c.score
    FROM candidates c LEFT JOIN longer ON longer.lang = c.lang AND longer.part = c.g
    WHERE longer.a IS NULL OR 100 * longer.a < 50 * c.a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
