"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: Base32 of a SHA-1 in hexadecimal: four letters for every five digits.
WARC = r"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, list_aggregate(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

#: Sets of two-word shingles, links by a prefix filter that is exact, and the least id that links reach.
NEAR_DEDUP = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
 sized AS (SELECT doc_id, s, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS h FROM sets),
 class AS (SELECT h, min(doc_id) AS rep, any_value(s) AS s, any_value(n) AS n FROM sized WHERE n > 0 GROUP BY h),
 posting AS (SELECT rep, n, unnest(s) AS v FROM class),
 held AS (SELECT v, count(*) AS c FROM posting GROUP BY v HAVING count(*) > 1),
 ranked AS (SELECT rep, n, v, row_number() OVER (PARTITION BY rep ORDER BY c DESC, v) AS from_common, count(*) OVER (PARTITION BY rep) AS shared FROM posting JOIN held USING (v)),
 -- of a pair's common values, which are at least 0.8 of the larger set, the rarest lies among each set's rarest
 prefix AS (SELECT rep, n, v FROM ranked WHERE from_common >= ceil(0.8 * n)),
 cand AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM prefix a JOIN prefix b ON a.v = b.v AND a.rep < b.rep AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
 link AS (SELECT a, b FROM (SELECT a, b, x.n AS na, y.n AS nb, len(list_intersect(x.s, y.s)) AS shared FROM cand JOIN class x ON x.rep = a JOIN class y ON y.rep = b) WHERE 100 * shared >= 80 * (na + nb - shared)),
 edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
 reach AS (SELECT rep AS node, rep AS other FROM class UNION SELECT r.node, e.b FROM reach r JOIN edge e ON r.other = e.a),
 comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT doc_id, CAST(sized.n AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept FROM sized LEFT JOIN class ON class.h = sized.h AND sized.n > 0 LEFT JOIN comp ON comp.node = class.rep"""

#: Failures as bits, every order of the five letters, and the first step of an order whose filter a document fails.
FILTER_AUDIT = r"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low FROM documents),
 w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
 lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
 d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
   || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > low THEN 'E' ELSE '' END AS bad
  FROM w LEFT JOIN lab USING (doc_id)),
 c AS (SELECT part, bad, count(*) AS n, count(*) FILTER (good) AS ng, count(*) FILTER (toxic) AS nt FROM d GROUP BY part, bad),
 l(a) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
 o AS (SELECT p.a || q.a || r.a || s.a || u.a AS ord FROM l p, l q, l r, l s, l u WHERE len(list_distinct([p.a, q.a, r.a, s.a, u.a])) = 5),
 st AS (SELECT ord, CAST(i AS INTEGER) AS step, substr(ord, i, 1) AS f FROM o, range(1, 6) AS x(i)),
 x AS (SELECT part, bad, n, ng, nt, ord, step, f, contains(bad, f) AND NOT regexp_matches(bad, '[' || substr(ord, 1, step - 1) || '_]') AS here, regexp_matches(bad, '[' || substr(ord, 1, step) || '_]') AS gone FROM c, st),
 g AS (SELECT part, ord, step, f, sum(n) FILTER (NOT gone) AS kept, sum(n) FILTER (here) AS removed, sum(n) FILTER (contains(bad, f) AND NOT here) AS redundant, sum(n) FILTER (bad = f) AS unique_fails,
   sum(ng) FILTER (here) AS good_lost, sum(nt) FILTER (here) AS toxic_lost FROM x GROUP BY part, ord, step, f)
SELECT part, ord AS filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
 CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley FROM g"""

#: CRC-32 byte by byte with a table that a reduction over eight bits makes.
RESAMPLING = r"""WITH tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
 texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 aims AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
 uses AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM texts) GROUP BY doc_id, w),
 known AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(w)), lambda i: CAST('0x' || substr(hex(w), 1 + 2 * i, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM (SELECT w FROM uses UNION ALL SELECT w FROM aims)), tab),
 s AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS s FROM uses JOIN known USING (w) GROUP BY bucket),
 t AS (SELECT bucket, count(*) AS t FROM aims JOIN known USING (w) GROUP BY bucket),
 gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
 weighed AS (SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS weight FROM uses JOIN known USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
 scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM texts LEFT JOIN weighed USING (doc_id)),
 final AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS many FROM final)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * many // 100 THEN CAST(r AS BIGINT) END AS rank FROM ranked"""

#: Windows of 13 words with the least document that has them; words under a window of a smaller document go.
SUBSTRING_DEDUP = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 win AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: {'i': i, 'h': md5(array_to_string(w[i : i + 12], ' '))}), recursive := true) FROM d),
 low AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM win),
 gone AS (SELECT doc_id, list(DISTINCT i + k) AS places FROM low, range(0, 13) AS x(k) WHERE least < doc_id GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
 sha256(CASE WHEN places IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(places, i)), ' '), '') END) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id)"""
