"""SQL twins of the corpus queries, written for DuckDB."""

from __future__ import annotations

from veilmark.llm.queries import SHARD_BYTES

SQL: dict[str, str] = {}

SQL["op2_sharding"] = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, COALESCE(strlen(text), 0)::BIGINT AS bytes,
         CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), tree AS (
  SELECT 0 AS depth, 0::BIGINT AS p, sum(bytes) AS b, min(h) AS lo, max(h) AS hi FROM rows GROUP BY ALL
  UNION ALL
  SELECT * FROM (
    SELECT t.depth + 1 AS depth, r.h >> (59 - t.depth) AS p, sum(r.bytes) AS b, min(r.h) AS lo, max(r.h) AS hi
    FROM tree t JOIN rows r ON (r.h >> (60 - t.depth)) = t.p
    WHERE t.b > {SHARD_BYTES} AND t.lo < t.hi GROUP BY ALL)
), leaf AS (SELECT * FROM tree WHERE b <= {SHARD_BYTES} OR lo = hi)
SELECT r.doc_id, r.bytes, l.depth,
       CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(l.p), l.depth::INT, '0') END AS shard,
       l.b::BIGINT AS shard_bytes, 0::BIGINT AS part, l.b > {SHARD_BYTES} AS oversized
FROM rows r JOIN leaf l ON (r.h >> (60 - l.depth)) = l.p
"""

SQL["op5_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CAST('0x' || substr(md5(concat_ws(':', '7', CAST(doc_id AS VARCHAR), md5(text))), 1, 15) AS BIGINT) AS k
  FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source
), lvl AS (
  SELECT 1 AS i, (SELECT sum(source_size) / sum(w) FROM s)::DOUBLE AS level, 0 AS n
  UNION ALL
  SELECT i + 1, (SELECT (sum(source_size) - sum(CASE WHEN 3.0 * source_size < w * l.level THEN 3.0 * source_size ELSE 0 END))
                 / sum(CASE WHEN 3.0 * source_size < w * l.level THEN 0 ELSE w END) FROM s)::DOUBLE,
         (SELECT count(*) FROM s WHERE 3.0 * source_size < w * l.level)
  FROM lvl l WHERE i < 200 AND (i = 1 OR n < (SELECT count(*) FROM s WHERE 3.0 * source_size < w * l.level))
), t AS (
  SELECT source, source_size::BIGINT AS source_size,
         least(3.0 * source_size, w * (SELECT level FROM lvl ORDER BY i DESC LIMIT 1))::DOUBLE AS target FROM s
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
         COALESCE(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE
         (budget // source_size) * size + least(greatest(budget % source_size - before, 0), size) END::BIGINT AS taken
FROM o
"""

SQL["op8_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM p QUALIFY rank <= 20
"""

SQL["op9_group_join"] = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM t
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS c
      FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (an + bn - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, m.component_id FROM s JOIN m ON m.a = s.doc_id
"""

SQL["op11_collocations"] = r"""
WITH p AS (
  SELECT COALESCE(lang, 'und') AS lang,
         unnest(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k.n AS words, unnest(list_transform(range(1, len(w) - k.n + 2), lambda i: array_to_string(w[i:i + k.n - 1], ' '))) AS phrase
  FROM w, (SELECT unnest(range(1, 6)) AS n) k WHERE len(w) >= k.n
), c AS (SELECT lang, words, phrase, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, sum(a)::BIGINT AS n FROM c WHERE words = 1 GROUP BY lang),
f AS (SELECT *, string_split(phrase, ' ') AS w FROM c WHERE words > 1 AND a >= 100),
cut AS (
  SELECT lang, phrase, a, w, k, array_to_string(w[1:k], ' ') AS l_part, array_to_string(w[k + 1:], ' ') AS r_part
  FROM (SELECT *, unnest(range(1, words)) AS k FROM f)
), s AS (
  SELECT cut.lang, cut.phrase, cut.a, x.a AS l, y.a AS r, t.n, k,
         ((1000::HUGEINT * cut.a * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cut JOIN c x ON x.lang = cut.lang AND x.phrase = l_part
           JOIN c y ON y.lang = cut.lang AND y.phrase = r_part JOIN t ON t.lang = cut.lang
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (
  SELECT DISTINCT lang, inner_phrase FROM (
    SELECT lang, a, unnest(list_transform(
      list_filter(flatten(list_transform(range(1, words + 1), lambda i: list_transform(range(i + 1, words + 1), lambda j: [i, j]))), lambda e: e[2] - e[1] + 1 < words),
      lambda e: array_to_string(w[e[1]:e[2]], ' '))) AS inner_phrase FROM f) o
  WHERE 100 * a >= 100 * (SELECT c.a FROM c WHERE c.lang = o.lang AND c.phrase = o.inner_phrase)
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INT) AS rank, phrase, a, l, r, n, score
FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = b.lang AND d.inner_phrase = b.phrase)
QUALIFY rank <= 2000
"""

SQL["op12_runs"] = r"""
WITH b AS (
  SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
           lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)),
             lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)) AS c
  FROM documents
), h AS (SELECT doc_id, w, len(w) AS n, xor(c, 4294967295::BIGINT) AS h FROM b),
g AS (SELECT *, h // 10 AS g, (h // 10) % greatest(n, 1) AS a FROM h),
d AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
    w[1:a] || list_transform(range(a, n), lambda i: w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1]) ELSE w END AS w FROM g
), t AS (SELECT row_number() OVER () AS r, * FROM d),
e AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS x FROM t),
m AS (SELECT a.r, a.i, b.i - a.i AS q FROM e a JOIN e b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
o AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m),
s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM o GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
p AS (SELECT r, start, length, min(q) AS period FROM s GROUP BY ALL),
k AS (
  SELECT r, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256
  FROM p GROUP BY r
), best AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY r ORDER BY (length::DECIMAL(38, 12) / period) DESC, start, period) = 1),
c AS (
  SELECT e.r, sha256(string_agg(e.x, ' ' ORDER BY e.i)) AS collapsed FROM e
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.r = e.r AND e.i >= p.start + p.period AND e.i < p.start + p.length) GROUP BY e.r
)
SELECT t.doc_id, COALESCE(k.n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
       (1000 * best.length // best.period)::BIGINT AS exponent_milli, COALESCE(k.runs_sha256, sha256('')) AS runs_sha256,
       COALESCE(c.collapsed, sha256('')) AS collapsed_sha256
FROM t LEFT JOIN k USING (r) LEFT JOIN best USING (r) LEFT JOIN c USING (r)
"""

SQL["op13_syncmers"] = r"""
WITH d AS (
  SELECT doc_id, COALESCE(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(COALESCE(text, ''))) AS r FROM documents
), e AS (
  SELECT r, doc_id, text, length(text) AS n,
         COALESCE(lead(text) OVER (ORDER BY r), first_value(text) OVER (ORDER BY r)) AS other FROM d
), x AS (SELECT r, doc_id, text, n, left(text, n - n // 2) || left(other, n // 2) AS edited FROM e),
a AS (SELECT DISTINCT text AS t FROM x UNION SELECT edited FROM x),
w AS (SELECT t, regexp_extract_all(t, '[^\x20\x09-\x0D]{1,32}') AS w FROM a),
v AS (SELECT DISTINCT unnest(w) AS v FROM w UNION SELECT array_to_string(w, ' ') FROM w WHERE len(w) < 40),
crc AS (
  SELECT v, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(v)), '..'), lambda c: CAST('0x' || c AS BIGINT))),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END))) AS c
  FROM v
), num AS (SELECT v, (((c * 1000000007) % 1073741789) << 30 | ((c * 812345677) % 1073741783))::HUGEINT AS x FROM crc),
pos AS (SELECT t, unnest(w) AS v, unnest(range(len(w))) AS i FROM w),
h AS (
  SELECT w.t, w.w, COALESCE(g.h, []) AS h, whole.x AS whole FROM w
  LEFT JOIN (SELECT t, list(x ORDER BY i) AS h FROM pos JOIN num USING (v) GROUP BY t) g USING (t)
  LEFT JOIN num whole ON len(w.w) < 40 AND whole.v = array_to_string(w.w, ' ')
),
i AS (
  SELECT t, w, h, whole, list_transform(range(1, len(h)), lambda i: xor(h[i], (((h[i + 1] << 11) & 1152921504606846975) | (h[i + 1] >> 49)))) AS s FROM h
), k AS (
  SELECT t, w, whole, list_transform(list_filter(range(1, len(h) - 3), lambda i: list_min(s[i:i + 3]) IN (s[i], s[i + 3])), lambda i:
      xor(xor(xor(xor(h[i], (((h[i + 1] << 11) & 1152921504606846975) | (h[i + 1] >> 49))),
                      (((h[i + 2] << 22) & 1152921504606846975) | (h[i + 2] >> 38))),
                  (((h[i + 3] << 33) & 1152921504606846975) | (h[i + 3] >> 27))),
          (((h[i + 4] << 44) & 1152921504606846975) | (h[i + 4] >> 16)))) AS z FROM i
), f AS (
  SELECT t, CASE WHEN len(z) > 0 THEN z WHEN len(w) = 0 THEN []::HUGEINT[]
                 ELSE [whole] END AS z FROM k
), q AS (SELECT t, z, list_distinct(z) AS y, array_to_string(list_transform(z, lambda v: lpad(lower(to_hex((v & 4294967295)::BIGINT)), 8, '0')), ' ') AS p FROM f),
u AS (
  SELECT x.*, q.p AS fingerprint, v.p AS edited_fingerprint, q.y AS y, v.y AS ye FROM x JOIN q ON q.t = x.text JOIN q v ON v.t = x.edited
), n AS (SELECT *, COALESCE(lead(y) OVER (ORDER BY r), first_value(y) OVER (ORDER BY r)) AS yn FROM u)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN len(y) + len(ye) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(y, ye))::DOUBLE / (len(y) + len(ye) - len(list_intersect(y, ye))) END AS near_edited,
  CASE WHEN len(y) + len(yn) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(y, yn))::DOUBLE / (len(y) + len(yn) - len(list_intersect(y, yn))) END AS near_next
FROM n
"""
