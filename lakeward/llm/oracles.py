"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_BLANK = r"'[^\x20\x09-\x0D]+'"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLDED}, {_PLAIN}) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_FOLDED}, {_PLAIN}) AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS gram
      FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM g),
p AS (SELECT r, size, s, array_to_string(w[s : s + size - 1], ' ') AS gram
      FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
h AS (SELECT r, item, p.size, s FROM p JOIN g ON p.size = g.size AND p.gram = g.gram),
n AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS pos FROM h) GROUP BY r),
i AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""

OP2 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(strlen(text), 0) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, c, substr(h, 2 * c + 1, 1798) AS h FROM (SELECT r, h, unnest(range(0, n - 399, 500)) AS c FROM d WHERE n >= 400)),
w AS (SELECT r, c + i AS s, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT r, c, h, unnest(range(least(500, length(h) // 2 - 399))) AS i FROM p)),
k AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
g AS (SELECT r, s, coalesce(s > lag(s) OVER (PARTITION BY r ORDER BY s) + 400, true) AS fresh FROM w SEMI JOIN k USING (k)),
i AS (SELECT r, sum(fresh::INT) OVER (PARTITION BY r ORDER BY s ROWS UNBOUNDED PRECEDING) AS run, s FROM g),
spans AS (SELECT r, min(s) AS lo, max(s) + 400 AS hi FROM i GROUP BY r, run),
parts AS (SELECT r, hi AS lo, coalesce(lead(lo) OVER (PARTITION BY r ORDER BY lo), 1000000000000) AS hi FROM spans UNION ALL SELECT r, 0, min(lo) FROM spans GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * lo + 1, 2 * (least(hi, n) - lo)), '' ORDER BY lo) AS x FROM parts JOIN d USING (r) GROUP BY r),
c AS (SELECT r, sum(hi - lo) AS removed, count(*) AS spans FROM spans GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(x, h))) AS kept_sha256
FROM d LEFT JOIN c USING (r) LEFT JOIN kept USING (r)
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_BLANK})), 0)::BIGINT AS size, coalesce(md5(doc_id::VARCHAR), '') AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM s),
c AS (SELECT *, sum(source_size) OVER () AS t, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM w),
f AS (SELECT *, (t - before) * weight > cap * onward AS capped FROM c),
a AS (SELECT *, sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS free_weight, t - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS free FROM f),
g AS (SELECT source, source_size, t, CASE WHEN capped THEN cap::DOUBLE ELSE coalesce(weight * (free::DOUBLE / nullif(free_weight, 0)::DOUBLE), 0) END AS target FROM a),
o AS (SELECT row_number() OVER () AS r, d.*, source_size, target, t, sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS UNBOUNDED PRECEDING) AS sent
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, (pass * source_size + sent)::DOUBLE / target AS finish FROM o, range(3) AS x(pass) WHERE size > 0 AND target > 0),
q AS (SELECT r, size, t, sum(size) OVER (ORDER BY finish, source NULLS LAST, k, pass, size ROWS UNBOUNDED PRECEDING) AS spent FROM p),
n AS (SELECT r, sum(size) AS taken FROM q WHERE spent <= t GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM o LEFT JOIN n USING (r)
"""

OP6 = """
WITH poly AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(strlen(text), 0) + 1 AS size, coalesce(md5(text), '') AS k FROM documents),
crc AS (SELECT r, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
               lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]))) AS crc FROM d, poly WHERE text IS NOT NULL),
t AS (SELECT sum(size) AS total, greatest(1, sum(size) // (16 * 64)) AS cap FROM d),
g AS (SELECT k, sum(size) AS bytes FROM d GROUP BY k),
u AS (SELECT d.r, doc_id, size, total, k || lpad(CASE WHEN bytes > cap THEN ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % ceil(bytes / cap)::BIGINT ELSE 0 END::VARCHAR, 10, '0') AS unit
      FROM d JOIN g USING (k), t),
o AS (SELECT *, sum(size) OVER (ORDER BY unit, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS ended, sum(size) OVER (PARTITION BY unit) AS bytes FROM u),
m AS (SELECT *, max(ended) OVER (PARTITION BY unit) AS last FROM o),
s AS (SELECT *, least(15, floor((2 * last - bytes) * 16 / (2 * total)))::INT AS shard FROM m)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY unit, doc_id NULLS FIRST, size) - 1 AS slot, NULL::INT AS grown_shard
FROM s LEFT JOIN crc USING (r)
"""

OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, {_BLANK}), []) AS w FROM documents),
x AS (SELECT r, doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
f AS (SELECT k, min(doc_id) AS first FROM x GROUP BY k),
c AS (SELECT DISTINCT r, unnest(range(s, s + 50)) AS p FROM x JOIN f USING (k) WHERE first < doc_id OR (first IS NOT NULL AND doc_id IS NULL)),
n AS (SELECT r, count(*) AS removed FROM c GROUP BY r),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN c USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""

OP9 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

OP12 = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, {_BLANK}) AS w FROM t),
lo AS (SELECT text, min(doc_id) AS lo FROM t GROUP BY text),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             ['A', 'B', 'C', 'D', 'E'] AS names,
             [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > lo, false)] AS fails
      FROM w JOIN lo USING (text) LEFT JOIN l USING (doc_id)),
k AS (SELECT part, list_filter(names, lambda x, i: fails[i]) AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v),
o AS (SELECT [a.v, b.v, c.v, d.v, e.v] AS letters FROM x a JOIN x b ON b.v <> a.v JOIN x c ON c.v NOT IN (a.v, b.v) JOIN x d ON d.v NOT IN (a.v, b.v, c.v) JOIN x e ON e.v NOT IN (a.v, b.v, c.v, d.v)),
s AS (SELECT letters, unnest(range(1, 6)) AS step FROM o),
r AS (SELECT part, array_to_string(letters, '') AS filter_order, step::INT AS step, letters[step] AS letter, n, good, toxic, len(failed) AS m,
             list_contains(failed, letters[step]) AS own, list_has_any(failed, letters[1 : step - 1]) AS gone FROM k, s),
g AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN own AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN own AND m = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM g
"""

OP13 = rf"""
WITH poly AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, {_BLANK}), []) AS w, len(coalesce(regexp_extract_all(text, {_BLANK}), []))::BIGINT AS n,
             xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]))) AS h
      FROM documents, poly),
e AS (SELECT r, doc_id, w, n, h % 10 = 0 AND n > 0 AS edited, (h // 10) % greatest(n, 1) AS a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p FROM d),
t AS (SELECT r, doc_id, n, CASE WHEN edited THEN list_transform(range(n), lambda i: w[(CASE WHEN i >= a THEN a + (i - a) % p ELSE i END) + 1]) ELSE w END AS w FROM e),
o AS (SELECT r, n, word, i FROM (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM t)),
z AS (SELECT r, n, i, list(i) OVER (PARTITION BY r, word ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later, count(*) OVER (PARTITION BY r, word) AS times FROM o),
m AS (SELECT r, i, j - i AS q FROM (SELECT r, n, i, unnest(later) AS j FROM z WHERE times > 3) WHERE 4 * (j - i) <= n),
g AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m),
c AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
k AS (SELECT r, start, length, min(q) AS period FROM c GROUP BY r, start, length),
x AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM k),
v AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT r, word, i FROM o) ANTI JOIN x USING (r, i) GROUP BY r),
b AS (SELECT r, start, length, period FROM k QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) = 1),
s AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM k GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN s USING (r) LEFT JOIN b USING (r) LEFT JOIN v USING (r)
"""

ORACLES = {
    "op1_decontaminate": OP1, "op2_suffix_dedup": OP2, "op3_mix_sources": OP3, "op6_shard": OP6, "op8_substring_dedup": OP8, "op9_top_k": OP9,
    "op12_filter_audit": OP12, "op13_periodic_runs": OP13,
}
