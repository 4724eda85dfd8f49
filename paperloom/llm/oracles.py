"""DuckDB twins of the queries that SQL can express over whole tables."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

_SOURCE_KEY = "CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END"

ORACLE_SQL["op7_mixing"] = f"""
WITH sized AS (
  SELECT doc_id, source, {_SOURCE_KEY} AS g,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents),
sources AS (SELECT g, any_value(source) AS source, sum(size)::BIGINT AS n FROM sized GROUP BY g),
weighed AS (SELECT *, 2 * n AS cap, list_extract([3, 1, 2], ((row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 + 1)::INT) AS w FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(n) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / w, source IS NULL, source COLLATE "C" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT g, n, least(cap::DOUBLE, coalesce(max(CASE WHEN level <= cap / w THEN level END) OVER () * w, cap::DOUBLE)) AS target FROM levels),
house AS (SELECT *, sum(target) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS t FROM targets),
quotients AS (SELECT g, target / (2 * k + 1) AS quotient, k FROM house, unnest(generate_series(0, (target / 16)::BIGINT + 2)) AS s(k) WHERE target > 0),
seats AS (SELECT g, row_number() OVER (ORDER BY quotient DESC, g, k) AS place FROM quotients),
blocks AS (
  SELECT g, row_number() OVER (PARTITION BY g ORDER BY place) - 1 AS block, ((place * 16 + b - 1) // b - 1)::INT AS shard
  FROM seats, (SELECT floor(any_value(t) / 16 + 0.5)::BIGINT AS b FROM house) WHERE place <= b),
quotas AS (SELECT g, count(*) AS q FROM blocks GROUP BY g),
plan AS (SELECT t.g, t.n, t.target, least(coalesce(q, 0) * 16, 2 * t.n) AS words FROM targets t LEFT JOIN quotas USING (g)),
placed AS (
  SELECT s.*, p.n, p.target, p.words,
         coalesce(sum(s.size) OVER (PARTITION BY s.g ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN plan p USING (g)),
mixed AS (
  SELECT *, (CASE WHEN n > 0 THEN (words // n) * size + least(greatest(words - (words // n) * n - before, 0), size) ELSE 0 END)::BIGINT AS taken
  FROM placed),
quota AS (SELECT g, shard, 16 * min(block) AS a, 16 * (max(block) + 1) AS b FROM blocks GROUP BY g, shard),
rows AS (SELECT row_number() OVER () AS r, * FROM mixed),
passes AS (SELECT r, g, words, k * n + before AS a, k * n + before + size AS b FROM rows, (SELECT unnest([0, 1]) AS k)),
dealt AS (SELECT r, shard, sum(least(p.b, q.b, words) - greatest(p.a, q.a))::BIGINT AS w FROM passes p JOIN quota q ON p.g = q.g AND least(p.b, q.b, words) > greatest(p.a, q.a) GROUP BY r, shard),
lists AS (SELECT r, list(shard ORDER BY shard) AS shards, list(w ORDER BY shard) AS ws FROM dealt GROUP BY r)
SELECT doc_id, size, n AS source_size, target, taken, coalesce(shards, []) AS shards, coalesce(ws, []) AS shard_words FROM rows LEFT JOIN lists USING (r)
"""

ORACLE_SQL["op9_decontamination"] = """
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(w, []) AS w FROM low),
items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
sizes AS (SELECT item, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM sizes, unnest(generate_series(1, len(w) - k + 1)) AS s(i)),
lens AS (SELECT DISTINCT k FROM grams),
windows AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram FROM docs, lens, unnest(generate_series(1, len(w) - k + 1)) AS s(i) WHERE len(w) >= k),
met AS (SELECT r, i, k, item FROM windows JOIN grams USING (k, gram)),
hits AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT DISTINCT r, i, k FROM met), unnest(generate_series(i, i + k - 1)) AS s(p) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(f.n, 0)::BIGINT AS n_items,
       sha256(coalesce(f.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits h USING (r) LEFT JOIN found f USING (r)
"""

ORACLE_SQL["op3_topk"] = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.own, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.own != c.own),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

ORACLE_SQL["op6_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (
  SELECT *, length('<s>[INST]' || role || '[/INST]' || regexp_replace(text, '\\\\|</?s>|\[/?INST\]', '\0 ', 'g') || '</s>') AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""

ORACLE_SQL["op8_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""

ORACLE_SQL["op2_sharding"] = f"""
WITH bits AS (SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS s(k)),
crc AS (SELECT list(c ORDER BY k) AS t FROM bits),
keyed AS (
  SELECT doc_id, coalesce(text, '') AS text, {_SOURCE_KEY} AS g, md5('shard-1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY h, doc_id NULLS FIRST) - 1 AS rank, count(*) OVER (PARTITION BY g) AS n,
         ('0x' || substr(md5('shard-1:' || g), 1, 8))::BIGINT / 4294967296::DOUBLE AS start
  FROM keyed),
placed AS (SELECT *, row_number() OVER (ORDER BY (rank + start) / n, g, h, doc_id NULLS FIRST) - 1 AS place, count(*) OVER () AS total FROM ranked)
SELECT doc_id, (strlen(text) + 1)::BIGINT AS size,
       xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
       'rows' AS law, (place * 16 // total)::INT AS shard, (place - ((place * 16 // total) * total + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard
FROM placed, crc
"""

_CRC = """WITH bits AS (SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS s(k)),
crc AS (SELECT list(c ORDER BY k) AS t FROM bits)"""


def _crc32(of: str) -> str:
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({of})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT"


# a match of lag q has 16 words at least, so equal windows of 16 words are enough to find the runs
ORACLE_SQL["op12_periodic_runs"] = f"""
{_CRC},
texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w, {_crc32("coalesce(doc_id::VARCHAR, '')")} AS h FROM documents, crc),
parts AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 AND doc_id IS NOT NULL THEN ((h // 10) % len(w))::BIGINT END AS a FROM texts),
docs AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END) END AS w
  FROM parts),
grams AS (SELECT r, i, md5(array_to_string(w[i + 1:i + 16], ' ')) AS g FROM docs, unnest(range(n - 15)) AS s(i)),
met AS (SELECT x.r, x.i - y.i AS q, y.i AS j FROM grams x JOIN grams y ON x.r = y.r AND x.g = y.g AND x.i > y.i),
held AS (SELECT r, q, j, j - row_number() OVER (PARTITION BY r, q ORDER BY j) AS island FROM met),
stretches AS (SELECT r, q, min(j) AS s, max(j) - min(j) + 16 + q AS l FROM held GROUP BY r, q, island HAVING max(j) - min(j) + 16 + q >= greatest(24, 3 * q)),
runs AS (SELECT * FROM stretches a WHERE NOT EXISTS (SELECT 1 FROM stretches b WHERE b.r = a.r AND b.q < a.q AND b.s <= a.s AND b.s + b.l >= a.s + a.l)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY l::DOUBLE / q DESC, s, q) AS k FROM runs),
best AS (SELECT * FROM ranked WHERE k = 1),
lists AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, p FROM runs, unnest(range(s + q, s + l)) AS u(p)),
lost AS (SELECT r, list(p) AS p FROM gone GROUP BY r),
kept AS (SELECT docs.r, array_to_string(CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(p, i - 1)) END, ' ') AS t FROM docs LEFT JOIN lost ON docs.r = lost.r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli,
       sha256(coalesce(lists.t, '')) AS runs_sha256, sha256(kept.t) AS collapsed_sha256
FROM docs LEFT JOIN best USING (r) LEFT JOIN lists USING (r) JOIN kept USING (r)
"""

ORACLE_SQL["op13_spelling"] = f"""
{_CRC},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, c, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM each, crc),
said AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM said WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
less AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM words, unnest(range(1, length(word) + 1)) AS s(i)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word != b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
judged AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 10 * w.n THEN other END AS form, CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND k = 1),
chain AS (
  WITH RECURSIVE c AS (SELECT word, word AS here, form AS onward, 0 AS d FROM judged UNION ALL SELECT c.word, j.word, j.form, d + 1 FROM c JOIN judged j ON c.onward = j.word)
  SELECT word, arg_max(here, d) AS root FROM c GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN chain USING (word)
"""

ORACLE_SQL["op11_imatch"] = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
ordered AS (
  SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following, coalesce(lead(r) OVER w, first_value(r) OVER w) AS next_r
  FROM texts WINDOW w AS (ORDER BY doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
edits AS (SELECT *, text[:length(text) - length(text) // 2] || substring(following, 1, length(text) // 2) AS edited FROM ordered),
versions AS (SELECT r, 0 AS v, text FROM edits UNION ALL SELECT r, 1, edited FROM edits),
terms AS (SELECT r, v, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))) AS term FROM versions),
lexicon AS (SELECT term FROM terms WHERE v = 0 GROUP BY term HAVING count(*) BETWEEN pow((SELECT count(*) FROM texts), 0.3) AND pow((SELECT count(*) FROM texts), 0.8)),
digests AS (SELECT term, array_to_string(list_transform(range(8), lambda i: md5(i || ':' || term)), '') AS d FROM lexicon),
members AS (SELECT term, j FROM digests, unnest(range(64)) AS s(j) WHERE ('0x' || substr(d, 4 * j::INT + 1, 4))::BIGINT < CASE WHEN j = 0 THEN 65536 ELSE round(65536 * pow(2, -2 - 11 * (j - 1) / 62)) END),
hashes AS (SELECT r, v, j, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS h FROM terms JOIN members USING (term) GROUP BY r, v, j),
maps AS (SELECT r, v, map(list(j), list(h)) AS m FROM hashes GROUP BY r, v),
held AS (SELECT r, v, array_to_string(list_transform(range(64), lambda j: coalesce(m[j], '00000000')), '') AS f FROM maps),
prints AS (SELECT r, v, coalesce(f, substr(md5('text:' || text), 1, 8) || repeat('00000000', 63)) AS f FROM versions LEFT JOIN held USING (r, v)),
sides AS (SELECT e.r, doc_id, text, edited, a.f AS f, b.f AS ef, c.f AS nf FROM edits e JOIN prints a ON e.r = a.r AND a.v = 0 JOIN prints b ON e.r = b.r AND b.v = 1 JOIN prints c ON e.next_r = c.r AND c.v = 0),
cut AS (SELECT *, regexp_extract_all(f, '.{8}') AS fs, regexp_extract_all(ef, '.{8}') AS es, regexp_extract_all(nf, '.{8}') AS ns FROM sides)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, f AS fingerprint, ef AS edited_fingerprint,
       len(list_filter(range(64), lambda j: fs[j + 1] = es[j + 1] AND fs[j + 1] != '00000000')) / len(list_filter(range(64), lambda j: fs[j + 1] != '00000000' OR es[j + 1] != '00000000')) AS near_edited,
       len(list_filter(range(64), lambda j: fs[j + 1] = ns[j + 1] AND fs[j + 1] != '00000000')) / len(list_filter(range(64), lambda j: fs[j + 1] != '00000000' OR ns[j + 1] != '00000000')) AS near_next
FROM cut
"""
