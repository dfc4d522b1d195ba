"""DuckDB SQL for the queries that SQL can express."""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes,
  -- base32 of the digest: 32 groups of five bits
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, 1 + (5 * (i // 4)), 5))::BIGINT // [32768, 1024, 32, 1][1 + i % 4]) % 32, 1), '' ORDER BY i)
   FROM (SELECT sha1(p.html) AS h), range(32) r(i)) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.html = f.html
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = f"""
WITH b AS (SELECT DISTINCT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
       FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
hits AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM hits), LATERAL (SELECT unnest(range(i, i + n)) AS k) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

OP4 = """
WITH RECURSIVE sizes AS (SELECT coalesce(source, '') AS source, count(*) AS docs FROM documents GROUP BY 1),
w AS (SELECT source, docs, greatest(1, round(pow(docs::DOUBLE, 0.7e0) / (SELECT sum(pow(docs::DOUBLE, 0.7e0)) FROM sizes) * 1000000000000)::BIGINT) AS q FROM sizes),
l AS (SELECT *, least(4096, ceil(length)::BIGINT) AS slots, ceil(length / least(4096, ceil(length)::BIGINT))::BIGINT AS block
  FROM (SELECT sum(q)::BIGINT AS total, max(docs * ((SELECT sum(q)::DOUBLE FROM w) / q)) AS length FROM w)),
g AS (SELECT source, docs, q, greatest(docs, floor(length * (q / total::DOUBLE))::BIGINT) AS due, q * slots >= total AS big FROM w, l),
s AS (SELECT *, ceil(docs / (SELECT block FROM l))::BIGINT AS need, row_number() OVER (ORDER BY stream) AS i FROM (
  SELECT CASE WHEN big THEN '=' || source ELSE 'small' END AS stream, sum(q)::BIGINT AS q, sum(CASE WHEN big THEN docs ELSE due END)::BIGINT AS docs FROM g GROUP BY 1)),
k AS (SELECT list(q ORDER BY i) AS q, list(CASE WHEN stream = 'small' THEN need ELSE 0 END ORDER BY i) AS clip, any_value(total) AS total, any_value(slots) AS slots,
  max(CASE WHEN stream = 'small' THEN least(slots, (need * total + q - 1) // q) ELSE (need * total + q - 1) // q END) AS length FROM s, l),
edf(t, had, pick) AS (
  SELECT -1::BIGINT, list_transform(q, lambda x: 0::BIGINT), NULL::BIGINT FROM k
  UNION ALL
  SELECT t + 1, list_transform(had, lambda n, i: n + (i = p)::INT), p
  FROM (SELECT t, had, list_position(due, list_min(due)) AS p
        FROM (SELECT t, had, list_transform(had, lambda n, i: (n * total // q[i] > t + 1)::BIGINT * 1000000000
                + CASE WHEN n < clip[i] THEN least(slots, ((n + 1) * total + q[i] - 1) // q[i]) ELSE ((n + 1) * total + q[i] - 1) // q[i] END) AS due
              FROM edf, k WHERE t + 1 < length))),
numbered AS (SELECT pick, t, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM edf WHERE t >= 0),
plan AS (SELECT stream, t AS slot, turn FROM numbered JOIN s ON pick = i WHERE t <= (SELECT max(t) FROM numbered JOIN s ON pick = i AND turn = need - 1)),
turns AS (SELECT stream, count(*) * any_value(block) AS given FROM plan, l GROUP BY 1),
r AS (SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS rank FROM documents),
e AS (SELECT doc_id, r.source, h, rank, docs, due, big FROM r JOIN g ON coalesce(r.source, '') = g.source),
b AS (SELECT doc_id, source, '=' || coalesce(source, '') AS stream, docs, rank, unnest(range(0, (given - 1 - rank) // docs + 1)) AS epoch FROM e JOIN turns ON stream = '=' || coalesce(source, '') WHERE big),
c AS (SELECT *, row_number() OVER (ORDER BY md5(h || ':' || epoch), doc_id) - 1 AS place, (due - 1 - rank) // docs + 1 AS times
  FROM (SELECT *, unnest(range(0, (due - 1 - rank) // docs + 1)) AS epoch FROM e WHERE NOT big)),
d AS (SELECT *, (SELECT docs FROM s WHERE stream = 'small') AS every, unnest(range(0, (given - 1 - place) // (SELECT docs FROM s WHERE stream = 'small') + 1)) AS cycle FROM c JOIN turns ON stream = 'small'),
x AS (SELECT doc_id, source, epoch, stream, rank + epoch * docs AS x FROM b UNION ALL SELECT doc_id, source, epoch + cycle * times, 'small', place + cycle * every FROM d),
o AS (SELECT doc_id, source, epoch, slot, x % block AS o, block, slot // 256 * 256 AS start, least(256, (SELECT count(*) FROM plan) - slot // 256 * 256) AS width
  FROM x, l JOIN plan ON plan.stream = x.stream AND plan.turn = x // block)
SELECT doc_id, source, slot, start * block + o * width + slot - start AS position, epoch FROM o
"""

# CRC-32 by the usual table of 256 (a single row ``tbl``), which is made by eight steps of each number.
_TABLE = """steps(b, k, c) AS (
  SELECT i::BIGINT, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END FROM steps WHERE k < 8),
tbl AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8)"""


def _crc32(text: str) -> str:
    data = f"list_transform(range(0, octet_length(encode({text}))::BIGINT), lambda i: ('0x' || substr(hex(encode({text})), 1 + 2 * i, 2))::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])))"


OP12 = f"""
WITH RECURSIVE {_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS word FROM d),
bw AS (SELECT unnest(w) AS word FROM b),
hashed AS (SELECT word, {_crc32("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)), tbl),
dc AS (SELECT r, bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY r, bucket),
s AS (SELECT bucket, sum(n) AS n FROM dc GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t),
gains AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (sums.s + 10000) / ((s.n + 1)::DOUBLE * (sums.t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t ON s.bucket = t.bucket, sums),
weights AS (SELECT r, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS gain FROM dc JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (gain - ((gain % n) + n) % n) // n ELSE 0 END AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN weights USING (r)),
noisy AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296e0)))::BIGINT AS score, n_features >= 20 AS able FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS FIRST) AS k FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= (SELECT count(*) FROM noisy WHERE able) * 10 // 100 THEN k END AS rank FROM placed
"""

# Runs: pairs of equal words of a document by their distance; consecutive pairs of one distance are a stretch of that period, and
# of stretches with the same ends the least period counts.
OP11 = f"""
WITH RECURSIVE {_TABLE},
d0 AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
d1 AS (SELECT *, len(w)::BIGINT AS n, {_crc32("doc_id::VARCHAR")} AS h FROM d0, tbl),
d2 AS (SELECT *, h // 10 AS g, (h // 10) % greatest(n, 1) AS a FROM d1),
d3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM d2),
d AS (SELECT r, doc_id, CASE WHEN doc_id IS NOT NULL AND h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) ELSE w END AS w FROM d3),
x AS (SELECT r, i, w[i + 1] AS word FROM d, LATERAL (SELECT unnest(range(0, len(w))) AS i)),
same AS (SELECT a.r, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.r = b.r AND a.word = b.word AND b.i > a.i),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same),
stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
told AS (SELECT r, count(*) AS n_runs, arg_max({{'start': start, 'length': length, 'period': period}}, length * 1000000000000000 - start * 10000000 - period) AS best,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, i FROM runs, LATERAL (SELECT unnest(range(start + period, start + length)) AS i)),
kept AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.i) AS text FROM x LEFT JOIN gone ON gone.r = x.r AND gone.i = x.i WHERE gone.r IS NULL GROUP BY x.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256, len(w)::BIGINT AS n_words
FROM d LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""

ORACLE = {"op4_mixing": OP4, "op6_warc": OP6, "op7_decontamination": OP7, "op11_periodic_runs": OP11, "op12_importance_resampling": OP12}
