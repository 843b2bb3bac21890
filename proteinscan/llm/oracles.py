"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
#: Only A to Z are lower-cased.
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text"

NEAR_DEDUP = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, {_LOWERED} FROM documents)),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS id, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY 1),
items AS (SELECT id, n, unnest(s) AS x FROM classes),
links AS (SELECT a.id AS a, b.id AS b FROM items a JOIN items b ON a.x = b.x AND a.id < b.id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id AS a, id AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
found AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)
SELECT sets.doc_id, len(sets.s) AS n_shingles, coalesce(found.component, sets.doc_id) AS component_id, sets.doc_id = coalesce(found.component, sets.doc_id) AS kept
FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s LEFT JOIN found ON found.id = classes.id"""

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_GROUPS = " || ".join(f"to_base(('0x' || substr(h, {1 + 10 * k}, 10))::BIGINT, 32, 8)" for k in range(4))
WARC = f"""SELECT page_id, payload_bytes, translate({_GROUPS}, '{_DIGITS}', '{_BASE32}') AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)"""

#: CRC-32 byte by byte: the table of its remainders, then a fold over the text's bytes.
_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, bit: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
def _crc(text: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])))"


SHARDING = f"""WITH crc_table AS (SELECT {_CRC_TABLE} AS t),
rows AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, md5(coalesce(text, '')) AS h, {_crc("coalesce(text, '')")} AS text_crc32 FROM documents, crc_table),
placed AS (
  SELECT *, row_number() OVER o - 1 AS row, sum(size) OVER () AS total,
    ((2 * coalesce(sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size) * 24) // (2 * sum(size) OVER ()) AS cut
  FROM rows WINDOW o AS (ORDER BY h, doc_id NULLS FIRST, size)),
grouped AS (SELECT *, min(cut) OVER g AS first_cut, max(cut) OVER g AS last_cut, sum(size) OVER g AS b FROM placed WINDOW g AS (PARTITION BY h)),
sharded AS (SELECT *, CASE WHEN first_cut < last_cut AND b * 24 * 20 <= total THEN first_cut ELSE cut END AS shard FROM grouped)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row - min(row) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM sharded"""

_RUNS = "list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 16))"


def _hashes(text: str) -> str:
    return f"(SELECT CASE WHEN len(w) = 0 THEN [] ELSE {_RUNS} END FROM (SELECT list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w))"


def _alike(a: str, b: str, same: str) -> str:
    return f"CASE WHEN least(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) WHEN len({a}) = len({b}) THEN CAST({same} AS DOUBLE) ELSE 0.0 END"


FINGERPRINTS = f"""WITH rows AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pairs AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first(text) OVER (ORDER BY doc_id DESC)) AS after FROM rows),
edits AS (SELECT *, left(text, length(text) - length(text) // 3) || left(after, length(text) // 3) AS edited FROM pairs),
hashed AS (SELECT *, list_distinct({_hashes('text')}) AS a, list_distinct({_hashes('edited')}) AS e, list_distinct({_hashes('after')}) AS n FROM edits),
low AS (SELECT *, list_sort(list_filter(a, lambda x: x < '10000000')) AS a_low, list_sort(list_filter(e, lambda x: x < '10000000')) AS e_low, list_filter(n, lambda x: x < '10000000') AS n_low FROM hashed)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, coalesce(array_to_string(a_low, ','), '') AS fingerprint, coalesce(array_to_string(e_low, ','), '') AS edited_fingerprint, {_alike('a_low', 'e_low', 'text = edited')} AS near_edited, {_alike('a_low', 'n_low', 'text = after')} AS near_next FROM low"""

_FEATURES = r"list_filter(string_split_regex(text, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
RESAMPLING = f"""WITH crc_table AS (SELECT {_CRC_TABLE} AS t),
d AS (SELECT doc_id, row_number() OVER () AS row, {_FEATURES} AS w FROM (SELECT doc_id, {_LOWERED} FROM documents)),
b AS (SELECT {_FEATURES} AS w FROM (SELECT {_LOWERED} FROM benchmark)),
corpus AS (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(w) AS word FROM d) GROUP BY ALL),
target AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY ALL),
hashed AS (SELECT word, {_crc('word')} % 10000 AS bucket FROM (SELECT word FROM corpus UNION SELECT word FROM target), crc_table),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM corpus JOIN hashed USING (word) GROUP BY 1),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM target JOIN hashed USING (word) GROUP BY 1),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
weights AS (SELECT row, sum(n * gain) AS weight FROM corpus JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY 1),
scored AS (
  SELECT doc_id, row, len(w) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (row)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM ranked"""

COLLOCATIONS = f"""WITH pieces AS (SELECT row, lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, {_LOWERED} FROM documents)),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
runs AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS p FROM w, (VALUES (1), (2), (3)) AS x(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM runs GROUP BY ALL HAVING k = 1 OR count(*) >= 10),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT *, string_split(p, ' ') AS w FROM f WHERE k > 1),
inside AS (SELECT lang, array_to_string(w[1:2], ' ') AS p, f FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM c WHERE k = 3),
longer AS (SELECT lang, p, max(f) AS longer FROM inside GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN longer USING (lang, p) WHERE 100 * coalesce(longer, 0) < 50 * f),
cuts AS (SELECT lang, p, f, cut, array_to_string(w[1:cut], ' ') AS p1, array_to_string(w[cut + 1:], ' ') AS p2 FROM kept, (VALUES (1), (2)) AS x(cut) WHERE cut < k),
parts AS (
  SELECT cuts.lang, cuts.p, cuts.f AS a, cut, x.f AS l, y.f AS r, (1000000::HUGEINT * cuts.f * cuts.f // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.p = p1 JOIN f AS y ON y.lang = cuts.lang AND y.p = p2),
lowest AS (SELECT lang, p AS phrase, a, l, r, score FROM parts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

ORACLES = {
    "op3_minhash_near_dedup": NEAR_DEDUP, "op7_warc": WARC, "op9_sharding": SHARDING, "op10_document_fingerprints": FINGERPRINTS,
    "op11_importance_resampling": RESAMPLING, "op13_collocations": COLLOCATIONS,
}
