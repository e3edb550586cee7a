"""SQL twins of queries whose rows DuckDB can compute."""

WORDS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: Components of links(a, b): the smallest of all that is reachable.
_REACH = "both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b), least_of AS (SELECT a AS id, least(a, min(b)) AS component_id FROM reach GROUP BY a)"

OP8 = f"""
WITH RECURSIVE words AS (SELECT doc_id AS id, {WORDS} AS w FROM documents), sized AS (SELECT id, w, len(w) AS n FROM words WHERE len(w) > 0),
shingle AS (SELECT DISTINCT id, array_to_string(w[i:i + least(n, 3) - 1], ' ') AS s FROM sized, unnest(range(1, n - least(n, 3) + 2)) AS t(i)),
size_of AS (SELECT id, count(*) AS n FROM shingle GROUP BY id),
shared AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM shingle x JOIN shingle y ON x.s = y.s AND x.id < y.id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN size_of p ON p.id = a JOIN size_of q ON q.id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
{_REACH}
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, coalesce(l.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN size_of s ON s.id = d.doc_id LEFT JOIN least_of l ON l.id = d.doc_id
"""

OP6 = f"""
WITH RECURSIVE good AS (
  SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (SELECT p.id AS a, q.id AS b FROM good p JOIN good q ON p.label = q.label AND p.id < q.id AND len(p.v) = len(q.v) WHERE list_cosine_similarity(p.v, q.v) >= 0.93),
{_REACH}, count_of AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(l.component_id, e.vec_id) AS component_id, coalesce(l.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN count_of c ON c.id = e.vec_id LEFT JOIN least_of l ON l.id = e.vec_id
"""

_BIT = " + ".join(f"{16 >> k} * (substring(bits, 5 * i + {k + 1}, 1) = '1')::INTEGER" for k in range(5))
OP10 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), h AS (SELECT *, sha1(html) AS sha FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(sha, ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '') AS bits, min(page_id) OVER (PARTITION BY sha) AS first FROM h)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BIT}, 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""

#: crc32 bit by bit: the byte joins the low end, then eight shifts with the reversed polynomial.
_CRC = "xor(list_reduce(x, lambda acc, v: list_reduce([xor(acc, v), 1, 1, 1, 1, 1, 1, 1, 1]::UBIGINT[], lambda c, k: xor(c >> 1, 3988292384::UBIGINT * (c & 1))), 4294967295::UBIGINT), 4294967295::UBIGINT)"
OP4 = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS stratum, ('0x' || substring(md5('42|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents
), hexed AS (SELECT *, string_split(hex(encode(text)), '') AS c FROM base),
bytes AS (SELECT *, list_transform(c[1:-:2], lambda v, i: (strpos('123456789ABCDEF', v) * 16 + strpos('123456789ABCDEF', c[2 * i]))::UBIGINT) AS x FROM hexed),
summed AS (SELECT doc_id, stratum, h, (octet_length(encode(text)) + 1)::BIGINT AS size, CASE WHEN text = '' THEN 0 ELSE {_CRC} END::BIGINT AS text_crc32 FROM bytes),
spread AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, text_crc32, size) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS f FROM summed),
placed AS (SELECT *, row_number() OVER (ORDER BY f, stratum, h, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM spread),
cut AS (SELECT *, pos * 8 // n AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, (pos - (shard * n + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM cut
"""
