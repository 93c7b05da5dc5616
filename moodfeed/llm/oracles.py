"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_ASCII_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), n AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM n
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), parts AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id,
  vec_id = component_id AS kept
FROM parts
"""

OP6 = f"""
WITH w AS (
  SELECT doc_id, {_WORDS} AS ws FROM documents
), places AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS win FROM places
), again AS (
  SELECT win FROM windows GROUP BY win HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM windows SEMI JOIN again USING (win)
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP8 = f"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, text, '')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), p AS (
  SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT
    AS weight, 3 * source_size AS most
  FROM s
), l AS (
  SELECT *, most / weight AS full_at,
    (sum(source_size) OVER ()::BIGINT - coalesce(sum(most) OVER (ORDER BY most / weight, source IS NULL,
      source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / (sum(weight) OVER (ORDER BY most / weight, source IS NULL, source
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM p
), f AS (
  SELECT *, first_value(CASE WHEN level * weight <= most THEN level END IGNORE NULLS) OVER (
      ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS final
  FROM l
), t AS (
  SELECT source, source_size, coalesce(final * weight, most)::DOUBLE AS target,
    CASE WHEN source_size > 0
      THEN floor(coalesce(final * weight, most) / source_size)::BIGINT ELSE 0 END AS epochs
  FROM f
), o AS (
  SELECT d.*, source_size, target, epochs, target - epochs * source_size AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (epochs * size + CASE WHEN epochs >= 3 THEN 0 WHEN start + size <= budget THEN size
    WHEN start < budget THEN floor(budget - start) ELSE 0 END)::BIGINT AS taken
FROM o
"""

OP10 = f"""
WITH d AS (
  SELECT doc_id, {_ASCII_WORDS} AS ws FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, {_ASCII_WORDS} AS ws FROM benchmark
), tests AS (
  SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i
  FROM b WHERE len(ws) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM tests
), places AS (
  SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
  FROM d, (SELECT DISTINCT n FROM windows)
), found AS (
  SELECT doc_id, i, n, item_id
  FROM (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM places)
  JOIN windows USING (n, win)
), hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM found GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP11 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP12 = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), d AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix,
    coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

#: CRC-32 by a table of its 256 bytes, itself made from the polynomial.
OP13 = f"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda x, i:
    CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS t
  FROM range(256) AS r(b)
), d AS (
  SELECT doc_id, {_ASCII_WORDS} AS ws FROM documents
), b AS (
  SELECT {_ASCII_WORDS} AS ws FROM benchmark
), dw AS (
  SELECT doc_id, unnest(ws) AS word FROM d
), bw AS (
  SELECT unnest(ws) AS word FROM b
), vocabulary AS (
  SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)
), buckets AS (
  SELECT word, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)),
    lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1])), 4294967295) % 10000 AS bucket
  FROM vocabulary, crc
), s AS (
  SELECT bucket, count(*) AS s FROM dw JOIN buckets USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM bw JOIN buckets USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000))))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), w AS (
  SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM dw JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id::VARCHAR)[1:8])::BIGINT + 0.5::DOUBLE)
      / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN rank <= 10 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op3_near_vectors": OP3,
    "op6_repeated_windows": OP6,
    "op8_mixture": OP8,
    "op10_decontaminate": OP10,
    "op11_top_products": OP11,
    "op12_fill_in_middle": OP12,
    "op13_resample": OP13,
}
