"""DuckDB SQL of the queries that SQL can state on whole tables."""

from tickwatch.llm import sharding

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP7 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (SELECT doc_id, i, line, translate(trim(line, {_SPACES}), {_LOWER}) AS k FROM lines),
frequent AS (
  SELECT k FROM (SELECT DISTINCT doc_id, k FROM keyed WHERE k <> '') GROUP BY k HAVING count(*) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
GROUP BY doc_id
"""


_WORD = "'[^\\x20\\x09-\\x0D]+'"

OP2 = f"""
WITH docs AS (
  SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
split AS (SELECT *, regexp_extract_all(t, {_WORD}) AS w, string_split(t, chr(10)) AS ls FROM docs),
grams AS (
  SELECT row, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6),
         lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM split WHERE len(w) >= 8),
many AS (SELECT row, i FROM grams QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
covered AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + 8)) AS p FROM many) GROUP BY row),
lines AS (SELECT row, host, unnest(ls) AS line FROM split),
plain AS (
  SELECT row, host, len(regexp_extract_all(line, {_WORD})) AS n,
         trim(regexp_replace(regexp_replace(lower(line), '\\p{{N}}+', '0', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS k
  FROM lines),
frequent AS (
  SELECT host, k FROM (SELECT DISTINCT row, host, k FROM plain WHERE k <> '') GROUP BY host, k HAVING count(*) > 10),
removed AS (
  SELECT row, count(*) AS n_lines, sum(n)::BIGINT AS n FROM plain JOIN frequent USING (host, k) GROUP BY row),
counted AS (
  SELECT split.doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         (len(list_filter(ls, lambda x: regexp_matches(x, {_WORD}))) - len(list_distinct(list_filter(ls, lambda x:
            regexp_matches(x, {_WORD})))))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, coalesce(removed.n_lines, 0) AS n_removed_lines,
         coalesce(removed.n, 0) AS n_removed_words
  FROM split LEFT JOIN covered USING (row) LEFT JOIN removed USING (row)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (n_words - n_removed_words) >= 0.5 * n_words AS kept, n_removed_lines, n_removed_words
FROM judged
"""

# Inner products of doubles are exact here: the components are integers below 2**10.
OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, n.vec_id, a.label = n.label AS same, list_inner_product(a.c, n.c)::BIGINT AS score
  FROM v a JOIN v n ON a.vec_id % 100 = 0 AND a.vec_id <> n.vec_id AND len(a.c) = len(n.c)),
p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id))::INT AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same
  AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""


def _feistel(source: str, number: str, rounds: int, key: str) -> str:
    """SQL that adds `y`, the rounds applied to `number`, to the rows of `source`; they have a and b."""
    sql = f"SELECT *, {number} % a AS l, {number} // a AS r FROM {source}"
    for i in range(rounds):
        half, other, size = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        noise = f"('0x' || substr(md5('{key}:{i}:' || {other}), 1, 15))::BIGINT"
        sql = f"SELECT * REPLACE (({half} + {noise} % {size}) % {size} AS {half}) FROM ({sql})"
    return f"SELECT * EXCLUDE (l, r), r * a + l AS y FROM ({sql})"


def _op13(shards: int, rounds: int, key: str) -> str:
    # A checksum byte by byte: the table's 256 entries follow from the polynomial.
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k:
             CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
content AS (SELECT doc_id, encode(coalesce(text, '')) AS u FROM documents),
bytes AS (
  SELECT doc_id, octet_length(u) + 8 AS size, list_prepend(4294967295::BIGINT, list_transform(
    regexp_extract_all(hex(u), '..'), lambda h: ('0x' || h)::BIGINT)) AS n FROM content),
sums AS (
  SELECT doc_id, size, xor(list_reduce(n, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM bytes, crc_table),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, crc) - 1 AS x, count(*) OVER () AS total,
         ceil(sqrt(count(*) OVER ()))::BIGINT AS a
  FROM sums),
halves AS (SELECT *, (total + a - 1) // a AS b FROM numbered),
walk AS (
  {_feistel("halves", "x", rounds, key)}
  UNION ALL
  {_feistel("(SELECT * EXCLUDE (y), y AS z FROM walk WHERE y >= total)", "z", rounds, key).replace("* EXCLUDE (l, r)", "* EXCLUDE (l, r, z)")})
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (y % {shards})::INT AS shard, y // {shards} AS slot,
       NULL::INT AS grown_shard, x AS row_number
FROM walk WHERE y < total
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_host_lines": OP2, "op7_line_runs": OP7, "op11_hard_negatives": OP11,
            "op13_feistel_shards": _op13(sharding.SHARDS, sharding.ROUNDS, "shards")}
