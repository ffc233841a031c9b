"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bayes_language, block_topk, collocations, conversation_repair, curve_packing, exact_digest, license_scan, ordinal_quality, sentencepiece_codec, simhash, substring_dedup, token_shards, warc

_OPERATORS = (
    ordinal_quality.op1_ordinal_quality,
    token_shards.op2_token_shards,
    block_topk.op3_block_topk,
    exact_digest.op4_exact_digest,
    curve_packing.op5_curve_packing,
    warc.op6_warc,
    sentencepiece_codec.op7_sentencepiece,
    simhash.op8_simhash,
    substring_dedup.op9_substring,
    bayes_language.op10_language,
    collocations.op11_collocations,
    conversation_repair.op12_repair,
    license_scan.op13_licenses,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS}


_OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: base32 of a SHA-1: 32 digits of five bits each, from the 160 bits as a string
_OP6 = f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first,
    list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', digest[i]) - 1), 4, '0')), 'string_agg', '') AS bits FROM p
)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: '{_BASE32}'[CAST(
    16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT)
    + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT) AS INT) + 1]), 'string_agg', '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""


_OP9 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35
), windows AS (
  SELECT r, i, sha256(array_to_string(w[i : i + 34], ' ')) AS h FROM starts JOIN d USING (r)
), repeated AS (
  SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM repeated
), kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) ANTI JOIN gone USING (r, j) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, unnest(list_transform(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]'), lambda p: regexp_extract_all(p, '[^\x20\x09]+'))) AS w FROM d
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
), runs AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, range(1, 6) t(m) WHERE len(w) >= m)
), f AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS a FROM runs GROUP BY lang, m, phrase HAVING count(*) >= 100
), cuts AS (
  SELECT lang, m, phrase, a, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS w FROM f WHERE m > 1
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, t.n, CAST(CAST(1000 AS HUGEINT) * c.a * t.n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 :], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest s
  WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.lang = s.lang AND b.phrase <> s.phrase AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * b.a >= 100 * s.a)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def _edit(state: str, cost: str, letter: str, line: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}}"


def _insert(state: str, role: str) -> str:
    return _edit(state, "5", "I", f"chr(10) || '{role}:'")


def _keep(state: str, initial: str) -> str:
    return _edit(state, f"stay + CASE WHEN c = '{initial}' THEN 0 ELSE 1000000 END", "K", "chr(10) || role || ':' || text")


def _rerole(state: str, role: str) -> str:
    return _edit(state, "stay + 1", "R", f"chr(10) || '{role}:' || text")


_NEVER = "{'c': 1000000::BIGINT, 'a': '', 't': ''}"
#: a step of the recursion is a row of a conversation: e, s, u, a hold the cheapest edits that end in each state
_OP12 = f"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda b: CAST(ascii(b) AS BIGINT))),
      lambda x, b: list_reduce(list_prepend(xor(x, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 20 AS code
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM coded WHERE code <> 0
), numbered AS (
  SELECT *, left(role, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS i, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS bare
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM damaged)
), f AS MATERIALIZED (
  SELECT *, CASE fault WHEN 't' THEN 5 WHEN '' THEN 0 ELSE 1000000 END AS stay FROM (
    SELECT *, CASE WHEN bare = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
      lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM numbered)
), walk(conv_id, i, e, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 't': ''}}, {_NEVER}, {{'c': 5::BIGINT, 'a': 'I', 't': chr(10) || 'user:'}}, {{'c': 10::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT conv_id, i, e, s, u, least(a, {_insert("u", "assistant")}) FROM (
    SELECT conv_id, i, e, s, a, least(u, {_insert("e", "user")}, {_insert("s", "user")}, {_insert("a", "user")}) AS u FROM (
      SELECT w.conv_id, f.i, {_edit("w.e", "2", "D")} AS e,
        least({_edit("w.s", "2", "D")}, {_keep("w.e", "s")}) AS s,
        least({_edit("w.u", "2", "D")}, {_keep("w.e", "u")}, {_keep("w.s", "u")}, {_keep("w.a", "u")}, {_rerole("w.e", "user")}, {_rerole("w.s", "user")}, {_rerole("w.a", "user")}) AS u,
        least({_edit("w.a", "2", "D")}, {_keep("w.u", "a")}, {_rerole("w.u", "assistant")}) AS a
      FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))
), ends AS (
  SELECT conv_id, least(e, a) AS z FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT k.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(z.c, 0) AS cost, coalesce(z.a, '') AS audit, sha256(coalesce(z.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM k.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_block_topk": _OP3, "op6_warc": _OP6, "op9_substring": _OP9, "op11_collocations": _OP11, "op12_repair": _OP12}
