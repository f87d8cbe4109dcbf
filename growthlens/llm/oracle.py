"""DuckDB SQL for the queries that SQL can express, over the raw tables.

Written as the contracts read, not as the Spark plans compute. Tokenisation,
learned scores, alignments and the rules' labels have no SQL form; those
queries are tested against brute force.
"""

from __future__ import annotations

from .quality_rules import STOP_LETTERS, STOP_WORDS, THRESHOLDS

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"'[^\x20\x09-\x0D]+'"

# -- op3: template lengths are those of <|im_start|>ROLE\nTEXT<|im_end|>\n.

_ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"

CHAT_FORMAT = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, COUNT(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(SUM(length('<|im_start|>') + length(replace({_ESCAPED.format('role')}, chr(10), '\n')) + 1
                + length({_ESCAPED.format('text')}) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id"""

# -- op4: base 32 of a digest, five bits at a time, from ten hex digits each.

WARC = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT digest, MIN(page_id) AS first_id FROM payloads GROUP BY digest)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((('0x' || substr(digest, CAST(i // 8 * 10 + 1 AS BIGINT), 10))::BIGINT >> CAST(35 - i % 8 * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM payloads JOIN firsts USING (digest)"""


def _quality_rules() -> str:
    rules = " AND ".join(
        "NOT (" + f"{r.scale} * {r.measure} {r.op} {r.limit} * {r.per or 1}" + (f" AND n_words >= {r.from_words}" if r.from_words else "")
        + (" AND 2 * n_stop_letters >= word_chars" if r.known_script else "") + ")"
        for r in THRESHOLDS)
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), {_WORD}) AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_SPACE}) <> '') AS lines
  FROM documents),
windows AS (
  SELECT k, i, array_to_string(words[i:i + 4], ' ') AS w
  FROM (SELECT k, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)),
again AS (SELECT k, w FROM windows GROUP BY k, w HAVING COUNT(*) > 1),
covered AS (
  SELECT k, COUNT(DISTINCT i + j) AS n FROM windows SEMI JOIN again USING (k, w), range(5) AS r(j) GROUP BY k),
m AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
         coalesce(c.n, 0) AS n_repeat_words,
         len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')), [{stops}])) AS n_stop_words,
         length(regexp_replace(text, '[^{STOP_LETTERS}]', '', 'g')) AS n_stop_letters
  FROM d LEFT JOIN covered c USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       {rules} AS kept
FROM m"""


LINE_DEDUP = f"""
WITH lines AS (
  SELECT k, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM (
    SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
keyed AS (SELECT *, translate(trim(line, {_SPACE}), {_LOWER}) AS key FROM lines),
repeated AS (
  SELECT key, MIN(doc_id) AS owner FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING COUNT(DISTINCT doc_id) >= 2),
judged AS (SELECT k.*, coalesce(k.doc_id <> r.owner, FALSE) AS gone FROM keyed k LEFT JOIN repeated r USING (key))
SELECT any_value(doc_id) AS doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY k"""

JACCARD_JOIN = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_WORD}) AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
                      WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS s
  FROM w),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * COUNT(*) >= 85 * (a.n + b.n - COUNT(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sets
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id
FROM sets s JOIN (SELECT x, MIN(y) AS component_id FROM reach GROUP BY x) m ON m.x = s.doc_id"""

ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": CHAT_FORMAT,
    "op4_warc": WARC,
    "op7_quality_rules": _quality_rules(),
    "op9_line_dedup": LINE_DEDUP,
    "op10_jaccard_join": JACCARD_JOIN,
}
