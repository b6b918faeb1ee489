"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: Words of whole texts, A-Z lower-cased, as a DuckDB list; null where there are none.
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
           ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s
    FROM words
), flat AS (
    SELECT doc_id, unnest(s) AS x FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
    HAVING 100 * count(*) >= 80 * ((SELECT len(s) FROM sets WHERE doc_id = a.doc_id) + (SELECT len(s) FROM sets WHERE doc_id = b.doc_id) - count(*))
), reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least_of AS (
    SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(b, doc_id)) AS kept
FROM sets LEFT JOIN least_of ON a = doc_id
"""

OP6 = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
    SELECT *, length(regexp_replace(text, '([\[<])(\\*)(/?(?:INST|SYS|TURN|TEXT)\]|/?s>)', '\1\\\2\3', 'g'))
        + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7
          ELSE 23 + length(regexp_replace(role, '([\[<])(\\*)(/?(?:INST|SYS|TURN|TEXT)\]|/?s>)', '\1\\\2\3', 'g')) END AS n
    FROM c
), o AS (
    SELECT conv_id, role, row_number() OVER w AS k, lag(role) OVER w AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), m AS (
    SELECT conv_id, min(k - 1) FILTER (WHERE CASE WHEN k = 1 THEN role NOT IN ('system', 'user') WHEN role = 'user' THEN before NOT IN ('system', 'assistant') ELSE role <> 'assistant' OR before <> 'user' END) AS first_bad,
           max_by(role, k) AS last
    FROM o GROUP BY conv_id
), g AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
           coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(n) AS n
    FROM t GROUP BY conv_id
)
SELECT g.conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars,
       first_bad IS NULL AND last = 'assistant' AS valid, CAST(first_bad AS BIGINT) AS first_bad
FROM g JOIN m ON g.conv_id IS NOT DISTINCT FROM m.conv_id
"""

_ALNUM = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

OP8 = rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, m, array_to_string(w[i + 1 : i + m], ' ') AS g FROM (SELECT *, least(len(w), 10) AS m FROM b WHERE len(w) > 0), LATERAL (SELECT unnest(range(0, len(w) - m + 1)) AS i)),
grams AS (SELECT doc_id, i, m, array_to_string(w[i + 1 : i + m], ' ') AS g FROM (SELECT * FROM d, (SELECT DISTINCT m FROM wins) WHERE len(w) >= m), LATERAL (SELECT unnest(range(0, len(w) - m + 1)) AS i)),
found AS (SELECT doc_id, i, m, item FROM grams JOIN wins USING (m, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""



def _crc32(text: str) -> str:
    """crc32 of an ASCII string, unsigned: one step of the polynomial for each bit."""
    bits = f"flatten([[ascii({text}[k]), 0, 0, 0, 0, 0, 0, 0] FOR k IN range(1, length({text}) + 1)])"
    return f"xor(list_reduce([CAST(b AS BIGINT) FOR b IN list_prepend(4294967295, {bits})], lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"


#: Stretches of words that are equal `period` words on: neighbouring pairs of equal 16-grams, as no run shares fewer words with its copy.
OP11 = rf"""
WITH h AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 AS g FROM h),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a, 1 + CASE WHEN n > 0 THEN (n - g % n) // (3 + g % 8) END AS p FROM g),
d AS (SELECT doc_id, n, CASE WHEN a < n THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] FOR i IN range(n)] ELSE w END AS w FROM a),
grams AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + 16], ' ') AS s FROM (SELECT *, unnest(range(n - 15)) AS i FROM d WHERE n >= 24)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.s = y.s AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + 15 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
best AS (SELECT doc_id, start, length, period, length * 1000 // period AS exponent_milli FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(w[i + 1], ' ' ORDER BY i) AS t FROM (SELECT doc_id, w, unnest(range(n)) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _least(*options: str) -> str:
    return f"list_sort([o FOR o IN [{', '.join(options)}] IF o IS NOT NULL])[1]"


def _edited(to: str, letter: str, cost: str, turn: str | None, only_if: str = "true") -> str:
    """A (cost, audit, turns) that begins with an edit and goes on as `to`; null if the edit is not allowed."""
    turns = f"list_prepend({turn}, {to}.t)" if turn else f"{to}.t"
    return f"CASE WHEN {only_if} THEN {{'c': {to}.c + {cost}, 'a': '{letter}' || {to}.a, 't': {turns}}} END"


def _row(state: int, kept: dict[str, int]) -> str:
    """Best way on from a row in a state: deleted, kept where its initial leads on, or given the role that the state wants."""
    want, role = (3, "'assistant:'") if state == 2 else (2, "'user:'")
    keeps = [_edited(f"v{to}", "K", "e", "role || ':' || text", f"may AND x = '{initial}'") for initial, to in kept.items()]
    return _least(_edited(f"v{state}", "D", "4", None), *keeps, _edited(f"v{want}", "R", "3 + e", f"{role} || text", "may"))


#: Best edits from each grammar state on, from the last row to the first, as whole (cost, audit, turns).
OP13 = rf"""
WITH RECURSIVE k AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), c AS (SELECT *, {_crc32("key")} % 20 AS v FROM k
), d AS (
    SELECT conv_id, turn, CASE v WHEN 4 THEN 'user' ELSE role END AS role, CASE v WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE v WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM c WHERE v <> 0
), n AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, substr(role, 1, 1) AS x FROM d
), f AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
           lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair FROM n
), r AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS may, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS e FROM f
), b(conv_id, i, v0, v1, v2, v3) AS (
    SELECT conv_id, max(i), {{'c': 0, 'a': '', 't': []::VARCHAR[]}}, {{'c': 6, 'a': 'II', 't': ['user:', 'assistant:']}}, {{'c': 3, 'a': 'I', 't': ['assistant:']}}, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} FROM r GROUP BY conv_id
    UNION ALL
    SELECT conv_id, i, {_least("b0", _edited("w2", "I", "3", "'user:'"))}, {_least("b1", _edited("w2", "I", "3", "'user:'"))}, w2, {_least("b3", _edited("b2", "I", "3", "'user:'"))}
    FROM (SELECT *, {_least("b2", _edited("b3", "I", "3", "'assistant:'"))} AS w2
          FROM (SELECT b.conv_id, b.i - 1 AS i, {_row(0, {"s": 1, "u": 2})} AS b0, {_row(1, {"u": 2})} AS b1, {_row(2, {"a": 3})} AS b2, {_row(3, {"u": 2})} AS b3
                FROM b JOIN r ON b.conv_id IS NOT DISTINCT FROM r.conv_id AND b.i = r.i))
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
           count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM r GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(v0.c, 0) AS BIGINT) AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON o.conv_id IS NOT DISTINCT FROM counts.conv_id LEFT JOIN (SELECT * FROM b WHERE i = 0) z ON o.conv_id IS NOT DISTINCT FROM z.conv_id
"""

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": OP1,
    "op6_chat_format": OP6,
    "op8_decontaminate": OP8,
    "op11_periodic_runs": OP11,
    "op13_conversation_repair": OP13,
}
