"""SQL (DuckDB) for the queries over conversations."""

from __future__ import annotations

#: CRC-32 of ASCII text: a table of 256 remainders made from the polynomial, then one step a character.
_TABLE = """tab AS (SELECT list(c ORDER BY n) AS t FROM (
  SELECT n, list_reduce([n]::BIGINT[] || [0,0,0,0,0,0,0,0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) g(n)))"""


def _crc32(text: str) -> str:
    return f"xor(list_reduce([4294967295]::BIGINT[] || list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


def _then(state: str, cost: str, letter: str, line: str | None, when: str = "true") -> str:
    lines = f"list_append({state}.t, {line})" if line else f"{state}.t"
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 's': {state}.s || '{letter}', 't': {lines}}} END"


def _least(*choices: str) -> str:
    return f"list_min([{', '.join(choices)}])"


def _op12() -> str:
    insert = {n: _then(f"p{n}", "3", "I", "'assistant:'" if n == 2 else "'user:'") for n in range(4)}
    may, extra = "fault NOT IN (1, 2)", "CASE fault WHEN 3 THEN 3 ELSE 0 END"
    own = "role || ':' || text"
    after = {
        0: [_then("e0", "4", "D", None)],
        1: [_then("e1", "4", "D", None), _then("e0", extra, "K", own, f"{may} AND initial = 's'")],
        2: [_then("e2", "4", "D", None)] + [_then(f"e{n}", f"{c} + {extra}", k, line, when) for n in (0, 1, 3) for k, c, line, when in (("K", "0", own, f"{may} AND initial = 'u'"), ("R", "3", "'user:' || text", may))],
        3: [_then("e3", "4", "D", None), _then("e2", extra, "K", own, f"{may} AND initial = 'a'"), _then("e2", f"3 + {extra}", "R", "'assistant:' || text", may)],
    }
    state = "STRUCT(c BIGINT, s VARCHAR, t VARCHAR[])"
    return rf"""
WITH RECURSIVE {_TABLE},
r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("conv_id || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations, tab),
d AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE f WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM r WHERE f <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, substr(role, 1, 1) AS initial FROM d),
w AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
  coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS bad FROM n),
c AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (bad) AS illegal FROM w GROUP BY conv_id),
dp AS (
  SELECT conv_id, 0 AS i, CAST({{'c': 0, 's': '', 't': []}} AS {state}) AS p0, CAST(NULL AS {state}) AS p1, CAST(NULL AS {state}) AS p2, CAST(NULL AS {state}) AS p3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {", ".join(_least(*after[n]) for n in range(4))}
  FROM (SELECT conv_id, i, role, text, fault, initial, p0 AS e0, p1 AS e1, e2, {_least("p3", _then("e2", "3", "I", "'assistant:'"))} AS e3
    FROM (SELECT dp.conv_id, w.i, role, text, fault, initial, p0, p1, p3, {_least("p2", insert[0], insert[1], insert[3])} AS e2 FROM dp JOIN w ON w.conv_id = dp.conv_id AND w.i = dp.i + 1))),
ends AS (SELECT conv_id, i, {_least("p0", "p3", insert[2], _then("q", "3", "I", "'assistant:'"))} AS best FROM (SELECT *, {insert[1]} AS q FROM dp))
SELECT ends.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(best.c AS BIGINT) AS cost, best.s AS audit, sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM ends LEFT JOIN c USING (conv_id) WHERE ends.i = coalesce(c.n, 0)
"""


OP12_SQL = _op12()

OP11_SQL = rf"""
WITH {_TABLE},
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h, n FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id), tab),
p AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS k FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT p.conv_id, o.pos AS d, role, text FROM p JOIN o ON o.conv_id = p.base AND o.pos <= p.h
  UNION ALL SELECT p.conv_id, o.pos - h + k, role, text FROM p JOIN o ON o.conv_id = p.conv_id AND o.pos > p.h),
m AS (SELECT conv_id, d, sha256(CAST(to_json(list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY d)) AS VARCHAR)) AS key, text FROM r UNION ALL SELECT conv_id, 0, '', '' FROM p),
nodes AS (SELECT d AS depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) AS words FROM m GROUP BY d, key),
paths AS (SELECT m.conv_id AS member, nodes.conv_id, depth FROM m JOIN nodes ON d = depth AND m.key = nodes.key),
up AS (SELECT n.*, paths.conv_id AS parent_conv_id FROM nodes n LEFT JOIN paths ON member = n.conv_id AND paths.depth = n.depth - 1),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY 1, 2),
own AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids USING (conv_id, depth)),
roll AS (SELECT paths.conv_id, paths.depth, count(*) FILTER (x.n_children = 0) AS n_leaves, CAST(sum((x.n_convs - 1) * x.words) AS BIGINT) AS saved_tokens FROM own x JOIN paths ON member = x.conv_id AND paths.depth <= x.depth GROUP BY 1, 2),
ends AS (SELECT paths.conv_id, depth, string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) AS members FROM paths JOIN (SELECT conv_id, max(d) AS total FROM m GROUP BY conv_id) t ON member = t.conv_id AND depth = total GROUP BY 1, 2)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(members, '')) AS ends_sha256 FROM own JOIN roll USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)
"""
