"""DuckDB twins that need more than a short query."""

from __future__ import annotations

_NEXT = (2, 2, 3, 2)
_NAME = {2: "user", 3: "assistant"}


def _entry(cost: str, audit: str, lines: str) -> str:
    return f"{{'c': {cost}, 'a': {audit}, 'r': {lines}}}"


def _least(options: list[str]) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _step(s: int) -> str:
    """Best of the arcs over one row from state ``s``, before inserted rows."""
    n, name = _NEXT[s], _NAME[_NEXT[s]]
    delete = _entry(f"d{s}.c + 3", f"'D' || d{s}.a", f"d{s}.r")
    far = _entry("1000000000", "''", "[]::VARCHAR[]")
    kept = lambda to: _entry(f"d{to}.c + cut", f"'K' || d{to}.a", f"list_prepend(role || ':' || text, d{to}.r)")
    system = f"WHEN initial = 's' THEN {kept(1)} " if s == 0 else ""
    keep = f"CASE WHEN must THEN {far} {system}WHEN initial = '{name[0]}' THEN {kept(n)} ELSE {far} END"
    rerole = f"CASE WHEN must THEN {far} ELSE {_entry(f'd{n}.c + 2 + cut', f'''{chr(39)}R{chr(39)} || d{n}.a''', f'''list_prepend({chr(39)}{name}:{chr(39)} || text, d{n}.r)''')} END"
    return _least([delete, keep, rerole])


def _inserted(s: int) -> str:
    one, two = _NEXT[s], _NEXT[_NEXT[s]]
    return _least([f"b{s}", _entry(f"b{one}.c + 2", f"'I' || b{one}.a", f"list_prepend('{_NAME[one]}:', b{one}.r)"),
                   _entry(f"b{two}.c + 4", f"'II' || b{two}.a", f"list_prepend('{_NAME[one]}:', list_prepend('{_NAME[two]}:', b{two}.r))")])


CONVERSATION = rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS l
  FROM range(256) t(i)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations),
dealt AS (
  SELECT keyed.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ord(k[i])::BIGINT)),
                             lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS c
  FROM keyed, crc),
rows_ AS (
  SELECT conv_id, turn, CASE c WHEN 4 THEN 'user' ELSE role END AS role,
         CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dealt, unnest(range(CASE c WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) u(copy)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank
  FROM rows_),
flagged AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS dup,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before
  FROM numbered),
turns AS (
  SELECT *, blank OR dup AS must,
         CASE WHEN NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 1 ELSE 0 END AS cut
  FROM flagged),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, sum(cut) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM turns GROUP BY conv_id),
walk AS (
  SELECT conv_id, n AS i, {_entry("0::BIGINT", "''", "[]::VARCHAR[]")} AS d0, {_entry("4::BIGINT", "'II'", "['user:', 'assistant:']")} AS d1,
         {_entry("2::BIGINT", "'I'", "['assistant:']")} AS d2, {_entry("0::BIGINT", "''", "[]::VARCHAR[]")} AS d3
  FROM counts
  UNION ALL
  SELECT conv_id, i, {", ".join(_inserted(s) for s in range(4))}
  FROM (SELECT w.conv_id, w.i - 1 AS i, {", ".join(f"{_step(s)} AS b{s}" for s in range(4))}
        FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.i) x),
done AS (SELECT conv_id, d0.c AS cost, d0.a AS audit, array_to_string(d0.r, chr(10)) AS repaired FROM walk WHERE i = 0)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""

REPEATS = """
WITH d AS (SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT id, 1000 * c AS base, substr(h, 2000 * c + 1, 2798) AS p FROM d, unnest(range(0, (length(h) // 2 + 600) // 1000)) u(c)),
w AS (SELECT id, base + j AS i, md5(substr(p, 2 * j + 1, 800)) AS k FROM parts, unnest(range(0, length(p) // 2 - 399)) u(j)),
hit AS (SELECT id, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
spans AS (
  SELECT id, min(i) AS s, max(i) + 400 AS e
  FROM (SELECT id, i, sum(fresh) OVER (PARTITION BY id ORDER BY i) AS run
        FROM (SELECT id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM hit) f) g
  GROUP BY id, run),
runs AS (SELECT id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM spans GROUP BY id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN ss IS NULL THEN h ELSE
         list_aggregate(list_transform(range(1, len(ss) + 2), lambda k: substr(h, 2 * coalesce(es[k - 1], 0) + 1, 2 * (coalesce(ss[k], length(h) // 2) - coalesce(es[k - 1], 0)))), 'string_agg', '') END)) AS kept_sha256
FROM d LEFT JOIN runs USING (id)
"""
