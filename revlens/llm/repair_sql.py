"""SQL twin of the conversation repair: states of the role pattern row by row, in a recursive query."""

CRC_TABLE = "list_transform(range(256), lambda c: list_reduce(list_prepend(c, range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))"
CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' ||
    coalesce(CAST(turn AS VARCHAR), ' ')), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295)"""


def _arc(state: str, cost: str, letter: str, line: str | None) -> str:
    """The state one edit on: least cost first, then the letters; the lines written so far go along."""
    lines = f"list_append({state}.o, {line})" if line else f"{state}.o"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {lines}}} END"


def _least(*arcs: str) -> str:
    return f"list_min(list_filter([{', '.join(arcs)}], lambda x: x IS NOT NULL))"


def _kept(state: str, initial: str) -> str:
    keep = _arc(state, "more", "K", "role || ':' || text")
    return f"CASE WHEN ini = '{initial}' AND fault IN ('-', 't') THEN {keep} END"


def _changed(state: str, role: str) -> str:
    return f"CASE WHEN fault IN ('-', 't') THEN {_arc(state, '1 + more', 'R', f"'{role}:' || text")} END"


def _inserted(state: str, role: str) -> str:
    return _arc(state, "5", "I", f"'{role}:'")


_STEP = ", ".join(
    f"{_least(*arcs)} AS t{i}"
    for i, arcs in enumerate(
        [
            [_arc("s0", "2", "D", None)],
            [_arc("s1", "2", "D", None), _kept("s0", "s")],
            [_arc("s2", "2", "D", None), *[f(s, x) for s in ("s0", "s1", "s3") for f, x in ((_kept, "u"), (_changed, "user"))]],
            [_arc("s3", "2", "D", None), _kept("s2", "a"), _changed("s2", "assistant")],
        ]
    )
)
_USER = _least("t2", *[_inserted(s, "user") for s in ("t0", "t1", "t3")])

SQL = f"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE} AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC} % 20 AS kind FROM conversations, crc),
dam AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM raw WHERE kind <> 0)),
pos AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, left(role, 1) AS ini FROM dam),
f AS (
  SELECT *, CASE WHEN regexp_full_match(text, '[\\x20\\x09-\\x0D]*') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd'
    WHEN regexp_matches(text, '[^.!?\\x20\\x09-\\x0D][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '-' END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY k) || ini AS pair
  FROM pos),
g AS (SELECT *, CASE fault WHEN 't' THEN 5 ELSE 0 END AS more FROM f),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n
  FROM g GROUP BY conv_id),
first AS (SELECT n, conv_id, {{'c': 0, 'a': '', 'o': CAST([] AS VARCHAR[])}} AS t0 FROM sums),
walk AS (
  SELECT conv_id, n, CAST(0 AS BIGINT) AS k, t0 AS s0, CASE WHEN n < 0 THEN t0 END AS s1, {_inserted("t0", "user")} AS s2,
    {{'c': 10, 'a': 'II', 'o': ['user:', 'assistant:']}} AS s3 FROM first
  UNION ALL
  SELECT conv_id, n, k, t0, t1, u2, {_least("t3", _inserted("u2", "assistant"))} FROM (
    SELECT *, {_USER} AS u2 FROM (
      SELECT w.conv_id, n, g.k, {_STEP} FROM walk w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.k = w.k + 1))),
best AS (SELECT conv_id, {_least("s0", "s3")} AS b FROM walk WHERE k = n)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
"""
