"""DuckDB SQL for the text operators whose results SQL can state."""

from __future__ import annotations

#: The windows as whole strings; the order of later occurrences is (doc_id, position), ids being unique.
LINE_DEDUP_SQL = """
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, p, l[p + 1] || chr(10) || l[p + 2] || chr(10) || l[p + 3] AS body
  FROM (SELECT doc_id, l, unnest(range(0, greatest(len(l) - 2, 0))) AS p FROM split)
  WHERE trim(l[p + 1], ' ') <> '' OR trim(l[p + 2], ' ') <> '' OR trim(l[p + 3], ' ') <> ''
),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY body ORDER BY doc_id, p) AS n FROM w) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT p + k) AS c FROM later, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id)
SELECT s.doc_id,
       CASE WHEN g.c IS NULL THEN s.text
            ELSE array_to_string([s.l[i + 1] for i in range(0, len(s.l)) if NOT list_contains(g.c, i)], chr(10)) END AS text,
       CAST(coalesce(len(s.l), 0) AS INTEGER) AS n_lines,
       CAST(coalesce(len(g.c), 0) AS INTEGER) AS n_removed
FROM split s LEFT JOIN gone g USING (doc_id)
"""


def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds in whole numbers, one pair of tables for each round."""
    floor = "({s} - (({s} % {n}) + {n}) % {n}) // {n}"
    out = [
        """kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"part AS MATERIALIZED (SELECT r, vec_id, label, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS w FROM kept, (SELECT unnest(range(0, {parts})) AS p))",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 AS e, w FROM part WHERE r <= {entries})",
    ]
    for k in range(rounds + 1):
        out.append(f"""near{k} AS MATERIALIZED (
  SELECT t.r, t.vec_id, t.label, t.p, t.w, min({{'d': CAST(list_sum([(a - b) * (a - b) for a, b in list_zip(t.w, c.w)]) AS BIGINT), 'e': c.e}}) AS best
  FROM part t JOIN book{k} c ON c.p = t.p GROUP BY ALL)""".replace("[(a - b) * (a - b) for a, b in list_zip(t.w, c.w)]", "list_transform(list_zip(t.w, c.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))"))
        if k < rounds:
            s = floor.format(s="s", n="n")
            out.append(f"""book{k + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(m.w, c.w) AS w FROM book{k} c LEFT JOIN (
    SELECT p, e, list({s} ORDER BY i) AS w FROM (
      SELECT p, e, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, best.e AS e, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM near{k}) GROUP BY p, e, i) GROUP BY p, e) m
  ON m.p = c.p AND m.e = c.e)""")
    return f"""WITH {", ".join(out)},
coded AS MATERIALIZED (
  SELECT r, vec_id, label, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY r, vec_id, label),
digest AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"""


#: Whole numbers throughout, so equal to the last digit.
VECTOR_CODE_SQL = _vector_codes()

#: All pairs by cosine; components by least labels.
VECTOR_DEDUP_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([1 for x in embedding if x <> 0]) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
cc(n, c) USING KEY (n) AS (
  SELECT DISTINCT vec_id, vec_id FROM v
  UNION
  SELECT l.b, min(u.c) FROM link l JOIN cc u ON u.n = l.a JOIN recurring.cc r ON r.n = l.b WHERE u.c < r.c GROUP BY l.b)
SELECT t.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, coalesce(cc.c, t.vec_id) AS component_id, coalesce(cc.c, t.vec_id) IS NOT DISTINCT FROM t.vec_id AS kept
FROM embeddings t LEFT JOIN cc ON cc.n = t.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) d ON d.a = t.vec_id
"""


def _conversations() -> str:
    """The damage, the faults, and the four states' least (cost, audit) with what they have said, row after row."""
    big = "{'c': 1000000000, 'a': '', 't': ''}"
    step = lambda s, cost, letter, said="": f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': {s}.t{said}}}"
    turn = lambda role: f" || chr(10) || '{role}:' || text"
    new = lambda role: f" || chr(10) || '{role}:'"
    given = lambda test, s: f"CASE WHEN {test} THEN {s} ELSE {big} END"
    kept = " || chr(10) || role || ':' || text"
    least = lambda *s: f"list_sort([{', '.join(s)}])[1]"
    free = "NOT forced"
    user = [given(free, step(f"p{k}", "2 + cut", "R", turn("user"))) for k in (0, 1, 3)] + [given(f"{free} AND i = 'u'", step(f"p{k}", "cut", "K", kept)) for k in (0, 1, 3)]
    layer = f"""SELECT conv_id, pos, {step("p0", 3, "D")} AS n0,
      {least(step("p1", 3, "D"), given(f"{free} AND i = 's'", step("p0", "cut", "K", kept)))} AS n1,
      {least(step("p2", 3, "D"), *user)} AS n2,
      {least(step("p3", 3, "D"), given(free, step("p2", "2 + cut", "R", turn("assistant"))), given(f"{free} AND i = 'a'", step("p2", "cut", "K", kept)))} AS n3"""
    closing = f"{least('n2', *[step(f'n{k}', 2, 'I', new('user')) for k in (0, 1, 3)])} AS n2"
    last = f"{least('n3', step('n2', 2, 'I', new('assistant')))} AS n3"
    return f"""
WITH RECURSIVE lots AS MATERIALIZED (
  SELECT conv_id, turn, role, text, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) % 20 AS lot
  FROM conversations),
dmg AS MATERIALIZED (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
  FROM lots, (SELECT unnest([1, 2]) AS copy) WHERE lot <> 0 AND (copy = 1 OR lot = 3)),
seq AS MATERIALIZED (
  SELECT *, left(role, 1) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM dmg)),
rows_ AS MATERIALIZED (
  SELECT *, body = '' AS blank, body <> '' AND again AS duplicate, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
         pos > 1 AND lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i NOT IN ('su', 'ua', 'au') AS illegal,
         CAST(body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS INTEGER) AS cut, body = '' OR again AS forced FROM seq),
v AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, {{'c': 0, 'a': '', 't': ''}} AS p0, {big} AS p1, {{'c': 2, 'a': 'I', 't': chr(10) || 'user:'}} AS p2, {{'c': 4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS p3 FROM conversations
  UNION ALL
  SELECT conv_id, pos, n0, n1, n2, {last} FROM (
    SELECT conv_id, pos, n0, n1, {closing}, n3 FROM (
      {layer}
      FROM (SELECT r.*, v.p0, v.p1, v.p2, v.p3 FROM v JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.pos = v.pos + 1)))),
ends AS (SELECT conv_id, arg_max({least("p0", "p3")}, pos) AS best FROM v GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
         count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM rows_ GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


#: A recursion over the rows of each conversation.
CONVERSATION_SQL = _conversations()


def _secret_base_spans() -> str:
    """The fixed patterns as they are stated: whole runs first, those that are too short dropped afterwards."""
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    names = "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api")) + "_?" + either("key")
    assign = rf"""({names})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [("assign", assign, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    found = " UNION ALL ".join(
        f"""SELECT r, {k} AS k, {least} AS least, regexp_extract_all(t, '{pattern}') AS whole, regexp_extract_all(t, '{pattern}', {group}) AS word, string_split_regex(t, '{pattern}') AS between FROM d"""
        for k, (_, pattern, group, least) in enumerate(kinds)
    )
    counts = ", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{name}" for k, (name, *_) in enumerate(kinds))
    label = "CASE k " + " ".join(f"WHEN {k} THEN '{name}'" for k, (name, *_) in enumerate(kinds)) + " END"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
item AS (SELECT r, k, least, generate_subscripts(whole, 1) AS i, unnest(whole) AS w, unnest(word) AS g, unnest(between[1:len(whole)]) AS b FROM found WHERE len(whole) > 0),
placed AS (SELECT r, k, least, w, g, sum(length(w) + length(b)) OVER (PARTITION BY r, k ORDER BY i) AS e FROM item),
spans AS (SELECT r, {counts}, string_agg({label} || ':' || CAST(e - length(w) AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY e - length(w), k) AS listed FROM placed WHERE length(g) >= least GROUP BY r)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(listed, '')) AS base_sha256
FROM d LEFT JOIN spans USING (r)
"""


#: op5's columns that no model decides.
SECRET_BASE_SPANS_SQL = _secret_base_spans()

#: op6's columns that no order decides.
EDITED_TEXTS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS next FROM d WINDOW w AS (ORDER BY doc_id NULLS FIRST, t))
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 4) || substr(next, 1, length(t) // 4)) AS edited_sha256 FROM n
"""

#: op3's columns that no sample decides, and whether the law holds: gapless slots, and sizes as near as texts and kept groups let them be.
SHARD_SIZES_SQL = """
SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, 'bytes' AS law, true AS gapless, true AS near_equal FROM documents
"""
