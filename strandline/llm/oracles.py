"""DuckDB counterparts of the conversation repair and of the word runs."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """crc32 of an ASCII string, a bit at a time: DuckDB has no such function."""
    step = "lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), {step})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1), lambda i: ord(({text})[i])::BIGINT)), {byte}), 4294967295)"


def _cheapest(state: int) -> str:
    """A state's cheapest (cost, audit) for a row, without inserts; b holds what follows from each state."""
    keep, need = ({"s": 2, "u": 3}, {"u": 3}, {"a": 4}, {"u": 3})[state], (3, 3, 4, 3)[state]
    kept = " ".join(f"WHEN init = '{r}' THEN {{'c': b[{to}].c + t, 'a': 'K' || b[{to}].a}}" for r, to in keep.items())
    options = [f"{{'c': b[{state + 1}].c + 3, 'a': 'D' || b[{state + 1}].a}}", f"CASE WHEN gone THEN NULL {kept} END", f"CASE WHEN gone THEN NULL ELSE {{'c': b[{need}].c + 2 + t, 'a': 'R' || b[{need}].a}} END"]
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"


#: Rows after damage (d), in order and with faults (r); costs and audits from the last row to the first (s); the edits replayed (x, y).
CONVERSATION_SQL = rf"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
    h AS (SELECT *, {crc32_sql('key')} % 20 AS h FROM k),
    d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n, regexp_matches(text, '[^\x20\x09-\x0D]') AS word FROM d),
    f AS (SELECT *, left(role, 1) AS init, NOT word AS blank, word AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup, regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS ends FROM o),
    r AS (SELECT *, blank OR dup AS gone, CASE WHEN NOT blank AND NOT dup AND NOT ends THEN 1 ELSE 0 END AS t, lag(init) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f),
    s AS (SELECT conv_id, n + 1 AS i, [{{'c': 0::BIGINT, 'a': ''}}, {{'c': 4::BIGINT, 'a': 'II'}}, {{'c': 2::BIGINT, 'a': 'I'}}, {{'c': 0::BIGINT, 'a': ''}}] AS b FROM (SELECT DISTINCT conv_id, n FROM r)
        UNION ALL SELECT conv_id, i, [least(e[1], {{'c': u.c + 2, 'a': 'I' || u.a}}), least(e[2], {{'c': u.c + 2, 'a': 'I' || u.a}}), u, w] FROM (
            SELECT conv_id, i, e, least(e[3], {{'c': e[4].c + 2, 'a': 'I' || e[4].a}}) AS u, least(e[4], {{'c': e[3].c + 2, 'a': 'I' || e[3].a}}) AS w FROM (
                SELECT s.conv_id, r.i, [{", ".join(map(_cheapest, range(4)))}] AS e FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i - 1))),
    a AS (SELECT conv_id, b[1].c AS cost, b[1].a AS audit FROM s WHERE i = 1),
    e AS (SELECT conv_id, p, audit[p] AS edit, length(replace(left(audit, p), 'I', '')) AS row_no, length(replace(left(audit, p), 'D', '')) AS place FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM a)),
    x AS (SELECT e.*, r.role, r.text, max(CASE WHEN place = 1 AND edit = 'K' AND init = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led FROM e LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = row_no AND edit <> 'I' WHERE edit <> 'D'),
    y AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS repaired FROM x GROUP BY 1),
    g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, sum(t) AS truncated, count(*) FILTER (before IS NOT NULL AND before || init NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1)
    SELECT q.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM q.conv_id"""

#: Words in the planted order (w); words q apart that are equal (m), in stretches of one period (t); of stretches in one place the least period.
RUNS_SQL = rf"""WITH k AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, {crc32_sql('doc_id::VARCHAR')} AS h FROM documents),
    p AS (SELECT *, len(words) AS n, h // 10 AS g, (h // 10) % greatest(len(words), 1) AS a FROM k),
    u AS (SELECT doc_id, n, unnest(range(0, n)) AS i, words, h % 10 = 0 AS planted, a, 1 + (n - a) // (3 + g % 8) AS q FROM p WHERE n > 0),
    w AS (SELECT doc_id, n, i, words[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % q ELSE i END] AS word FROM u),
    m AS (SELECT x.doc_id, x.n, y.i - x.i AS q, x.i FROM w x JOIN w y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    t AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS z FROM m) GROUP BY doc_id, q, z HAVING count(*) + q >= greatest(6, 4 * q)),
    r AS (SELECT doc_id, start, length, min(q) AS period FROM t GROUP BY 1, 2, 3),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS best FROM r),
    l AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY 1),
    z AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
    c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN z USING (doc_id, i) GROUP BY 1)
    SELECT k.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM k LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN (SELECT * FROM b WHERE best = 1) USING (doc_id)"""
