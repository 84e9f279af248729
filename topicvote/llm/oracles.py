"""The queries that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

from topicvote.llm.license_scan import COPYRIGHT_LINE, KNOWN, PARAGRAPHS, SPELLINGS
from topicvote.llm.secret_scan import ACCESS, ASSIGN, COMMON_OWNERS, COMMON_REPOSITORIES, HEX, OPAQUE


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


EXACT_DEDUP = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

URL_FILTER = r"""
WITH c AS (
    SELECT row_number() OVER () AS id, page_id, url, (19723 + (page_id * 7919) % 365)::INT AS day,
           regexp_replace(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '') AS rest
    FROM pages),
a AS (
    SELECT id, page_id, url, day, split_part(rest, '/', 1) AS authority, rest,
           lower(regexp_replace(regexp_replace(split_part(rest, '/', 1), '^.*@', ''), ':[0-9]*$', '')) AS host
    FROM c),
p AS (
    SELECT *, string_split(host, '.') AS labels,
           string_split(host || substr(rest, length(authority) + 1), '/') AS parts
    FROM a WHERE host <> ''),
cand AS (
    SELECT id, day, 'host' AS rule, array_to_string(labels[k:], '.') AS value, len(labels) - k AS weight
    FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS k FROM p)
    UNION ALL
    SELECT id, day, 'prefix', array_to_string(parts[:k], '/'), k + 1000
    FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS k FROM p)),
v AS (
    SELECT DISTINCT rule, value, ('0x' || substr(md5(value), 1, 8))::BIGINT AS k
    FROM cand WHERE (rule = 'host' AND weight >= 1) OR (rule = 'prefix' AND weight = 1002)),
e AS (
    SELECT rule, value, 19723 + k % 300 AS day, 'block' AS action FROM v WHERE rule = 'host' AND k % 3 = 0
    UNION ALL
    SELECT rule, value, 19763 + k % 300, 'remove' FROM v WHERE rule = 'host' AND k % 6 = 0
    UNION ALL
    SELECT rule, value, 19813 + k % 300, 'block' FROM v WHERE rule = 'host' AND k % 15 = 0
    UNION ALL
    SELECT rule, value, 19723 + k % 300, 'allow' FROM v WHERE rule = 'prefix' AND k % 4 = 0),
hit AS (
    SELECT cand.id, cand.weight, cand.rule, cand.value, e.day AS since, e.action
    FROM cand ASOF JOIN e ON cand.rule = e.rule AND cand.value = e.value AND cand.day >= e.day),
best AS (
    SELECT id, rule, value, since, action FROM hit WHERE action <> 'remove'
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight DESC) = 1)
SELECT page_id, url, day, coalesce(action, 'allow') AS verdict, rule, value, since::INT AS since
FROM c LEFT JOIN best USING (id)
"""


def _found(kind: int, name: str, pattern: str, group: int, valid: str) -> str:
    p = quoted(pattern)
    return f"""
    SELECT row, {kind} AS kind, '{name}' AS name, start, start + length(whole) AS stop, value, owner, repository
    FROM (
        SELECT *, list_sum(list_transform(leads[:n], lambda x: length(x)))
                  + coalesce(list_sum(list_transform(wholes[:n - 1], lambda x: length(x))), 0) AS start,
               wholes[n] AS whole, vals[n] AS value
        FROM (
            SELECT row, owner, repository, string_split_regex(t, {p}) AS leads, regexp_extract_all(t, {p}) AS wholes,
                   regexp_extract_all(t, {p}, {group}) AS vals,
                   unnest(range(1, len(regexp_extract_all(t, {p})) + 1)) AS n
            FROM d))
    WHERE {valid}"""


SECRET_SCAN = f"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, source AS owner,
           concat_ws('/', source, lang) AS repository
    FROM documents),
f AS ({_found(0, "assign", ASSIGN, 2, "length(value) >= 6")}
    UNION ALL {_found(1, "access", ACCESS, 0, "length(value) >= 20")}
    UNION ALL {_found(2, "hex", HEX, 0, "true")}
    UNION ALL {_found(3, "opaque", OPAQUE, 0,
                      "regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')")}),
o AS (
    SELECT value, count(DISTINCT owner) < {COMMON_OWNERS} AND count(DISTINCT repository) < {COMMON_REPOSITORIES} AS live
    FROM f GROUP BY value),
j AS (SELECT f.*, live FROM f JOIN o USING (value)),
k AS (
    SELECT * FROM j WHERE kind < 3
    UNION ALL
    SELECT * FROM j WHERE kind = 3 AND live AND NOT EXISTS (
        SELECT 1 FROM j AS b WHERE b.row = j.row AND b.kind < 3 AND b.start < j.stop AND j.start < b.stop)),
r AS (
    SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
           count(*) FILTER (kind = 2) AS n_hex,
           string_agg(concat_ws(':', name, start, stop), ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
           string_agg(concat_ws(':', name, start, stop), ',' ORDER BY start, kind) AS spans,
           count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
    FROM k GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN r USING (row)
"""


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), {quoted(COPYRIGHT_LINE)}, ' ', 'g')"
    for pattern, same in SPELLINGS:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(same.replace('$', chr(92)))}, 'g')"
    return f"trim(regexp_replace({out}, {quoted('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+')}, ' ', 'g'))"


def _license_scan() -> str:
    known = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, _, text in KNOWN)
    return f"""
WITH k AS (SELECT {_canonical("body")} AS body, min(name) AS license FROM (VALUES {known}) AS v(name, body) GROUP BY 1),
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT row, string_split(t, chr(10)) AS parts FROM d),
paragraphs AS (SELECT row, string_split_regex(t, {quoted(PARAGRAPHS)}) AS parts FROM d),
u AS (
    SELECT row, 'text' AS unit, t AS part FROM d
    UNION ALL SELECT row, 'line', unnest(parts) FROM lines WHERE len(parts) > 1
    UNION ALL SELECT row, 'paragraph', unnest(parts) FROM paragraphs WHERE len(parts) > 1),
f AS (SELECT u.row, unit, license FROM (SELECT row, unit, {_canonical("part")} AS body FROM u) AS u JOIN k USING (body)),
r AS (
    SELECT row, max(license) FILTER (unit = 'text') AS license, count(*) FILTER (unit <> 'text') AS n_notices,
           array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses
    FROM f GROUP BY row)
SELECT doc_id, license, coalesce(n_notices, 0) AS n_notices, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN r USING (row)
"""


COLLOCATIONS = r"""
WITH t AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM t),
s AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (
    SELECT lang, array_to_string(words[i:i + k - 1], ' ') AS phrase, k
    FROM (SELECT *, unnest(range(1, least(5, len(words) - i + 1) + 1)) AS k FROM s)),
f AS (SELECT lang, phrase, k, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 100),
parts AS (
    SELECT lang, a, array_to_string(ws[i:i + size - 1], ' ') AS part
    FROM (SELECT *, unnest(range(1, k - size + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS size FROM c))),
longer AS (SELECT lang, part AS phrase, max(a) AS most FROM parts GROUP BY ALL),
cuts AS (
    SELECT lang, phrase, a, cut, array_to_string(ws[:cut], ' ') AS x, array_to_string(ws[cut + 1:], ' ') AS y
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
q AS (
    SELECT cuts.lang, cuts.phrase, cuts.a, cut, x.a AS l, y.a AS r, n.n,
           (1000::HUGEINT * cuts.a * n.n) // (x.a::HUGEINT * y.a) AS score
    FROM cuts JOIN n USING (lang)
    JOIN f AS x ON x.lang = cuts.lang AND x.phrase = cuts.x
    JOIN f AS y ON y.lang = cuts.lang AND y.phrase = cuts.y),
best AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (
    SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase)
    WHERE most IS NULL OR 100 * most < 100 * best.a)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
WHERE rank <= 2000
"""

def _repair() -> str:
    """States of a conversation are (cost, audit, text) by what was said last, in s0 to s3 (nothing, s,
    u, a); the smaller of two is the cheaper, then the one with the lesser audit."""
    far = "{'c': 1000000000, 'a': '', 'r': ''}"

    def least(*states):
        return f"list_sort([{', '.join(states)}])[1]"

    def said(old, cost, letter, role, text):
        end = f"CASE WHEN replace({old}.a, 'D', '') = '' THEN '' ELSE chr(10) END"
        return f"{{'c': {old}.c + {cost}, 'a': {old}.a || '{letter}', 'r': {old}.r || {end} || {role} || ':' || {text}}}"

    def deleted(old):
        return f"{{'c': {old}.c + 4, 'a': {old}.a || 'D', 'r': {old}.r}}"

    def inserted(old, *roles):
        for role in roles:
            old = "(" + said(old, 3, "I", quoted(role), "''") + ")"
        return old

    def given(old, initial, role):
        keep, change = said(old, "extra", "K", "role", "text"), said(old, "extra + 3", "R", quoted(role), "text")
        return f"CASE WHEN fault IN (1, 2) THEN {far} WHEN initial = '{initial}' THEN {keep} ELSE {change} END"

    kept_s = f"CASE WHEN fault IN (1, 2) OR initial <> 's' THEN {far} ELSE {said('s0', 'extra', 'K', 'role', 'text')} END"
    return rf"""
WITH RECURSIVE
e AS (
    SELECT list(list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                lambda x, y: CASE WHEN x & 1 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END) ORDER BY n) AS t
    FROM (SELECT unnest(range(256)) AS n)),
b AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           list_prepend(4294967295::BIGINT, list_transform(string_split(
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
               lambda x: ord(x)::BIGINT)) AS name
    FROM conversations),
f AS (
    SELECT conv_id, turn, role, text, xor(4294967295,
           list_reduce(name, lambda x, y: xor(t[(xor(x, y) & 255) + 1], x >> 8))) % 20 AS f
    FROM b, e),
d AS (
    SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
           CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy) AS i FROM d),
r AS (
    SELECT *, CASE fault WHEN 3 THEN 3 ELSE 0 END AS extra FROM (
        SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
               CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 1
                    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                    WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 3 ELSE 0 END AS fault
        FROM o)),
w AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'r': ''}} AS s0, {far} AS s1,
           {{'c': 3, 'a': 'I', 'r': 'user:'}} AS s2, {{'c': 6, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:'}} AS s3
    FROM d
    UNION ALL
    SELECT conv_id, i, n0, n1,
           {least("n2", inserted("n0", "user"), inserted("n1", "user"), inserted("n3", "user"))},
           {least("n3", inserted("n2", "assistant"), inserted("n0", "user", "assistant"), inserted("n1", "user", "assistant"))}
    FROM (
        SELECT w.conv_id, r.i, {deleted("s0")} AS n0,
               {least(deleted("s1"), kept_s)} AS n1,
               {least(deleted("s2"), *(given(x, "u", "user") for x in ("s0", "s1", "s3")))} AS n2,
               {least(deleted("s3"), given("s2", "a", "assistant"))} AS n3
        FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)),
last AS (
    SELECT conv_id, {least("s0", "s3")} AS best FROM w
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
g AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
           count(*) FILTER (fault = 3) AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM r GROUP BY conv_id),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(best.r, '')) AS repaired_sha256
FROM c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN last ON last.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLES = {
    "op1_exact_dedup": EXACT_DEDUP,
    "op2_url_filter": URL_FILTER,
    "op4_secret_scan": SECRET_SCAN,
    "op5_license_scan": _license_scan(),
    "op11_conversation_repair": _repair(),
    "op13_collocations": COLLOCATIONS,
}
