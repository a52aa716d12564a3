"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from quarry.llm.chat import BODY, CONTROLS, END, LOSS_ROLE, START, TURN
from quarry.llm.collocations import COVER_PERCENT, MIN_COUNT, TOP
from quarry.llm.divergence import MIN_DOCS, TOP_TERMS
from quarry.llm.quality import BARS, MARKS, MAX_REPEAT_PERCENT, MIN_LEFT, MIN_WORDS, PHRASES, UNMARKED

_UNMARKED = UNMARKED.replace(r"\p{Is", r"\p{")        # the name of a script in the other dialect
_BARS = "[" + "".join(BARS) + "]"
_WHITE = r"[\x20\x09-\x0D]"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, [x FOR x IN regexp_split_to_array(text, '{_WHITE}+') IF x <> ''] AS w FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM
        (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
hit AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(8) t(k) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
j AS (SELECT r, pos, line, len([x FOR x IN regexp_split_to_array(line, '{_WHITE}+') IF x <> '']) AS n,
             len(regexp_extract_all(line, '{_BARS}')) AS bars, len(regexp_extract_all(line, '[#*$%&|<>]')) AS sym FROM l),
keep AS (SELECT *, NOT ((NOT regexp_matches(line, '[{MARKS}{_UNMARKED}]') AND n >= 12)
    OR (NOT regexp_matches(line, '\p{{Ll}}') AND regexp_matches(line, '\p{{Lu}}') AND n >= 8
        AND length(regexp_replace(line, '[^\p{{Lu}}\p{{Lt}}]+', '', 'g')) > length(regexp_replace(line, '[^\p{{Lo}}\p{{Lm}}]+', '', 'g')))
    OR (bars >= 3 AND n <= (bars + 1) * 3 + bars)
    OR (regexp_matches(lower(line), '{"|".join(PHRASES)}') AND n <= 40)
    OR (n >= 4 AND sym * 4 > n)) AS ok FROM j),
lines AS (SELECT r, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
                 sum(CASE WHEN ok THEN length(regexp_replace(line, '{_WHITE}+', '', 'g')) ELSE 0 END)::BIGINT AS left_chars
          FROM keep GROUP BY r),
f AS (SELECT d.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, n_dup_lines,
             coalesce(hit.n, 0)::BIGINT AS n_repeat_words, left_chars
      FROM d JOIN w USING (r) JOIN lines USING (r) LEFT JOIN hit USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND left_chars >= {MIN_LEFT} * word_chars AS kept, left_chars FROM b
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAM = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
        FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, dw.n, i, item FROM dw JOIN win ON dw.s = win.s AND dw.n = win.n),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS s FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

LINE_DEDUP = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^{_WHITE}+', ''), '{_WHITE}+$', ''),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, min(doc_id) AS holder FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
f AS (SELECT k.r, k.pos, k.line, h.key IS NOT NULL AND k.doc_id > h.holder AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT d.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f JOIN d USING (r) GROUP BY d.r, d.doc_id
"""

_MARKS = "|".join([r"<\|", *(c.replace("[", r"\[").replace("]", r"\]") for c in CONTROLS)])


def _extra(column: str) -> str:
    """Characters that escaping adds to a text: one per backslash and per control string."""
    return rf"(length({column}) - length(replace({column}, chr(92), '')) + len(regexp_extract_all({column}, '{_MARKS}')))"


CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER w AS i, coalesce(role = lag(role) OVER w, false) AS joins,
             length(text) + {_extra("text")} AS text_chars, length(role) + {_extra("role")} AS role_chars
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
       sum(text_chars + CASE WHEN joins THEN {len(TURN)} ELSE role_chars + {len(START + BODY + END)} END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_P = "(1 + 1000000000::HUGEINT * ({n} + 2) // ({total} + 2 * {v}))::BIGINT"

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({_LOW}, '{_TERM}') AS t FROM documents),
x AS (SELECT r, lang, source, unnest(t) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM x GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM x SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_P.format(n="coalesce(c.n, 0)", total="g.total", v="l.v")} AS p,
             {_P.format(n="k.lang_n", total="l.lang_total", v="l.v")} AS q
      FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(f), 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source AS sa, y.source AS sb, (x.p - y.p) * (x.p - y.p) // (x.p + y.p) AS f
                     FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term) o ON o.lang = a.lang AND o.sa = a.source AND o.sb = b.source
          GROUP BY ALL)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM s WHERE n > 0 AND p > q
      UNION ALL SELECT lang, source, 'pair', item, value FROM pairs)
QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""

COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOW}, '[.,;:!?\x0A-\x0D]')) AS s FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f1 AS MATERIALIZED (SELECT lang, x, count(*) AS a FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, x, y, count(*) AS a FROM (SELECT lang, unnest(w[:-2]) AS x, unnest(w[2:]) AS y FROM w WHERE len(w) > 1) GROUP BY ALL HAVING a >= {MIN_COUNT}),
f3 AS MATERIALIZED (SELECT lang, x, y, z, count(*) AS a FROM (SELECT lang, unnest(w[:-3]) AS x, unnest(w[2:-2]) AS y, unnest(w[3:]) AS z FROM w WHERE len(w) > 2)
                    GROUP BY ALL HAVING a >= {MIN_COUNT}),
cuts AS (SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.a, 1 AS j, l.a AS l, r.a AS r FROM f2
         JOIN f1 l ON l.lang = f2.lang AND l.x = f2.x JOIN f1 r ON r.lang = f2.lang AND r.x = f2.y
         LEFT JOIN (SELECT lang, x, y, max(a) AS a FROM (SELECT lang, x, y, a FROM f3 UNION ALL SELECT lang, y, z, a FROM f3) GROUP BY ALL) o
           ON o.lang = f2.lang AND o.x = f2.x AND o.y = f2.y WHERE o.a IS NULL OR 100 * o.a < {COVER_PERCENT} * f2.a
         UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.a, 1, l.a, r.a FROM f3
         JOIN f1 l ON l.lang = f3.lang AND l.x = f3.x JOIN f2 r ON r.lang = f3.lang AND r.x = f3.y AND r.y = f3.z
         UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.a, 2, l.a, r.a FROM f3
         JOIN f2 l ON l.lang = f3.lang AND l.x = f3.x AND l.y = f3.y JOIN f1 r ON r.lang = f3.lang AND r.x = f3.z),
best AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts
         QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase))::INTEGER AS rank, phrase, a, l, r, n, score
FROM best JOIN n USING (lang) QUALIFY rank <= {TOP}
"""
