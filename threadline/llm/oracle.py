"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from collections.abc import Iterable

from .license_scan import HINT, IN_BRACKETS, MARKS, NO_NAME, SPDX, SPDX_IDS, SUFFIX, TEMPLATES, longest

OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw))
), hits AS (
  SELECT doc_id, item_id, i, dw.size FROM dw JOIN bw USING (size, win)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), wins AS (
  SELECT row, i, array_to_string(w[i : i + 4], ' ') AS win FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT row, i FROM wins JOIN (SELECT row, win FROM wins GROUP BY row, win HAVING count(*) > 1) USING (row, win)
), covered AS (
  SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY row
), c AS (
  SELECT doc_id, host, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (row)
), f AS (
  SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_symbols > 0.25 * n_words AS f1, len(lines) - len(list_distinct(lines)) > 0.5 * len(lines) AS f2
  FROM c
), h AS (
  SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS n0, count(*) FILTER (f1) AS n1, count(*) FILTER (f2) AS n2 FROM f GROUP BY host
), prior AS (
  SELECT count(*) - 1 AS k, sum(n) AS m, sum(n * n)::DOUBLE AS q, sum(n0) / sum(n) AS m0, sum(n0 * n0 / n) AS y0, sum(n1) / sum(n) AS m1, sum(n1 * n1 / n) AS y1, sum(n2) / sum(n) AS m2, sum(n2 * n2 / n) AS y2 FROM h
), e AS (
  SELECT *, m - q / m - k AS room, 3 * sqrt(2 * k) AS chance, CASE WHEN m0 > 0 AND m0 < 1 THEN (y0 - m0 * m0 * m) / (m0 * (1 - m0)) - k END AS e0,
         CASE WHEN m1 > 0 AND m1 < 1 THEN (y1 - m1 * m1 * m) / (m1 * (1 - m1)) - k END AS e1, CASE WHEN m2 > 0 AND m2 < 1 THEN (y2 - m2 * m2 * m) / (m2 * (1 - m2)) - k END AS e2
  FROM prior
), s AS (
  SELECT *, CASE WHEN k > 0 AND room > 0 AND e0 > chance THEN greatest(room / e0 - 1, 1) END AS w0, CASE WHEN k > 0 AND room > 0 AND e1 > chance THEN greatest(room / e1 - 1, 1) END AS w1,
         CASE WHEN k > 0 AND room > 0 AND e2 > chance THEN greatest(room / e2 - 1, 1) END AS w2
  FROM e
), r AS (
  SELECT host, (n0 + m0 * w0) / (n + w0) AS r0, (n1 + m1 * w1) / (n + w1) AS r1, (n2 + m2 * w2) / (n + w2) AS r2, m1, m2 FROM h, s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR coalesce(greatest(r0, r1, r2) > 0.5, false) OR (f1 AND NOT coalesce(r1 >= greatest(1.25 * m1, 0.05), false)) OR (f2 AND NOT coalesce(r2 >= greatest(1.25 * m2, 0.05), false))) AS kept
FROM f JOIN r ON f.host IS NOT DISTINCT FROM r.host
"""

_TEMPLATE_ROWS = ", ".join(f"({i}, '{name}', '{text.lower()}')" for i, (name, text) in enumerate((name, text) for name, texts in TEMPLATES.items() for text in texts))



def _listed(values: Iterable[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


OP4_SQL = r"""
WITH t AS (
  SELECT tid, name, regexp_extract_all(text, '[a-z0-9]+(?:\.[0-9]+)*') AS terms FROM (VALUES __TEMPLATES__) AS v(tid, name, text)
), d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
         CASE WHEN doc_id % 20 = 0 THEN coalesce(source, '') || '/LICENSE'
              WHEN doc_id % 10 = 0 THEN concat_ws('/', coalesce(source, ''), (doc_id // 10) % 7, 'LICENSE')
              ELSE concat_ws('/', coalesce(source, ''), (doc_id // 10) % 7, (doc_id // 70) % 7, doc_id || '.txt') END AS path
  FROM documents
), each AS (
  SELECT row, string_split(text, chr(10)) AS lines, list_transform(string_split(text, chr(10)), lambda x: regexp_extract_all(lower(x), '[a-z0-9]+(?:\.[0-9]+)*')) AS terms
  FROM d WHERE regexp_matches(text, '__HINT__')
), l AS (
  SELECT DISTINCT row, own, w FROM (
    SELECT row, lines[i] AS line, terms[i] AS own, flatten(terms[i : i + __REACH__])[1 : len(terms[i]) + __REACH__] AS w FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM each)
  ) WHERE regexp_matches(line, '__HINT__')
), ln AS (SELECT row_number() OVER () AS id, row, own, w FROM l),
total AS (SELECT count(*) AS n FROM ln),
vocabulary AS (SELECT DISTINCT unnest(terms) AS term FROM t),
df AS (SELECT term, count(o.id) AS df FROM vocabulary LEFT JOIN (SELECT DISTINCT id, unnest(own) AS term FROM ln) o USING (term) GROUP BY term),
idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM df, total),
windows AS (
  SELECT id, tid, s, w[s : s + len(terms) - 1] AS win
  FROM (SELECT id, tid, own, w, terms, unnest(range(1, len(own) + 1)) AS s FROM ln, t)
  WHERE (s = 1 OR own[s] = terms[1]) AND list_sort(list_distinct(list_filter(w[s : s + len(terms) - 1], lambda x: x IN (__MARKS__)))) = list_sort(list_distinct(list_filter(terms, lambda x: x IN (__MARKS__))))
),
wt AS (SELECT id, tid, s, term, count(*) AS tf FROM (SELECT id, tid, s, unnest(win) AS term FROM windows) GROUP BY ALL),
lw AS (SELECT id, tid, s, term, tf * coalesce(idf, (SELECT avg(idf) FROM idf)) AS w FROM wt LEFT JOIN idf USING (term)),
tw AS (SELECT tid, name, term, tf * idf AS w FROM (SELECT tid, name, term, count(*) AS tf FROM (SELECT tid, name, unnest(terms) AS term FROM t) GROUP BY ALL) JOIN idf USING (term)),
scored AS (
  SELECT id, any_value(name) AS name, round(sum(lw.w * tw.w) / (sqrt(any_value(a.q)) * any_value(b.s)), 4) AS score
  FROM lw JOIN tw USING (tid, term) JOIN (SELECT id, tid, s, sum(w * w) AS q FROM lw GROUP BY ALL) a USING (id, tid, s) JOIN (SELECT tid, sqrt(sum(w * w)) AS s FROM tw GROUP BY tid) b USING (tid)
  GROUP BY id, tid, lw.s
), own AS (
  SELECT row, doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, coalesce(spdx, c.licence) AS licence, CASE WHEN spdx IS NOT NULL THEN 1.0 ELSE c.score END AS score
  FROM (
    SELECT *, regexp_replace(list_filter(regexp_extract_all(text, '__SPDX__', 1), lambda e: len(list_filter(string_split(regexp_replace(e, '__NO_NAME__', ' ', 'g'), ' '),
      lambda x: lower(regexp_replace(x, '__SUFFIX__', '')) NOT IN ('', __SPDX_IDS__))) = 0)[1], '__IN_BRACKETS__', '\1') AS spdx FROM d
  ) LEFT JOIN (
    SELECT row, first(name ORDER BY score DESC, name) AS licence, max(score) AS score FROM scored JOIN ln USING (id) WHERE score >= 0.6 GROUP BY row
  ) c USING (row)
), files AS (
  SELECT dir, first(licence ORDER BY score DESC, licence) AS licence, max(score) AS score FROM own WHERE path LIKE '%/LICENSE' AND licence IS NOT NULL GROUP BY dir
), near AS (
  SELECT o.row, first(f.dir ORDER BY length(f.dir) DESC) AS folder, first(f.licence ORDER BY length(f.dir) DESC) AS licence, first(f.score ORDER BY length(f.dir) DESC) AS score
  FROM own o JOIN files f ON o.dir = f.dir OR starts_with(o.dir, f.dir || '/') WHERE o.licence IS NULL GROUP BY o.row
)
SELECT doc_id, path, coalesce(own.licence, near.licence) AS licence, coalesce(own.score, near.score) AS score,
       CASE WHEN own.licence IS NOT NULL THEN 'header' ELSE folder END AS origin
FROM own LEFT JOIN near USING (row)
""".replace("__TEMPLATES__", _TEMPLATE_ROWS).replace("__HINT__", HINT).replace("__SPDX__", SPDX).replace("__NO_NAME__", NO_NAME).replace("__SUFFIX__", SUFFIX).replace("__IN_BRACKETS__", IN_BRACKETS).replace("__MARKS__", _listed(MARKS)).replace("__SPDX_IDS__", _listed(x.lower() for x in SPDX_IDS)).replace("__REACH__", str(longest(TEMPLATES)))

OP5_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p
), listed AS (
  SELECT host FROM (
    SELECT p.host, sum(len(regexp_extract_all(html, '<a href='))) AS links, sum(len(regexp_extract_all(html, '<p[ >]'))) AS paragraphs
    FROM p JOIN pages USING (page_id) GROUP BY p.host
  ) WHERE links > paragraphs OR regexp_matches(host, 'ads-track|adult|casino|cheap-pills|free-bets|spam')
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

OP12_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM p),
r AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM r
"""

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)
), g AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS v(k))
), c AS (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM c WHERE k > 1 AND a >= 10),
cuts AS (
  SELECT o.lang, o.k, o.phrase, o.a, o.cut, x.a AS l, y.a AS r, (1000000::HUGEINT * o.a * o.a // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM (SELECT *, array_to_string(w[1 : cut], ' ') AS first, array_to_string(w[cut + 1 : k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM often)) o
  JOIN c x ON x.lang = o.lang AND x.phrase = o.first JOIN c y ON y.lang = o.lang AND y.phrase = o.rest
), worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM cuts) WHERE place = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM often WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM often WHERE k = 3
  ) GROUP BY ALL
), kept AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank
  FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) WHERE rank <= 2000
"""
