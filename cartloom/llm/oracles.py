"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents
), word AS (
  SELECT r, doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs
), coded AS (
  SELECT r, doc_id, i, word, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS code FROM word
), gram AS (
  SELECT r, doc_id, code % 1048576 AS b FROM coded
  UNION ALL
  SELECT a.r, a.doc_id, 1048576 + (a.code * 1000003 + z.code) % 65536 FROM coded a JOIN coded z ON a.r = z.r AND z.i = a.i + 1
), lab AS (
  SELECT doc_id, min(quality) AS q, max(toxic) AS t FROM labels
  WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id
), role AS (
  SELECT doc_id, CASE WHEN q = 1 AND t = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END
                      WHEN doc_id % 5 = 0 AND q = 0 THEN 3 WHEN doc_id % 5 = 0 THEN 4 ELSE 0 END AS role FROM lab
), cnt AS (
  SELECT b, b >= 1048576 AS pair, CASE WHEN b >= 1048576 THEN 65536 ELSE 1048576 END AS size,
         count(*) AS raw, count(*) FILTER (role = 1) AS trusted FROM gram LEFT JOIN role USING (doc_id) GROUP BY b
), weight AS (
  SELECT b, CAST(floor((ln((trusted + 1) / (sum(trusted) OVER k + size)) - ln((raw + 1) / (sum(raw) OVER k + size)))
                       * 1000000 + 0.5) AS BIGINT) AS w FROM cnt WINDOW k AS (PARTITION BY pair)
), score AS (
  SELECT r, CAST(sum(w) AS BIGINT) AS score_sum, count(*) AS n_grams FROM gram JOIN weight USING (b) GROUP BY r
), low AS (
  SELECT r, CAST(min(s) AS BIGINT) AS low_sum FROM (
    SELECT r, w + lead(w) OVER (PARTITION BY r ORDER BY i) AS s FROM coded JOIN weight ON b = code % 1048576
  ) GROUP BY r
), five AS (
  SELECT r, i, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w || ' ' || lead(word, 3) OVER w
               || ' ' || lead(word, 4) OVER w AS five FROM word WINDOW w AS (PARTITION BY r ORDER BY i)
), win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM five WHERE five IS NOT NULL
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT r, i, unnest(range(5)) AS k FROM win WHERE n >= 2) GROUP BY r
), line AS (
  SELECT r, line, row_number() OVER (PARTITION BY r, line) AS nth
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (SELECT r, count(*) AS n_dup_lines FROM line WHERE nth > 1 GROUP BY r),
chars AS (SELECT r, CAST(sum(length(word)) AS BIGINT) AS word_chars FROM word GROUP BY r),
base AS (
  SELECT d.r, d.doc_id, len(w) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(score_sum, 0) AS score_sum, coalesce(n_grams, 0) AS n_grams,
         coalesce(low_sum, 0) AS low_sum
  FROM docs d LEFT JOIN chars USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN score USING (r) LEFT JOIN low USING (r)
), judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
held AS (
  SELECT trunc(score_sum / (n_grams * 10000)) AS s, count(*) FILTER (role = 2) AS good, count(*) FILTER (role = 3) AS bad
  FROM judged JOIN role USING (doc_id) WHERE role IN (2, 3) AND NOT base_failed GROUP BY 1
), gain AS (
  SELECT s, (sum(bad) OVER w - bad) * (SELECT sum(good) FROM held) - 20 * (sum(good) OVER w - good) * (SELECT sum(bad) FROM held) AS g
  FROM held WINDOW w AS (ORDER BY s)
), cut AS (
  SELECT CASE WHEN (SELECT coalesce(sum(good), 0) FROM held) = 0 OR (SELECT coalesce(sum(bad), 0) FROM held) = 0 THEN -100000
    ELSE (SELECT CAST(s AS BIGINT) * 10000 - abs(CAST(s AS BIGINT)) * 2500 FROM gain ORDER BY g DESC, s LIMIT 1) END AS t
), held_low AS (
  SELECT trunc(low_sum / 20000) AS s, count(*) FILTER (role = 2) AS good, count(*) FILTER (role = 4) AS bad
  FROM judged JOIN role USING (doc_id) WHERE role IN (2, 4) AND NOT base_failed GROUP BY 1
), gain_low AS (
  SELECT s, (sum(bad) OVER w - bad) * (SELECT sum(good) FROM held_low) - 20 * (sum(good) OVER w - good) * (SELECT sum(bad) FROM held_low) AS g
  FROM held_low WINDOW w AS (ORDER BY s)
), cut_low AS (
  SELECT CASE WHEN (SELECT coalesce(sum(good), 0) FROM held_low) = 0 OR (SELECT coalesce(sum(bad), 0) FROM held_low) = 0
    THEN -(1::BIGINT << 40) ELSE (SELECT CAST(s AS BIGINT) * 10000 FROM gain_low ORDER BY g DESC, s LIMIT 1) END AS t
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND score_sum >= (SELECT t FROM cut) * n_grams AND low_sum >= (SELECT t FROM cut_low) * 2 AS kept
FROM judged
"""

OP6 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
line AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM docs),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACES})")} AS key FROM line),
often AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 AND doc_id IS NOT NULL
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (SELECT k.*, last IS NOT NULL AND doc_id <> last AS gone FROM keyed k LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT coalesce(gone, false)), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


def _strength(level: str) -> str:
    return f"""(SELECT CASE WHEN coalesce(n, 0) = 0 OR k < 2 OR bad = 0 OR bad = n OR room <= 0 OR spread <= 0 THEN 1000.0
      ELSE least(1000.0, greatest(1.0, (1 - spread / room) / (spread / room))) END
    FROM (SELECT n, k, bad, (weighted - n * (bad / n) * (bad / n)) / ((bad / n) * (1 - bad / n)) - (k - 1) AS spread,
                 n - squares / n - (k - 1) AS room
          FROM (SELECT count(*) AS k, sum(n) AS n, sum(bad) AS bad, sum(n * n) AS squares, sum(bad * bad / n) AS weighted
                FROM {level} WHERE n > 0)))"""


_TWO = "'ac.uk', 'co.in', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'com.au', 'com.br', 'com.cn', 'gov.uk', 'org.uk'"

OP7 = rf"""
WITH parsed AS (
  SELECT page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages
), bad AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality = 1 THEN 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), host AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
         array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS two
  FROM parsed LEFT JOIN bad USING (page_id) GROUP BY host
), hosts AS (
  SELECT host, n, bad, CASE WHEN two IN ({_TWO}) THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') ELSE two END AS domain,
         CASE WHEN two IN ({_TWO}) THEN two ELSE string_split(host, '.')[-1] END AS suffix FROM host
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
s AS (SELECT {_strength("suffixes")} AS s1, {_strength("domains")} AS s2, {_strength("hosts")} AS s3,
             (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) FROM suffixes) AS base),
r1 AS (SELECT suffix, (bad + base * s1) / (n + s1) AS rate FROM suffixes, s),
r2 AS (SELECT domain, (bad + rate * s2) / (n + s2) AS rate FROM domains JOIN r1 USING (suffix), s),
r3 AS (SELECT host, (bad + rate * s3) / (n + s3) AS rate, n + s3 AS strength FROM hosts JOIN r2 USING (domain), s),
judged AS (
  SELECT page_id, host, path, rate - 1.645 * sqrt(rate * (1 - rate) / (strength + 1)) AS bound,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM parsed JOIN r3 USING (host)
)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'example.com/de/' THEN 'block'
                 WHEN 'net/' THEN 'block' ELSE CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END END AS verdict
FROM judged
"""

OP10 = rf"""
WITH sized AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sums),
levels AS (
  SELECT *, source_size * 2 AS cap,
         (CAST((SELECT sum(source_size) FROM sums) AS DOUBLE) * 1.5
          - coalesce(sum(source_size * 2) OVER w, 0)) / ((SELECT sum(weight) FROM ranked) - coalesce(sum(weight) OVER w, 0)) AS level
  FROM ranked
  WINDOW w AS (ORDER BY source_size * 2 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), reached AS (SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, level LIMIT 1),
goal AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM reached), cap) * weight) AS target FROM levels
), rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM goal)
SELECT s.doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT)
                            < (rate - floor(rate)) * 4294967296 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
"""

OP12 = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), word AS (SELECT lang, p, unnest(w) AS word, unnest(range(len(w))) AS i FROM piece),
total AS (SELECT lang, count(*) AS n FROM word GROUP BY lang),
part AS (
  SELECT lang, m, CASE m WHEN 1 THEN word ELSE array_to_string([word, w1, w2, w3, w4][1:m], ' ') END AS phrase
  FROM (SELECT lang, word, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3,
               lead(word, 4) OVER o AS w4, count(*) OVER (PARTITION BY p) - i AS room FROM word WINDOW o AS (PARTITION BY p ORDER BY i)),
       (SELECT unnest(range(1, 6)) AS m) WHERE room >= m
), often AS (SELECT lang, m, phrase, count(*) AS f FROM part GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, phrase, m, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first,
         array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM often, (SELECT unnest(range(1, 5)) AS k) WHERE k < m
), scored AS (
  SELECT c.*, x.f AS l, y.f AS r, n, (1000 * a::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM cuts c JOIN often x ON c.lang = x.lang AND first = x.phrase JOIN often y ON c.lang = y.lang AND rest = y.phrase
  JOIN total t ON c.lang = t.lang
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM often o WHERE o.lang = b.lang AND o.m > b.m AND 100 * o.f >= 100 * b.a
      AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def _leaf(n_chars: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: CAST(ascii(c) AS BIGINT))), lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)),
  lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)))"""

#: The trees are built level by level; level by level a row takes its sibling and folds its changed leaf.
OP13 = rf"""
WITH RECURSIVE leaf AS (
  SELECT row_number() OVER () AS r, doc_id, lang, {_leaf("n_chars")} AS leaf,
         CASE WHEN ({_CRC}) % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS claimed FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf
), node AS (
  SELECT lang, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2
  FROM node WHERE n > 1 GROUP BY lang, level, pos // 2
), subroot AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM node WHERE n = 1),
crown AS (
  SELECT 0 AS level, pos, subroot AS h, count(*) OVER () AS n FROM subroot
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2
  FROM crown WHERE n > 1 GROUP BY level, pos // 2
), up AS (
  SELECT r, lang, 0 AS level, pos, claimed AS h, '' AS siblings FROM placed
  UNION ALL
  SELECT r, u.lang, u.level + 1, u.pos // 2,
         sha256(CASE WHEN s.h IS NULL THEN u.h WHEN u.pos % 2 = 1 THEN s.h || u.h ELSE u.h || s.h END), siblings || coalesce(s.h, '')
  FROM up u JOIN node o ON o.lang IS NOT DISTINCT FROM u.lang AND o.level = u.level AND o.pos = u.pos AND o.n > 1
  LEFT JOIN node s ON s.lang IS NOT DISTINCT FROM u.lang AND s.level = u.level AND s.pos = xor(u.pos, 1)
), low AS (
  SELECT r, u.lang, h, siblings FROM up u
  JOIN (SELECT lang, max(level) AS top FROM node GROUP BY lang) t ON t.lang IS NOT DISTINCT FROM u.lang AND u.level = top
), high AS (
  SELECT r, 0 AS level, s.pos, h, siblings FROM low l JOIN subroot s ON s.lang IS NOT DISTINCT FROM l.lang
  UNION ALL
  SELECT r, u.level + 1, u.pos // 2,
         sha256(CASE WHEN s.h IS NULL THEN u.h WHEN u.pos % 2 = 1 THEN s.h || u.h ELSE u.h || s.h END), siblings || coalesce(s.h, '')
  FROM high u JOIN crown o ON o.level = u.level AND o.pos = u.pos AND o.n > 1
  LEFT JOIN crown s ON s.level = u.level AND s.pos = xor(u.pos, 1)
)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, h.h AS folded_root, h.h = root AS verified
FROM placed p JOIN subroot s ON s.lang IS NOT DISTINCT FROM p.lang
JOIN high h USING (r) JOIN (SELECT level AS top, h AS root FROM crown WHERE n = 1) ON h.level = top
"""

ORACLES = {
    "op1_quality_rules": OP1,
    "op6_line_dedup": OP6,
    "op7_url_filters": OP7,
    "op10_mixing": OP10,
    "op12_phrase_collocations": OP12,
    "op13_merkle_manifest": OP13,
}
