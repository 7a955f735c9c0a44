"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Two documents share a shingle before they can link, so pairs come from equal shingles.
OP8 = f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id,
         CASE WHEN len(words) = 0 THEN []
              WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
              ELSE list_distinct([array_to_string(words[i:i + 3], ' ')
                                  FOR i IN generate_series(1, len(words) - 3)]) END AS grams
  FROM w),
classes AS MATERIALIZED (
  SELECT list_sort(grams) AS grams, min(doc_id) AS class_id, len(any_value(grams)) AS n
  FROM sets GROUP BY list_sort(grams)),
member AS MATERIALIZED (
  SELECT s.doc_id, len(s.grams) AS n, CASE WHEN n = 0 THEN s.doc_id ELSE c.class_id END AS class_id
  FROM sets s JOIN classes c ON list_sort(s.grams) = c.grams),
posted AS MATERIALIZED (SELECT class_id, n, unnest(grams) AS gram FROM classes WHERE n > 0),
shared AS (
  SELECT a.class_id AS a, b.class_id AS b, a.n AS na, b.n AS nb, count(*) AS n_both
  FROM posted a JOIN posted b ON a.gram = b.gram AND a.class_id < b.class_id
  GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM shared WHERE 100 * n_both >= 85 * (na + nb - n_both)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
root AS (SELECT a, least(a, min(b)) AS root FROM reach GROUP BY a)
SELECT m.doc_id, CAST(m.n AS BIGINT) AS n_shingles,
       coalesce(r.root, m.class_id) AS component_id, m.class_id
FROM member m LEFT JOIN root r ON r.a = m.class_id
"""

OP1 = """
WITH d AS MATERIALIZED (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][place % 3 + 1] AS weight FROM per),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER earlier, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS DOUBLE) AS level
  FROM weighed
  WINDOW earlier AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS MATERIALIZED (
  SELECT source, source_size,
         CASE WHEN level * weight > 3 * source_size THEN CAST(3 * source_size AS DOUBLE)
              ELSE weight * (SELECT level FROM levels WHERE level * weight <= 3 * source_size
                             ORDER BY source_size / weight, place LIMIT 1) END AS target
  FROM levels),
sized AS MATERIALIZED (SELECT *, greatest(1, length(ltrim(bin(size), '0'))) AS importance FROM d),
classes AS (SELECT source, importance, sum(size) AS words FROM sized GROUP BY ALL),
solved AS (
  SELECT c.source, c.importance, c.words,
         (g.target - 3 * coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY importance DESC
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(words * importance) OVER (PARTITION BY c.source ORDER BY importance
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
  FROM classes c JOIN goal g ON c.source IS NOT DISTINCT FROM g.source),
factor AS (
  SELECT source, coalesce(arg_max(c, importance) FILTER (words > 0 AND c * importance <= 3), 1e300) AS c
  FROM solved GROUP BY source),
expected AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target, least(3.0::DOUBLE, f.c * s.importance) AS e,
         (CAST('0x' || substr(md5('17|' || coalesce(CAST(s.doc_id AS VARCHAR), '') || '|' || CAST(s.size AS VARCHAR)), 1, 13)
               AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
  JOIN factor f ON s.source IS NOT DISTINCT FROM f.source),
drawn AS (
  SELECT *, CASE WHEN size > 0 THEN CAST(floor(e + 1e-9) AS BIGINT) ELSE 0 END AS whole,
         CASE WHEN size > 0 AND e - floor(e + 1e-9) > 1e-9 THEN e - floor(e + 1e-9) ELSE 0.0::DOUBLE END AS chance
  FROM expected),
ranked AS (
  SELECT *, (u / (1 - u)) / (chance / (1 - chance)) AS rank,
         target - sum(whole * size) OVER (PARTITION BY source) AS budget FROM drawn),
filled AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ends
  FROM ranked WHERE chance > 0),
copies AS (
  SELECT *, whole + CASE WHEN ends + ends - size <= 2 * budget THEN 1 ELSE 0 END AS copies FROM filled
  UNION ALL SELECT *, NULL AS ends, whole AS copies FROM ranked WHERE chance = 0)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies
FROM copies
"""

OP3 = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")},
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")},
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
grams AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(words), 10) AS n,
         unnest([array_to_string(words[i:i + least(len(words), 10) - 1], ' ')
                 FOR i IN generate_series(1, len(words) - least(len(words), 10) + 1)]) AS gram
  FROM b WHERE len(words) > 0),
lengths AS (SELECT DISTINCT n FROM grams),
places AS (SELECT doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i FROM d, lengths WHERE len(words) >= n),
hits AS MATERIALIZED (
  SELECT p.doc_id, p.i, p.n, g.item_id
  FROM places p JOIN grams g ON g.n = p.n AND g.gram = array_to_string(p.words[p.i:p.i + p.n - 1], ' ')),
covered AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS w FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit,
       coalesce(f.n_items, 0) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
"""

OP2 = """
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS key FROM pages),
often AS (
  SELECT key, max(page_id) AS first_id FROM p WHERE octet_length(payload) >= 1000 GROUP BY key HAVING count(*) > 1)
SELECT p.page_id, CAST(octet_length(p.payload) AS BIGINT) AS payload_bytes, p.key AS payload_digest,
       CASE WHEN o.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN o.first_id <> p.page_id THEN o.first_id END AS refers_to,
       p.url, CAST(NULL AS VARCHAR) AS problem
FROM p LEFT JOIN often o ON o.key = p.key
"""

#: Unsigned crc32 of the UTF-8 bytes of {text}; ``crc_table`` holds the step of each byte.
_CRC_TABLE = """
crc_table AS MATERIALIZED (
  SELECT [list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b)
          FOR b IN range(256)] AS step)"""
_CRC = """xor(4294967295, list_reduce(
    [CAST('0x' || substr(hex(encode({text})), 2 * i - 1, 2) AS BIGINT) FOR i IN range(1, octet_length(encode({text})) + 1)],
    lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295))"""

OP9 = f"""
WITH {_CRC_TABLE},
o AS MATERIALIZED (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place
  FROM conversations),
cuts AS MATERIALIZED (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN n ELSE {_CRC.format(text="CAST(conv_id AS VARCHAR)")} % (n + 1) END AS cut
  FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id), crc_table),
t AS MATERIALIZED (
  SELECT conv_id AS pair_id, 0 AS side, role, text, place FROM o
  UNION ALL
  SELECT o.conv_id, 1, role, text, place FROM o JOIN cuts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id WHERE place < cut
  UNION ALL
  SELECT c.conv_id, 1, role, text, row_number() OVER (PARTITION BY c.conv_id ORDER BY place) - 1 + least(cut, n)
  FROM o JOIN cuts c ON xor(o.conv_id, 1) = c.conv_id
  JOIN (SELECT conv_id AS own, count(*) AS n FROM o GROUP BY conv_id) ON own = c.conv_id WHERE place >= cut),
alike AS (
  SELECT a.pair_id, a.place FROM t a JOIN t b ON a.pair_id IS NOT DISTINCT FROM b.pair_id AND a.place = b.place
  WHERE a.side = 0 AND b.side = 1 AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text),
prefix AS (
  SELECT t.pair_id,
         coalesce(min(t.place) FILTER (a.place IS NULL), count(DISTINCT t.place)) AS n_prompt
  FROM t LEFT JOIN alike a ON a.pair_id IS NOT DISTINCT FROM t.pair_id AND a.place = t.place GROUP BY t.pair_id),
shown AS (
  SELECT t.*, p.n_prompt, '<|im_start|>' || coalesce(role, '') || chr(10) AS head,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS body
  FROM t JOIN prefix p ON p.pair_id IS NOT DISTINCT FROM t.pair_id),
measured AS (
  SELECT *, sum(CASE WHEN place >= n_prompt THEN length(body) ELSE 0 END)
              OVER (PARTITION BY pair_id, side ORDER BY place) AS ends FROM shown)
SELECT pair_id, CAST(n_prompt AS BIGINT) AS n_prompt,
       coalesce(string_agg(body, '' ORDER BY place) FILTER (side = 0 AND place < n_prompt), '') AS prompt,
       coalesce(string_agg(body, '' ORDER BY place) FILTER (side = 0 AND place >= n_prompt), '') AS chosen,
       coalesce(string_agg(body, '' ORDER BY place) FILTER (side = 1 AND place >= n_prompt), '') AS rejected,
       coalesce(string_agg((ends - length(body) + length(head)) || '-' || ends, ',' ORDER BY place)
                FILTER (side = 0 AND place >= n_prompt AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg((ends - length(body) + length(head)) || '-' || ends, ',' ORDER BY place)
                FILTER (side = 1 AND place >= n_prompt AND role = 'assistant'), '') AS rejected_spans
FROM measured GROUP BY pair_id, n_prompt
"""

OP11 = f"""
WITH {_CRC_TABLE},
w AS MATERIALIZED (
  SELECT 0 AS side, doc_id AS id, row_number() OVER () AS place,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
  UNION ALL
  SELECT 1, NULL, NULL, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')
  FROM benchmark),
posted AS MATERIALIZED (SELECT side, place, word, count(*) AS n FROM (SELECT side, place, unnest(words) AS word FROM w) GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT word, {_CRC.format(text="word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM posted), crc_table),
per AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t
  FROM posted JOIN hashed USING (word) GROUP BY bucket),
gains AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln(
           CAST((t + 1) * ((SELECT sum(s) FROM per) + 10000) AS DOUBLE)
           / CAST((s + 1) * ((SELECT sum(t) FROM per) + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM per),
sums AS (
  SELECT place, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total
  FROM posted JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY place),
scored AS (
  SELECT w.id AS doc_id, coalesce(n_features, 0) AS n_features,
         CAST(coalesce(floor(total::DOUBLE / n_features), 0) AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('2024:' || coalesce(CAST(w.id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE AS h
  FROM w LEFT JOIN sums USING (place) WHERE side = 0),
drawn AS (
  SELECT doc_id, n_features, weight,
         weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
         count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS most
  FROM drawn)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= most THEN place END AS rank FROM ordered
"""


def _field(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join([*map(_field, ('doc_id', 'source', 'lang', 'n_chars')), _field(text)])})"


#: Trees level by level; `up` is the run a node belongs to, in the upper tree from the subroots on.
OP12 = f"""
WITH RECURSIVE {_CRC_TABLE},
leaves AS MATERIALIZED (
  SELECT doc_id, lang, {_leaf("text")} AS leaf,
         CASE WHEN {_CRC.format(text="CAST(doc_id AS VARCHAR)")} % 3 = 0
              THEN {_leaf(_LOWER.format("text"))} END AS other
  FROM documents, crc_table),
groups AS (
  SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree, count(*) AS n FROM leaves GROUP BY lang),
bottom AS MATERIALIZED (
  SELECT l.*, g.tree, g.n, row_number() OVER (PARTITION BY g.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM leaves l JOIN groups g ON l.lang IS NOT DISTINCT FROM g.lang),
grown(tree, level, i, n, digest) AS (
  SELECT tree, 0, i, n, leaf FROM bottom
  UNION ALL
  SELECT tree, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i))
  FROM grown WHERE n > 1 GROUP BY tree, level + 1, i // 8, (n + 7) // 8),
tops AS MATERIALIZED (SELECT tree, level, digest FROM grown WHERE n = 1),
upper(level, i, n, digest) AS (
  SELECT 0, tree, (SELECT count(*) FROM tops), digest FROM tops
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i))
  FROM upper WHERE n > 1 GROUP BY level + 1, i // 8, (n + 7) // 8),
root AS (SELECT digest FROM upper WHERE n = 1),
nodes AS MATERIALIZED (
  SELECT tree, level, i, n, digest FROM grown WHERE n > 1
  UNION ALL
  SELECT -1, level, i, n, digest FROM upper WHERE n > 1),
sides AS MATERIALIZED (
  SELECT a.tree, a.level, a.i,
         coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.i // 8 = b.i // 8
  GROUP BY a.tree, a.level, a.i),
walk(doc_id, leaf, own, tree, level, i, proof, folded) AS (
  SELECT doc_id, leaf, tree, tree, 0, i, '', coalesce(other, leaf) FROM bottom
  UNION ALL
  SELECT w.doc_id, w.leaf, w.own, s.tree, s.level + 1, s.i // 8, w.proof || s.before || s.after,
         sha256(s.before || w.folded || s.after)
  FROM (SELECT w.*, t.level IS NOT NULL AND w.tree >= 0 AS arrived
        FROM walk w LEFT JOIN tops t ON t.tree = w.tree AND t.level = w.level) w
  JOIN sides s ON s.tree = CASE WHEN arrived THEN -1 ELSE w.tree END
              AND s.level = CASE WHEN arrived THEN 0 ELSE w.level END
              AND s.i = CASE WHEN arrived THEN w.tree ELSE w.i END),
longest AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, leaf, own ORDER BY tree >= 0, level DESC) AS place FROM walk)
SELECT l.doc_id, l.leaf, t.digest AS subroot, root.digest AS root, sha256(l.proof) AS proof_sha256,
       l.folded AS folded_root, l.folded = root.digest AS verified
FROM longest l JOIN tops t ON t.tree = l.own, root WHERE place = 1
"""


def _found(kind: str, order: int, pattern: str, least: int, head: str = "") -> str:
    """Matches of a pattern by place: texts between matches and matches, one after the other."""
    pattern, head = pattern.replace("'", "''"), head.replace("'", "''")
    body = f"length(hit) - length(regexp_extract(hit, '^{head}'))" if head else "length(hit)"
    return f"""
  SELECT place, '{kind}' AS kind, {order} AS ord, "start", "start" + length(hit) AS "end" FROM (
    SELECT place, hits[k] AS hit,
           CAST(list_sum([length(x) FOR x IN rest[1:k]]) + coalesce(list_sum([length(x) FOR x IN hits[1:k - 1]]), 0) AS BIGINT) AS "start"
    FROM (SELECT place, hits, rest, unnest(generate_series(1, len(hits))) AS k
          FROM (SELECT place, regexp_extract_all(text, '{head}{pattern}') AS hits,
                       regexp_split_to_array(text, '{head}{pattern}') AS rest FROM d)))
  WHERE {body} >= {least}"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_KINDS = " UNION ALL ".join([
    _found("assign", 1, "[A-Za-z0-9+/_.=-]+", 12, f"""(?:{_NAMES})["']?\\x20*[:=]\\x20*["']?"""),
    _found("access", 2, "AKIA[A-Z0-9]+", 18),
    _found("hex", 3, "[0-9a-f]+", 16),
    _found("github", 4, "gh[pousr]_[A-Za-z0-9]+", 40),
    _found("slack", 5, "xox[abprs]-[A-Za-z0-9-]+", 15),
    _found("jwt", 6, "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 30),
    _found("pem", 7, "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 1),
])

OP13 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS place, coalesce(text, '') AS text FROM documents),
found AS MATERIALIZED ({_KINDS}),
named AS (SELECT *, kind || ':' || "start" || ':' || "end" AS span FROM found)
SELECT any_value(d.doc_id) AS doc_id, count(*) FILTER (ord = 1) AS n_assign, count(*) FILTER (ord = 2) AS n_access,
       count(*) FILTER (ord = 3) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY "start", ord) FILTER (ord <= 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY "start", ord), '') AS spans
FROM d LEFT JOIN named USING (place) GROUP BY place
"""
