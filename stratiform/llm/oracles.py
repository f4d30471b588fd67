"""DuckDB SQL for the queries that SQL can express.

The others have none: token ids (1, 6) need a tokenizer library, byte windows (2) are too many rows, alignment (4) and
span positions (8) have no SQL form. Those are tested against brute force in tests/llm.
"""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"

OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
g AS (SELECT doc_id, pos, word || ' ' || lead(word) OVER p || ' ' || lead(word, 2) OVER p AS gram FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS dup FROM g),
c AS (SELECT doc_id, pos, dup OR coalesce(lag(dup) OVER p, false) OR coalesce(lag(dup, 2) OVER p, false) AS covered FROM r WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
n AS (SELECT doc_id, count(*) FILTER (covered) AS n_repeat_words FROM c GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, {_BLANK}) <> '') AS lines FROM d),
m AS (SELECT d.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
len(list_filter(words, lambda w: regexp_matches(w, '[^\x00-@\[-`{{-\x7F]'))) AS n_letter_words, len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets,
len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut_off, coalesce(list_max(map_values(list_histogram(words))), 0) AS top_word FROM d JOIN l ON d.doc_id = l.doc_id LEFT JOIN n ON d.doc_id = n.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
NOT base_failed AND NOT (10 * n_symbols > word_chars) AND NOT (word_chars > 25 * n_words OR word_chars < 2 * n_words) AND NOT (2 * n_dup_lines > n_lines)
AND NOT (100 * n_letter_words < 70 * n_words) AND NOT (10 * n_bullets > 9 * n_lines) AND NOT (10 * n_cut_off > 3 * n_lines) AND NOT (100 * top_word > 20 * n_words) AS kept FROM b
"""

OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_transform({_WORDS}, lambda w: {_LOWER.format("w")}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS token FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM s a JOIN s b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_have >= 75 * (a.n + b.n - both_have)),
reach AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
c AS (SELECT x, min(y) AS least FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(c.least, doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = doc_id
"""

OP7 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS win, w FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, win, md5(array_to_string(list_slice(w, win, win + 34), ' ')) AS h FROM s),
r AS (SELECT doc_id, win FROM (SELECT doc_id, win, count(*) OVER (PARTITION BY h) AS times FROM h) WHERE times > 1),
gone AS (SELECT DISTINCT doc_id, win + k AS pos, true AS is_gone FROM r, range(35) t(k)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
k AS (SELECT words.doc_id, count(*) AS n_words, count(is_gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY words.pos) FILTER (is_gone IS NULL), '') AS kept FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)
"""

OP9 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT *, 4 + length(role) + length(regexp_replace(role, '[^~<>\[\]]', '', 'g')) + 2 + length(text) + length(regexp_replace(text, '[^~<>\[\]]', '', 'g')) + 5 AS chars FROM t),
o AS (SELECT *, row_number() OVER w AS pos, sum(chars) OVER w AS upto, role = 'assistant' OR row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS example FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(upto) FILTER (example) AS BIGINT) AS formatted_chars FROM o GROUP BY conv_id
"""

OP10 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANK})")} AS key FROM l),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT doc_id, pos, line, coalesce(doc_id <> keeper, false) AS dropped FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""


#: The three assignments are alike: every part against all entries, then entries from the parts that chose them.
def _assign(name: str, books: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT vec_id, label, part, x, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM (SELECT p.*, b.entry, list_sum(list_transform(list_zip(p.x, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN {books} b USING (part)) GROUP BY ALL)"""


def _move(name: str, chosen: str, books: str) -> str:
    return f"""{name}_s AS (SELECT part, entry, pos, sum(v) AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM {chosen}) GROUP BY ALL),
{name}_l AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS y FROM {name}_s GROUP BY ALL),
{name} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(l.y, b.y) AS y FROM {books} b LEFT JOIN {name}_l l USING (part, entry))"""


OP11 = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, CAST(part AS INT) AS part, list_slice(x, part * (len(x) // 16) + 1, (part + 1) * (len(x) // 16)) AS x FROM v, range(16) t(part)),
f AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INT) AS entry FROM (SELECT DISTINCT vec_id FROM v ORDER BY vec_id LIMIT 64)),
b0 AS MATERIALIZED (SELECT part, entry, min(x) AS y FROM p JOIN f USING (vec_id) GROUP BY ALL),
{_assign("a1", "b0")}, {_move("b1", "a1", "b0")}, {_assign("a2", "b1")}, {_move("b2", "a2", "b1")}, {_assign("a3", "b2")},
c AS (SELECT vec_id, label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a3 GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
(SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256 FROM c
"""

OP12 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, list_value(2, 3, 1)[1 + row_number() OVER (ORDER BY source NULLS LAST) % 3] AS weight FROM d GROUP BY source),
o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(2 * sum(source_size) OVER w, 0)::DOUBLE AS budget, (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS free, row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS pos
FROM s WINDOW w AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT budget, free FROM o WHERE budget * weight / free < 2 * source_size ORDER BY pos LIMIT 1),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, k.budget * weight / k.free) AS target FROM o, k),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
c AS (SELECT doc_id, size, d.source, source_size, target, CAST(seed AS INT) AS seed, size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5(concat_ws(':', seed, coalesce(CAST(doc_id AS VARCHAR), ''), size)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, range(64) q(seed)),
b AS (SELECT source, seed FROM c GROUP BY source, seed QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(sum(taken) - any_value(target)), seed) = 1)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source AND c.seed = b.seed
"""

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS MATERIALIZED (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM v GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN v USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, v.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 5) // (coalesce(n.n, 0) + 5 * l.v) AS p, 1 + 1000000000 * (v.c + 5) // (l.n + 5 * l.v) AS q
FROM g JOIN v USING (lang) JOIN l USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
LEFT JOIN (SELECT a.lang, a.source AS s, b.source AS t, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x ON x.lang = a.lang AND x.s = a.source AND x.t = b.source
UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM o)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3, "op5_jaccard_join": OP5, "op7_substring_dedup": OP7, "op9_chat_format": OP9, "op10_line_dedup": OP10, "op11_vector_codes": OP11, "op12_source_mix": OP12, "op13_source_divergence": OP13}
