"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from corpusweave.llm import quality_rules, vector_search

_WORD = r"[^\x20\x09-\x0D]+"

QUALITY_RULES = rf"""
WITH own AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
coded AS (
    SELECT *, list_transform(words, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT) AS codes FROM own),
grams AS (
    SELECT doc_id, list_concat(
        list_transform(codes, lambda c: c % {quality_rules.BUCKETS}),
        list_transform(range(1, len(codes)), lambda i: (codes[i] * 31 + codes[i + 1] * 17 + 7) % {quality_rules.BUCKETS})) AS g
    FROM coded),
each AS (SELECT doc_id, unnest(g) AS bucket FROM grams),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
counts AS (
    SELECT bucket, count(*) + 1 AS raw, count(*) FILTER (doc_id IN (SELECT doc_id FROM trusted)) AS target FROM each GROUP BY bucket),
sums AS (
    SELECT sum(raw) + {quality_rules.BUCKETS} - count(*) AS n_raw, sum(target) AS n_target FROM counts),
ratios AS (
    SELECT bucket, round((ln((target + {quality_rules.PRIOR} * (raw / n_raw)) / (n_target + {quality_rules.PRIOR})) - ln(raw / n_raw))
        * 1000000)::BIGINT AS ratio FROM counts, sums),
scores AS (SELECT doc_id, count(*) AS n_grams, sum(ratio)::BIGINT AS score_sum FROM each JOIN ratios USING (bucket) GROUP BY doc_id),
places AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM own WHERE len(words) >= 3),
windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM places),
covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
lined AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM own),
base AS (
    SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
        length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM own JOIN lined USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (
    SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        coalesce(n_grams, 0) AS grams, coalesce(score_sum, 0) AS score FROM base LEFT JOIN scores USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, grams AS n_grams, score AS score_sum,
    NOT base_failed AND score >= grams * ({round(quality_rules.THRESHOLD * 1_000_000)}) AS kept
FROM judged"""

VECTOR_SEARCH = f"""
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor({vector_search.SCALE} * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= {vector_search.TOP}"""

# crc32 of the digits of an id, bit by bit
_CRC32 = """xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda c, b:
    list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295), 4294967295)"""

CONVERSATION_TRIE = f"""
WITH own AS (
    SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
        ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
skips AS (SELECT *, {_CRC32} % 4 AS h FROM own),
built AS (
    SELECT s.conv_id, list_concat(coalesce(b.turns, [])[1:s.h], s.turns[s.h + 1:]) AS turns
    FROM skips s LEFT JOIN own b ON b.conv_id = s.conv_id - s.conv_id % 20),
paths AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM built),
members AS (SELECT conv_id, depth, turns[1:depth] AS path, len(turns) = depth AS ends FROM paths),
nodes AS (
    SELECT path, depth, min(conv_id) AS node, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
        (count(*) - 1) * coalesce(len(regexp_extract_all(path[depth].text, '{_WORD}')), 0) AS saved
    FROM members GROUP BY path, depth),
linked AS (
    SELECT n.*, p.node AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]),
children AS (SELECT parent_conv_id AS node, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY 1, 2),
counted AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children USING (node, depth)),
above AS (SELECT path[1:d] AS path, d AS depth, n_children = 0 AS leaf, saved FROM (SELECT *, unnest(range(depth + 1)) AS d FROM counted)),
sums AS (SELECT path, depth, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY path, depth)
SELECT node AS conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM counted JOIN sums USING (path, depth)"""

ORACLES = {
    "op1_quality_rules": QUALITY_RULES,
    "op2_vector_search": VECTOR_SEARCH,
    "op11_conversation_trie": CONVERSATION_TRIE,
}
