"""SQL of the queries that it can express, over the whole tables."""

SQL = {
    "op1_host_rules": r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS whole,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
lines AS (
  SELECT *, [x FOR x IN string_split(whole, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS filled
  FROM base),
windows AS (
  SELECT doc_id, i, struct_pack(a := words[i], b := words[i + 1], c := words[i + 2]) AS win
  FROM base, unnest(range(1, len(words) - 1)) AS t(i)),
again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM again, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
counts AS (
  SELECT l.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(whole) - length(regexp_replace(whole, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(filled) - len(list_distinct(filled)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM lines l LEFT JOIN repeats r ON l.doc_id = r.doc_id),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [
    n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 2 * n_dup_lines > n_words,
    word_chars < 2 * n_words OR word_chars > 15 * n_words] AS failed
  FROM counts),
hosts AS (
  SELECT source, rule, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (failed[rule]) AS DOUBLE) AS k
  FROM judged, range(1, 6) AS t(rule) GROUP BY source, rule),
sums AS (
  SELECT rule, least(greatest(avg(k / n), 1e-6), 1 - 1e-6) AS mean, avg(k * (k - 1) / (n * (n - 1))) AS square
  FROM hosts WHERE n > 1 GROUP BY rule),
sizes AS (
  SELECT rule, mean, 1 / least(greatest((square - mean * mean) / (mean - mean * mean), 1e-4), 0.5) - 1 AS size FROM sums),
rates AS (
  SELECT source, n + coalesce(size, 2) AS weight, (k + coalesce(mean * size, 1)) / (n + coalesce(size, 2)) AS rate, coalesce(mean, 0.5) AS mean
  FROM hosts LEFT JOIN sizes USING (rule)),
verdicts AS (
  SELECT source, bool_or(rate - 2 * sqrt(rate * (1 - rate) / (weight + 1)) > (1 + mean) / 2) AS rejected FROM rates GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source""",
    "op2_chat_masks": r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM rows),
sized AS (SELECT *, length(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|turn|>', '<' || chr(92) || '|turn|>'), '<|body|>', '<' || chr(92) || '|body|>'), '<|end|>', '<' || chr(92) || '|end|>'), '<|endoftext|>', '<' || chr(92) || '|endoftext|>'), '<|im_start|>', '<' || chr(92) || '|im_start|>'), '<|im_end|>', '<' || chr(92) || '|im_end|>'), '<s>', '<' || chr(92) || 's>'), '</s>', '<' || chr(92) || '/s>'), '[INST]', '[' || chr(92) || 'INST]'), '[/INST]', '[' || chr(92) || '/INST]'), '<<SYS>>', '<' || chr(92) || '<SYS>>'), '<</SYS>>', '<' || chr(92) || '</SYS>>')) + length(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '<|turn|>', '<' || chr(92) || '|turn|>'), '<|body|>', '<' || chr(92) || '|body|>'), '<|end|>', '<' || chr(92) || '|end|>'), '<|endoftext|>', '<' || chr(92) || '|endoftext|>'), '<|im_start|>', '<' || chr(92) || '|im_start|>'), '<|im_end|>', '<' || chr(92) || '|im_end|>'), '<s>', '<' || chr(92) || 's>'), '</s>', '<' || chr(92) || '/s>'), '[INST]', '[' || chr(92) || 'INST]'), '[/INST]', '[' || chr(92) || '/INST]'), '<<SYS>>', '<' || chr(92) || '<SYS>>'), '<</SYS>>', '<' || chr(92) || '</SYS>>')) + 23 AS size FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY p)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY p) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op3_suffix_arrays": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS s FROM items WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item_id, s, array_to_string(w[i : i + s - 1], ' ') AS win
  FROM sized, unnest(range(1, len(w) - s + 2)) AS t(i)),
places AS (
  SELECT r, i, s, array_to_string(w[i : i + s - 1], ' ') AS win
  FROM docs, (SELECT DISTINCT s FROM wins) AS z, unnest(range(1, len(w) - s + 2)) AS t(i)),
hits AS (SELECT r, i, p.s, item_id FROM places p JOIN wins USING (s, win)),
words AS (SELECT r, count(DISTINCT i + k) AS n FROM hits, range(10) AS o(k) WHERE k < s GROUP BY r),
found AS (SELECT r, list(DISTINCT item_id::VARCHAR) FILTER (item_id IS NOT NULL) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(list_sort(ids), ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)""",
    "op6_substring_dedup": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS win FROM docs, unnest(range(1, len(w) - 33)) AS t(i)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY win) > 1),
covered AS (SELECT DISTINCT r, i + k AS i FROM again, range(35) AS o(k)),
words AS (SELECT r, i, w[i] AS word FROM docs, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN covered USING (r, i) GROUP BY r),
gone AS (SELECT r, count(*) AS n FROM covered GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r) LEFT JOIN gone USING (r)""",
    "op9_line_dedup": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS holder, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, holder, i, l[i] AS line,
         translate(regexp_replace(l[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM docs), unnest(range(1, len(l) + 1)) AS t(i)),
shared AS (
  SELECT key, max(holder) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT holder) >= 5),
marked AS (SELECT l.*, s.key IS NULL OR keeper = holder AS stays FROM lines l LEFT JOIN shared s ON s.key = l.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id""",
    "op11_minhash_bayes": r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(
    [array_to_string(w[i : i + 3], ' ') FOR i IN range(1, greatest(len(w) - 2, 2))])) END AS s
  FROM words),
entries AS (SELECT s, row_number() OVER (ORDER BY min(r)) AS e, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT e, n, unnest(s) AS x FROM entries),
often AS (SELECT x, count(*) AS f FROM items GROUP BY x),
-- of two sets that are alike enough, the rarest fifths share a shingle
rare AS (
  SELECT e, n, x FROM items JOIN often USING (x)
  QUALIFY row_number() OVER (PARTITION BY e ORDER BY f, x) <= n - (4 * n + 4) // 5 + 1),
candidates AS (
  SELECT DISTINCT a.e AS a, b.e AS b
  FROM rare a JOIN rare b ON a.x = b.x AND a.e < b.e AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
common AS (
  SELECT a, b, len(x.s) AS n, len(y.s) AS m, len(list_intersect(x.s, y.s)) AS shared
  FROM candidates JOIN entries x ON x.e = a JOIN entries y ON y.e = b),
pairs AS (SELECT a, b FROM common WHERE 100 * shared >= 80 * (n + m - shared)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT e, e AS m FROM entries UNION SELECT l.b, reach.m FROM reach JOIN links l ON l.a = reach.e WHERE reach.m < l.b),
roots AS (SELECT e, min(m) AS root FROM reach GROUP BY e),
least AS (SELECT root, min(doc_id) AS component_id FROM sets JOIN entries USING (s) JOIN roots USING (e) GROUP BY root),
named AS (
  SELECT t.doc_id, len(t.s) AS n_shingles, CASE WHEN len(t.s) = 0 THEN t.doc_id ELSE l.component_id END AS component_id
  FROM sets t LEFT JOIN entries e ON e.s = t.s LEFT JOIN roots USING (e) LEFT JOIN least l USING (root))
SELECT doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM named""",
    "op12_phrase_mining": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM lists GROUP BY lang),
grams AS (
  SELECT lang, s AS size, array_to_string(words[i : i + s - 1], ' ') AS phrase
  FROM lists, range(1, 6) AS t(s), unnest(range(1, len(words) - s + 2)) AS u(i)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
found AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS words FROM f WHERE size > 1),
cuts AS (
  SELECT lang, phrase, size, a, k, array_to_string(words[1 : k], ' ') AS front, array_to_string(words[k + 1 : size], ' ') AS back
  FROM found, range(1, 5) AS t(k) WHERE k < size),
scored AS (
  SELECT c.lang, c.phrase, c.size, a, x.f AS l, y.f AS r, n,
         CAST(1000::HUGEINT * a * n // (x.f::HUGEINT * y.f) AS BIGINT) AS score, k
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = front JOIN f y ON y.lang = c.lang AND y.phrase = back
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, array_to_string(words[i : i + s - 1], ' ') AS phrase, max(a) AS most
  FROM found, range(2, 5) AS t(s), range(1, 5) AS u(i) WHERE s < size AND i + s - 1 <= size GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
  WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000""",
    "op13_prefix_trie": r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, xor(list_reduce(list_concat([4294967295], [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))),
    4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT i.conv_id, 0 AS own, p, role, text FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 5 WHERE p <= h
  UNION ALL SELECT i.conv_id, 1, p, role, text FROM ids i JOIN turns t ON t.conv_id = i.conv_id WHERE p > h),
paths AS (
  SELECT i.conv_id, list(sha256(octet_length(encode(role)) || ':' || role || text) ORDER BY own, p) FILTER (role IS NOT NULL) AS path,
         list(octet_length(encode(text)) ORDER BY own, p) FILTER (role IS NOT NULL) AS sizes
  FROM ids i LEFT JOIN rebuilt r ON r.conv_id = i.conv_id GROUP BY i.conv_id),
members AS (
  SELECT conv_id, d AS depth, array_to_string(path[1 : d], '') AS node, array_to_string(path[1 : d - 1], '') AS above,
         coalesce(sizes[d], 0) AS size, d = coalesce(len(path), 0) AS ends
  FROM paths, unnest(range(0, coalesce(len(path), 0) + 1)) AS t(d)),
nodes AS (
  SELECT depth, node, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS own,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY depth, node),
kids AS (SELECT above AS node, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT t.depth, t.node, count(*) FILTER (k.n IS NULL) AS n_leaves, sum(b.own) AS saved
  FROM (SELECT DISTINCT depth, node FROM members) t
  JOIN (SELECT DISTINCT m.depth AS depth, m.node AS node, a.depth AS at, a.node AS top
        FROM members m JOIN members a ON a.conv_id = m.conv_id AND a.depth <= m.depth) s ON s.at = t.depth AND s.top = t.node
  JOIN nodes b ON b.depth = s.depth AND b.node = s.node
  LEFT JOIN kids k ON k.depth = b.depth AND k.node = b.node
  GROUP BY ALL)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(k.n, 0) AS n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM nodes x LEFT JOIN nodes p ON x.depth > 0 AND p.depth = x.depth - 1 AND p.node = x.above
LEFT JOIN kids k ON k.depth = x.depth AND k.node = x.node JOIN below b ON b.depth = x.depth AND b.node = x.node""",
}
