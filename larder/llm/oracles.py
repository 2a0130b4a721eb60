"""DuckDB texts for the operators that SQL can express."""

# Every window of consecutive item words as one space-joined string with its
# size, and every document word position; a window occurs where the joined
# words from a position equal it.
OP2 = r"""
WITH norm_b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT item_id, least(len(w), 13) AS size,
         array_to_string(list_slice(w, p, p + least(len(w), 13) - 1), ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS p FROM norm_b WHERE len(w) > 0)),
norm_d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
spots AS (
  SELECT r, p, size, array_to_string(list_slice(w, p, p + size - 1), ' ') AS key
  FROM (SELECT r, w, s.size, unnest(range(1, len(w) - s.size + 2)) AS p
        FROM norm_d, (SELECT DISTINCT size FROM wins) s WHERE len(w) >= s.size)),
found AS (SELECT s.r, s.p, s.size, w.item_id FROM spots s JOIN wins w ON s.key = w.key AND s.size = w.size),
hits AS (SELECT r, count(DISTINCT q) AS n_hit
         FROM (SELECT r, unnest(range(p, p + size)) AS q FROM found) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM found GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM norm_d d LEFT JOIN hits h USING (r) LEFT JOIN items i USING (r)
"""

OP5 = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
             sha256(coalesce(html, '')) AS payload_digest,
             min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
      FROM pages)
"""

# All pairs of a query and a row, on lists of bits.
OP7 = """
WITH codes AS (
  SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pairs AS (
  SELECT q.id AS query_id, r.id AS neighbor_id,
         CAST(list_sum(list_transform(list_zip(q.bits, r.bits), lambda x: abs(x[1] - x[2]))) AS BIGINT) AS distance
  FROM codes q, codes r WHERE q.id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, distance FROM ranked WHERE rank <= 10
"""

# Whole conversations as lists; a prefix is a list that starts a longer one.
OP9 = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
convs AS (
  SELECT conv_id, count(*) AS n,
         list({'role': role, 'text': text} ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS said,
         string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10)
                    || replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>')
                    || '<|im_end|>' || chr(10), ''
                    ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS chat
  FROM turns GROUP BY conv_id),
prefixes AS (SELECT conv_id, unnest(range(1, n)) AS i, said FROM convs WHERE n > 1),
longer AS (SELECT list_slice(said, 1, i) AS said, min(conv_id) AS by FROM prefixes GROUP BY 1),
firsts AS (SELECT said, min(conv_id) AS first_id FROM convs GROUP BY said)
SELECT c.conv_id, CAST(c.n AS BIGINT) AS n_turns,
       CASE WHEN l.by IS NOT NULL THEN 'prefix' WHEN c.conv_id = f.first_id THEN 'kept' ELSE 'copy' END AS status,
       CASE WHEN l.by IS NOT NULL THEN l.by WHEN c.conv_id <> f.first_id THEN f.first_id END AS kept_in,
       CASE WHEN l.by IS NULL AND c.conv_id = f.first_id THEN CAST(0 AS BIGINT) END AS part,
       CASE WHEN l.by IS NULL AND c.conv_id = f.first_id THEN c.chat END AS text
FROM convs c JOIN firsts f ON c.said = f.said LEFT JOIN longer l ON c.said = l.said
"""

# Whole rebuilt conversations as lists, a node as a list; CRC-32 bit by bit over the decimal id.
OP12 = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id AS c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS w FROM said GROUP BY conv_id),
steps AS (
  SELECT c, w, list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
           lambda x: list_prepend(CAST(ascii(x) AS BIGINT), list_transform(range(8), lambda y: CAST(-1 AS BIGINT)))))) AS ops FROM own),
crcs AS (
  SELECT c, w, xor(list_reduce(ops, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT))
                                                       ELSE a >> 1 END), CAST(4294967295 AS BIGINT)) % 6 AS h FROM steps),
built AS (
  SELECT a.c, list_concat(list_slice(coalesce(b.w, []), 1, a.h), list_slice(a.w, a.h + 1, len(a.w))) AS seq
  FROM crcs a LEFT JOIN own b ON b.c = a.c - a.c % 100),
prefixes AS (SELECT c, seq, d, list_slice(seq, 1, d) AS node FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM built)),
nodes AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n,
         coalesce(string_agg(CASE WHEN len(seq) = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends
  FROM prefixes GROUP BY node, d),
linked AS (
  SELECT v.*, p.conv_id AS parent_conv_id, CASE WHEN v.d > 0 THEN (v.n - 1) * length(v.node[v.d].text) ELSE 0 END AS own,
         (SELECT count(*) FROM nodes k WHERE k.d = v.d + 1 AND list_slice(k.node, 1, v.d) = v.node) AS n_children
  FROM nodes v LEFT JOIN nodes p ON v.d = p.d + 1 AND list_slice(v.node, 1, v.d - 1) = p.node),
below AS (
  SELECT list_slice(node, 1, a) AS node, a AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved
  FROM (SELECT node, n_children, own, unnest(range(0, d + 1)) AS a FROM linked) GROUP BY ALL)
SELECT l.conv_id, CAST(l.d AS BIGINT) AS depth, l.parent_conv_id, CAST(l.n AS BIGINT) AS n_convs, CAST(l.n_children AS BIGINT) AS n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(l.ends) AS ends_sha256
FROM linked l JOIN below b ON l.node = b.node AND l.d = b.d
"""

# Every phrase of one to three words of a piece, counted by its text.
OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
said AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, size, list_slice(w, p, p + size - 1) AS g
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS p
        FROM said, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size)),
f AS (SELECT lang, size, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
counts AS (SELECT lang, phrase, any_value(size) AS size, any_value(g) AS g, sum(n) AS n FROM f GROUP BY lang, phrase),
cand AS (SELECT lang, phrase, size, g, n AS a FROM counts WHERE size > 1 AND n >= 10),
inside AS (
  SELECT lang, max(a) AS longer, phrase FROM (
    SELECT lang, a, array_to_string(list_slice(g, 1, 2), ' ') AS phrase FROM cand WHERE size = 3
    UNION ALL SELECT lang, a, array_to_string(list_slice(g, 2, 3), ' ') FROM cand WHERE size = 3) GROUP BY lang, phrase),
kept AS (SELECT c.* FROM cand c LEFT JOIN inside i ON c.size = 2 AND c.lang = i.lang AND c.phrase = i.phrase
         WHERE i.longer IS NULL OR 100 * i.longer < 50 * c.a),
cuts AS (
  SELECT k.lang, k.phrase, k.a, c.k AS cut, x.n AS l, y.n AS r,
         (CAST(1000000 AS HUGEINT) * CAST(k.a AS HUGEINT) * CAST(k.a AS HUGEINT)) // (CAST(x.n AS HUGEINT) * CAST(y.n AS HUGEINT)) AS score
  FROM kept k, (SELECT unnest([1, 2]) AS k) c, counts x, counts y
  WHERE c.k < k.size AND x.lang = k.lang AND y.lang = k.lang
    AND x.phrase = array_to_string(list_slice(k.g, 1, c.k), ' ') AND y.phrase = array_to_string(list_slice(k.g, c.k + 1, k.size), ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE nth = 1)
SELECT r.lang, CAST(r.rank AS BIGINT) AS rank, r.phrase, CAST(r.a AS BIGINT) AS a, CAST(r.l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r,
       t.n, CAST(r.score AS BIGINT) AS score
FROM ranked r JOIN totals t USING (lang) WHERE r.rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": OP2,
    "op5_warc_archives": OP5,
    "op7_hamming_top_k": OP7,
    "op9_chat_formatting": OP9,
    "op12_conversation_trie": OP12,
    "op13_phrase_collocations": OP13,
}
