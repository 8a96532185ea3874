"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from lumiquarry.llm import chat_format, chat_repair, decontaminate, filter_audit, licenses, maxent_lm, ngram_join, pieces_codec, prefix_forest, quality, secrets, token_store, warc_zip

LETTERS = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LETTERS}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LETTERS}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i+least(len(w), 10)-1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, i, size, array_to_string(w[i:i+size-1], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw USING (size, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


OP1 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({LETTERS}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id))::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1) USING (doc_id)
"""


#: Base 32 of a SHA-1, five bits at a time from its hexadecimal digits.
OP3 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (SELECT page_id, n, h, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || h[i])::INTEGER), 4, '0')), '') AS b FROM p),
k AS (SELECT page_id, n, h, array_to_string(list_transform(range(0, 32), lambda i:
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_reduce(list_transform(range(1, 6), lambda j: b[5 * i + j]::INTEGER), lambda x, y: 2 * x + y)]), '') AS d FROM bits)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> f THEN f END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM k)
"""

OP8 = f"""
WITH t(name, text) AS (VALUES {', '.join("('" + n + "', '" + x.replace("'", "''") + "')" for n, x in licenses.TEMPLATES)}),
w AS (SELECT 'd' AS k, doc_id, '' AS name, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents
      UNION ALL SELECT 't', NULL, name, regexp_extract_all(lower(text), '[a-z0-9]+') FROM t),
s AS (SELECT DISTINCT k, doc_id, name, array_to_string(w[i:i+4], ' ') AS g
      FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
n AS (SELECT name, count(*) AS n FROM s WHERE k = 't' GROUP BY 1)
SELECT d.doc_id, t.name AS license_id, count(*) AS n_shared, any_value(n) AS n_shingles
FROM s d JOIN s t ON d.g = t.g AND d.k = 'd' AND t.k = 't' JOIN n ON n.name = t.name
GROUP BY 1, 2 HAVING count(*) * 100 >= any_value(n) * 80
"""

#: The CRC-32 of conv_id:turn, byte by byte and bit by bit; then one level of the lattice a row, all states at once.
OP11 = r"""
WITH RECURSIVE k AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t FROM conversations),
f AS (SELECT conv_id, turn, r, t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(key) + 1), lambda i: ord(key[i])::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS fault FROM k),
g AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE r END AS role,
      CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS text, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS time FROM f WHERE fault <> 0),
o AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, time) AS seen,
      lag(role) OVER w AS before, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS trimmed FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, time)),
x AS (SELECT *, trimmed = '' AS blank, trimmed <> '' AND seen > 1 AS dup, trimmed <> '' AND seen = 1 AND NOT regexp_matches(trimmed, '[.!?]$') AS trunc FROM o),
s AS (SELECT conv_id, CASE WHEN count(turn) > 0 THEN max(turn) - min(turn) + 1 - count(DISTINCT turn) ELSE 0 END AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
      count(*) FILTER (trunc) AS truncated, count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM x GROUP BY 1),
step(q, letter, z) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(q, z, cost, audit) AS (SELECT DISTINCT q, q, 0, '' FROM (VALUES (0), (1), (2), (3)) v(q) UNION ALL SELECT q, z, 3, 'I' FROM step WHERE letter <> 's'
      UNION ALL SELECT a.q, b.z, 6, 'II' FROM step a JOIN step b ON a.z = b.q WHERE a.letter <> 's'),
mv AS (SELECT conv_id, i, q, q AS z, 4 AS cost, 'D' AS e FROM x, (VALUES (0), (1), (2), (3)) v(q)
      UNION ALL SELECT conv_id, i, q, z, 3 * trunc::INT, 'K' FROM x JOIN step ON letter = left(role, 1) WHERE NOT blank AND NOT dup
      UNION ALL SELECT conv_id, i, q, z, 3 * trunc::INT + 3, 'R' FROM x JOIN step ON letter <> 's' WHERE NOT blank AND NOT dup),
edge AS (SELECT conv_id, i, m.q, n.z, m.cost + n.cost AS cost, m.e || n.audit AS audit FROM mv m JOIN ins n ON m.z = n.q),
best AS (SELECT conv_id, 0::BIGINT AS i, z AS q, struct_pack(cost := cost, audit := audit) AS p FROM s, ins WHERE ins.q = 0
      UNION ALL SELECT b.conv_id, b.i + 1, e.z, min(struct_pack(cost := b.p.cost + e.cost, audit := b.p.audit || e.audit))
      FROM best b JOIN edge e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i + 1 AND e.q = b.q GROUP BY 1, 2, 3),
top AS (SELECT b.conv_id, min(p) AS p FROM best b JOIN s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = s.n WHERE q IN (0, 3) GROUP BY 1),
l AS (SELECT conv_id, spot, p.audit[spot] AS e FROM (SELECT conv_id, p, unnest(range(1, len(p.audit) + 1)) AS spot FROM top)),
m AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS out FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY spot)),
y AS (SELECT m.conv_id, m.spot, m.e, m.out, x.role, x.text, max(CASE WHEN m.out = 1 AND m.e = 'K' AND left(x.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS sys
      FROM m LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM m.conv_id AND x.i = m.i AND m.e <> 'I' WHERE m.e <> 'D'),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (out - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY spot)) AS sha FROM y GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(p.cost, 0)::BIGINT AS cost, coalesce(p.audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN top ON top.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""

OP12 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT t, min(doc_id) AS first FROM d GROUP BY 1),
m AS (SELECT part, doc_id, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
      + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask FROM d JOIN f USING (t)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
      count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM m GROUP BY 1, 2),
o(prefix, letter, step, before, bit) AS (SELECT '', '', 0, 0, 0 UNION ALL SELECT prefix || l, l, step + 1, before | o.bit, v.bit
      FROM o, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, bit) WHERE ((before | o.bit) & v.bit) = 0),
p AS (SELECT part, prefix, letter, step, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, o WHERE step > 0 GROUP BY 1, 2, 3, 4),
a AS (SELECT p.*, w.prefix AS filter_order FROM p JOIN o w ON w.step = 5 AND left(w.prefix, p.step) = p.prefix)
SELECT part, filter_order, step, letter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM a
"""

#: The template's marks are 6 + role + 1 characters before a text and 7 after it; a backslash and each mark cost one more, in a role every backslash and angle bracket.
OP13 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, len(regexp_extract_all(text, '\\|<turn |</turn>|<part ')) + length(text) AS size, length(role) + len(regexp_extract_all(role, '[\\<>]')) AS head FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(size + head + 14)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens
FROM e GROUP BY 1
"""

OPERATORS = (
    ngram_join.op1_ngram_jaccard_join,
    quality.op2_quality_classifier,
    warc_zip.op3_warc,
    token_store.op4_token_id_binary_output,
    pieces_codec.op5_sentencepiece_codec,
    maxent_lm.op6_lm_scoring,
    prefix_forest.op7_approximate_nearest_neighbours,
    licenses.op8_license_scans,
    secrets.op9_secret_scans,
    decontaminate.op10_benchmark_decontamination,
    chat_repair.op11_conversation_repair,
    filter_audit.op12_filter_interaction_audit,
    chat_format.op13_chat_formatting,
)


def queries() -> dict:
    import corpus_pipeline

    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    more = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return more | {"op1_ngram_jaccard_join": OP1, "op3_warc": OP3, "op8_license_scans": OP8, "op10_benchmark_decontamination": OP10, "op11_conversation_repair": OP11, "op12_filter_interaction_audit": OP12, "op13_chat_formatting": OP13}
