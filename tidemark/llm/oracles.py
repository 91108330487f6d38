"""The same results in SQL, where SQL can express them."""

from tidemark.llm.exact_dedup import OP5_SQL

OP2_SQL = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
    SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
        array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), '') AS payload_digest,
        min(page_id) OVER (PARTITION BY body) AS first
    FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

OP4_SQL = r"""
WITH k(ord, kind, pattern, context) AS (VALUES
    (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', ''),
    (2, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)', ''),
    (3, 'card', '[0-9](?:[\x20-]?[0-9])+', ''),
    (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]', ''),
    (5, 'iban', '[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})', ''),
    (6, 'ssn', '[0-9]{3}-[0-9]{2}-[0-9]{4}', '\b(?:ssn|social security)')
), m AS (
    SELECT doc_id, ord, kind, context, string_split_regex(coalesce(text, ''), pattern) AS gaps, regexp_extract_all(coalesce(text, ''), pattern) AS found
    FROM documents, k
), s AS (
    SELECT doc_id, ord, kind, context, found[i] AS v, gaps[i] AS gap, regexp_replace(found[i], '[^0-9]', '', 'g') AS d,
        list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS a
    FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m)
), good AS (
    SELECT doc_id, ord, kind, a::BIGINT AS a, (a + length(v))::BIGINT AS b FROM s
    WHERE CASE kind
        WHEN 'email' THEN true
        WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS BIGINT), 256) > 255)) = 0
        WHEN 'card' THEN length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length(d)), lambda i:
            CASE WHEN i % 2 = 0 THEN reverse(d)[i + 1]::INT WHEN reverse(d)[i + 1]::INT > 4 THEN reverse(d)[i + 1]::INT * 2 - 9
            ELSE reverse(d)[i + 1]::INT * 2 END)) % 10 = 0
        WHEN 'phone' THEN length(d) BETWEEN 8 AND 15
        WHEN 'ssn' THEN NOT regexp_matches(right(gap, 1), '[A-Za-z0-9-]') AND regexp_matches(lower(right(gap, 48)), context)
        ELSE NOT regexp_matches(right(gap, 1), '[A-Za-z0-9-]') AND list_reduce(list_prepend(0, list_transform(
            string_split(substr(replace(v, ' ', ''), 5) || substr(v, 1, 4), ''), lambda c: ascii(c))),
            lambda x, c: CASE WHEN c >= 65 THEN (x * 100 + c - 55) % 97 ELSE (x * 10 + c - 48) % 97 END) = 1
        END
), g AS (
    SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
        count(*) FILTER (kind = 'phone') AS n_phone,
        string_agg(kind || ':' || a || ':' || b, ',' ORDER BY ord, a) FILTER (ord <= 4) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY ord, a) AS spans
    FROM good GROUP BY doc_id
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP7_SQL = f"""
WITH item AS (
    SELECT item_id::VARCHAR AS item_id, words, least(13, len(words)) AS n
    FROM (SELECT item_id, {_WORDS} AS words FROM benchmark)
), windows AS (
    SELECT DISTINCT item_id, n, array_to_string(words[p:p + n - 1], ' ') AS body
    FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS p FROM item WHERE n > 0)
), doc AS (
    SELECT doc_id, {_WORDS} AS words FROM documents
), spot AS (
    SELECT doc_id, n, p, array_to_string(words[p:p + n - 1], ' ') AS body
    FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM doc, (SELECT DISTINCT n FROM windows))
), found AS (
    SELECT doc_id, p, n, item_id FROM spot JOIN windows USING (n, body)
), hit AS (
    SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS w FROM found) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

#: CRC-32 of the distinct texts `w` of the table `named`, by the table of its polynomial.
_CRC = """
crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), bytes AS (
    SELECT w, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::BIGINT, 2))::BIGINT) AS b FROM (SELECT DISTINCT w FROM named)
), crc AS (
    SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM bytes, crc_table
)"""

OP12_SQL = f"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents
), source AS (
    SELECT r, unnest(words) AS w FROM doc
), target AS (
    SELECT unnest({_WORDS}) AS w FROM benchmark
), named AS (
    SELECT w FROM source UNION SELECT w FROM target
), {_CRC}, s AS (
    SELECT crc % 10000 AS bucket, count(*) AS s FROM source JOIN crc USING (w) GROUP BY 1
), t AS (
    SELECT crc % 10000 AS bucket, count(*) AS t FROM target JOIN crc USING (w) GROUP BY 1
), gain AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM source) + 10000)
        / ((s + 1)::DOUBLE * ((SELECT count(*) FROM target) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)
), weight AS (
    SELECT r, sum(gain)::BIGINT AS weight FROM source JOIN crc USING (w) JOIN gain ON gain.bucket = crc.crc % 10000 GROUP BY r
), scored AS (
    SELECT r, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
        (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM doc LEFT JOIN weight USING (r)
), ranked AS (
    SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""

OP13_SQL = f"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
    FROM conversations WHERE conv_id IS NOT NULL
), named AS (
    SELECT DISTINCT conv_id::VARCHAR AS w FROM t
), {_CRC}, own AS (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY p) AS seq, (SELECT crc % 6 FROM crc WHERE w = conv_id::VARCHAR)::BIGINT AS h FROM t GROUP BY conv_id
), rebuilt AS (
    SELECT c.conv_id, list_concat(list_filter(coalesce(b.seq, []), lambda x, i: i <= c.h), list_filter(c.seq, lambda x, i: i > c.h)) AS seq
    FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
), m AS (
    SELECT conv_id, d, sha256(to_json(list_filter(seq, lambda x, i: i <= d))::VARCHAR) AS node, d = len(seq) AS last,
        CASE WHEN d > 0 THEN length(seq[d]['text']) ELSE 0 END AS size
    FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)
), node AS (
    SELECT node, d, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last) AS ends
    FROM m GROUP BY node, d
), above AS (
    SELECT n.node, m.node AS over FROM node n JOIN m ON m.conv_id = n.conv_id AND m.d = n.d - 1
), kids AS (
    SELECT over AS node, count(*) AS kids FROM above GROUP BY over
), below AS (
    SELECT m.node, count(*) FILTER (kids IS NULL) AS leaves, sum((n - 1) * n.size)::BIGINT AS saved
    FROM node n LEFT JOIN kids USING (node) JOIN m ON m.conv_id = n.conv_id AND m.d <= n.d GROUP BY m.node
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens,
    sha256(coalesce(n.ends, '')) AS ends_sha256
FROM node n LEFT JOIN above USING (node) LEFT JOIN node p ON p.node = above.over LEFT JOIN kids ON kids.node = n.node JOIN below ON below.node = n.node
"""

ORACLES = {
    "op2_warc": OP2_SQL, "op4_pii": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op7_decontaminate": OP7_SQL, "op12_resample": OP12_SQL,
    "op13_trie": OP13_SQL,
}
