"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

#: White space and words of the contracts.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op7_exact_dedup": rf"""
WITH t AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g') AS norm FROM documents
), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
""",
    "op8_line_dedup": r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), repeated AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS dropped FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op12_merkle": r"""
WITH RECURSIVE rows_ AS (
    SELECT doc_id, source, text,
           coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') ||
           coalesce(octet_length(encode(source)) || ':' || source, '-') ||
           coalesce(octet_length(encode(lang)) || ':' || lang, '-') ||
           coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS front
    FROM documents
), hashed AS (
    SELECT doc_id, source,
           sha256(front || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
           sha256(front || coalesce(octet_length(encode(text)) || ':' || translate(text,
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS lowered
    FROM rows_
), crc AS (
    -- CRC-32 of the decimal digits, bit by bit.
    SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS i, 4294967295::BIGINT AS c FROM (SELECT DISTINCT doc_id FROM documents)
    WHERE doc_id IS NOT NULL
    UNION ALL
    SELECT doc_id, s, i + 1, CASE WHEN met & 1 = 1 THEN xor(met >> 1, 3988292384::BIGINT) ELSE met >> 1 END
    FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(c, ascii(s[i // 8 + 1])::BIGINT) ELSE c END AS met FROM crc)
    WHERE i < 8 * length(s)
), hit AS (
    SELECT doc_id, xor(c, 4294967295::BIGINT) % 5 = 0 AS tampered FROM crc WHERE i = 8 * length(s)
), leaves AS (
    SELECT h.doc_id, leaf, CASE WHEN coalesce(tampered, FALSE) THEN lowered ELSE leaf END AS given,
           dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
           row_number() OVER (PARTITION BY source ORDER BY h.doc_id NULLS FIRST, leaf) - 1 AS idx,
           count(*) OVER (PARTITION BY source) AS nodes
    FROM hashed h LEFT JOIN hit USING (doc_id)
), low AS (
    SELECT tree, 0 AS level, idx, leaf AS digest, nodes FROM leaves
    UNION ALL
    SELECT tree, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), any_value((nodes + 15) // 16)
    FROM low WHERE nodes > 1 GROUP BY tree, level, idx // 16
), subroots AS (
    SELECT tree, level, digest AS subroot FROM low WHERE nodes = 1
), high AS (
    SELECT 0 AS level, tree AS idx, subroot AS digest, (SELECT count(*) FROM subroots) AS nodes FROM subroots
    UNION ALL
    SELECT level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), any_value((nodes + 15) // 16)
    FROM high WHERE nodes > 1 GROUP BY level, idx // 16
), nodes AS (
    SELECT tree, level, idx, digest FROM low WHERE nodes > 1
    UNION ALL
    SELECT s.tree, s.level + h.level, h.idx, h.digest
    FROM high h JOIN subroots s ON s.tree // CAST(pow(16, h.level + 1) AS BIGINT) = h.idx // 16 WHERE h.nodes > 1
), runs AS (
    SELECT tree, level, idx, digest, idx // 16 AS run,
           coalesce(string_agg(digest, '' ) OVER (PARTITION BY tree, level, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
           coalesce(string_agg(digest, '' ) OVER (PARTITION BY tree, level, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
    FROM nodes
), climb AS (
    SELECT l.doc_id, l.leaf, l.tree, l.idx AS leaf_idx, 0 AS level, CASE WHEN s.level = 0 THEN l.tree ELSE l.idx END AS idx,
           '' AS proof, l.given AS folded, s.level AS height
    FROM leaves l JOIN subroots s USING (tree)
    UNION ALL
    SELECT c.doc_id, c.leaf, c.tree, c.leaf_idx, c.level + 1,
           CASE WHEN c.level + 1 = c.height THEN c.tree ELSE c.idx // 16 END,
           c.proof || r.before || r.after, sha256(r.before || c.folded || r.after), c.height
    FROM climb c JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.idx = c.idx
), top AS (
    SELECT digest AS root, level AS upper FROM high WHERE nodes = 1
)
SELECT c.doc_id, c.leaf, s.subroot, t.root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = t.root AS verified
FROM climb c JOIN subroots s USING (tree), top t
WHERE c.level = c.height + t.upper
""",
}
