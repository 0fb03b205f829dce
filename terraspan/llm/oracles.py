"""DuckDB SQL for the queries that SQL expresses. The others are tested against brute force in tests/llm."""

LOWER_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op3_site_spread_lines": r"""
        WITH split AS (
            SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
        ), placed AS (
            SELECT doc_id, source, generate_subscripts(parts, 1) AS place, unnest(parts) AS line FROM split
        ), lines AS (
            SELECT doc_id, source, place, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS normal FROM placed
        ), bad AS (
            SELECT normal FROM lines WHERE normal <> '' GROUP BY normal HAVING count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) >= 5
        ), judged AS (
            SELECT l.doc_id, l.place, l.line, b.normal IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON l.normal = b.normal
        ), joined AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
                   coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text
            FROM judged GROUP BY doc_id
        )
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE j.n_lines END AS n_lines,
               CASE WHEN d.text IS NULL THEN 0 ELSE j.n_removed END AS n_removed,
               CASE WHEN d.text IS NULL THEN NULL WHEN j.n_removed = 0 THEN d.text ELSE j.text END AS text
        FROM documents d JOIN joined j USING (doc_id)""",
    "op4_fast_similarity_near_dedup": rf"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, {LOWER_WORDS} AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM worded
        ), rows AS (
            SELECT doc_id, len(s) AS n, md5(unnest(s)) AS h FROM sets
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM rows a JOIN rows b ON a.h = b.h AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.seen
        ), least AS (
            SELECT id, min(seen) AS component_id FROM reach GROUP BY id
        )
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
        FROM sets s JOIN least m ON m.id = s.doc_id""",
    "op6_zip_warc_round_trip": """
        WITH payloads AS (
            SELECT page_id, encode(coalesce(html, '')) AS p FROM pages
        ), sized AS (
            SELECT page_id, octet_length(p) AS n, sha256(p) AS d FROM payloads
        ), firsts AS (
            SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM sized
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
        FROM firsts""",
    "op7_fuse_filter_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
