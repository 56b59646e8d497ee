"""The queries of this subpackage and their SQL oracles."""

from veilframe.llm import exact_dedup, jaccard_join, lang_id, license_scan, line_dedup, media, mixing, packing, toxicity, warc

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_best_fit_packing": packing.query,
    "op3_warc": warc.query,
    "op4_source_mixing": mixing.query,
    "op5_jaccard_join": jaccard_join.query,
    "op6_license_scan": license_scan.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_media_ts": media.query,
    "op9_toxicity": toxicity.query,
    "op10_lang_id": lang_id.query,
}

#: Only what SQL can express; the others are tested against brute force, round trips or held-out accuracy.
ORACLES = {
    "op3_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), g AS (
            SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < top THEN top END AS refers_to
        FROM p LEFT JOIN g USING (payload_digest)
    """,
    "op7_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        ), g AS (
            SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
}
