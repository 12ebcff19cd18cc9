"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from graphloom.llm import pipeline
from graphloom.llm.decontamination import op7_winnowing_decontamination
from graphloom.llm.exact_dedup import op1_exact_dedup
from graphloom.llm.language import op6_language_id
from graphloom.llm.language_model import op9_language_model
from graphloom.llm.mixing import op5_source_mixing
from graphloom.llm.near_dedup import op10_order_minhash
from graphloom.llm.pii import op8_personal_data
from graphloom.llm.quality import op4_quality_classifier
from graphloom.llm.substrings import op3_substring_dedup
from graphloom.llm.warc import op2_warc_index

QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_warc_index,
        op3_substring_dedup,
        op4_quality_classifier,
        op5_source_mixing,
        op6_language_id,
        op7_winnowing_decontamination,
        op8_personal_data,
        op9_language_model,
        op10_order_minhash,
    )
}
QUERIES["pipeline"] = pipeline.run

ORACLE = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op2_warc_index": r"""
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, url
            FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p),
        u AS (
            SELECT *, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www[0-9]*\.', '') AS host,
                   regexp_extract(url, '^[a-zA-Z]+://[^/?#:]*(:[0-9]+)?([^#]*)', 2) AS rest
            FROM f)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to,
               array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END AS surt,
               true AS checked
        FROM u""",
}
