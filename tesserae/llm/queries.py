"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers

from tesserae.llm import alignment, bpe, chat, exact_dedup, fim, licenses, line_dedup, minhash, packing, quality, sharding, toxicity, warc
from tesserae.runtime import table


BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_minhash_dedup(spark, sf_dir):
    return minhash.near_copies(table(spark, sf_dir, "documents"))


def op2_chat_format(spark, sf_dir):
    return chat.formatted(*chat.turns_as_calls(table(spark, sf_dir, "conversations")), chat.ASK)


def op2_chat_records(spark, sf_dir):
    return chat.records(table(spark, sf_dir, "conversations"))


def op3_line_dedup(spark, sf_dir):
    return line_dedup.mark_lines(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    return quality.signals(table(spark, sf_dir, "documents"))


def op5_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op6_warc(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def op8_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op9_toxicity(spark, sf_dir):
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark, sf_dir):
    return fim.transformed(table(spark, sf_dir, "documents"), digests=True)


def op12_token_alignment(spark, sf_dir):
    return alignment.scored(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


def op13_kd_shards(spark, sf_dir):
    return sharding.assigned(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_chat_format, op3_line_dedup, op4_quality_rules, op5_pack, op6_warc, op7_exact_dedup, op8_bpe, op9_toxicity, op10_license_scan, op11_fill_in_middle, op12_token_alignment, op13_kd_shards, op2_chat_records)}

ORACLE_SQL = {
    "op2_chat_format": """
        WITH c AS (SELECT conv_id, turn, text, conv_id || '-' || turn AS call_id FROM conversations WHERE role = 'user'),
             g AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c),
             l AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1)::INTEGER AS level FROM g),
             r AS (SELECT conv_id || '-' || (turn - 1) AS call_id, turn AS result_turn, text AS result FROM conversations WHERE role = 'assistant')
        SELECT coalesce(l.call_id, r.call_id) AS call_id, conv_id, turn AS call_turn, result_turn,
               CASE WHEN l.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
               level, true AS valid, []::VARCHAR[] AS problems,
               '{"arguments":' || CASE WHEN l.call_id IS NULL THEN '{}' ELSE '{"text":' || to_json(text) || ',"turn":' || turn || '}' END
               || ',"id":"' || coalesce(l.call_id, r.call_id) || '","name":' || CASE WHEN l.call_id IS NULL THEN 'null' ELSE '"ask"' END
               || ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') || ',"valid":true}' AS message_json
        FROM l FULL JOIN r ON l.call_id = r.call_id""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
             g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keep FROM d),
             r AS (SELECT *, payload_bytes >= 1000 AND page_id <> keep AS again FROM g)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN keep END AS refers_to, true AS sound
        FROM r""",
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
}
