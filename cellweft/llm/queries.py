"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from cellweft.llm import conversation_repair, embed_dedup, filter_audit, hamming_topk, jaccard_join, mixing, packing, piece_encoding, pii, secret_scan, sql, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_pack": packing.op2_pack,
    "op3_embed_dedup": embed_dedup.op3_embed_dedup,
    "op4_mix": mixing.op4_mix,
    "op5_pii": pii.op5_pii,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_hamming_topk": hamming_topk.op7_hamming_topk,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_jaccard": jaccard_join.op10_jaccard,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_piece_encoding": piece_encoding.op13_piece_encoding,
}
SQL = {
    "op3_embed_dedup": sql.SQL_OP3,
    "op4_mix": mixing.SQL_OP4,
    "op7_hamming_topk": hamming_topk.SQL_OP7,
    "op8_suffix_dedup": sql.SQL_OP8,
    "op10_jaccard": sql.SQL_OP10,
    "op11_filter_audit": filter_audit.SQL_OP11,
    "op12_conversation_repair": sql.SQL_OP12,
}
