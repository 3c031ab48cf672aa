"""The queries of the training-data operators, and the SQL they are held against."""

from __future__ import annotations

from . import bottom_k, chat_format, decontamination, filter_audit, fingerprints, license_scan, line_dedup, lm_scoring, secret_scan, sentencepiece_bpe, simhash_dedup, toxicity, turn_repair

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_sentencepiece": sentencepiece_bpe.op3_sentencepiece,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_document_fingerprints": fingerprints.op7_document_fingerprints,
    "op8_simhash_near_dedup": simhash_dedup.op8_simhash_near_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_minhash_near_dedup": bottom_k.op11_minhash_near_dedup,
    "op12_turn_repair": turn_repair.op12_turn_repair,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL = {"op1_line_dedup": line_dedup.ORACLE, "op6_secret_scan": secret_scan.ORACLE, "op10_chat_format": chat_format.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
