"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from revlens.llm import (bpe, decontam, filter_audit, hard_negatives, jaccard_join, knn, langid, license_scan, line_dedup,
                         near_dup, substring_dedup, toxicity, warc)

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_license_scan": license_scan.query,
    "op3_language_id": langid.query,
    "op4_near_dup": near_dup.query,
    "op5_decontaminate": decontam.query,
    "op6_line_dedup": line_dedup.query,
    "op7_top_k": knn.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_bpe": bpe.query,
    "op10_warc": warc.query,
    "op11_jaccard_join": jaccard_join.query,
    "op12_filter_audit": filter_audit.query,
    "op13_hard_negatives": hard_negatives.query,
}

ORACLE: dict[str, str] = {
    "op6_line_dedup": line_dedup.SQL,
    "op7_top_k": knn.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op10_warc": warc.SQL,
    "op11_jaccard_join": jaccard_join.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
