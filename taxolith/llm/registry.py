"""The queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from taxolith.llm import conversations, decontaminate, exact_dedup, jaccard, licenses, line_dedup, line_labels, pieces, quality, resampling, token_counts, toxicity, warc

QUERIES = {
    "op1_ngram_jaccard_join": jaccard.op1_ngram_jaccard_join,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_warc": warc.op5_warc,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_quality_rules": line_labels.op12_quality_rules,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}
ORACLES = {
    "op5_warc": warc.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op11_importance_resampling": resampling.ORACLE,
    "op13_conversation_repair": conversations.ORACLE,
}
