"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from claimloom.llm import embedding_dedup, exact_dedup, language_id, line_dedup, packing, sentence_pieces, simhash, source_audit, spelling, substring_dedup, toxicity, url_filter, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1,
    "op2_url_filters": url_filter.op2,
    "op3_substring_dedup": substring_dedup.op3,
    "op4_simhash_near_dedup": simhash.op4,
    "op5_best_fit_packing": packing.op5,
    "op6_language_id": language_id.op6,
    "op7_sentence_pieces": sentence_pieces.op7,
    "op8_embedding_near_dedup": embedding_dedup.op8,
    "op9_line_dedup": line_dedup.op9,
    "op10_toxicity": toxicity.op10,
    "op11_spelling_variants": spelling.op11,
    "op12_source_divergence": source_audit.op12,
    "op13_warc": warc.op13,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op2_url_filters": url_filter.OP2_SQL,
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op8_embedding_near_dedup": embedding_dedup.OP8_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op12_source_divergence": source_audit.OP12_SQL,
    "op13_warc": warc.OP13_SQL,
}
