"""The registered queries of this subpackage: name -> (run, SQL that gives the same rows, or None)."""

from __future__ import annotations

from rowloom.llm import (
    conversations,
    decontamination,
    fill_in_middle,
    fingerprints,
    language,
    line_dedup,
    mixing,
    paragraphs,
    sentence_pieces,
    simhash,
    suffix_index,
    toxicity,
    url_filter,
)

QUERIES = {
    "op1_line_dedup": (line_dedup.op1_line_dedup, None),
    "op2_mix_sources": (mixing.op2_mix_sources, mixing.OP2_SQL),
    "op3_language_id": (language.op3_language_id, None),
    "op4_document_fingerprints": (fingerprints.op4_document_fingerprints, None),
    "op5_url_filter": (url_filter.op5_url_filter, None),
    "op6_simhash_near_dedup": (simhash.op6_simhash_near_dedup, None),
    "op7_toxicity": (toxicity.op7_toxicity, None),
    "op8_paragraph_dedup": (paragraphs.op8_paragraph_dedup, None),
    "op9_suffix_array_dedup": (suffix_index.op9_suffix_array_dedup, None),
    "op10_benchmark_decontamination": (decontamination.op10_benchmark_decontamination, decontamination.OP10_SQL),
    "op11_conversation_repair": (conversations.op11_conversation_repair, None),
    "op12_sentence_pieces": (sentence_pieces.op12_sentence_pieces, None),
    "op13_fill_in_middle": (fill_in_middle.op13_fill_in_middle, None),
}
