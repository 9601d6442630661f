"""Queries of this subpackage and their oracle statements."""

from __future__ import annotations

import corpus_pipeline
from crossquote.llm import (bloom_lm, cover_tree, language, merkle, mixing, ngram_join, packing, personal_data, pieces,
                            quality, quotations, simhash, substrings)

QUERIES = {
    "op1_quotation_links": quotations.op1_quotation_links,
    "op2_language_spans": language.op2_language_spans,
    "op3_token_fertility": quality.op3_token_fertility,
    "op4_cost_packing": packing.op4_cost_packing,
    "op5_bilstm_pii": personal_data.op5_bilstm_pii,
    "op6_weighted_mix": mixing.op6_weighted_mix,
    "op7_bloom_lm": bloom_lm.op7_bloom_lm,
    "op8_simhash": simhash.op8_simhash,
    "op9_super_kmers": substrings.op9_super_kmers,
    "op10_ngram_jaccard": ngram_join.op10_ngram_jaccard,
    "op11_piece_agenda": pieces.op11_piece_agenda,
    "op12_cover_negatives": cover_tree.op12_cover_negatives,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op1_quotation_links": quotations.ORACLE,
    "op6_weighted_mix": mixing.ORACLE,
    "op9_super_kmers": substrings.ORACLE,
    "op10_ngram_jaccard": ngram_join.ORACLE,
    "op12_cover_negatives": cover_tree.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
