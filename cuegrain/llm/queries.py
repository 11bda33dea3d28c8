"""Queries of the training-data operators and the SQL that expresses them, where SQL can."""

from . import best_fit_packing, context_mixing, exact_dedup, fm_dedup, hard_negatives, line_dedup, mixing, phrase_mining, quality_cnn, quality_rules, sentencepiece_fst, simhash, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_substring_dedup": fm_dedup.op5_substring_dedup,
    "op6_warc_index": warc.op6_warc_index,
    "op7_sentencepiece": sentencepiece_fst.op7_sentencepiece,
    "op8_simhash": simhash.op8_simhash,
    "op9_lm_score": context_mixing.op9_lm_score,
    "op10_quality_cnn": quality_cnn.op10_quality_cnn,
    "op11_best_fit_packing": best_fit_packing.op11_best_fit_packing,
    "op12_phrase_mining": phrase_mining.op12_phrase_mining,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_mix_sources": mixing.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_substring_dedup": fm_dedup.ORACLE,
    "op12_phrase_mining": phrase_mining.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
