"""The queries of this package, and the SQL that some have to agree with."""

from likeness.llm import (contamination, htmltext, language, neardup, packing, pii, resampling, substrings,
                          tokencounts, tokenfiles, topk, toxicity, turns)

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_topk": topk.op2_topk,
    "op3_tokens": tokenfiles.op3_tokens,
    "op4_main_text": htmltext.op4_main_text,
    "op5_token_counts": tokencounts.op5_token_counts,
    "op6_language": language.op6_language,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_contamination": contamination.op8_contamination,
    "op9_pii": pii.op9_pii,
    "op10_near_duplicates": neardup.op10_near_duplicates,
    "op11_repeats": substrings.op11_repeats,
    "op12_conversations": turns.op12_conversations,
    "op13_importance": resampling.op13_importance,
}
ORACLES = {
    "op2_topk": topk.ORACLE,
    "op8_contamination": contamination.ORACLE,
    "op9_pii": pii.ORACLE,
    "op11_repeats": substrings.ORACLE,
}
