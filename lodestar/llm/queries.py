"""The registered queries of this subpackage, with SQL for those that SQL can express."""

from . import contamination, conversations, exact, html_text, importance, language, mixing, personal, repeats, scoring, similarity, toxicity, training_order

QUERIES = {
    "op10_personal_data": personal.op10_personal_data,
    "op11_lm_score": scoring.op11_lm_score,
    "op12_repair": conversations.op12_repair,
    "op13_importance": importance.op13_importance,
    "op1_training_order": training_order.op1_training_order,
    "op2_decontaminate": contamination.op2_decontaminate,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_ngram_jaccard": similarity.op5_ngram_jaccard,
    "op6_suffix_dedup": repeats.op6_suffix_dedup,
    "op7_html_text": html_text.op7_html_text,
    "op8_exact_dedup": exact.op8_exact_dedup,
    "op9_language_id": language.op9_language_id,
}
SQL = {"op2_decontaminate": contamination.SQL2, "op8_exact_dedup": exact.SQL8, "op12_repair": conversations.SQL12, "op13_importance": importance.SQL13}
