"""Registry of the training-data queries and their SQL oracles."""

from quern.llm import chat, codes, collocations, html, jaccard, language, licences, lines, mixing, packing, quality, tiers, topk

QUERIES = {
    "op1_robust_outliers": quality.op1_robust_outliers,
    "op2_pack_best_fit": packing.op2_pack_best_fit,
    "op3_preference_format": chat.op3_preference_format,
    "op4_exact_top_k": topk.op4_exact_top_k,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_licence_scan": licences.op6_licence_scan,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_rank_order_language": language.op8_rank_order_language,
    "op9_html_main_text": html.op9_html_main_text,
    "op10_ngram_jaccard_join": jaccard.op10_ngram_jaccard_join,
    "op11_pack_tiers": tiers.op11_pack_tiers,
    "op12_compress_vectors": codes.op12_compress_vectors,
    "op13_mine_collocations": collocations.op13_mine_collocations,
}
ORACLES = {
    "op3_preference_format": chat.OP3_SQL,
    "op4_exact_top_k": topk.OP4_SQL,
    "op5_line_dedup": lines.OP5_SQL,
    "op7_mix_sources": mixing.OP7_SQL,
    "op10_ngram_jaccard_join": jaccard.OP10_SQL,
    "op12_compress_vectors": codes.OP12_SQL,
    "op13_mine_collocations": collocations.OP13_SQL,
}
