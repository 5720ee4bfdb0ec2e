"""Queries ``opN_<name>`` of the training-data operators and their SQL."""

from __future__ import annotations

from trovelens.llm import bpe, chat, exact_dedup, html_text, importance, ngram_join, packing, quality_net, quality_rules, simhash, toxicity, warc, whitening

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_html_extraction": html_text.query,
    "op3_quality_classifier": quality_net.query,
    "op4_warc_merkle_audit": warc.query,
    "op5_ngram_jaccard_join": ngram_join.query,
    "op6_bpe_codec": bpe.query,
    "op7_chat_formatting": chat.query,
    "op8_toxicity": toxicity.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_quality_rules": quality_rules.query,
    "op11_embedding_whitening": whitening.query,
    "op12_document_fingerprints": simhash.query,
    "op13_importance_resampling": importance.query,
}
ORACLE_SQL = {
    "op4_warc_merkle_audit": warc.ORACLE_SQL,
    "op5_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op7_chat_formatting": chat.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_quality_rules": quality_rules.ORACLE_SQL,
    "op13_importance_resampling": importance.ORACLE_SQL,
}
