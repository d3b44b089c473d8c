"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, embeddings, jaccard, language, licenses, lm, mixing, substring, topk

QUERIES = {
    "op2_embedding_dedup": embeddings.op2_embedding_dedup,
    "op1_lm_score": lm.op1_lm_score,
    "op3_substring_dedup": substring.op3_substring_dedup,
    "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_mixing": mixing.op6_mixing,
    "op7_exact_topk": topk.op7_exact_topk,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_chat_format": chat.op9_chat_format,
    "op10_language_id": language.op10_language_id,
}

ORACLES = {
    "op2_embedding_dedup": embeddings.ORACLE,
    "op3_substring_dedup": substring.ORACLE,
    "op4_ngram_jaccard": jaccard.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op7_exact_topk": topk.ORACLE,
}
