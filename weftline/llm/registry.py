"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from weftline.llm import bpe, chat_format, exact_dedup, gru_lm, infill, jaccard_join, line_chunks, mixing, nb_svm, quality_rules, token_store, warc, word_runs

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_mixing": mixing.query,
    "op3_line_chunks": line_chunks.query,
    "op4_byte_bpe": bpe.query,
    "op5_jaccard_join": jaccard_join.query,
    "op6_nb_svm": nb_svm.query,
    "op7_chat_format": chat_format.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_token_parquet": token_store.query,
    "op10_gru_lm": gru_lm.query,
    "op11_warc_archive": warc.query,
    "op12_word_runs": word_runs.query,
    "op13_infill": infill.query,
}

ORACLE_SQL = {
    "op2_mixing": mixing.SQL,
    "op3_line_chunks": line_chunks.SQL,
    "op5_jaccard_join": jaccard_join.SQL,
    "op7_chat_format": chat_format.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op11_warc_archive": warc.SQL,
    "op13_infill": infill.SQL,
}
