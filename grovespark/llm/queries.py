"""The registered queries of the text operators and their DuckDB twins."""

from __future__ import annotations

from grovespark.llm import blocks, bytebpe, decontam, divergence, fm, lexical, linerules, packing, pii, simhash, urllists, warc, wordpiece


def queries() -> dict:
    return {
        "op1_warc": warc.query,
        "op2_best_fit_packing": packing.query,
        "op3_factorisation_machine": fm.query,
        "op4_line_rules": linerules.query,
        "op5_recurrent_blocks": blocks.query,
        "op6_simhash": simhash.query,
        "op7_pii": pii.query,
        "op8_decontamination": decontam.query,
        "op9_wordpiece_counts": wordpiece.query,
        "op10_url_lists": urllists.query,
        "op11_source_divergence": divergence.query,
        "op12_byte_bpe": bytebpe.query,
        "op13_lexical_search": lexical.query,
    }


def oracle_sql() -> dict:
    return {
        "op1_warc": warc.ORACLE_SQL,
        "op4_line_rules": linerules.ORACLE_SQL,
        "op10_url_lists": urllists.ORACLE_SQL,
        "op11_source_divergence": divergence.ORACLE_SQL,
        "op13_lexical_search": lexical.ORACLE_SQL,
    }
