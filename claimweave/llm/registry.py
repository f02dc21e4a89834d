"""Queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from claimweave.llm import bpe_codec, co_training, decontaminate, host_rules, matroska, minmax_dedup, ranked_search, reply_trees, source_mixing, token_counts, url_filter, whitening, zip_warc

QUERIES = {
    "op1_reply_trees": reply_trees.query,
    "op2_token_counts": token_counts.query,
    "op3_source_mixing": source_mixing.query,
    "op4_co_training": co_training.query,
    "op5_host_rules": host_rules.query,
    "op6_matroska": matroska.query,
    "op7_url_filter": url_filter.query,
    "op8_minmax_dedup": minmax_dedup.query,
    "op9_zip_warc": zip_warc.query,
    "op10_bpe_codec": bpe_codec.query,
    "op11_aho_corasick": decontaminate.query,
    "op12_whitening": whitening.query,
    "op13_ranked_search": ranked_search.query,
}
ORACLES = {"op9_zip_warc": zip_warc.ORACLE, "op3_source_mixing": source_mixing.ORACLE, "op1_reply_trees": reply_trees.ORACLE, "op5_host_rules": host_rules.ORACLE, "op8_minmax_dedup": minmax_dedup.ORACLE, "op11_aho_corasick": decontaminate.ORACLE, "op13_ranked_search": ranked_search.ORACLE}
