"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from stemloom.llm import ann, html_extract, mixing, packing, quality, secret_scan, simhash, substring_dedup, token_lengths, warc

QUERIES = {
    "op1_warc_normalise": warc.warc_query,
    "op2_drr_packing": packing.pack_query,
    "op3_learned_partitions": ann.ann_query,
    "op4_secret_entropy": secret_scan.secrets_query,
    "op5_html_subsequence": html_extract.extract_query,
    "op6_repeated_bytes": substring_dedup.repeats_query,
    "op7_token_lengths": token_lengths.lengths_query,
    "op8_simhash_trie": simhash.simhash_query,
    "op9_ipf_mixing": mixing.mixing_query,
    "op10_quality_rules": quality.quality_query,
}

#: The others are beyond SQL: their tests hold them against brute force.
SQL: dict[str, str] = {
    "op1_warc_normalise": warc.WARC_SQL,
    "op9_ipf_mixing": mixing.mixing_sql(),
    "op10_quality_rules": quality.quality_sql(),
}
