"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import (
    op01_langid,
    op02_licenses,
    op03_warc,
    op04_simhash,
    op05_tokens,
    op06_preferences,
    op07_mix,
    op08_decontaminate,
    op09_quality,
    op10_lines,
    op11_passages,
    op12_merkle,
    op13_drake,
)

QUERIES = {
    "op1_byte_conv_langid": op01_langid.query,
    "op2_license_templates": op02_licenses.query,
    "op3_warc_chains": op03_warc.query,
    "op4_simhash_near_dedup": op04_simhash.query,
    "op5_transducer_token_counts": op05_tokens.query,
    "op6_preference_pairs": op06_preferences.query,
    "op7_cube_mix": op07_mix.query,
    "op8_simhash_decontamination": op08_decontaminate.query,
    "op9_adaptive_quality": op09_quality.query,
    "op10_fuzzy_lines": op10_lines.query,
    "op11_repeated_passages": op11_passages.query,
    "op12_merkle_manifest": op12_merkle.query,
    "op13_drake_clusters": op13_drake.query,
}
ORACLE_SQL = {
    "op3_warc_chains": op03_warc.ORACLE_SQL,
    "op6_preference_pairs": op06_preferences.ORACLE_SQL,
    "op11_repeated_passages": op11_passages.ORACLE_SQL,
    "op12_merkle_manifest": op12_merkle.ORACLE_SQL,
    "op13_drake_clusters": op13_drake.ORACLE_SQL,
}
