"""Queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from . import op01_license, op02_chat_format, op03_url_filters, op04_decontaminate, op05_jaccard, op06_suffix_dedup, op07_quality_model, op08_secrets, op09_quality_rules, op10_packing

QUERIES = {
    "op1_license_scans": op01_license.op1_license_scans,
    "op2_chat_format": op02_chat_format.op2_chat_format,
    "op3_url_filters": op03_url_filters.op3_url_filters,
    "op4_decontamination": op04_decontaminate.op4_decontamination,
    "op5_ngram_jaccard": op05_jaccard.op5_ngram_jaccard,
    "op6_suffix_dedup": op06_suffix_dedup.op6_suffix_dedup,
    "op7_quality_classifier": op07_quality_model.op7_quality_classifier,
    "op8_secret_scans": op08_secrets.op8_secret_scans,
    "op9_quality_rules": op09_quality_rules.op9_quality_rules,
    "op10_best_fit_packing": op10_packing.op10_best_fit_packing,
}
ORACLES = {
    "op2_chat_format": op02_chat_format.ORACLE,
    "op3_url_filters": op03_url_filters.ORACLE,
    "op9_quality_rules": op09_quality_rules.ORACLE,
}
