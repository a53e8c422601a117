"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, license_scan, ngram_join, quality_classifier, quality_rules, secret_scan, source_mixing, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_source_mixing": source_mixing.op7_source_mixing,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

SQL = {
    "op4_ngram_join": ngram_join.OP4_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
    "op7_source_mixing": source_mixing.OP7_SQL,
}
