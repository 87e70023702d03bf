"""Queries of the training-data operators and their DuckDB forms."""

from __future__ import annotations

from . import (
    content_sort, fill_middle, html_extract, line_rules, merkle, mixing, near_dup, packing, quality_rank, secret_scan,
    simhash_join, token_scan, url_filter,
)
from .runtime import table


def op2_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op1_chosen_path": near_dup.op1_chosen_path,
    "op2_url_filter": op2_url_filter,
    "op5_separator_scan": token_scan.op5_separator_scan,
    "op6_content_sort": content_sort.op6_content_sort,
    "op3_temperature_mixing": mixing.op3_temperature_mixing,
    "op4_bradley_terry": quality_rank.op4_bradley_terry,
    "op7_randomness_battery": secret_scan.op7_randomness_battery,
    "op8_line_rules": line_rules.op8_line_rules,
    "op9_dom_trees": html_extract.op9_dom_trees,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_pigeonhole": simhash_join.op11_pigeonhole,
    "op12_superblock_manifest": merkle.op12_superblock_manifest,
    "op13_distinct_text_cuts": fill_middle.op13_distinct_text_cuts,
}

ORACLES = {
    "op2_url_filter": url_filter.ORACLE,
    "op3_temperature_mixing": mixing.oracle(),
    "op6_content_sort": content_sort.ORACLE,
    "op8_line_rules": line_rules.ORACLE,
    "op12_superblock_manifest": merkle.ORACLE,
    "op13_distinct_text_cuts": fill_middle.ORACLE,
}
