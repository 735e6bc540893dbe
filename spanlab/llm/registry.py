"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanlab.llm import (
    decontaminate,
    dialog_repair,
    filter_audit,
    language_id,
    lm_quality,
    ngram_join,
    packing,
    quality_rules,
    secret_scan,
    substring_dedup,
    token_counts,
    url_filter,
    warc,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_quality_lm": lm_quality.op2_quality_lm,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op5_language_id": language_id.op5_language_id,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_warc": warc.op7_warc,
        "op8_packing": packing.op8_packing,
        "op9_secret_ledger": secret_scan.op9_secret_ledger,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_dialog_repair": dialog_repair.op11_dialog_repair,
        "op12_token_counts": token_counts.op12_token_counts,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.ORACLE,
        "op3_substring_dedup": substring_dedup.ORACLE,
        "op4_ngram_join": ngram_join.ORACLE,
        "op7_warc": warc.ORACLE,
        "op10_url_filter": url_filter.ORACLE,
        "op11_dialog_repair": dialog_repair.ORACLE,
        "op13_filter_audit": filter_audit.ORACLE,
    }
