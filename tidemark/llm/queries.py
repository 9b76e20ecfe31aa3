"""Queries over the text tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, divergence, extract, langid, ledger, licenses, passages, pieces, prefixes, resample, rules, simhash, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": ledger.op1_token_counts,
        "op2_extract": extract.op2_extract,
        "op3_rules": rules.op3_rules,
        "op4_pieces": pieces.op4_pieces,
        "op5_licenses": licenses.op5_licenses,
        "op6_passages": passages.op6_passages,
        "op7_resample": resample.op7_resample,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_simhash": simhash.op10_simhash,
        "op11_divergence": divergence.op11_divergence,
        "op12_prefixes": prefixes.op12_prefixes,
        "op13_langid": langid.op13_langid,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_rules": rules.ORACLE, "op11_divergence": divergence.ORACLE, "op12_prefixes": prefixes.ORACLE}
