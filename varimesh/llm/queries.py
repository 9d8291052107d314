"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, byte_bpe, exact, line_dedup, lm, packing, phrases, quality_model, quality_rules, secret_scan, simhash, toxicity
from .common import documents


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_attention_lm": lm.query,
        "op2_bpe": lambda spark, d: bpe.query(documents(spark, d)),
        "op3_quality_rules": quality_rules.query,
        "op4_toxicity": toxicity.query,
        "op5_line_dedup": line_dedup.query,
        "op6_simhash": lambda spark, d: simhash.query(documents(spark, d)),
        "op7_packing": lambda spark, d: packing.query(documents(spark, d)),
        "op8_exact_dedup": exact.query,
        "op9_quality_model": quality_model.query,
        "op10_secret_scan": secret_scan.query,
        "op11_phrases": lambda spark, d: phrases.query(documents(spark, d)),
        "op12_byte_bpe": lambda spark, d: byte_bpe.query(documents(spark, d)),
        "op13_alignment": lambda spark, d: alignment.query(documents(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": exact.SQL, "op11_phrases": phrases.SQL}
