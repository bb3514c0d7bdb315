"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import leaks, licenses, lines, lm, pieces, quality, shards, simhash, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": pieces.op1_sentencepiece,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_simhash_neardup": simhash.op3_simhash_neardup,
        "op4_lm_scoring": lm.op4_lm_scoring,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_token_shards": shards.op6_token_shards,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_warc": warc.op8_warc,
        "op9_decontaminate": leaks.op9_decontaminate,
        "op10_line_dedup": lines.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": warc.OP8_SQL, "op9_decontaminate": leaks.OP9_SQL, "op10_line_dedup": lines.OP10_SQL}
