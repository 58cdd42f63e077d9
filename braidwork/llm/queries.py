"""The queries opN_<name>, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontamination, fingerprints, language_id, line_dedup, lm_scoring, near_dedup, packing, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_line_dedup": line_dedup.query,
    "op3_packing": packing.query,
    "op4_fingerprints": fingerprints.query,
    "op5_lm_scoring": lm_scoring.query,
    "op6_near_dedup": near_dedup.query,
    "op7_toxicity": toxicity.query,
    "op8_chat_format": chat_format.query,
    "op9_language_id": language_id.query,
    "op10_decontamination": decontamination.query,
}
ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op6_near_dedup": near_dedup.ORACLE,
    "op8_chat_format": chat_format.ORACLE,
    "op10_decontamination": decontamination.ORACLE,
}
