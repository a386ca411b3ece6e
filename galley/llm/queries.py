"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, licences, media, oracles, pages, pii, quality, simhash, substrings, token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.op1_pii,
        "op2_licences": licences.op2_licences,
        "op3_token_files": token_files.op3_token_files,
        "op4_main_text": pages.op4_main_text,
        "op5_quality": quality.op5_quality,
        "op6_simhash": simhash.op6_simhash,
        "op7_substring_dedup": substrings.op7_substring_dedup,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_png_media": media.op9_png_media,
        "op10_byte_bpe": bpe.op10_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_licences": oracles.licences(), "op7_substring_dedup": oracles.SUBSTRINGS, "op8_decontaminate": oracles.DECONTAMINATE}
