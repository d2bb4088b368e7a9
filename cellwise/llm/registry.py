"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellwise.llm import decontam, exact_dedup, html_text, langid, packing, pii, sentencepiece, simhash, warc, wordpiece


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": langid.op1_langid,
        "op2_html": html_text.op2_html,
        "op3_pii": pii.op3_pii,
        "op4_sentencepiece": sentencepiece.op4_sentencepiece,
        "op5_simhash": simhash.op5_simhash,
        "op6_token_counts": wordpiece.op6_token_counts,
        "op7_decontamination": decontam.op7_decontamination,
        "op8_warc": warc.op8_warc,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_packing": packing.op10_packing,
        # Parts of the above that SQL can express.
        "llm_pii_base": pii.pii_base,
        "llm_held_out": langid.held_out_rows,
        "llm_word_counts": wordpiece.word_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_warc": warc.ORACLE,
        "op9_exact_dedup": exact_dedup.ORACLE,
        "llm_pii_base": pii.BASE_ORACLE,
        "llm_held_out": langid.HELD_OUT_ORACLE,
        "llm_word_counts": wordpiece.WORDS_ORACLE,
    }
