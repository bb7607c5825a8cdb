"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embed_dedup, exact_dedup, licenses, line_dedup, mixing, simhash, token_binary, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        licenses.op1_licenses,
        mixing.op2_mixing,
        exact_dedup.op3_exact_dedup,
        toxicity.op4_toxicity,
        embed_dedup.op5_embedding_dedup,
        warc.op6_warc,
        line_dedup.op7_line_dedup,
        token_binary.op8_token_binary,
        simhash.op9_simhash,
        bpe.op10_bpe,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.SQL, "op3_exact_dedup": exact_dedup.SQL, "op6_warc": warc.SQL}
