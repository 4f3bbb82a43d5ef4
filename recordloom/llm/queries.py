"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import bpe, jaccard, licenses, media, mixing, neighbours, quality, shards, substrings, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_jaccard": jaccard.op2_jaccard,
        "op3_neighbours": neighbours.op3_neighbours,
        "op4_media": media.op4_media,
        "op5_licenses": licenses.op5_licenses,
        "op6_substrings": substrings.op6_substrings,
        "op7_shards": shards.op7_shards,
        "op8_quality": quality.op8_quality,
        "op9_bpe": bpe.op9_bpe,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard": jaccard.OP2_SQL, "op6_substrings": substrings.OP6_SQL, "op10_mixing": mixing.OP10_SQL}
