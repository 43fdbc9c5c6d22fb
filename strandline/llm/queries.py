"""The corpus operators' registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from strandline.llm import ann, bpe_codec, divergence, exact_dedup, hard_negatives, jaccard_join, main_text, mixing, packing, substring_dedup, token_counts, toxicity, warc

#: Query name -> module of this subpackage that defines it; ``ORACLE_SQL`` there is its oracle, if any.
MODULES = {
    "op1_token_counts": token_counts,
    "op2_substring_dedup": substring_dedup,
    "op3_exact_dedup": exact_dedup,
    "op4_jaccard_join": jaccard_join,
    "op5_bpe_codec": bpe_codec,
    "op6_toxicity": toxicity,
    "op7_warc": warc,
    "op8_main_text": main_text,
    "op9_mixing": mixing,
    "op10_nearest": ann,
    "op11_hard_negatives": hard_negatives,
    "op12_divergence": divergence,
    "op13_packing": packing,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The operators' queries and the pipeline's."""
    return {name: getattr(MODULES[name], name) for name in MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Oracle SQL where SQL can express the operator over whole tables."""
    found = {name: getattr(MODULES[name], "ORACLE_SQL", None) for name in MODULES} | {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in found.items() if v}
