"""Queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ctw, decontaminate, language, licenses, merkle, mixing, ngrams, periods, quality, sharding, simhash, substrings, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_wu_manber": decontaminate.op2_wu_manber,
        "op3_mix_sources": mixing.op3_mix_sources,
        "op4_context_tree": ctw.op4_context_tree,
        "op5_offset_tokens": tokens.op5_offset_tokens,
        "op6_substring_doubling": substrings.op6_substring_doubling,
        "op7_language_crf": language.op7_language_crf,
        "op8_jump_sharding": sharding.op8_jump_sharding,
        "op9_simhash_anchors": simhash.op9_simhash_anchors,
        "op10_license_rules": licenses.op10_license_rules,
        "op11_periodic_runs": periods.op11_periodic_runs,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_ngram_join": ngrams.op13_ngram_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.OP1_SQL, "op2_wu_manber": decontaminate.OP2_SQL, "op6_substring_doubling": substrings.OP6_SQL, "op11_periodic_runs": periods.OP11_SQL, "op12_merkle_manifest": merkle.OP12_SQL, "op13_ngram_join": ngrams.OP13_SQL}
