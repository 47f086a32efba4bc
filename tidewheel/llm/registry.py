"""Queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline

from . import byte_bpe, collocations, exact_dedup, jaccard, katz, mixing, pair_merge, prefix_counts, quality, sharding, spelling, token_files, tool_calls


def queries():
    return {
        "op1_katz": katz.op1_katz,
        "op2_tool_calls": tool_calls.op2_tool_calls,
        "op3_jaccard_join": jaccard.op3_jaccard_join,
        "op4_byte_bpe": byte_bpe.op4_byte_bpe,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_token_files": token_files.op6_token_files,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_mixing": mixing.op8_mixing,
        "op9_token_counts": prefix_counts.op9_token_counts,
        "op10_sharding": sharding.op10_sharding,
        "op11_spelling": spelling.op11_spelling,
        "op12_pair_merge": pair_merge.op12_pair_merge,
        "op13_collocations": collocations.op13_collocations,
        "quality_ablation": quality.quality_ablation,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op2_tool_calls": tool_calls.ORACLE,
        "op5_exact_dedup": exact_dedup.ORACLE,
        "op7_quality_rules": quality.ORACLE,
        "op13_collocations": collocations.ORACLE,
        "quality_ablation": quality.ABLATION_ORACLE,
    }
