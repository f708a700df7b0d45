"""The queries of the training-data operators, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricewright.llm import audit, collocation, cutting, embdedup, minhash, mixing, oracles, packing, secrets, sharding, substring, tokenfile, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        mixing.op1_mixture, minhash.op2_minhash, embdedup.op3_binary_codes, substring.op4_seed_and_extend, topk.op5_cover_trees,
        tokenfile.op6_token_files, packing.op7_best_fit, secrets.op8_secret_scan, sharding.op9_histogram_sort, toxicity.op10_toxicity,
        collocation.op11_collocations, audit.op12_filter_audit, cutting.op13_cutting_stock,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_minhash": oracles.minhash(),
        "op3_binary_codes": oracles.vectors(),
        "op4_seed_and_extend": oracles.substrings(),
        "op5_cover_trees": oracles.top_k(),
        "op8_secret_scan": oracles.secret_spans(),
        "op11_collocations": oracles.collocations(),
        "op12_filter_audit": oracles.filter_audit(),
    }
