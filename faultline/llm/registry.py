"""Names of the registered training-data queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import oracles, queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in vars(q).items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": oracles.OP1, "op2_warc_revisits": oracles.OP2, "op6_substring_dedup": oracles.OP6,
            "op8_benchmark_decontamination": oracles.OP8, "op9_secret_scan": oracles.OP9,
            "op12_spelling_variants": oracles.OP12}
