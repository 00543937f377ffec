"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from termtrail.llm import (byte_bpe, common, decontam, html_wrapper, merkle, near_duplicates, packing, periodic_runs,
                           quality, substring, token_file, toxicity, url_filter, winnow)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {
    "op1_token_file": token_file.query,
    "op2_html_wrapper": html_wrapper.query,
    "op3_packing": packing.query,
    "op4_near_duplicates": near_duplicates.query,
    "op5_url_filter": url_filter.query,
    "op6_toxicity": toxicity.query,
    "op7_substring_dedup": substring.query,
    "op8_quality": quality.query,
    "op9_decontamination": decontam.query,
    "op10_winnowing": winnow.query,
    "op11_merkle": merkle.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_byte_bpe": byte_bpe.query,
    "pipeline": corpus_pipeline.run,
}


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.ship(spark)
        return query(spark, sf_dir)
    return run


def queries() -> dict[str, Query]:
    return {name: _shipped(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_url_filter": url_filter.ORACLE_SQL,
        "op7_substring_dedup": substring.ORACLE_SQL,
        "op9_decontamination": decontam.ORACLE_SQL,
        "op11_merkle": merkle.ORACLE_SQL,
    }
