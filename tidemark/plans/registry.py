"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import annotation_queries, catalog_queries, curation_queries, identity_queries, join_queries, lint_queries, media_queries, patch_queries, postprocess_queries, prompt_queries, retrieval_queries, rule_queries, score_queries, source_queries, stream_queries, study_queries, timeline_queries

MODULES = (media_queries, timeline_queries, score_queries, join_queries, retrieval_queries, rule_queries, annotation_queries, catalog_queries, stream_queries, lint_queries, postprocess_queries, curation_queries, identity_queries, prompt_queries, patch_queries, study_queries, source_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline_queries.gap_timeline(spark, sf_dir)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
