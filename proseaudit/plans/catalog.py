"""Imports every module that registers queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proseaudit.plans import corpus, queries_fleet, queries_model, queries_names, queries_review, queries_rules, queries_suggest, review  # noqa: F401


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return review.worst_documents(corpus.documents(spark, folder))
