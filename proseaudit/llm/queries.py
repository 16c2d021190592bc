"""The registered query of each operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from proseaudit.llm import collocations, decontamination, embedding_dedup, filter_audit, jaccard_join, line_dedup, mixing, packing, pii, quality, recompression, rollups, store, suffixes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_quality_rules")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_mixture_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op5_line_dedup", line_dedup.SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup(table(spark, folder, "documents"))
    return kept.select("doc_id", F.col("__line_n").alias("n_lines"), F.col("__line_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op10_mixing_weights")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = mixing.mix(table(spark, folder, "documents"))
    return rows.select("doc_id", *[F.col(f"__{c}").alias(c) for c in mixing.MARGINS], F.col("__p").alias("probability"), F.col("__kept").alias("kept"))


@query("op6_ngram_jaccard_join")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.classes(table(spark, folder, "documents")).drop("key", "component")


@query("op8_substring_recompression")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    kept = recompression.dedup(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op9_suffix_array_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    kept = suffixes.dedup(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_pii")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, folder, "documents")))


@query("op7_token_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Estimates first, exact counts as revisions, then toxic documents leave; the last batch is sent twice."""
    rows = store.written(rollups.counted(table(spark, folder, "documents")), "counts")
    totals = rollups.Rollup(spark, store.new_path(spark, "rollup"))
    totals.commit(1, rollups.changes(rows, "insert", {"byte_bpe_50k": "n_bytes div 4", "words": "n_words"}))
    totals.commit(2, rollups.changes(rows, "revise", {"byte_bpe_50k": "n_tokens"}))
    toxic = table(spark, folder, "labels").where("toxic = 1").select("doc_id")
    gone = rollups.changes(rows.join(toxic, "doc_id", "left_semi"), "delete", {"byte_bpe_50k": "0", "words": "0"})
    for _ in range(2):
        totals.commit(3, gone)
    return totals.totals()


@query("op4_embedding_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, folder, "embeddings"))


@query("op11_benchmark_decontamination", decontamination.SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.digest(decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


@query("op12_filter_audit", filter_audit.SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_phrase_collocations", collocations.SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))
