"""The registered queries of the corpus operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldgauge.llm import decision_list, decontaminate, importance, licenses, line_dedup, merkle, near_dup, pii, quality_model, sentencepiece_bpe, sharding, toxicity, url_filter
from fieldgauge.llm.common import table


def piece_model() -> str:
    """The model file of the installed tokenizer package."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_blocks", F.array_join("licenses", ",").alias("licenses"), F.to_json("findings").alias("findings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"), min_chars=line_dedup.ALL_LINES)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.graded_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digest(table(spark, sf_dir, "documents"), piece_model())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a fixed one here, so that runs agree; a user passes a secret."""
    done = pii.pseudonymized(table(spark, sf_dir, "documents").select("doc_id", "text"), key="registered query")
    return done.select("doc_id", F.size("kinds").cast("long").alias("n_values"), F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"), "text")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filtered_urls(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_line_dedup, op3_quality_classifier, op4_sentencepiece, op5_toxicity, op6_decontamination, op7_pseudonyms, op8_quality_rules, op9_sharding, op10_near_duplicates, op11_merkle_manifest, op12_importance_resampling, op13_url_filters)}


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": decontaminate.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_importance_resampling": importance.ORACLE, "op13_url_filters": url_filter.ORACLE}
