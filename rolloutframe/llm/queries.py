"""One query for each training-data operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat,
    decontaminate,
    fill_middle,
    knn_tree,
    line_dedup,
    packing,
    quality,
    ranked_search,
    repair,
    sharding,
    simhash,
    substring_dedup,
    warc,
)
from .common import table, vocabulary


def op1_knn_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_tree.digest(table(spark, sf_dir, "embeddings"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.mark_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op4_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_knn_tree": op1_knn_tree,
        "op2_decontamination": op2_decontamination,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_repair_tokens": op4_repair_tokens,
        "op5_simhash": op5_simhash,
        "op6_kd_sharding": op6_kd_sharding,
        "op7_line_dedup": op7_line_dedup,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_ranked_search": op12_ranked_search,
        "op13_warc": op13_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": decontaminate.ORACLE_SQL,
        "op3_substring_dedup": substring_dedup.ORACLE_SQL,
        "op7_line_dedup": line_dedup.ORACLE_SQL,
        "op9_chat_formatting": chat.ORACLE_SQL,
        "op11_fill_in_middle": fill_middle.ORACLE_SQL,
        "op12_ranked_search": ranked_search.ORACLE_SQL,
        "op13_warc": warc.ORACLE_SQL,
    }
