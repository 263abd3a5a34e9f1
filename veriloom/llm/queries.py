"""The dealt operators as queries over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fill_in_middle, language_id, media, mixing, packing, phrases, secrets, simhash, slack_packing, substring_dedup, token_store, url_filter


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def op5_bit_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digest(documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_report(documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(documents(spark, sf_dir))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(documents(spark, sf_dir))


def op9_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fim_report(documents(spark, sf_dir))


def op13_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack_packing.packing_report(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_language_id": op2_language_id,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_bit_plane_tokens": op5_bit_plane_tokens,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_media_chunks": op9_media_chunks,
    "op10_mixing": op10_mixing,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_slack_packing": op13_slack_packing,
}
ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.ORACLE_SQL,
    "op4_url_filter": url_filter.ORACLE_SQL,
    "op6_substring_dedup": substring_dedup.ORACLE_SQL,
    "op11_phrase_collocations": phrases.ORACLE_SQL,
    "op12_fill_in_middle": fill_in_middle.ORACLE_SQL,
}
