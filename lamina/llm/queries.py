"""The queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat_rotation,
    collocations,
    decontamination,
    html_extraction,
    merkle_manifest,
    mixing,
    ngram_join,
    pii,
    quality_classifier,
    quality_rules,
    secret_scans,
    trie_dedup,
    url_filters,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate(table(spark, sf_dir, "conversations"))


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, and rejects alone, from the ledger of operator 2."""
    return quality_rules.ablation_report(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.report(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.report(table(spark, sf_dir, "pages"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = url_filters.evaluate(url_filters.dated_captures(pages), url_filters.derived_entries(pages))
    return judged.withColumns({c: judged[c].cast("string") for c in ("fetched", "since")})


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


def op12_trie_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_dedup.duplicates(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_chat_rotation": op1_chat_rotation,
    "op2_quality_ledger": op2_quality_ledger,
    "quality_ablation": quality_ablation,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_decontaminate": op4_decontaminate,
    "op5_secret_scan": op5_secret_scan,
    "op6_ngram_join": op6_ngram_join,
    "op7_personal_data": op7_personal_data,
    "op8_html_extraction": op8_html_extraction,
    "op9_url_filters": op9_url_filters,
    "op10_mix_sources": op10_mix_sources,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_trie_dedup": op12_trie_dedup,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_rotation": chat_rotation.ORACLE_SQL,
    "op2_quality_ledger": quality_rules.ORACLE_SQL,
    "quality_ablation": quality_rules.ABLATION_SQL,
    "op4_decontaminate": decontamination.ORACLE_SQL,
    "op5_secret_scan": secret_scans.ORACLE_SQL,
    "op6_ngram_join": ngram_join.ORACLE_SQL,
    "op8_html_extraction": html_extraction.ORACLE_SQL,
    "op9_url_filters": url_filters.ORACLE_SQL,
    "op10_mix_sources": mixing.ORACLE_SQL,
    "op11_merkle_manifest": merkle_manifest.ORACLE_SQL,
    "op12_trie_dedup": trie_dedup.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}
