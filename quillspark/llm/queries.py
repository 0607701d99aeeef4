"""The training-data operators as queries over the test tables, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(common.table(spark, sf_dir, "documents"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_digest

    return token_digest(common.table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_digest

    return line_digest(common.table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_digest

    return substring_digest(common.table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(common.table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_pages

    return extract_pages(common.table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_digest

    return warc_digest(common.table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaked_items

    return leaked_items(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_verdicts

    return quality_verdicts(common.table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(common.table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine_hard_negatives, relabelled

    return mine_hard_negatives(common.table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, relabelled())


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(common.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_token_ids, op3_line_dedup, op4_substring_dedup, op5_mixing, op6_html_text, op7_warc, op8_decontamination, op9_quality_rules, op10_near_dedup, op11_source_divergence, op12_hard_negatives, op13_ngram_join)}


def oracle_sql() -> dict[str, str]:
    from . import divergence, hard_negatives, line_dedup, mixing, near_dedup, ngram_join, quality, substring_dedup

    return {"op3_line_dedup": line_dedup.ORACLE_SQL, "op4_substring_dedup": substring_dedup.ORACLE_SQL, "op5_mixing": mixing.ORACLE_SQL, "op9_quality_rules": quality.ORACLE_SQL, "op10_near_dedup": near_dedup.ORACLE_SQL, "op11_source_divergence": divergence.ORACLE_SQL, "op12_hard_negatives": hard_negatives.ORACLE_SQL, "op13_ngram_join": ngram_join.ORACLE_SQL}
