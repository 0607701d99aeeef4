"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, source mixing, token output.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; ``run`` writes each stage's
result as Parquet to the shared folder and reads it again as the next one's input. All but the last return the columns of
``documents``; the last returns a row per written document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common, decontaminate, mixing, near_dedup, quality, tokens


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted by their host's frequent lines, without these lines."""
    return quality.filter_quality(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more.

    Documents without an id are documents of their own. Rows that repeat an id and its text stay once: that with the smallest
    source, lang and n_chars. Rows of one id with different texts stay or go together. Blank texts stay.
    """
    nodes = near_dedup.Nodes(docs, "doc_id", "text")
    kept = near_dedup.verdicts(docs, nodes, words=5, percent=80).filter("kept").select(F.col("node").alias("_node")).distinct()
    order = [c for c in ("source", "lang", "n_chars") if c in docs.columns]
    # repeated rows lie together after the join, so that leaving one of them takes no further shuffle of the texts
    rows = docs.select(F.struct("*").alias("_row"), nodes.number.alias("_node"), F.xxhash64("text").alias("_text"), F.struct(*order or [F.lit(0)]).alias("_order")).join(kept.hint("merge"), "_node", "left_semi")
    return rows.groupBy("_node", "_text").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mixture reads them; the budget is what came in."""
    return mixing.mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder; a row per document read back from them."""
    return tokens.token_digest(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: MinHash candidates, block-max WAND and byte-level BPE are beyond SQL; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
