"""Gates between retrieval and answer: evidence profiles, relevance, diversity, scope and focus, each per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import text as T
from .retrieval import several, title_overlap

#: Least candidates that a filter must leave; limits of the gates.
LEAST_CANDIDATES = 8
FOCUSED_RELEVANCE, COVERAGE_RELEVANCE = 0.03, 0.02
COVERAGE_SOURCES, COVERAGE_CHUNKS = 3, 8


def evidence_profile(chunks: DataFrame) -> DataFrame:
    """(query_id, chunk, narrative, structural and substantive counts, substantive_ratio); unknown blocks count as substantive."""
    kind = F.lower(F.trim(F.coalesce("block_type", F.lit(""))))
    structural = kind.isin(R.STRUCTURAL_BLOCKS)
    rows = chunks.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.count_if(kind == "narrative").alias("narrative_count"), F.count_if(structural).alias("structural_count"), F.count_if(~structural).alias("substantive_count"))
    return rows.withColumn("substantive_ratio", F.round(F.col("substantive_count") / F.col("chunk_count"), 6)).withColumn("structural_only", (F.col("structural_count") > 0) & (F.col("substantive_count") == 0))


def retrieval_gates(chunks: DataFrame, query_type: Column, anchored: Column) -> DataFrame:
    """Per query: mean of the first three sigmoid scores, distinct sources, and whether each gate lets the answer pass."""
    rows = chunks.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).withColumn("mode", query_type).withColumn("anchored", anchored)
    out = rows.groupBy("query_id", "mode", "anchored").agg(F.round(F.avg(F.when(F.col("nth") <= 3, T.sigmoid(F.col("score")))), 6).alias("relevance"), F.count_distinct("file_id").alias("n_sources"), F.count(F.lit(1)).alias("n_chunks"))
    coverage = F.col("mode") == "coverage"
    relevant = F.when(coverage, F.col("relevance") >= COVERAGE_RELEVANCE).otherwise(F.col("anchored") | (F.col("relevance") >= FOCUSED_RELEVANCE))
    out = out.withColumn("relevant", relevant).withColumn("diverse", ~coverage | (F.col("n_sources") >= 2))
    return out.withColumn("floor_reached", coverage & (F.col("n_sources") >= COVERAGE_SOURCES) & (F.col("n_chunks") >= COVERAGE_CHUNKS))


def continuation_gate(prior: Column, current: Column, continues: Column, reset: Column) -> Column:
    """(passed, overlap): a continuation needs a source in common with what it continues, unless its scope starts anew."""
    overlap = F.size(F.array_intersect(prior, current))
    return F.struct((~continues | reset | (overlap > 0)).alias("passed"), overlap.alias("overlap"))


def without_structural(candidates: DataFrame, top_k: int) -> DataFrame:
    """Leaves structural snippets out of a query's candidates if enough others remain."""
    whole = Window.partitionBy("query_id")
    structural = R.structural_snippet(F.col("content"))
    rows = candidates.withColumn("_out", structural).withColumn("_left", F.count_if(~F.col("_out")).over(whole)).withColumn("_all", F.count(F.lit(1)).over(whole))
    return rows.filter(~F.col("_out") | (F.col("_left") < max(top_k, LEAST_CANDIDATES)) | (F.col("_all") <= 1)).drop("_out", "_left", "_all")


def title_focus(candidates: DataFrame) -> DataFrame:
    """Keeps the files whose names share the most terms with the question, if any shares one; candidates without a file go then."""
    shared = F.when(F.col("file_id").isNotNull(), title_overlap()).otherwise(0)
    rows = candidates.withColumn("_many", several()).withColumn("_file", F.max(shared).over(Window.partitionBy("query_id", "file_id"))).withColumn("_best", F.max(shared).over(Window.partitionBy("query_id")))
    return rows.filter(~F.col("_many") | (F.col("_best") == 0) | (F.col("_file") == F.col("_best"))).drop("_many", "_file", "_best")


def merged_sources(sources: DataFrame) -> DataFrame:
    """The last row of each path and file name within an answer."""
    last = Window.partitionBy("answer_id", "path", "filename").orderBy(F.desc("seq"))
    return sources.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth")


def followup_file(answers: DataFrame) -> DataFrame:
    """(chat_id, filename): the one file that the newest answer with a single source file rests on."""
    rows = answers.withColumn("names", F.array_distinct(F.filter(F.transform("filenames", lambda x: F.trim(x)), lambda x: x != ""))).filter(F.size("names") == 1)
    return rows.groupBy("chat_id").agg(F.max_by(F.col("names")[0], "turn").alias("filename"))


def retry_suppressed(scanned: DataFrame, failures: DataFrame) -> DataFrame:
    """Adds ``skip`` and its ``error_code``: a failure that can't be retried, of the same content."""
    keys = ["source_provider", "entity_type", "source_item_id"]
    bad = failures.filter("retryable = 0").select(*keys, F.col("content_hash").alias("_hash"), F.col("error_code").alias("_code"))
    rows = scanned.join(bad, keys, "left").withColumn("skip", F.coalesce(F.col("_hash") == F.col("content_hash"), F.lit(False)))
    return rows.withColumn("error_code", F.when(F.col("skip"), F.col("_code"))).drop("_hash", "_code")


def upload_orphans(listed: DataFrame, attachments: DataFrame) -> DataFrame:
    """Stored uploads of a chat that no live attachment names."""
    live = attachments.filter("deleted_at IS NULL").select("chat_id", "stored_name")
    return listed.join(live, ["chat_id", "stored_name"], "left_anti")
