"""Indexing of scanned files: classify, clean, chunk, embed and store, each file as a whole or not at all.

A batch goes through Spark jobs for all its files; per file nothing is half done: a file with any fault keeps what was
committed before, and a batch becomes visible by one manifest (``sources.versions``). Running a batch again finds its files
unchanged and writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import embedding
from ..functions import rules as R
from ..functions import text as T
from ..sources.versions import Store, new_batch
from . import chunking

#: Codes of faults, the limits behind them, and the codes that no retry can mend.
MAX_BYTES, MAX_LINE = 100 << 20, 200_000
FINAL = ["file_too_large", "text_pathological_line_length", "no_extractor"]
#: Bits of a chunk's id below its file's.
ORDINAL_BITS = 24
TABLES = ["files", "chunks", "vectors", "failures"]


def fault(size: Column, extension: Column, text: Column) -> Column:
    """The code of what bars a file, or null."""
    return (
        F.when(size > MAX_BYTES, "file_too_large")
        .when(~extension.isin(list(T.CATEGORIES)), "no_extractor")
        .when((F.length(text) > MAX_LINE) & (T.longest_line(text) > MAX_LINE), "text_pathological_line_length")
        .when(~text.rlike(r"\S"), "empty_text")
    )


def described(files: DataFrame) -> DataFrame:
    """Adds category, year, tags and the cleaned text."""
    return files.withColumn("category", T.category_of(F.col("extension"))).withColumn("year", T.year_of(F.col("filename"), F.col("path"), F.col("text"))).withColumn("tags", T.tags_of(F.col("path"))).withColumn("text", T.clean_glyphs(F.col("text")))


def chunk_rows(files: DataFrame, parent_budget: int, child_budget: int, overlap: int) -> DataFrame:
    """(file_id, id, parent_id, ordinal, content, section, place) of all chunks; children that are only table heads are left out."""
    rows = chunking.budget_chunks(files.select(F.col("file_id").alias("doc_id"), "text"), parent_budget, child_budget, overlap)
    rows = rows.filter((F.col("child") < 0) | ~R.header_only(F.col("content")))
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("file_id").orderBy("parent", "child")).cast("long") - 1)
    base = F.shiftleft(F.col("file_id"), ORDINAL_BITS)
    first = F.min("ordinal").over(Window.partitionBy("file_id", "parent"))
    return rows.select("file_id", (base + F.col("ordinal")).alias("id"), F.when(F.col("child") >= 0, base + first).alias("parent_id"), "ordinal", "content", "section", "place")


def index_files(store: Store, scanned: DataFrame, removed: DataFrame | None = None, embed: Callable[[Column], Column] = embedding.embed, parent_budget: int = 512, child_budget: int = 150, overlap: int = 60) -> int:
    """Index (file_id, path, filename, extension, size_bytes, content_hash, text) and remove (file_id); returns the version.

    Files of unchanged content are left alone, and so are those that failed with this content for good. ``failures`` gets a row (file_id, content_hash, error_code, retryable) per file
    that could not be indexed: barred from the start, no chunk, more chunks than ids, a chunk without a vector or a parent.
    A file that is scanned and removed at once is removed. Of rows that repeat a file id the one of the smallest hash counts.
    """
    base, batch = store.manifest(), new_batch()
    scanned = scanned.withColumn("_nth", F.row_number().over(Window.partitionBy("file_id").orderBy("content_hash"))).filter("_nth = 1").drop("_nth")
    if removed is not None:
        scanned = scanned.join(removed.select("file_id"), "file_id", "left_anti")
    if base["batches"]:
        known = store.read("files", base).select("file_id", "content_hash")
        lost = failures(store, base).filter("NOT retryable").select("file_id", "content_hash")
        # by file alone, as the texts already lie by file
        done = known.union(lost).groupBy("file_id").agg(F.collect_set("content_hash").alias("_done"))
        scanned = scanned.join(done, "file_id", "left").filter(~F.coalesce(F.array_contains("_done", F.col("content_hash")), F.lit(False))).drop("_done")
    size, extension = F.col("size_bytes"), F.col("extension")
    rows = described(scanned.withColumn("error_code", fault(size, extension, F.coalesce("text", F.lit("")))))
    rows = store.stage(batch, "scanned", rows)
    good = rows.filter("error_code IS NULL")
    chunks = store.stage(batch, "chunks", chunk_rows(good, parent_budget, child_budget, overlap))
    children = chunks.filter("parent_id IS NOT NULL")
    vectors = store.stage(batch, "vectors", children.select("file_id", F.col("id").alias("chunk_id"), embed(F.col("content")).alias("vector")))
    # what each file has, from what has been stored
    held = chunks.groupBy("file_id").agg(F.count("parent_id").alias("children"), F.max("ordinal").alias("last"))
    stored = vectors.filter("vector IS NOT NULL").groupBy("file_id").agg(F.count(F.lit(1)).alias("vectors"))
    torn = children.join(chunks.filter("parent_id IS NULL").select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("file_id").distinct().withColumn("torn", F.lit(True))
    checked = good.select("file_id", "content_hash").join(held, "file_id", "left").join(stored, "file_id", "left").join(torn, "file_id", "left")
    code = (
        F.when(F.coalesce("children", F.lit(0)) == 0, "no_chunks")
        .when(F.col("last") >= 1 << ORDINAL_BITS, "too_many_chunks")
        .when(F.col("torn"), "parent_missing")
        .when(F.coalesce("vectors", F.lit(0)) != F.col("children"), "vector_missing")
    )
    failed = checked.withColumn("error_code", code).filter("error_code IS NOT NULL").select("file_id", "content_hash", "error_code")
    failed = failed.unionByName(rows.filter("error_code IS NOT NULL").select("file_id", "content_hash", "error_code"))
    failed = store.stage(batch, "failures", failed.withColumn("retryable", ~F.col("error_code").isin(FINAL)))
    files = good.join(failed.select("file_id"), "file_id", "left_anti")
    files = store.stage(batch, "files", files.drop("text", "error_code"))
    changes = files.select("file_id", F.lit(True).alias("live"))
    if removed is not None:
        changes = changes.union(removed.select("file_id", F.lit(False)).distinct())
    if changes.isEmpty() and failed.isEmpty():
        return base["version"]
    return store.commit(batch, TABLES, changes, base)


def failures(store: Store, manifest: dict | None = None) -> DataFrame:
    """(file_id, content_hash, error_code, retryable, failed): the last fault of each file since it was indexed or removed, and
    how many batches it has failed in."""
    manifest = manifest or store.manifest()
    batches = manifest["batches"]
    schema = "file_id long, content_hash string, error_code string, retryable boolean"
    if not batches:
        return store.spark.createDataFrame([], f"{schema}, failed long")
    place = F.create_map(*(F.lit(x) for k, b in enumerate(batches) for x in (b, k)))[F.col("batch")]
    rows = store.spark.read.schema(f"{schema}, batch string").parquet(f"{store.root}/failures").filter(F.col("batch").isin(batches)).withColumn("at", place)
    spoken = store.spark.read.schema("file_id long, live boolean, batch string").parquet(f"{store.root}/changes").filter(F.col("batch").isin(batches)).groupBy("file_id").agg(F.max(place).alias("since"))
    rows = rows.join(spoken, "file_id", "left").filter(F.col("since").isNull() | (F.col("at") > F.col("since")))
    last = lambda c: F.max_by(c, "at").alias(c)
    return rows.groupBy("file_id").agg(last("content_hash"), last("error_code"), last("retryable"), F.count(F.lit(1)).alias("failed"))
