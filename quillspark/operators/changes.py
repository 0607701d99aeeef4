"""Change detection, merges, integrity checks and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import staged


def change_set(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """(path, status) by content hash: new, changed, unchanged or deleted."""
    a, b = scanned.select("path", F.col("content_hash").alias("now")), known.select("path", F.col("content_hash").alias("before"))
    status = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("before"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


CHECKS = ["orphan_chunks", "orphan_vectors_chunk", "orphan_vectors_file", "missing_parent", "files_without_chunks", "child_without_vector", "drift_path", "drift_filename", "drift_extension", "drift_category", "drift_year", "drift_file_id"]
COPIES = ["path", "filename", "extension", "category", "year"]


def integrity_checks(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(check_name, n) of twelve checks. Differences by plain inequality, so that nulls never count, but for years.

    Chunks are read once, for their ids; vectors meet files once, for all drifts. Then one outer join per key: chunks with
    vectors, chunks counted per file with files, children counted per parent with ids.
    """
    ids = staged(chunks.select("id", "file_id", "parent_id"), "chunk-ids")
    f = files.select(F.col("id").alias("f_id"), *(F.col(x).alias(f"f_{x}") for x in COPIES))
    differ = {x: F.col(x) != F.col(f"f_{x}") for x in COPIES[:-1]} | {"year": F.coalesce("year", F.lit(-1)) != F.coalesce("f_year", F.lit(-1))}
    known = F.col("f_id").isNotNull()
    v = vectors.select("chunk_id", "file_id", *COPIES).join(f, F.col("file_id") == F.col("f_id"), "left")
    v = staged(v.select("chunk_id", F.col("file_id").alias("v_file_id"), (~known).alias("orphan"), *((known & F.coalesce(d, F.lit(False))).alias(f"drift_{x}") for x, d in differ.items())), "vector-checks")
    pairs = ids.withColumn("c", F.lit(True)).join(v.withColumn("v", F.lit(True)), F.col("id") == F.col("chunk_id"), "full_outer")
    here, there = F.col("c").isNotNull(), F.col("v").isNotNull()
    met = pairs.agg(
        F.count_if(~here).alias("orphan_vectors_chunk"),
        F.count_if(~there & F.col("parent_id").isNotNull()).alias("child_without_vector"),
        F.count_if(here & there & (F.col("v_file_id") != F.col("file_id"))).alias("drift_file_id"),
    )
    own = v.agg(F.count_if("orphan").alias("orphan_vectors_file"), *(F.count_if(f"drift_{x}").alias(f"drift_{x}") for x in COPIES))
    held = ids.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).join(files.select(F.col("id").alias("f_id")), F.col("file_id") == F.col("f_id"), "full_outer")
    held = held.agg(F.coalesce(F.sum(F.when(F.col("f_id").isNull(), F.col("n"))), F.lit(0)).alias("orphan_chunks"), F.count_if(F.col("n").isNull()).alias("files_without_chunks"))
    parents = ids.filter("parent_id IS NOT NULL").groupBy("parent_id").agg(F.count(F.lit(1)).alias("n")).join(ids.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
    parents = parents.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("missing_parent"))
    # four single rows side by side
    row = met.crossJoin(own).crossJoin(held).crossJoin(parents)
    return row.select(F.explode(F.array(*(F.struct(F.lit(x).alias("check_name"), F.col(x).alias("n")) for x in CHECKS))).alias("x")).select("x.*")


def repaired(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orphans deleted from the outside in, then the vectors' copies of file columns renewed.

    What stays is found on ids alone, which are stored between the steps; the tables themselves are filtered once at the end.
    """
    c = staged(chunks.select("id", "file_id", "parent_id").join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi"), "kept-chunks")
    top, under = c.filter("parent_id IS NULL"), c.filter("parent_id IS NOT NULL")
    under = under.join(c.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    v = vectors.select("chunk_id", "file_id").join(top.unionByName(under).select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    under = under.join(v.select(F.col("chunk_id").alias("id")), "id", "left_semi")
    c = staged(top.unionByName(under).select("id", "file_id"), "kept-chunks")
    files = files.join(c.select(F.col("file_id").alias("id")), "id", "left_semi")
    chunks = chunks.join(c.select("id"), "id", "left_semi")
    copies = [x for x in COPIES if x in vectors.columns]
    vectors = vectors.drop(*copies).join(c.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    return files, chunks, vectors.join(files.select(F.col("id").alias("file_id"), *copies), "file_id")



def merged_failures(known: DataFrame, new: DataFrame) -> DataFrame:
    """Failures by key; the counter goes on only if hash and error code are the same (null-safe), else starts at 1."""
    keys = ["source_provider", "source_item_id"]
    k, m = known.alias("k"), new.alias("m")
    same = (F.col("k.content_hash") == F.col("m.content_hash")) & F.col("k.error_code").eqNullSafe(F.col("m.error_code"))
    count = F.when(F.col("m.source_item_id").isNull(), F.col("k.failures")).when(same, F.col("k.failures") + 1).otherwise(1)
    is_new = F.col("m.source_item_id").isNotNull()
    pick = lambda c: F.when(is_new, F.col(f"m.{c}")).otherwise(F.col(f"k.{c}")).alias(c)
    on = [F.col(f"k.{x}") == F.col(f"m.{x}") for x in keys]
    return k.join(m, on, "full_outer").select(*(F.coalesce(f"k.{x}", f"m.{x}").alias(x) for x in keys), pick("content_hash"), pick("error_code"), count.cast("long").alias("failures"))


def upserted(known: DataFrame, new: DataFrame, keys: list[str], keep_if_null: list[str] = ()) -> DataFrame:
    """New rows over known ones; columns of ``keep_if_null`` keep the known value where the new one is null."""
    k, m = known.alias("k"), new.alias("m")
    has = F.col(f"m.{keys[0]}").isNotNull()
    cols = []
    for c in known.columns:
        value = F.coalesce(f"m.{c}", f"k.{c}") if c in keys or c in keep_if_null else F.when(has, F.col(f"m.{c}")).otherwise(F.col(f"k.{c}"))
        cols.append(value.alias(c))
    return k.join(m, [F.col(f"k.{x}") == F.col(f"m.{x}") for x in keys], "full_outer").select(*cols)


def last_write(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Last row per key: what a replacing sink leaves."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("nth = 1").drop("nth")


def without(rows: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """Delete by key: cascades are the same call on each table."""
    return rows.join(gone.select(on), on, "left_anti")


def inserted_once(known: DataFrame, new: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """(key, status) of idempotent inserts: inserted, no_op, or conflict where the payload hash differs."""
    digest = F.sha2(F.to_json(F.struct(*payload)), 256).alias("digest")
    a, b = new.select(key, digest), known.select(key, digest.alias("held"))
    status = F.when(F.col("held").isNull(), "inserted").when(F.col("held") == F.col("digest"), "no_op").otherwise("conflict")
    return a.join(b, key, "left").select(key, status.alias("status"))
