"""Vector and full-text retrieval, candidate pools, biases and selection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import text as T
from ..functions import vectors as V
from .lineage import staged, staging


def nearest(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, digits: int = 6) -> DataFrame:
    """Exact cosine search: the filter goes to the scan, the top k are taken per task before they meet."""
    rows = vectors if where is None else vectors.filter(where)
    rows = rows.filter(F.size("vector") == len(query)).withColumn("distance", F.round(V.cosine_distance(F.col("vector"), query), digits))
    return rows.drop("vector").orderBy("distance", "chunk_id").limit(k)


def top_chunk_per_file(vectors: DataFrame, query: list[float], digits: int = 6) -> DataFrame:
    """Nearest chunk of each file."""
    rows = vectors.filter(F.size("vector") == len(query)).withColumn("distance", F.round(V.cosine_distance(F.col("vector"), query), digits)).drop("vector")
    w = Window.partitionBy("file_id").orderBy("distance", "chunk_id")
    return rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def with_files(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits of files that exist, in the order of the hits."""
    return hits.join(files.select(F.col("id").alias("file_id"), "filename", "extension", "category", "year", "content_hash", "source_provider"), "file_id")


def scoped_search(vectors: DataFrame, files: DataFrame, query: list[float], limit: int, category: str | None = None, extensions: list[str] | None = None, excluded: list[str] = ()) -> DataFrame:
    """Over-fetches threefold if filters follow, leaves excluded providers out, keeps the best hit per content."""
    fetch = 3 * limit if category or extensions else limit
    allowed = files.filter(~F.col("source_provider").isin(list(excluded))) if excluded else files
    hits = nearest(vectors.join(allowed.select(F.col("id").alias("file_id")), "file_id", "left_semi"), query, fetch)
    rows = with_files(hits, files)
    if category:
        rows = rows.filter(F.col("category") == category)
    if extensions:
        rows = rows.filter(F.col("extension").isin(extensions))
    w = Window.partitionBy("content_hash").orderBy("distance", "chunk_id")
    return rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth").orderBy("distance", "chunk_id").limit(limit)


def parent_chunks(hits: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """Best child per parent stands for the parent; a child whose parent is missing stands for itself."""
    rows = hits.select("chunk_id", "score").join(children.select(F.col("id").alias("chunk_id"), "parent_id", F.col("content").alias("child_content"), "file_id"), "chunk_id")
    rows = rows.join(parents.select(F.col("id").alias("parent_id"), F.col("content").alias("parent_content")), "parent_id", "left")
    unit = F.when(F.col("parent_content").isNotNull(), F.col("parent_id")).otherwise(F.col("chunk_id"))
    rows = rows.select(unit.alias("id"), "file_id", F.coalesce("parent_content", "child_content").alias("content"), "score", "chunk_id")
    w = Window.partitionBy("id").orderBy(F.desc("score"), "chunk_id")
    return rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def bm25(chunks: DataFrame, terms: list[str], k: int, every: bool = True, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Chunks that hold the unstemmed terms (all of them, if ``every``), by BM25 score, without an index.

    The texts are split once: the same pass counts chunks and words and stores the hits, which are all that later steps
    read. ``fulltext`` has the stored index.
    """
    terms, seen = sorted(set(terms)), Observation()
    words = F.array_remove(F.split(T.term_text(F.col("content")), " +"), "")
    rows = chunks.select("id", words.alias("words")).select("id", F.size("words").alias("length"), F.filter("words", lambda x: x.isin(terms)).alias("found"))
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("length").alias("words")).filter(F.size("found") > 0)
    count = lambda t: F.size(F.filter("found", lambda x: x == t))
    tf = [count(t).alias(f"tf{j}") for j, t in enumerate(terms)]
    rows = staged(rows.select("id", "length", *tf), "bm25")
    total = seen.get
    df = rows.agg(*(F.count_if(F.col(f"tf{j}") > 0).alias(f"df{j}") for j in range(len(terms)))).first()
    if not total["n"]:
        return rows.select("id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_terms"))
    mean, score, n = total["words"] / total["n"], F.lit(0.0), F.lit(0).cast("long")
    for j in range(len(terms)):
        x = F.col(f"tf{j}")
        idf = math.log(1 + (total["n"] - df[j] + 0.5) / (df[j] + 0.5))
        score = score + F.lit(idf) * x * (k1 + 1) / (x + k1 * (1 - b + b * F.col("length") / F.lit(mean)))
        n = n + (x > 0).cast("long")
    out = rows.select("id", F.round(score, 6).alias("score"), n.alias("n_terms"))
    if every:
        out = out.filter(F.col("n_terms") == len(terms))
    return out.orderBy(F.desc("score"), "id").limit(k)


def fts_terms(query: str) -> list[str]:
    """Words of a search: punctuation and the operators AND, OR and NOT go."""
    import re

    return [x for x in re.sub(r"[^\w\s]", " ", query).lower().split() if x not in ("and", "or", "not")]


def pool(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """Vector hits, then text hits that are not among them, with a constant score of 1."""
    more = second.select("chunk_id").join(first.select("chunk_id"), "chunk_id", "left_anti").orderBy("chunk_id").limit(limit).withColumn("score", F.lit(1.0))
    return first.select("chunk_id", "score").unionByName(more)


def reranked(candidates: DataFrame, score: Column) -> DataFrame:
    """Candidates with a new score and their place by it within the query; equal scores stay in the order of ``rank``."""
    rows = candidates.withColumn("score", F.round(score, 6))
    return rows.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")))


def several() -> Column:
    """Whether a query has more than one candidate; a single one is never scored anew."""
    return F.count(F.lit(1)).over(Window.partitionBy("query_id")) > 1


def substantive_bias(candidates: DataFrame) -> DataFrame:
    """Lowers the score of tables, of structural sections and texts, and of very short ones."""
    # a column of its own: within a branch Spark would compute what repeats in it each time
    rows = candidates.withColumn("_penalty", R.structural_penalty(F.col("content"), F.col("section"), F.col("block_type")))
    return reranked(rows, F.col("score") - F.when(several(), F.col("_penalty")).otherwise(0.0)).drop("_penalty")


def title_overlap(asked: Column | None = None) -> Column:
    """How many terms a question shares with a file's name; ``asked`` are the question's terms, where they are at hand."""
    return F.size(F.array_intersect(R.title_terms(F.col("query")) if asked is None else asked, R.title_terms(F.col("filename"))))


def title_bias(candidates: DataFrame, strict: bool = False, asked: Column | None = None) -> DataFrame:
    """Rewards terms that the question shares with the file name; the strict form also punishes files that share none, if
    another candidate of the query does."""
    each, most = (R.STRICT_BONUS, R.STRICT_MOST) if strict else (R.TITLE_BONUS, R.TITLE_MOST)
    rows = candidates.withColumn("_shared", title_overlap(asked))
    none = F.lit(0.0)
    if strict:
        none = F.when(F.max("_shared").over(Window.partitionBy("query_id")) > 0, -R.STRICT_PENALTY).otherwise(0.0)
    bonus = F.when(F.col("_shared") > 0, F.least(F.lit(most), F.col("_shared") * each)).otherwise(none)
    return reranked(rows, F.col("score") + F.when(several(), bonus).otherwise(0.0)).drop("_shared")


def focused_selection(candidates: DataFrame, k: int) -> DataFrame:
    """One candidate per file and place first, then the others, each in rank order, k per query."""
    w = Window.partitionBy("query_id", "file_id", "place").orderBy("rank")
    rows = candidates.withColumn("second", (F.row_number().over(w) > 1).cast("int"))
    out = rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("second", "rank")))
    return out.filter(F.col("nth") <= k).drop("second")


def coverage_selection(candidates: DataFrame, k: int) -> DataFrame:
    """Four passes per query: one per file at a new place, two per file at new places, two per file, any; k in all.

    A pass takes a file's best candidates first, so its outcome is a number on each candidate: ``nth`` among the file's
    places (by their best candidates) and among the file's candidates; passes follow each other, each in rank order.
    """
    place, file = ["query_id", "file_id", "place"], ["query_id", "file_id"]
    rows = candidates.select("query_id", "chunk_id", "file_id", "place", "rank")
    rows = rows.withColumn("in_place", F.row_number().over(Window.partitionBy(*place).orderBy("rank")))
    rows = rows.withColumn("of_file", F.row_number().over(Window.partitionBy(*file).orderBy(F.col("in_place") > 1, "rank")))
    rows = rows.withColumn("round", F.when((F.col("in_place") == 1) & (F.col("of_file") == 1), 1).when((F.col("in_place") == 1) & (F.col("of_file") == 2), 2).when(F.col("of_file") == 2, 3).otherwise(4))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("round", "rank")))
    return rows.filter(F.col("nth") <= k).select("query_id", "chunk_id", F.col("nth").cast("long").alias("nth"))


def evidence(claims: DataFrame, sources: DataFrame, threshold: int = 2, block: int = 4096) -> DataFrame:
    """Per claim the largest number of its words that one source holds, and whether that supports it.

    Claims travel to the sources: a task takes the claims block by block from the shared folder, counts the words that each of
    its sources shares with them through an index of the claims' words, and returns one number a claim. What is shuffled
    grows with claims and tasks, however common a word is.
    """
    path = staging(claims.sparkSession, "claims")
    asked = claims.select(F.col("claim_id").cast("long").alias("claim_id"), T.tokens(F.col("claim")).alias("words"))
    asked.write.option("maxRecordsPerFile", block).parquet(path)
    schema = pa.schema([("claim_id", pa.int64()), ("shared", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .batch_search import blocks_of

        # few sources at a time: an index of a whole batch takes hundreds of megabytes
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            words = batch.column(0)
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(words.value_lengths().fill_null(0)))
            held = words.flatten().dictionary_encode()
            code = held.indices.to_numpy(zero_copy_only=False)
            place = {w: k for k, w in enumerate(held.dictionary.to_pylist())}
            order = np.argsort(code, kind="stable")
            start, holders = np.searchsorted(code[order], np.arange(len(place) + 1)), owner[order]
            for part in blocks_of(path):
                best = []
                for found in part.column(1).to_pylist():
                    some = [holders[start[k] : start[k + 1]] for w in found if (k := place.get(w)) is not None]
                    best.append(int(np.bincount(np.concatenate(some)).max()) if some else 0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.int64())], schema=schema)

    best = sources.select(T.tokens(F.col("text")).alias("words")).mapInArrow(run, "claim_id long, shared long").groupBy("claim_id").agg(F.max("shared").alias("shared"))
    rows = claims.select("claim_id").join(best, "claim_id", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return rows.withColumn("supported", F.col("shared") >= threshold)
