"""A stored full-text index: stemmed postings in blocks, bucketed by term, with what bounds the score of each block.

``build`` reads the texts once and writes three tables below a folder: ``postings`` (partitioned by bucket, blocks of up to
``block_rows`` postings of a term in ascending id, with the largest count and the least and largest length in a block), ``terms`` (df of
each term) and ``totals`` (one row). A frequent term is cut over tasks by ranges of (bucket, term, id); nothing gathers all
postings of a term. ``search`` reads the buckets and terms it is asked for only: the bucket is a partition of the folder, the
term a pushed filter over sorted row groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stems import search_terms, term_counts

BLOCK = pa.schema([("bucket", pa.int32()), ("term", pa.string()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("most", pa.int32()), ("least", pa.int32()), ("longest", pa.int32())])
BLOCK_DDL = "bucket int, term string, ids array<long>, counts array<int>, lengths array<int>, most int, least int, longest int"


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def postings(chunks: DataFrame, buckets: int, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(bucket, term, id, tf, length) of every term of every chunk; null texts have none."""
    schema = pa.schema([("bucket", pa.int32()), ("term", pa.string()), ("id", pa.int64()), ("tf", pa.int32()), ("length", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                length, counts = term_counts(text or "")
                held += [(bucket_of(term, buckets), term, ident, n, length) for term, n in counts.items()]
                if len(held) >= 1 << 15:
                    yield rows_to_batch(held, schema)
                    held = []
        if held:
            yield rows_to_batch(held, schema)

    return chunks.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "bucket int, term string, id long, tf int, length int")


def rows_to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def build(chunks: DataFrame, folder: str, buckets: int = 64, block_rows: int = 128, id_col: str = "id", text_col: str = "content") -> None:
    """Write the index of the chunks below ``folder``, which must be shared by all executors."""
    spark = chunks.sparkSession
    rows = postings(chunks, buckets, id_col, text_col).repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for bucket, term, ident, n, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, term) != key or len(held) >= block_rows:
                    if held:
                        out.append(block(key, held))
                    key, held = (bucket, term), []
                held.append((ident, n, length))
                if len(out) >= 4096:
                    yield rows_to_batch(out, BLOCK)
                    out = []
        if held:
            out.append(block(key, held))
        if out:
            yield rows_to_batch(out, BLOCK)

    def block(key: tuple, held: list[tuple]) -> tuple:
        ids, counts, lengths = (list(x) for x in zip(*held, strict=True))
        return *key, ids, counts, lengths, max(counts), min(lengths), max(lengths)

    rows.mapInArrow(pack, BLOCK_DDL).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    stored = spark.read.schema(BLOCK_DDL).parquet(f"{folder}/postings")
    stored.groupBy("bucket", "term").agg(F.sum(F.size("ids")).alias("df")).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/terms")
    # each chunk's length counts once: the counts of all its terms add up to it
    total = stored.agg(F.coalesce(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("words"))
    total.crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks"))).write.mode("overwrite").parquet(f"{folder}/totals")


class Index:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def blocks(self, terms: list[str]) -> DataFrame:
        """Posting blocks of these terms: pruned to their buckets, filtered by term in the scan."""
        rows = self.spark.read.schema(BLOCK_DDL).parquet(f"{self.folder}/postings")
        return rows.filter(F.col("bucket").isin(sorted({bucket_of(t, self.buckets) for t in terms})) & F.col("term").isin(terms))

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """df of the asked terms: as many rows as terms."""
        rows = self.spark.read.schema("bucket int, term string, df long").parquet(f"{self.folder}/terms")
        some = rows.filter(F.col("bucket").isin(sorted({bucket_of(t, self.buckets) for t in terms})) & F.col("term").isin(terms))
        return {r.term: r.df for r in some.collect()}

    def totals(self) -> tuple[int, float]:
        r = self.spark.read.schema("words long, chunks long").parquet(f"{self.folder}/totals").first()
        return r.chunks, r.words / r.chunks if r.chunks else 0.0


def search(index: Index, question: str, k: int, every: bool = True, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score, n_terms) of the best chunks for the question's stems: all of them if ``every``, else any.

    With any term allowed, blocks that can't lift a chunk among the best are left out before their postings are opened. A
    block has a chunk of at least the weight of its largest count at its largest length; the k-th best such weight of a term
    is a floor. A block stays if its bound (largest count, least length) and the best of all other terms reach the floor.
    Equal scores: smaller id first.
    """
    spark = index.spark
    terms = search_terms(question)
    empty = spark.createDataFrame([], "id long, score double, n_terms long")
    df = index.frequencies(terms) if terms else {}
    if not df or every and len(df) < len(terms):
        return empty
    chunks, mean = index.totals()
    terms = sorted(df)
    idf = F.create_map(*(F.lit(x) for t in terms for x in (t, df[t])))[F.col("term")]
    rows = index.blocks(terms).withColumn("idf", F.log(1 + (F.lit(chunks) - idf + 0.5) / (idf + 0.5)))
    w = lambda count, length: F.col("idf") * F.col(count) * (k1 + 1) / (F.col(count) + k1 * (1 - b + b * F.col(length) / F.lit(mean)))
    if not every:
        heads = rows.select("term", w("most", "least").alias("bound"), w("most", "longest").alias("sure"))
        heads = heads.withColumn("nth", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("sure"))))
        found = heads.groupBy("term").agg(F.max("bound").alias("top"), F.max(F.when(F.col("nth") == k, F.col("sure"))).alias("kth")).collect()
        tops, floor = {r.term: r.top for r in found}, max((r.kth for r in found if r.kth is not None), default=0.0)
        others = F.create_map(*(F.lit(x) for t in terms for x in (t, sum(tops.values()) - tops[t])))[F.col("term")]
        rows = rows.filter(w("most", "least") + others >= floor - 1e-6)
    hits = rows.select("term", "idf", F.inline(F.arrays_zip("ids", "counts", "lengths"))).select("term", F.col("ids").alias("id"), w("counts", "lengths").alias("w"))
    out = hits.groupBy("id").agg(F.round(F.sum("w"), 6).alias("score"), F.count(F.lit(1)).alias("n_terms"))
    if every:
        out = out.filter(F.col("n_terms") == len(terms))
    return out.orderBy(F.desc("score"), "id").limit(k)
