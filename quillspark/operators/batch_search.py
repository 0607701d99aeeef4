"""Retrieval for a table of questions at once: vector and full-text search in blocks, then selection per question.

Both searches leave the chunks where they are. A task holds the chunks of its partition and takes the questions block by
block from the shared folder: vectors by matrix products, texts by a small inverted index of the terms that are asked for.
Of each question only the best ``k`` of a task leave it, so that what is shuffled grows with questions, tasks and k, never
with questions times chunks. All results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import embedding, stems
from ..functions import rules as R
from . import gates, retrieval
from .lineage import staged, staging

#: Questions that a task holds at a time, and chunks that it holds before it searches them.
QUESTION_BLOCK, CHUNK_BLOCK = 1024, 65_536
#: Postings that a task holds before it searches them, and pairs of a question and a chunk that it follows at a time.
POSTING_BLOCK, PAIR_BLOCK = 1 << 21, 1 << 20
HITS = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])
HITS_DDL = "query_id long, chunk_id long, score double"


def stored(questions: DataFrame, name: str) -> str:
    """Questions written to the shared folder as files of bounded rows; the path."""
    path = staging(questions.sparkSession, name)
    questions.write.option("maxRecordsPerFile", QUESTION_BLOCK).parquet(path)
    return path


def blocks_of(path: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    local = path.startswith("file:") or "://" not in path
    system, root = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(path)
    for batch in ds.dataset(root, filesystem=system, format="parquet").to_batches(batch_size=QUESTION_BLOCK, batch_readahead=2, fragment_readahead=1):
        if batch.num_rows:
            yield batch


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run behind the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def top(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each row (equal ones: smaller id), row by row."""
    order = np.lexsort((ids, -score, row))
    sorted_rows = row[order]
    return order[np.arange(len(row)) - np.searchsorted(sorted_rows, sorted_rows) < k]


def merged(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each question, numbered."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def places_of(marks: np.ndarray) -> np.ndarray:
    """Places of the few marks that are set; eight are looked at together."""
    flat = marks.reshape(-1)
    if flat.size % 8:
        return np.flatnonzero(flat)
    at = np.flatnonzero(flat.view(np.uint64))
    place, offset = np.nonzero(flat.reshape(-1, 8)[at])
    return at[place] * 8 + offset


def matrices(ids: pa.Array, vectors: pa.Array, *more: pa.Array) -> Iterator[tuple]:
    """Ids, rows, squares of their lengths, rows of length 1 in single precision and what else there is, for each number of dimensions."""
    n = np.asarray(vectors.value_lengths().fill_null(0))
    for size in np.unique(n[n > 0]).tolist():
        some = np.flatnonzero(n == size)
        rows = vectors.take(pa.array(some)).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(some), size).astype(np.float64)
        with np.errstate(all="ignore"):
            square = np.einsum("ij,ij->i", rows, rows)
            whole = np.isfinite(square) & (square > 0)
        some, rows, square = some[whole], rows[whole], square[whole]
        yield ids.to_numpy(zero_copy_only=False)[some], rows, square, (rows / np.sqrt(square)[:, None]).astype(np.float32), *(x.to_numpy(zero_copy_only=False)[some] for x in more)


def nearest_of_all(vectors: DataFrame, questions: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k chunks of the highest cosine, rounded, for each (query_id, vector).

    Vectors of other lengths than a question's, and those of length 0, are no hits of it. Products in single precision rule
    out what is below a question's k-th best so far by more than their error; what is left is scored in double precision. A
    first pass over a sixteenth of the chunks gives each question a k-th best to begin with, so that tasks return few hits.
    """
    rows = staged(vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), "vector").filter("chunk_id IS NOT NULL"), "chunk-vectors")
    if dict(rows.dtypes)["vector"] != "array<float>":  # single precision travels as it is
        rows = rows.select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    asked = staged(questions.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")), "question-rows")

    def searched(path: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= CHUNK_BLOCK:
                    yield from search(held)
                    held = []
            if any(b.num_rows for b in held):
                yield from search(held)

        def search(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            chunks = {m[1].shape[1]: m for m in matrices(table.column(0).combine_chunks(), table.column(1).combine_chunks())}
            for block in blocks_of(path):
                for found in matrices(*block.columns):
                    if found[1].shape[1] in chunks:
                        for at in range(0, len(found[0]), 256):
                            yield from nearest_of_some(chunks[found[1].shape[1]], *(x[at : at + 256] for x in found))

        return run

    def nearest_of_some(chunks: tuple, asked: np.ndarray, q: np.ndarray, square: np.ndarray, unit: np.ndarray, least: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, m, squares, units = chunks
        error = np.float32(q.shape[1] * 2.0**-22 + 10.0**-digits)
        row, col, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        floor, limit = least.copy(), (least - error).astype(np.float32)
        fresh, n, room = [], 0, np.empty((len(asked), 2048), np.float32)
        for at in range(0, len(ids), 2048):
            near = unit @ units[at:].T if at + 2048 > len(ids) else np.matmul(unit, units[at : at + 2048].T, out=room)
            if at == 0 and near.shape[1] > k:  # the k-th best of the first chunks is a floor
                limit = np.maximum(limit, np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] - 2 * error)
            r, c = np.divmod(places_of(near >= limit[:, None]), near.shape[1])
            fresh.append((r, c + at))
            n += len(r)
            if n <= 2 * k * len(asked) and at + 2048 < len(ids):
                continue
            r, c = (np.concatenate(x) for x in zip(*fresh, strict=True))
            fresh, n = [], 0
            for cut in range(0, len(r), 1 << 16):
                a, b = r[cut : cut + (1 << 16)], c[cut : cut + (1 << 16)]
                with np.errstate(all="ignore"):
                    exact = np.round(np.einsum("ij,ij->i", q[a], m[b]) / np.sqrt(square[a] * squares[b]), digits)
                good = np.isfinite(exact) & (exact >= floor[a])
                row, col, score = np.append(row, a[good]), np.append(col, b[good]), np.append(score, exact[good])
                keep = top(row, score, ids[col], k)
                row, col, score = row[keep], col[keep], score[keep]
            full = np.flatnonzero(np.bincount(row, minlength=len(asked)) >= k)
            floor[full] = score[np.searchsorted(row, full) + k - 1]
            limit = np.maximum(limit, (floor - error).astype(np.float32))
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(asked[row]), pa.array(ids[col]), pa.array(score)], schema=HITS)

    first = stored(asked.withColumn("least", F.lit(-2.0)), "question-vectors")
    some = merged(rows.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(16)) == 0).mapInArrow(searched(first), HITS_DDL), k).filter(F.col("rank") == k)
    floors = some.select("query_id", F.col("score").alias("least")).groupBy("query_id").agg(F.min("least").alias("least"))
    path = stored(asked.join(floors, "query_id", "left").select("query_id", "vector", F.coalesce("least", F.lit(-2.0)).alias("least")), "question-floors")
    return merged(rows.mapInArrow(searched(path), HITS_DDL), k)


def matches_of_all(chunks: DataFrame, questions: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks by BM25 that hold all stems of each (query_id, question).

    Statistics are those of all chunks; a row with a number of ``copies`` counts as so many. A first pass counts chunks, words and
    the chunks of each asked stem; the second scores.
    """
    spark = chunks.sparkSession
    copies = F.col("copies").cast("long") if "copies" in chunks.columns else F.lit(1).cast("long")

    def stems_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stems.search_terms(x) for x in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["query_id", "terms"])

    asked = questions.select(F.col("query_id").cast("long").alias("query_id"), "question").mapInArrow(stems_of, "query_id long, terms array<string>").filter(F.size("terms") > 0)
    stems_at = stored(asked, "question-terms")
    asked = spark.read.schema("query_id long, terms array<string>").parquet(stems_at).select("query_id", F.posexplode("terms").alias("place", "term"))

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lengths, terms, counts, ends = [], [], [], [0]
                for text in part.column(1).to_pylist():
                    length, held = stems.term_counts(text or "")
                    lengths.append(length)
                    terms.extend(held)
                    counts.extend(held.values())
                    ends.append(len(terms))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.string())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32())), part.column(2)], names=["chunk_id", "length", "terms", "counts", "copies"])

    words = chunks.select(F.col("id").cast("long").alias("chunk_id"), F.col("content").alias("content"), copies.alias("copies")).mapInArrow(parted, "chunk_id long, length int, terms array<string>, counts array<int>, copies long")
    place = staging(spark, "chunk-terms")
    words.write.parquet(place)
    words = spark.read.schema(words.schema).parquet(place)
    n, total = words.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("length") * F.col("copies")), F.lit(0))).first()
    df = words.select(F.explode("terms").alias("term"), "copies").groupBy("term").agg(F.sum("copies").alias("df"))
    # questions carry the frequencies of their stems; one with a stem that no chunk has can't be matched
    asked = asked.join(df, "term", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "term", F.coalesce("df", F.lit(0)).alias("df")))).alias("x"))
    asked = asked.filter(~F.exists("x", lambda y: y["df"] == 0))
    # the rarest stem comes first, "place" is a stem's place in the question
    asked = asked.select("query_id", F.array_sort(F.transform("x", lambda y, k: F.struct(y["df"].alias("df"), k.alias("place"), y["term"].alias("term")))).alias("x"))
    path = stored(asked.select("query_id", F.col("x.term").alias("terms"), F.col("x.df").alias("df"), F.col("x.place").alias("place")), "question-weights")
    mean = total / n if n else 1.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= POSTING_BLOCK:
                yield from search(pa.Table.from_batches(held).combine_chunks())
                held, size = [], 0
        if size:
            yield from search(pa.Table.from_batches(held).combine_chunks())

    def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Questions go along their stems, the rarest first, with the chunks that hold all stems so far."""
        ids, length = table.column(0).to_numpy(), table.column(1).to_numpy().astype(np.float64)
        lists = table.column(2).combine_chunks()
        owner = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths()))
        terms = lists.flatten().dictionary_encode()
        code = terms.indices.to_numpy().astype(np.int64)
        order = np.argsort(code, kind="stable")
        code, owner, counts = code[order], owner[order], table.column(3).combine_chunks().flatten().to_numpy()[order]
        bounds = np.searchsorted(code, np.arange(len(terms.dictionary) + 1))
        key = code * len(ids) + owner  # ascending: postings lie by term and chunk
        at = {t: k for k, t in enumerate(terms.dictionary.to_pylist())}
        for block in blocks_of(path):
            query, found, df, place = block.column(0).to_numpy(), *(block.column(c).to_pylist() for c in range(1, 4))
            first = np.array([at.get(x[0], -1) for x in found], np.int64)
            some = np.flatnonzero(first >= 0)
            size = bounds[first[some] + 1] - bounds[first[some]]
            part = np.cumsum(size) // PAIR_BLOCK
            for p in np.unique(part):
                yield from hits(some[part == p], bounds[first[some[part == p]]], size[part == p], query, found, df, place, ids, length, owner, counts, key, at)

    def hits(some, start, size, query, found, df, place, ids, length, owner, counts, key, at) -> Iterator[pa.RecordBatch]:
        q, chunk = np.repeat(some, size), owner[spread(start, size)]
        done, r = [], 1
        while len(q):
            alive = np.unique(q)
            code = np.full(alive[-1] + 1, -2, np.int64)  # -2: no stem is left, -1: a stem that no chunk here has
            code[alive] = [at.get(found[x][r], -1) if r < len(found[x]) else -2 for x in alive.tolist()]
            mine = code[q]
            done.append((q[mine == -2], chunk[mine == -2]))
            q, chunk, mine = q[mine >= 0], chunk[mine >= 0], mine[mine >= 0]
            wanted = mine * len(ids) + chunk
            there = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            q, chunk = q[key[there] == wanted], chunk[key[there] == wanted]
            r += 1
        q, chunk = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (q, chunk)
        if not len(q):
            return
        order = np.argsort(q, kind="stable")
        q, chunk, total = q[order], chunk[order], np.zeros(len(q))
        for x in np.unique(q).tolist():
            mine = slice(*np.searchsorted(q, [x, x + 1]))
            own = chunk[mine]
            for y in sorted(range(len(found[x])), key=place[x].__getitem__):  # weights add up in the order of the question
                c = counts[np.searchsorted(key, at[found[x][y]] * len(ids) + own)].astype(np.float64)
                idf = np.log(1 + (n - df[x][y] + 0.5) / (df[x][y] + 0.5))
                total[mine] += idf * c * (k1 + 1) / (c + k1 * (1 - b + b * length[own] / mean))
        total = np.round(total, digits)
        keep = top(q, total, ids[chunk], k)
        yield pa.RecordBatch.from_arrays([pa.array(query[q[keep]]), pa.array(ids[chunk[keep]]), pa.array(total[keep])], schema=HITS)

    return merged(words.drop("copies").mapInArrow(score, HITS_DDL), k)


def retrieve(questions: DataFrame, chunks: DataFrame, files: DataFrame, parents: DataFrame, top_k: int = 8, pool: int = 25, text_limit: int = 10, coverage: Column | None = None, allowed: Column | None = None, substantive: bool = True, by_title: bool = True, strict_title: bool = False, dimensions: int = 64) -> DataFrame:
    """Passages for every (query_id, question): (query_id, nth, chunk_id, passage_id, file_id, score).

    Chunks are (id, file_id, parent_id, content, section, block_type, place); a section that all chunks of a file share may be
    a column of ``files`` instead, so that it isn't copied to every chunk. ``allowed`` is a condition on files. Twice ``top_k``
    and at least ``pool`` chunks come from the vectors, up to ``text_limit`` more from the full text, with score 0. Structural
    chunks go if enough others are left; scores are lowered for lack of substance and raised for matching titles; questions of
    ``coverage`` (a condition on the question) spread over files. A parent stands for its best child; a child whose parent is
    missing stands for itself.

    Chunks of the same text have the same scores. Each text is searched once, under the smallest id of its chunks: the k best
    chunks are among the chunks of the k best texts, and those of a text count in the order of their ids.
    """
    if allowed is not None:
        files = files.filter(allowed)
    # what several steps read is computed once
    chunks = staged(chunks.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi"), "asked-chunks")
    texts = staged(chunks.groupBy("content").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "asked-texts")
    k_near, k_worded = max(2 * top_k, pool), max(2 * top_k, pool) + text_limit
    vectors = texts.select(F.col("id").alias("chunk_id"), embedding.embed(F.col("content"), dimensions).alias("vector"))
    asked = questions.select("query_id", F.col("question"), embedding.embed(F.col("question"), dimensions).alias("vector"))
    near, worded = nearest_of_all(vectors, asked, k_near), matches_of_all(texts, questions, k_worded)
    best = staged(near.withColumn("worded", F.lit(False)).unionByName(worded.withColumn("worded", F.lit(True))), "text-hits").withColumnRenamed("chunk_id", "text_id")
    found = texts.select(F.col("id").alias("text_id"), "content").join(best.select("text_id").distinct(), "text_id", "left_semi")
    kin = F.row_number().over(Window.partitionBy("text_id").orderBy("id"))
    chunks = staged(chunks.join(found, "content").withColumn("kin", kin).filter(F.col("kin") <= k_worded).drop("kin").withColumnRenamed("id", "chunk_id"), "hit-chunks")
    best = best.join(chunks.select("text_id", "chunk_id"), "text_id").select("query_id", "text_id", "chunk_id", "score", "worded")
    near = staged(merged(best.filter(~F.col("worded")), k_near), "near-hits")
    worded = merged(best.filter("worded"), k_worded)
    fresh = worded.join(near.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    fresh = fresh.withColumn("more", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("more") <= text_limit)
    keys = ["query_id", "text_id", "chunk_id"]
    hits = near.select(*keys, "score", F.col("rank").cast("long").alias("rank")).unionByName(fresh.select(*keys, F.lit(0.0).alias("score"), (F.col("more") + F.lit(10**6)).cast("long").alias("rank")))
    rows = hits.join(chunks, ["text_id", "chunk_id"]).drop("text_id")
    section = [] if "section" in chunks.columns else ["section"]
    rows = rows.join(files.select(F.col("id").alias("file_id"), "filename", *section), "file_id").join(questions.select("query_id", F.col("question").alias("query"), R.title_terms(F.col("question")).alias("asked_terms")), "query_id")
    rows = staged(rows, "hit-rows")
    if substantive:
        rows = retrieval.substantive_bias(gates.without_structural(rows, top_k)).drop("rank").withColumnRenamed("new_rank", "rank")
    if by_title:
        rows = retrieval.title_bias(rows, strict_title, F.col("asked_terms")).drop("rank").withColumnRenamed("new_rank", "rank")
    if strict_title:
        rows = gates.title_focus(rows)
    rows = staged(rows, "scored-rows")
    wide = F.lit(False) if coverage is None else coverage
    chosen = retrieval.coverage_selection(rows.filter(wide), top_k).unionByName(rows.filter(~wide).withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")).filter(F.col("nth") <= top_k).select("query_id", "chunk_id", "nth"))
    rows = rows.join(chosen, ["query_id", "chunk_id"]).join(parents.select(F.col("id").alias("parent_id"), F.lit(True).alias("there")), "parent_id", "left")
    rows = rows.withColumn("passage_id", F.when(F.col("there"), F.col("parent_id")).otherwise(F.col("chunk_id")))
    first = F.row_number().over(Window.partitionBy("query_id", "passage_id").orderBy("nth"))
    rows = rows.withColumn("_first", first).filter("_first = 1")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("nth")).cast("long")).select("query_id", "nth", "chunk_id", "passage_id", "file_id", F.round("score", 6).alias("score"))
