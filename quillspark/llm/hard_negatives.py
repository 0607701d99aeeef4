"""Hard-negative mining by one-dimensional distance keys.

Vectors of whole numbers get one more coordinate, sqrt(M - v.v) with M the largest squared length, so that a higher inner
product with an anchor q (padded by 0) is a smaller distance: |x - q|^2 = M + q.q - 2 q.v. Every row belongs to its nearest
pivot and is stored sorted by (pivot, distance to it, id), in files of blocks with the interval of distances of each. By
the triangle inequality a row within r of an anchor has a key within r of the anchor's own distance to the pivot. A task
takes a batch of anchors and visits segments and blocks outwards, nearest key interval first, until what is left is
farther than the k-th find of every anchor: only then is an anchor's result certain, and it is exact.

Negatives are the best rows below a ceiling: in terms of distance an annulus, so that blocks which lie wholly inside its
inner sphere are passed over as well; the floor of the score bounds it from outside.

Pivots are the only thing fitted on a sample: ``sample_rows`` rows with the smallest hashes of their ids. Every row is
indexed. The driver receives that sample, one row of totals, and one row per run of a pivot in a partition.

Null or non-finite components, null vectors, null labels and null ids: the row takes no part. Shorter vectors are padded by
zeros; an empty vector scores 0. Equal scores: smaller id first. Rows that repeat an id are rows of their own, but none is a
positive or negative of an anchor of that id, and each of an anchor's rows gives its results. An empty table, or one without
anchors, gives no row. Scores that might not fit 62 bits raise an error. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Sums of products below this are exact as doubles; those below the other fit a long.
EXACT_DOUBLE, EXACT_LONG = 1 << 53, 1 << 62
RESULT = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])


def whole_vectors(rows: DataFrame, scale: int, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, label, vec, peak, square) of the rows that take part: vec holds floor(scale * x) as longs."""
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("vec", pa.binary()), ("peak", pa.float64()), ("square", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(2)
            n = np.asarray(vectors.value_lengths().fill_null(0))
            flat = vectors.flatten()
            values = np.floor(scale * flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64))
            first = np.concatenate(([0], np.cumsum(n)))
            good = np.bincount(np.repeat(np.arange(len(n)), n), ~np.isfinite(values), len(n)) == 0
            out = []
            for k, (ident, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True)):
                if good[k]:
                    v = values[first[k] : first[k + 1]]
                    peak, square = float(np.abs(v).max(initial=0)), float(v @ v)
                    out.append((ident, label, v.astype(np.int64).tobytes() if peak < EXACT_LONG else b"", peak, square))
            if out:
                yield common.to_batch(out, schema)

    some = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    some = some.filter("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    return some.mapInArrow(run, "id long, label long, vec binary, peak double, square double")


def matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    """Rows of ``dim`` longs, shorter vectors padded by zeros."""
    if all(len(v) == 8 * dim for v in vectors):
        return np.frombuffer(b"".join(vectors), np.int64).reshape(len(vectors), dim)
    return np.frombuffer(b"".join(v.ljust(8 * dim, b"\0") for v in vectors), np.int64).reshape(len(vectors), dim)


def fitted_pivots(sample: np.ndarray, many: int, rounds: int = 8) -> np.ndarray:
    """Means of a sample (Lloyd's rounds from rows far from one another)."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(many, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    pivots = sample[chosen]
    for _ in range(rounds):
        own = squared(sample, pivots).argmin(1)
        held = np.bincount(own, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, own, sample)
        pivots = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], pivots)
    return pivots


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to those of ``b``, as doubles."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


class Keys:
    """What turns rows into keys: pivots, the bound M of squared lengths, and the slack for rounding of distances."""

    def __init__(self, pivots: np.ndarray, most: int, dim: int, small: str):
        self.pivots, self.most, self.dim, self.small = pivots, most, dim, small
        self.slack = 1e-5 * (most**0.5 + 1)

    def augmented(self, vectors: np.ndarray, stored: bool = True) -> np.ndarray:
        v = vectors.astype(np.float64)
        rest = np.sqrt(np.maximum(self.most - (v * v).sum(1), 0)) if stored else np.zeros(len(v))
        return np.concatenate((v, rest[:, None]), 1)

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact inner products."""
        if self.most < EXACT_DOUBLE:
            return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
        return a @ b.T


def stored_index(rows: DataFrame, keys: Keys, folder: str, block_rows: int) -> DataFrame:
    """Write all rows sorted by (pivot, distance, id); a row (name, pivot, low, high, footer, blocks) per segment.

    A segment is a pivot's run in a partition: blocks of ids, labels and vectors, then a table of (low, high, offset, rows).
    A retried task writes under new names; only what the finished one has returned is read.
    """
    place = pa.schema([("pivot", pa.int32()), ("distance", pa.float64()), ("id", pa.int64()), ("label", pa.int64()), ("vec", pa.binary())])
    entry = pa.schema([("name", pa.string()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("footer", pa.int64()), ("blocks", pa.int64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = squared(keys.augmented(matrix(batch.column(2).to_pylist(), keys.dim)), keys.pivots)
            own = d.argmin(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.sqrt(d[np.arange(len(own)), own])), *batch.columns], schema=place)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = common.filesystem(folder)
        system.create_dir(path, recursive=True)
        out, name, pivot, blocks, done = None, "", None, [], []
        held: list[tuple] = []

        def flush() -> None:
            if held:
                at = out.tell()
                held.sort(key=lambda r: r[2])  # by id, so that the first of equal scores has the smallest
                far = [r[1] for r in held]
                out.write(np.array([[r[2], r[3]] for r in held], np.int64).tobytes())
                out.write(matrix([r[4] for r in held], keys.dim).astype(keys.small).tobytes())
                blocks.append((min(far), max(far), at, len(held)))
                held.clear()

        def close() -> None:
            if out is not None:
                flush()
                table = np.array(blocks, np.float64)
                done.append((name, pivot, float(table[:, 0].min()), float(table[:, 1].max()), out.tell(), len(blocks)))
                out.write(table.tobytes())
                out.close()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != pivot:
                    close()
                    pivot, blocks, name = row[0], [], f"{uuid.uuid4().hex}.seg"
                    out = system.open_output_stream(f"{path}/{name}")
                held.append(row)
                if len(held) >= block_rows:
                    flush()
        close()
        if done:
            yield common.to_batch(done, entry)

    placed = rows.select("id", "label", "vec").mapInArrow(assign, "pivot int, distance double, id long, label long, vec binary")
    ranged = placed.repartitionByRange("pivot", "distance", "id").sortWithinPartitions("pivot", "distance", "id")
    return ranged.mapInArrow(write, "name string, pivot int, low double, high double, footer long, blocks long")


class Index:
    """The stored index as a task reads it: segment tables on demand, one block of rows at a time."""

    def __init__(self, folder: str, segments: list[tuple], keys: Keys):
        self.system, self.path = common.filesystem(folder)
        self.names, self.keys = [s[0] for s in segments], keys
        self.pivot = np.array([s[1] for s in segments])
        self.low, self.high = (np.array([s[c] for s in segments]) for c in (2, 3))
        self.footers = [(s[4], s[5]) for s in segments]
        self.open: OrderedDict[int, pa.NativeFile] = OrderedDict()
        self.blocks = lru_cache(64)(self.table)

    def file(self, segment: int):
        if segment not in self.open:
            self.open[segment] = self.system.open_input_file(f"{self.path}/{self.names[segment]}")
            if len(self.open) > 64:
                self.open.popitem(last=False)[1].close()
        return self.open[segment]

    def table(self, segment: int) -> np.ndarray:
        at, n = self.footers[segment]
        return np.frombuffer(self.file(segment).read_at(32 * n, at), np.float64).reshape(n, 4)

    def rows(self, segment: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, _, at, n = self.blocks(segment)[block]
        n, dim, small = int(n), self.keys.dim, np.dtype(self.keys.small)
        data = self.file(segment).read_at(n * (16 + dim * small.itemsize), int(at))
        names = np.frombuffer(data, np.int64, 2 * n).reshape(n, 2)
        return names[:, 0], names[:, 1], np.frombuffer(data, small, n * dim, 16 * n).reshape(n, dim).astype(np.int64)


class Best:
    """The ``k`` best (score, id) of each of ``many`` searches, higher scores first, then smaller ids."""

    def __init__(self, many: int, k: int):
        self.k = k
        self.score = np.full((many, k), np.iinfo(np.int64).min)
        self.ident = np.zeros((many, k), np.int64)
        self.count = np.zeros(many, np.int64)

    def last(self) -> np.ndarray:
        """The score that a row must reach: of the k-th find, or the least number."""
        return self.score[:, -1]

    def add(self, which: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Rows of ``scores`` belong to the searches ``which``; ids ascend, so the first ``k`` of equal scores are enough."""
        allowed = allowed & (scores >= self.last()[which, None])
        if scores.shape[1] > self.k:
            held = np.where(allowed, scores, np.iinfo(np.int64).min)
            limit = np.partition(held, -self.k, axis=1)[:, -self.k, None]
            tie = allowed & (scores == limit)
            allowed = allowed & (scores > limit) | tie & (np.cumsum(tie, 1) <= self.k)
        row, col = np.nonzero(allowed)
        if not len(row):
            return
        hit = np.unique(row)
        old = [(np.repeat(which[hit], self.count[which[hit]]), *(np.concatenate([x[s, : self.count[s]] for s in which[hit]]) for x in (self.score, self.ident)))]
        search, score, ident = (np.concatenate(x) for x in zip(*old, (which[row], scores[row, col], ids[col]), strict=True))
        order = np.lexsort((ident, -score, search))
        search, score, ident = search[order], score[order], ident[order]
        place = np.arange(len(search)) - np.searchsorted(search, search)
        keep = place < self.k
        self.score[search[keep], place[keep]], self.ident[search[keep], place[keep]] = score[keep], ident[keep]
        self.count[which[hit]] = np.minimum(np.bincount(search, minlength=len(self.count))[which[hit]], self.k)


class Search:
    """All searches of a batch of anchors."""

    def __init__(self, index: Index, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.index, self.keys, self.ids, self.labels, self.vectors = index, index.keys, ids, labels, vectors
        self.to_pivot = np.sqrt(squared(self.keys.augmented(vectors, False), self.keys.pivots))
        self.square = (vectors.astype(np.float64) ** 2).sum(1)
        self.read = 0

    def radius(self, anchor: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance of rows with these scores; beyond it all scores are lower."""
        return np.sqrt(np.maximum(self.keys.most + self.square[anchor] - 2 * np.maximum(score.astype(np.float64), -2.0 * self.keys.most), 0))

    def outwards(self, of: np.ndarray, radii, inner: np.ndarray, visit) -> None:
        """Visit the blocks whose key interval meets the annuli of the searches, nearest interval first.

        ``of`` is each search's anchor, ``radii()`` their outer radii as they shrink, ``inner`` the inner ones.
        """
        index, slack = self.index, self.keys.slack

        def near(pivot, low, high):
            d = self.to_pivot[of, pivot]
            return np.where(d + high + slack < inner, np.inf, np.maximum(np.maximum(low - d, d - high), 0) - slack)

        heap = [(float(near(p, low, high).min()), s, -1) for s, (p, low, high) in enumerate(zip(index.pivot, index.low, index.high, strict=True))]
        heapq.heapify(heap)
        outer = radii()
        while heap and heap[0][0] <= outer.max(initial=-1):
            _, s, block = heapq.heappop(heap)
            if block < 0:
                for b, (low, high, _, _) in enumerate(index.blocks(s)):
                    if len(some := (d := near(index.pivot[s], low, high))[d <= outer]):
                        heapq.heappush(heap, (float(some.min()), s, b))
                continue
            low, high = index.blocks(s)[block][:2]
            active = np.flatnonzero(near(index.pivot[s], low, high) <= outer)
            if len(active):
                self.read += 1
                visit(active, *index.rows(s, block))
                outer = radii()

    def positives(self, k: int) -> Best:
        best, of = Best(len(self.ids), k), np.arange(len(self.ids))

        def visit(active, ids, labels, vectors):
            scores = self.keys.scores(self.vectors[active], vectors)
            best.add(active, scores, (labels == self.labels[active, None]) & (ids != self.ids[active, None]), ids)

        self.outwards(of, lambda: np.where(best.count == k, self.radius(of, best.last()), np.inf), np.zeros(len(of)), visit)
        return best

    def negatives(self, of: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, k: int) -> Best:
        """The best rows of other labels with scores from ``floor`` to ``ceiling``, for searches of the anchors ``of``."""
        best = Best(len(of), k)

        def visit(active, ids, labels, vectors):
            anchors, which = np.unique(of[active], return_inverse=True)
            scores = self.keys.scores(self.vectors[anchors], vectors)[which]
            other = (labels != self.labels[anchors, None])[which]
            best.add(active, scores, other & (scores >= floor[active, None]) & (scores <= ceiling[active, None]), ids)

        outer = lambda: self.radius(of, np.where(best.count == k, np.maximum(best.last(), floor), floor)) + self.keys.slack
        inner = np.maximum(self.radius(of, ceiling) - self.keys.slack, 0)
        self.outwards(of, outer, inner, visit)
        return best


def mined(index: Index, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, positives: int, negatives: int, low: int, high: int) -> list[tuple]:
    """Result rows of a batch of anchors."""
    search = Search(index, ids, labels, vectors)
    found = search.positives(positives)
    of = np.repeat(np.arange(len(ids)), found.count)
    place = np.arange(len(of)) - np.searchsorted(of, of)
    score, ident = found.score[of, place], found.ident[of, place]
    floor = np.array([-(-low * s // 100) for s in score.tolist()], np.int64)
    ceiling = np.array([high * s // 100 for s in score.tolist()], np.int64)
    some = np.flatnonzero(floor <= ceiling)
    of, score, ident = of[some], score[some], ident[some]
    best = search.negatives(of, floor[some], ceiling[some], negatives)
    return [(int(ids[of[k]]), int(ident[k]), r + 1, int(best.ident[k, r]), int(score[k]), int(best.score[k, r])) for k in range(len(of)) for r in range(best.count[k])]


def mine_hard_negatives(rows: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, pivots: int = 32, sample_rows: int = 4096, block_rows: int = 1024, batch_anchors: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Hard negatives of each anchor row (condition ``anchors`` on ``id``) and each of its positives."""
    spark = rows.sparkSession
    common.ensure_workers(spark)
    vectors = common.staged(whole_vectors(rows, scale, id_col, vector_col, F.col(label_col) if label is None else label), "vectors")
    total = vectors.agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("square"), F.max("peak").alias("peak"), F.max(F.length("vec")).alias("bytes")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not total.n:
        return spark.createDataFrame([], schema)
    if total.peak >= EXACT_LONG or total.square >= EXACT_LONG:
        raise ValueError("inner products of these vectors may not fit a long")
    most, dim = int(total.square) + 1, total.bytes // 8
    small = next(t for t, limit in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if total.peak < limit)
    sample = vectors.select("vec").orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    keys = Keys(np.zeros((1, dim + 1)), most, dim, small)
    keys.pivots = fitted_pivots(keys.augmented(matrix([bytes(r.vec) for r in sample], dim)), pivots)
    folder = common.staging(spark, "distance-keys")
    segments = [tuple(r) for r in common.staged(stored_index(vectors, keys, folder, block_rows), "segments").collect()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, segments, keys)
        for batch in batches:
            for at in range(0, batch.num_rows, batch_anchors):
                ids, labels, vecs = (batch.column(c).slice(at, batch_anchors) for c in range(3))
                found = mined(index, ids.to_numpy(), labels.to_numpy(), matrix(vecs.to_pylist(), dim), positives, negatives, low, high)
                for k in range(0, len(found), 8192):
                    yield common.to_batch(found[k : k + 8192], RESULT)

    asked = vectors.filter(anchors).select("id", "label", "vec")
    # anchors are few bytes but much work: a stated number of tasks keeps them from being put together by size
    n = asked.count()
    tasks = max(-(-n // batch_anchors), min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    return asked.repartition(tasks, F.xxhash64("id")).mapInArrow(search, schema)


def relabelled(id_col: str = "vec_id", label_col: str = "label") -> Column:
    """Every seventh id takes the next label."""
    return F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place FROM s WHERE same),
n AS (SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS place
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE p.place <= 5)
SELECT a AS anchor_id, p AS positive_id, CAST(place AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE place <= 10
"""
