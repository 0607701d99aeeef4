"""How the term frequencies of a language's sources differ, by systolic rotation.

Terms of a language that enough of its documents hold are dealt by hash into slices of about ``slice_terms``; within a slice
each has a slot, in order of its bytes. A group (language, source) is one compressed vector per slice: gaps of its slots and
counts, as LEB128. Sources are dealt into blocks of about ``block_groups``. A block stays where it is, in the partition of its
(language, slice, block), and the other blocks' vectors pass by in the rounds of a round-robin tournament: in round t the block
``t`` places on, so that with B blocks each pair of blocks meets once, in one of B // 2 rounds. First the language's own vector
passes. A task holds the dense shares of one block and one visitor at a time. A meeting gives both directions; what the slices
find is added up, and each slice keeps the ten best terms of a group on a heap of its own before these are ranked together.

Shares are exact: p = 1 + floor(scale * (count + 2) / (N + 2 * V)) by long division, f = floor((p - q)^2 / (p + q)). Counts up
to 9e15 in a language and scale 1e9 fit 64 bits. Zero counts need no slot: a pair's terms that neither holds share one f.

Null text, lang, source: ''. Every row is a document, also those that repeat an id. A language without kept terms gives pairs
of value 0. A language of one source gives no pair. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordhash import mix

#: Bytes of a term ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``: letters and all that is not ASCII.
IN_TERM = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shares are whole billionths, found by long division in three steps of a thousand.
STEP, STEPS = 1000, 3
#: Passes of a (language, slice, block): its own vectors, the language's, then the visitors of each round.
RESIDENT, LANGUAGE = 0, 1


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str, chunk_bytes: int = 1 << 24) -> DataFrame:
    """(lang, source, term, docs, n) counted within a chunk of texts; a row without term (null) marks each group."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])

    def counted(langs: list[str], sources: list[str], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple, int] = {}
        group = np.array([names.setdefault(x, len(names)) for x in zip(langs, sources, strict=True)], np.int64)
        lang, source = (pa.array([x[c] for x in names], pa.string()) for c in (0, 1))
        none = pa.array([0] * len(names), pa.int64())
        yield pa.RecordBatch.from_arrays([lang, source, pa.array([None] * len(names), pa.string()), none, none], schema=schema)
        data = np.frombuffer(b"\n".join(texts).translate(LOWER) + b"\n", np.uint8)
        inside = IN_TERM[data]
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return
        owner = np.searchsorted(np.cumsum([len(x) + 1 for x in texts]), starts, "right")
        offsets = np.concatenate(([0], np.cumsum(ends - starts)))
        terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[inside])]).dictionary_encode()
        code, many = terms.indices.to_numpy().astype(np.int64), len(terms.dictionary)
        pair, n = np.unique(owner * many + code, return_counts=True)
        key, inverse = np.unique(group[pair // many] * many + pair % many, return_inverse=True)
        docs, n = np.bincount(inverse), np.bincount(inverse, n).astype(np.int64)
        strings = terms.dictionary.cast(pa.string())
        for at in range(0, len(key), 1 << 16):
            some = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(key[some] // many)), source.take(pa.array(key[some] // many)), strings.take(pa.array(key[some] % many)), pa.array(docs[some], pa.int64()), pa.array(n[some])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.column_bytes(batch.column(2)), strict=True):
                held.append(row)
                size += len(row[2])
                if size >= chunk_bytes:
                    yield from counted(*map(list, zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield from counted(*map(list, zip(*held, strict=True)))

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text")).mapInArrow(run, "lang string, source string, term string, docs long, n long")
    return found.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers as LEB128, by the gap coder over their running sums."""
    return common.delta_bytes(np.cumsum(values))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), exact."""
    part, rest, whole = np.zeros(len(counts), np.int64), counts.astype(np.int64) + 2, total + 2 * terms
    part, rest = rest // whole, rest % whole
    for _ in range(STEPS):
        rest = rest * STEP
        part, rest = part * STEP + rest // whole, rest % whole
    return part + 1


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Vector:
    """A group's terms in a slice: slots, shares there, and the share of any other term."""

    def __init__(self, blob: bytes, total: int, terms: int):
        slots, counts = blob_parts(blob)
        self.slots, self.counts = slots, counts
        self.shares = shares(counts, total, terms)
        self.rest = int(shares(np.zeros(1, np.int64), total, terms)[0])


def blob_of(slots: np.ndarray, counts: np.ndarray) -> bytes:
    order = np.argsort(slots, kind="stable")
    gaps = common.delta_bytes(slots[order])
    return len(gaps).to_bytes(4, "little") + gaps + packed(counts[order])


def blob_parts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not blob:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = int.from_bytes(blob[:4], "little")
    return common.delta_values(blob[4 : 4 + n]), np.diff(common.delta_values(blob[4 + n :]), prepend=0)


class Block:
    """The resident vectors of a (language, slice, block) and what passes by."""

    def __init__(self, size: int, rows: list[tuple[str, Vector]]):
        self.size, self.names, self.vectors = size, [x[0] for x in rows], [x[1] for x in rows]
        self.dense = np.repeat(np.array([v.rest for v in self.vectors], np.int64)[:, None], size, 1)
        for k, v in enumerate(self.vectors):
            self.dense[k, v.slots] = v.shares
        self.owner = np.repeat(np.arange(len(rows)), [len(v.slots) for v in self.vectors])
        self.slots = np.concatenate([v.slots for v in self.vectors])
        self.held = np.concatenate([v.shares for v in self.vectors])

    def meet(self, other: Vector) -> np.ndarray:
        """The sum of f over the slice's terms, of every resident with a visitor."""
        total = gain(self.dense[:, other.slots], other.shares).sum(1)
        here = np.zeros(self.size, bool)
        here[other.slots] = True
        own = ~here[self.slots]
        alone = np.bincount(self.owner[own], minlength=len(self.names))
        f = gain(self.held[own], np.int64(other.rest))
        sums = np.zeros(len(self.names), np.int64)
        np.add.at(sums, self.owner[own], f)
        neither = self.size - len(other.slots) - alone
        return total + sums + neither * gain(np.array([v.rest for v in self.vectors], np.int64), np.int64(other.rest))

    def best_terms(self, whole: Vector, most: int) -> Iterator[tuple[str, int, int]]:
        """(source, slot, f) of the best terms that a resident holds more often than the language."""
        q = np.full(self.size, whole.rest, np.int64)
        q[whole.slots] = whole.shares
        for name, v in zip(self.names, self.vectors, strict=True):
            over = v.shares > q[v.slots]
            f = gain(v.shares[over], q[v.slots[over]])
            for value, slot in heapq.nlargest(most, zip(f.tolist(), (-v.slots[over]).tolist(), strict=True)):
                yield name, -slot, value


FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("slice", pa.int64()), ("slot", pa.int64()), ("value", pa.int64())])


def rotation(passing: DataFrame, most: int) -> DataFrame:
    """(lang, source, item, slice, slot, value): partial sums of pairs (slot null) and local best terms (item null).

    Rows come sorted by (lang, slice, block, turn): the residents, the language, then the visitors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def met() -> Iterator[tuple]:
            at, staying, block = None, [], None
            for lang, part, home, turn, source, blob, total, terms, size in rows():
                if (lang, part, home) != at:
                    at, staying, block = (lang, part, home), [], None
                vector = Vector(blob, total, terms)
                if turn == RESIDENT:
                    staying.append((source, vector))
                    continue
                if not staying:
                    continue  # a block without sources
                if block is None:
                    block = Block(size, staying)
                    for k, (name, one) in enumerate(staying):
                        for j, value in enumerate(block.meet(one).tolist()):
                            if j != k:
                                yield lang, name, staying[j][0], None, None, value
                if turn == LANGUAGE:
                    for name, slot, value in block.best_terms(vector, most):
                        yield lang, name, None, part, slot, value
                else:
                    for name, value in zip(block.names, block.meet(vector).tolist(), strict=True):
                        yield lang, name, source, None, None, value
                        yield lang, source, name, None, None, value

        yield from common.batches_of(met(), FOUND, 8192)

    ranged = passing.repartition("lang", "slice", "home").sortWithinPartitions("lang", "slice", "home", "turn")
    return ranged.mapInArrow(run, "lang string, source string, item string, slice long, slot long, value long")


def compressed(rows: DataFrame) -> DataFrame:
    """(lang, slice, source, blob) of (lang, slice, source, slot, n): a slice bounds the rows of a group."""
    schema = pa.schema([("lang", pa.string()), ("slice", pa.int64()), ("source", pa.string()), ("blob", pa.binary())])
    lists = rows.groupBy("lang", "slice", "source").agg(F.collect_list(F.struct("slot", "n")).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(3)
            flat = held.flatten()
            slots, counts = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.asarray(held.value_lengths()))
            blobs = [blob_of(slots[a:b], counts[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(blobs, pa.binary())], schema=schema)

    return lists.mapInArrow(run, "lang string, slice long, source string, blob binary")


def source_divergence(docs: DataFrame, least_docs: int = 10, ranks: int = 10, slice_terms: int = 16_384, block_groups: int = 32, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank: the sources of a language by divergence, and each source's own terms."""
    common.ensure_workers(docs.sparkSession)
    counts = common.staged(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    groups = counts.filter("term IS NULL").select("lang", "source")
    terms = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).filter(F.col("docs") >= least_docs)
    terms = common.staged(terms.select("lang", "term", "n"), "terms")
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("whole")), "lang", "left")
    sizes = sizes.select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("whole", F.lit(0)).alias("whole"), F.ceil(F.col("sources") / block_groups).alias("blocks"), F.greatest(F.ceil(F.col("terms") / slice_terms), F.lit(1)).alias("slices"))
    sizes = common.hinted(common.staged(sizes, "languages"))
    dealt = terms.join(sizes.select("lang", "slices"), "lang").withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices"))).drop("slices")
    from pyspark.sql import Window

    slots = dealt.withColumn("slot", F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")).cast("long") - 1)
    slots = common.staged(slots, "slots")
    held = counts.filter("term IS NOT NULL").select("lang", "source", "term", "n").join(slots.select("lang", "term", "slice", "slot"), ["lang", "term"])
    held = common.staged(held.select("lang", "source", "slice", "slot", "n"), "held")
    totals = groups.join(held.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    widths = slots.groupBy("lang", "slice").agg(F.count(F.lit(1)).alias("size"))
    every = totals.join(sizes, "lang").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    vectors = every.join(compressed(held), ["lang", "slice", "source"], "left").join(common.hinted(widths), ["lang", "slice"], "left")
    vectors = vectors.select("lang", "slice", "source", "blob", "total", "terms", F.coalesce("size", F.lit(0)).alias("size"), "blocks", F.pmod(F.xxhash64("source"), F.col("blocks")).alias("block"))
    vectors = common.staged(vectors, "vectors")
    row = lambda df, home, turn, source: df.select("lang", "slice", home.cast("long").alias("home"), turn.cast("long").alias("turn"), source.alias("source"), "blob", "total", "terms", "size")
    staying = row(vectors, F.col("block"), F.lit(RESIDENT), F.col("source"))
    # the language's vector passes all blocks
    whole = compressed(slots.select("lang", "slice", F.lit("").alias("source"), "slot", "n")).join(sizes, "lang").join(common.hinted(widths), ["lang", "slice"])
    whole = whole.withColumn("total", F.col("whole")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    whole = row(whole, F.col("block"), F.lit(LANGUAGE), F.lit(None).cast("string"))
    rounds = vectors.filter("blocks > 1").withColumn("round", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("blocks") / 2))))
    rounds = rounds.withColumn("home", F.pmod(F.col("block") - F.col("round"), F.col("blocks")))
    # of an even number, blocks that are half a turn apart would meet twice
    rounds = rounds.filter((2 * F.col("round") < F.col("blocks")) | (F.col("home") < F.col("block")))
    visiting = row(rounds, F.col("home"), F.col("round") + LANGUAGE, F.col("source"))
    # a block of one slice without terms has no language vector: an empty one wakes it
    empty = row(vectors.filter("size = 0").select("lang", "slice", "block", "total", "terms", "size", F.lit(None).cast("binary").alias("blob")).distinct(), F.col("block"), F.lit(LANGUAGE), F.lit(None).cast("string"))
    found = common.staged(rotation(staying.union(whole).union(empty).union(visiting), ranks), "divergence")
    pairs = found.filter("slot IS NULL").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    best = found.filter("slot IS NOT NULL").select("lang", "source", "slice", "slot", "value").join(slots.select("lang", "slice", "slot", F.col("term").alias("item")), ["lang", "slice", "slot"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    best = best.select("lang", "source", "item", "value", F.lit("term").alias("part")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).union(best.select(*columns))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t SEMI JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY 1, 2, 3),
l AS (SELECT lang, sum(n) AS whole, count(*) AS v FROM k GROUP BY 1),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * l.v) AS p
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (k.n + 2)) // (l.whole + 2 * l.v) AS q FROM k JOIN l ON l.lang = k.lang),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r QUALIFY part = 'pair' OR rank <= 10
"""
