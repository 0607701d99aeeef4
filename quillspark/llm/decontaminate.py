"""Benchmark decontamination: BM25 over test items, searched with every training passage by block-max WAND.

The items are the indexed side. Document frequencies, the number of items, their mean and greatest length are counted once
over all items, by DataFrame aggregates, so that scores don't depend on how the index is cut. A term's contribution to an
item's BM25 score is divided by the score of the item's own text, so that one threshold serves all items. Items stand in
blocks; each posting list has, per block, its largest contribution. Every document is cut into passages of twice the longest
item's length, half overlapping, so that any stretch as long as an item lies whole in one of them. For a passage,

* its own terms are put in order, longest posting list first, and their largest contributions are added up; the term at
  which the sum reaches a share ``PIVOT`` of the threshold is the pivot: an item without any term from the pivot on can't
  reach the threshold, so only blocks in the lists from the pivot on are looked at;
* such a block is skipped if its maxima of these lists and the sum before the pivot miss the threshold;
* the items of the remaining blocks are scored in full; all that reach the threshold are retrieved, not the best k.

This runs for many passages at once in numpy, in slices of bounded size. A retrieved item counts as a leak if at least
``overlap`` of the 5-word shingles of its question and of its answer stand in the passage. What follows the last question
mark or ``answer:`` is the answer; an item without such a mark is a question only.

The index is a table in the shared folder, in parts of about ``part_bytes`` of item text. A task holds the words of
``held_chars`` of documents at a time and takes one part after another to them; nothing of it goes through the driver.

Words are runs of letters and digits, case-folded. Null or empty text has no passages; null items and items without words
are left out, items of null id are found like others; repeated documents each get their rows, repeated items are items of
their own; an empty table on either side gives no row. A document of null id is a document of its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W_]+")
ANSWER = re.compile(r"(?is)^(.*(?:\?|\banswer\s*:))(.+)$")
K1, B = 1.2, 0.75
SHINGLE = 5
SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64())])
SQL = "doc_id long, text_key long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
#: The share of the threshold at whose reaching the pivot lies: the smaller, the more lists and the fewer blocks are looked at.
PIVOT = 0.25
#: Passage entries that are worked on at once.
SLICE = 1 << 20


def words(text: str) -> list[str]:
    return WORD.findall(text.casefold())


def parts(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    cut = ANSWER.match(text)
    if cut and WORD.search(cut[1]) and WORD.search(cut[2]):
        return words(cut[1]), words(cut[2])
    return words(text), []


def shingles(ids: list[int]) -> set[tuple[int, ...]]:
    n = min(SHINGLE, len(ids))
    return {tuple(ids[k : k + n]) for k in range(len(ids) - n + 1)} if n else set()


class Index:
    """Inverted index of some items with block maxima.

    ``items``: (id, question words, answer words, frequency among all items of each distinct word); ``n``, ``average`` and
    ``longest`` are those of all items, wherever they are indexed.
    """

    def __init__(self, items: list[tuple[int | None, list[str], list[str], dict[str, int]]], threshold: float, n: int, average: float, longest: int, block: int = 8):
        self.threshold, self.longest, self.block = threshold, longest, block
        items = sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2]))
        self.keys = [x[0] for x in items]
        self.n_blocks = max(1, -(-len(items) // block))
        lists: dict[str, set[int]] = {}
        for i, (_, q, a, _) in enumerate(items):
            for w in (*q, *a):
                lists.setdefault(w, set()).add(i // block)
        # numbers ascend from the longest list to the shortest
        self.vocabulary = {w: k for k, w in enumerate(sorted(lists, key=lambda w: (-len(lists[w]), w)))}
        term, item, value = [], [], []
        for i, (_, q, a, df) in enumerate(items):
            size = len(q) + len(a)
            got = {self.vocabulary[w]: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * size / average)) for w, c in Counter((*q, *a)).items()}
            own = sum(got.values())
            term += got
            item += [i] * len(got)
            value += [v / own for v in got.values()]
        # by item: full scores; by term and block: the bounds
        self.item_first = np.searchsorted(np.array(item, np.int64), np.arange(len(items) + 1))
        self.item_terms, self.item_values = np.array(term, np.int64), np.array(value)
        key = np.array(term, np.int64) * self.n_blocks + np.array(item, np.int64) // block
        found, where = np.unique(key, return_inverse=True)
        self.list_block, self.list_bound = found % self.n_blocks, np.zeros(len(found))
        np.maximum.at(self.list_bound, where, self.item_values)
        self.list_first = np.searchsorted(found // self.n_blocks, np.arange(len(lists) + 1))
        self.most = np.append(np.maximum.reduceat(self.list_bound, self.list_first[:-1]) if len(lists) else [], 0.0)
        get = self.vocabulary.__getitem__
        self.questions = [shingles(list(map(get, q))) for _, q, _, _ in items]
        self.answers = [shingles(list(map(get, a))) for _, _, a, _ in items]

    def search(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, float, int, np.ndarray]]:
        """(document, item, score, first word, words) of all passages that reach the threshold with an item."""
        size, step = 2 * self.longest, self.longest
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        # documents of about equal length together, so that padding at most doubles a slice
        for level in np.unique(np.frexp(sizes)[1]).tolist() if self.keys else []:
            some = np.flatnonzero(np.frexp(sizes)[1] == level)
            width = int(min(size, sizes[some].max()))
            if not width:
                continue
            starts = [np.arange(0, max(1, sizes[d] - step), step) for d in some.tolist()]
            doc, start = np.repeat(some, [len(s) for s in starts]), np.concatenate(starts)
            for at in range(0, len(doc), max(1, SLICE // width)):
                mine, first = doc[at : at + max(1, SLICE // width)], start[at : at + max(1, SLICE // width)]
                passages = np.full((len(mine), width), -1, np.int32)
                for k, (d, s) in enumerate(zip(mine.tolist(), first.tolist(), strict=True)):
                    piece = docs[d][s : s + width]
                    passages[k, : len(piece)] = piece
                for row, i, score in self.hits(passages):
                    yield int(mine[row]), i, score, int(first[row]), passages[row]

    def hits(self, passages: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(passage, item, score) at or above the threshold."""
        terms = np.sort(passages, axis=1)
        fresh = terms >= 0
        fresh[:, 1:] &= terms[:, 1:] != terms[:, :-1]
        reached = np.cumsum(np.where(fresh, self.most[terms], 0.0), axis=1)
        opens = fresh & (reached >= PIVOT * self.threshold - 1e-9)
        before = np.where(fresh & ~opens, reached, 0.0).max(1)
        row, column = np.nonzero(opens)
        opening = terms[row, column]
        count = self.list_first[opening + 1] - self.list_first[opening]
        if not count.sum():
            return
        at = np.repeat(self.list_first[opening] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
        key = np.repeat(row, count) * self.n_blocks + self.list_block[at]
        order = np.argsort(key, kind="stable")
        key, bound = key[order], self.list_bound[at][order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        total, key = np.add.reduceat(bound, new), key[new]
        mask = np.zeros(len(self.vocabulary) + 1, bool)
        at_row, known = -1, None
        for k in key[total + before[key // self.n_blocks] >= self.threshold - 1e-9].tolist():
            r, b = divmod(k, self.n_blocks)
            if r != at_row:
                if known is not None:
                    mask[known] = False
                at_row, known = r, terms[r][fresh[r]]
                mask[known] = True
            lo, hi = b * self.block, min((b + 1) * self.block, len(self.keys))
            first = self.item_first[lo : hi + 1]
            s = slice(first[0], first[-1])
            scores = np.add.reduceat(np.where(mask[self.item_terms[s]], self.item_values[s], 0.0), first[:-1] - first[0])
            for i in np.flatnonzero(scores >= self.threshold - 1e-9).tolist():
                yield r, lo + i, float(scores[i])

    def leaks(self, docs: list[np.ndarray], overlap: float) -> Iterator[tuple[int, int, float, float, float, int]]:
        """The best verified passage of each document and item."""
        best: dict[tuple[int, int], tuple] = {}
        for d, i, score, first, passage in self.search(docs):
            ids = passage.tolist()
            sizes = {len(x) for part in (self.questions[i], self.answers[i]) for x in part}
            held = set().union(*({tuple(ids[k : k + n]) for k in range(len(ids) - n + 1)} for n in sizes))
            q, a = (len(part & held) / len(part) if part else 1.0 for part in (self.questions[i], self.answers[i]))
            if q >= overlap and a >= overlap:
                found = (score, q, a, -first)
                best[d, i] = max(best.get((d, i), found), found)
        for (d, i), (score, q, a, first) in sorted(best.items()):
            yield d, i, score, q, a, -first


def stored_index(benchmark: DataFrame, part_bytes: int, item_col: str, text_col: str) -> tuple[str, int, dict]:
    """Write the items with their words' frequencies below the shared folder; its path, number of parts, and totals."""
    spark = benchmark.sparkSession
    schema = pa.schema([("item_id", pa.int64()), ("question", pa.list_(pa.string())), ("answer", pa.list_(pa.string()))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, *parts(text)) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if rows := [x for x in rows if x[1]]:
                yield common.to_batch(rows, schema)

    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    items = common.staged(items.mapInArrow(split, "item_id long, question array<string>, answer array<string>").withColumn("size", F.size("question") + F.size("answer")), "items")
    n, average, longest, size = items.agg(F.count(F.lit(1)), F.avg("size"), F.max("size"), F.sum(F.octet_length(F.array_join(F.concat("question", "answer"), " ")))).first()
    n_parts = max(1, -(-(size or 0) // part_bytes))
    key = F.xxhash64("item_id", "question", "answer").alias("key")
    each = items.select(key, F.explode(F.array_distinct(F.concat("question", "answer"))).alias("word"))
    frequency = common.staged(each.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "frequency")
    found = common.skew_join(each.distinct(), frequency, ["word"], ["key"]).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("df"))
    path = common.staging(spark, "index")
    whole = items.withColumn("key", key).join(found, "key").withColumn("part", F.pmod("key", F.lit(n_parts)))
    whole.select("part", "item_id", "question", "answer", "df").repartition(n_parts, "part").write.partitionBy("part").parquet(path)
    return path, n_parts, {"n": n, "average": average or 1.0, "longest": longest or 1}


_indexes: dict[tuple, Index | None] = {}


def loaded(path: str, part: int, threshold: float, totals: dict) -> Index | None:
    """A part of the index; a worker keeps the last one it read."""
    import pyarrow.dataset as ds

    if (path, part, threshold) not in _indexes:
        system, folder = common.filesystem(f"{path}/part={part}")
        rows: list[tuple] = []
        if [x for x in system.get_file_info([folder]) if x.type.name == "Directory"]:
            for batch in ds.dataset(folder, filesystem=system, format="parquet").to_batches(columns=["item_id", "question", "answer", "df"]):
                rows += [(*x, dict(df)) for *x, df in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)]
        _indexes.clear()
        _indexes[path, part, threshold] = Index(rows, threshold, **totals) if rows else None
    return _indexes[path, part, threshold]


def _search(docs: DataFrame, benchmark: DataFrame, threshold: float, overlap: float, part_bytes: int, held_chars: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """The columns of ``SCHEMA``: the text key tells documents of null id apart."""
    common.ensure_workers(docs.sparkSession)
    path, n_parts, totals = stored_index(benchmark, part_bytes, item_col, item_text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(keys: list[tuple], bodies: list[list[str]]) -> Iterator[pa.RecordBatch]:
            for part in range(n_parts):
                if (index := loaded(path, part, threshold, totals)) is None:
                    continue
                get = index.vocabulary.get
                docs = [np.fromiter((get(w, -1) for w in x), np.int32, len(x)) for x in bodies]
                if got := [(*keys[d], index.keys[i], score, q, a, first) for d, i, score, q, a, first in index.leaks(docs, overlap)]:
                    yield common.to_batch(got, SCHEMA)

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            texts = [x or "" for x in batch.column(2).to_pylist()]
            for some in common.groups(texts, held_chars if n_parts > 1 else 1 << 20):
                yield from found([keys[k] for k in some], [words(texts[k]) for k in some])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, SQL)


def leaked_items(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, part_bytes: int = 16 << 20, held_chars: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per document and leaked item: best BM25 score, overlaps and the passage's first word."""
    return _search(docs, benchmark, threshold, overlap, part_bytes, held_chars, id_col, text_col, item_col, item_text_col).drop("text_key")


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, part_bytes: int = 16 << 20, held_chars: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without any leaked item, with all their columns. Rows that share an id go or stay together; those of
    null id do so by their text."""
    leaked = _search(docs, benchmark, threshold, overlap, part_bytes, held_chars, id_col, text_col, item_col, item_text_col)
    gone = leaked.select(F.col("doc_id").alias("_leaked_id"), F.when(F.col("doc_id").isNull(), F.col("text_key")).otherwise(0).alias("_leaked_text")).distinct()
    ident = docs[id_col].cast("long")
    text = F.when(ident.isNull(), F.xxhash64(docs[text_col].cast("string"))).otherwise(0)
    return docs.join(gone, ident.eqNullSafe(gone["_leaked_id"]) & (text == gone["_leaked_text"]), "left_anti")
