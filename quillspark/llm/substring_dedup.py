"""Substring deduplication by difference-cover anchors.

A window is ``window`` consecutive words (``[^\\x20\\x09-\\x0D]+``) of one document. Any two windows with equal words share an
equal, equally shifted anchor: positions modulo ``PERIOD`` that lie in the difference cover start an anchor of
``window - PERIOD + 1`` words, and for any two positions some shift below the period brings both into the cover. So only
anchors are hashed and compared first (4 of 13 positions); where an anchor recurs, it is extended to the full windows
around it, and these are compared on 96-bit hashes. A window that also starts earlier (smaller ``doc_id``, or the same
document at an earlier word) is late, and the words that late windows cover are removed. Windows are judged on the input.

Documents are dealt to chunks of about ``chunk_bytes`` by a hash of their id (null ids: of their text). A chunk sends each
distinct anchor or window once, in packed arrays, so a passage of a third of all documents costs one entry per chunk, not
one per copy. The arrays go to buckets of hash values, each for some ``BUCKET_BYTES`` of text; there are never more rows of
arrays than chunks times buckets, nor than anchors.

Null text has no words; texts under ``window`` words lose none; rows of null id come after all others, in the order of a
hash of their texts; rows that share an id come in the order of their texts, as parts of one document in which no window
crosses from one to the next (so do rows of null id and equal text); an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash

#: A perfect difference set: every difference modulo 13 occurs.
PERIOD = 13
COVER = (0, 1, 3, 9)
BUCKET_BYTES = 128 << 20

ENTRIES = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("more", pa.binary()), ("places", pa.binary()), ("docs", pa.binary()), ("null_ids", pa.binary()), ("shared", pa.binary())])
ENTRIES_SQL = "bucket int, chunk int, hashes binary, more binary, places binary, docs binary, null_ids binary, shared binary"
REPLY = pa.schema([("chunk", pa.int32()), ("places", pa.binary())])
REPLY_SQL = "chunk int, places binary"


class Chunk:
    """The documents of a chunk in a fixed order, and the hashes of their words."""

    def __init__(self, table: pa.Table):
        keys, nulls, texts = table.column("doc_key").to_pylist(), table.column("null_id").to_pylist(), common.column_bytes(table.column("text"))
        order = sorted(range(len(keys)), key=lambda k: (nulls[k], keys[k], texts[k]))
        self.keys, self.nulls, self.texts = [keys[k] for k in order], [nulls[k] for k in order], [texts[k] for k in order]

    def hash(self) -> None:
        parts, sizes = [], []
        for some in common.groups(self.texts, 1 << 21):
            h, first = wordhash.hashed_words([self.texts[k] for k in some])
            parts.append(h)
            sizes.append(np.diff(first))
        self.h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.first = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1, np.int64)

    def anchors(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of each anchor."""
        a = wordhash.window_hashes(self.h, width)
        place = np.arange(len(a)) - np.repeat(self.first[:-1], np.diff(self.first))[: len(a)]
        take = np.flatnonzero(np.isin(place % PERIOD, COVER) & wordhash.whole_windows(self.first, width, len(a)))
        return a[take], take

    def doc_at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key of the document at each place, and whether its id is null."""
        doc = np.searchsorted(self.first, places, side="right") - 1
        return np.array(self.keys, np.int64)[doc], np.array(self.nulls, np.uint8)[doc]


def once(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each value: whether it is the only one; the distinct values that recur."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    end = np.concatenate((new[1:], [True])) if len(s) else new
    alone, lead = np.empty(len(h), bool), np.empty(len(h), bool)
    alone[order], lead[order] = new & end, new
    return alone, s[new & ~end], lead


def buckets_of(h: np.ndarray, n: int) -> np.ndarray:
    return (h % np.uint64(n)).astype(np.int64)


def split(buckets: np.ndarray, n: int, *arrays: np.ndarray) -> list[list[np.ndarray]]:
    """Each array cut by bucket, order kept."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.searchsorted(buckets[order], np.arange(1, n))
    return [np.split(x[order], cuts) for x in arrays]


def anchor_entries(chunk_id: int, table: pa.Table, window: int, n: int) -> pa.Table:
    chunk = Chunk(table)
    chunk.hash()
    h, _ = chunk.anchors(window - PERIOD + 1)
    alone, shared, _ = once(h)
    ordinal = np.flatnonzero(alone)
    hs, places = split(buckets_of(h[ordinal], n), n, h[ordinal], ordinal)
    (known,) = split(buckets_of(shared, n), n, shared)
    rows = [(b, chunk_id, hs[b].tobytes(), b"", common.delta_bytes(places[b]), b"", b"", known[b].tobytes()) for b in range(n) if len(hs[b]) or len(known[b])]
    return pa.Table.from_batches([common.to_batch(rows, ENTRIES)] if rows else [], ENTRIES)


def recurring(table: pa.Table) -> pa.Table:
    """Of a bucket's anchors, the ordinals of those that other chunks hold too."""
    chunks = table.column("chunk").to_pylist()
    hs = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    known = [np.frombuffer(x, np.uint64) for x in table.column("shared").to_pylist()]
    alone, _, _ = once(np.concatenate([*hs, *known]))
    rows, at = [], 0
    for chunk, h, places in zip(chunks, hs, table.column("places").to_pylist(), strict=True):
        again = ~alone[at : at + len(h)]
        at += len(h)
        if again.any():
            rows.append((chunk, common.delta_bytes(common.delta_values(places)[again])))
    return pa.Table.from_batches([common.to_batch(rows, REPLY)] if rows else [], REPLY)


def window_entries(chunk_id: int, table: pa.Table, replies: pa.Table, window: int, n: int) -> pa.Table:
    """Extend the recurring anchors of a chunk to all windows around them; each distinct one goes out with its first place."""
    chunk = Chunk(table)
    chunk.hash()
    h, at = chunk.anchors(window - PERIOD + 1)
    alone, _, _ = once(h)
    again = ~alone
    for places in replies.column("places").to_pylist():
        again[common.delta_values(places)] = True
    total = len(chunk.h) - window + 1
    if total <= 0 or not again.any():
        return pa.Table.from_batches([], ENTRIES)
    edge = np.zeros(len(chunk.h) + 2, np.int32)
    np.add.at(edge, np.maximum(at[again] - PERIOD + 1, 0), 1)
    np.add.at(edge, at[again] + 1, -1)
    places = np.flatnonzero((np.cumsum(edge)[:total] > 0) & wordhash.whole_windows(chunk.first, window, total))
    h1 = wordhash.window_hashes(chunk.h, window)[places]
    h2 = wordhash.window_hashes(wordhash.mix(chunk.h + np.uint64(1)), window)[places]
    _, _, lead = once(h1)
    keep = np.flatnonzero(lead)
    rows = []
    if len(keep) < len(places):  # known to be late without asking
        rows.append((-1 - chunk_id, chunk_id, b"", b"", common.delta_bytes(places[~lead]), b"", b"", b""))
    hs, more, ps, docs, nulls = split(buckets_of(h1[keep], n), n, h1[keep], (h2[keep] >> np.uint64(32)).astype(np.uint32), places[keep], *chunk.doc_at(places[keep]))
    rows += [(b, chunk_id, hs[b].tobytes(), more[b].tobytes(), common.delta_bytes(ps[b]), docs[b].tobytes(), nulls[b].tobytes(), b"") for b in range(n) if len(hs[b])]
    return pa.Table.from_batches([common.to_batch(rows, ENTRIES)] if rows else [], ENTRIES)


def late_windows(table: pa.Table) -> pa.Table:
    """Of a bucket's windows, the places of those that start earlier elsewhere."""
    chunks, raw = table.column("chunk").to_pylist(), table.column("places").to_pylist()
    if table.column("bucket")[0].as_py() < 0:
        return pa.Table.from_batches([common.to_batch(list(zip(chunks, raw, strict=True)), REPLY)], REPLY)
    hs = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    h = np.concatenate(hs)
    more = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("more").to_pylist()])
    docs = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("docs").to_pylist()])
    nulls = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("null_ids").to_pylist()])
    order = np.lexsort((docs, nulls, more, h))
    same = np.concatenate(([False], (h[order][1:] == h[order][:-1]) & (more[order][1:] == more[order][:-1])))
    late = np.zeros(len(h), bool)
    late[order] = same  # a chunk sends a window once, and a key is in one chunk, so keys alone order them
    rows, at = [], 0
    for chunk, part, places in zip(chunks, hs, raw, strict=True):
        mine = late[at : at + len(part)]
        at += len(part)
        if mine.any():
            rows.append((chunk, common.delta_bytes(common.delta_values(places)[mine])))
    return pa.Table.from_batches([common.to_batch(rows, REPLY)] if rows else [], REPLY)


def kept_words(table: pa.Table, replies: pa.Table, window: int) -> Iterator[tuple[int | None, list[bytes], int]]:
    """(doc_id, kept words, words removed) of a chunk's documents."""
    chunk = Chunk(table)
    words = [x.split() for x in chunk.texts]
    first = np.concatenate(([0], np.cumsum([len(x) for x in words], dtype=np.int64)))
    edge = np.zeros(int(first[-1]) + 1, np.int32)
    for places in replies.column("places").to_pylist():
        starts = common.delta_values(places)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
    keep = np.cumsum(edge)[:-1] == 0
    for k, found in enumerate(words):
        mine = keep[first[k] : first[k + 1]]
        left = int(mine.sum())
        yield None if chunk.nulls[k] else chunk.keys[k], found if left == len(found) else list(compress(found, mine.tolist())), len(found) - left


def late_table(docs: DataFrame, window: int, chunk_bytes: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The documents by chunk, and the places of late windows by chunk."""
    common.ensure_workers(docs.sparkSession)
    if window < PERIOD:
        raise ValueError(f"a window takes at least {PERIOD} words")
    text = F.col(text_col).cast("string")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_chunks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // chunk_bytes))
    n = max(16, -(-size // BUCKET_BYTES))
    ident = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(ident, F.xxhash64(text)).alias("doc_key"), ident.isNull().alias("null_id"), text.alias("text"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_key"), F.lit(n_chunks)).cast("int")).repartition(n_chunks, "chunk")

    def anchors(key: tuple, table: pa.Table) -> pa.Table:
        return anchor_entries(key[0].as_py(), table, window, n)

    def windows(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        return window_entries(key[0].as_py(), table, replies, window, n)

    again = rows.groupBy("chunk").applyInArrow(anchors, ENTRIES_SQL).groupBy("bucket").applyInArrow(recurring, REPLY_SQL)
    entries = rows.groupBy("chunk").cogroup(again.groupBy("chunk")).applyInArrow(windows, ENTRIES_SQL)
    return rows, entries.groupBy("bucket").applyInArrow(late_windows, REPLY_SQL)


def dedup_substrings(docs: DataFrame, window: int = 20, chunk_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept text (words joined by one space), n_words, n_removed."""
    return _kept(docs, window, chunk_bytes, id_col, text_col, lambda words: b" ".join(words).decode("utf-8", "replace"), "kept_text")


def substring_digest(docs: DataFrame, window: int = 20, chunk_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return _kept(docs, window, chunk_bytes, "doc_id", "text", lambda words: hashlib.sha256(b" ".join(words)).hexdigest(), "kept_sha256")


def _kept(docs: DataFrame, window: int, chunk_bytes: int, id_col: str, text_col: str, shape, name: str) -> DataFrame:
    rows, late = late_table(docs, window, chunk_bytes, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), (name, pa.string())])

    def finish(_key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        found = [(key, len(words) + gone, gone, shape(words)) for key, words, gone in kept_words(table, replies, window)]
        return pa.Table.from_batches([common.to_batch(found, schema)] if found else [], schema)

    return rows.groupBy("chunk").cogroup(late.groupBy("chunk")).applyInArrow(finish, f"doc_id long, n_words long, n_removed long, {name} string")


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM t WHERE len(words) >= 20),
k AS (SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 19], ' ')) AS win FROM p),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS w FROM r WHERE nth > 1),
e AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS w, unnest(words) AS word FROM t),
s AS (SELECT e.doc_id, string_agg(CASE WHEN c.w IS NULL THEN word END, ' ' ORDER BY e.w) AS kept, count(c.w) AS gone
      FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.w = e.w GROUP BY 1)
SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN s ON s.doc_id = t.doc_id
"""
