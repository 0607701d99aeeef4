"""Token-id output: byte-level BPE ids, frequency-ranked and stored in a byte-aligned variable-length code.

A file holds a run of documents in ascending ``doc_id`` order::

    b"QTOK1\\n"  magic
    6 x u64     documents, tokens, rank-table entries, control bytes, data bytes, flags (0)
    i64[d]      doc_id (null: the least value, with a bit set in the null map)
    u8[d]       1 where doc_id is null
    u32[d]      tokens per document, end id included
    u32[r]      rank table: id of each rank, most frequent in the file first, ties by id
    u8[c]       control bytes: four 2-bit lengths each (0: one byte ... 3: four bytes)
    u8[b]       little-endian rank bytes, leading zero bytes left out

Ranks are those of the file's own tokens, so every file is complete in itself, is encoded in one pass and is written
again by itself when an executor is lost. Decoding looks four tokens up per control byte in a numpy table.

Null text counts as empty; rows with equal ``doc_id`` are all kept (ordered by text); null ``doc_id`` comes first; an
empty table gives no file and no row. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

MAGIC = b"QTOK1\n"
VOCABULARY = "byte_bpe_50k.json"
MANIFEST = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])
DECODED = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("within", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("data_bytes", T.LongType())])
#: Write tasks whose files are counted together; there are as many blocks as partitions over this.
PARTS_A_BLOCK = 1000
#: Letters and other characters for which the pre-tokenizer's classes are spelled out here; texts with any other
#: character are cut only at sure boundaries and left to the library.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
OTHER = re.compile(rf"[^\t\n\r -~{LETTERS}]")
#: The byte-level pre-tokenizer's pattern over those characters.
PRETOKEN = re.compile(rf" ?[{LETTERS}]++|'(?:[stmd]|re|ve|ll)| ?[0-9]++| ?[^\s0-9{LETTERS}]++|\s+(?!\S)|\s+")
WORD = re.compile(rf" [{LETTERS}]+")
#: How the byte-level alphabet writes a space.
SPACE = "\u0120"
LONG = 64
#: Elsewhere, a space is a boundary of pre-tokens if a non-space stands before or after it.
SURE = re.compile(r"(?<=\S)(?= )|(?= \S)")


class Encoder:
    """Encodes whole texts with a memo of their pieces; a piece that the memo lacks goes to the tokenizers library.

    The memo is emptied when its pieces pass ``memo_chars`` characters; pieces over ``LONG`` characters aren't kept in it.
    """

    def __init__(self, path: str, memo_chars: int = 8_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = self.tokenizer.model
        if hasattr(model, "_resize_cache"):  # the library's own cache of words holds what the memo has already
            model._resize_cache(0)
            self.tokenizer.model = model
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[k for token, k in self.tokenizer.get_vocab().items() if token.startswith(SPACE)]] = True
        self.memo: dict[str, bytes] = {}
        self.held, self.limit = 0, memo_chars

    def learn(self, pieces: list[str]) -> None:
        encode = self.tokenizer.encode_batch_fast
        words, rest = [], []
        for piece in pieces:
            (words if WORD.fullmatch(piece) else rest).append(piece)
        for at in range(0, len(words), 4096):  # a word's space is its only one: the tokens that begin with it tell the words apart
            some = words[at : at + 4096]
            ids = np.array(encode(["".join(some)], add_special_tokens=False)[0].ids, self.width)
            raw, starts = ids.tobytes(), (np.flatnonzero(self.spaced[ids]) * ids.itemsize).tolist()
            if len(starts) != len(some):
                raise ValueError("not a byte-level vocabulary")
            self.memo.update((w, raw[a:b]) for w, a, b in zip(some, starts, [*starts[1:], len(raw)], strict=True))
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for piece, found in zip(some, encode(some, add_special_tokens=False), strict=True):
                self.memo[piece] = np.array(found.ids, self.width).tobytes()

    def pieces(self, text: str) -> list[str]:
        if not text:
            return []
        return SURE.split(text) if "<|" in text or OTHER.search(text) else PRETOKEN.findall(text)

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; every piece is looked up once, and only those that the memo lacks again."""
        cut = [self.pieces(x) for x in texts]
        found = [list(map(self.memo.get, x)) for x in cut]
        gaps = [[k for k, ids in enumerate(x) if ids is None] for x in found]
        new = {pieces[k] for pieces, gap in zip(cut, gaps, strict=True) for k in gap}
        if new:
            size = sum(map(len, new))
            if self.held + size > self.limit:
                self.memo.clear()
                self.held = 0
            self.held += size
            self.learn(list(new))
            for pieces, row, gap in zip(cut, found, gaps, strict=True):
                for k in gap:
                    row[k] = self.memo[pieces[k]]
        for piece in new:
            if len(piece) > LONG:
                del self.memo[piece]
                self.held -= len(piece)
        return [np.frombuffer(b"".join(x), self.width) for x in found]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """The bytes of one file."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    counts = np.bincount(flat) if len(flat) else np.zeros(0, np.int64)
    used = np.flatnonzero(counts)
    table = used[np.argsort(-counts[used], kind="stable")].astype("<u4")
    rank = np.zeros(len(counts), np.uint32)
    rank[table] = np.arange(len(table), dtype=np.uint32)
    control, data = pack_ranks(rank[flat])
    head = np.array([len(doc_ids), len(flat), len(table), len(control), len(data), 0], "<u8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join((MAGIC, head.tobytes(), keys.tobytes(), null.tobytes(), np.array([len(x) for x in ids], "<u4").tobytes(), table.tobytes(), control.tobytes(), data.tobytes()))


def pack_ranks(ranks: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    controls, datas = [], []
    for at in range(0, len(ranks), block):  # a multiple of four
        some = ranks[at : at + block].astype("<u4")
        code = (some > 0xFF).astype(np.uint8)
        wide = 2
        while some.max() >> 8 * wide:
            code += some > (1 << 8 * wide) - 1
            wide += 1
        full = np.concatenate((code, np.zeros(-len(code) % 4, np.uint8))).reshape(-1, 4)
        controls.append(full[:, 0] | full[:, 1] << 2 | full[:, 2] << 4 | full[:, 3] << 6)
        datas.append(some.view(np.uint8).reshape(-1, 4)[:, :wide][np.arange(wide) <= code[:, None]])
    empty = np.zeros(0, np.uint8)
    return np.concatenate([empty, *controls]).astype(np.uint8), np.concatenate([empty, *datas])


#: Lengths of the four tokens of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int, block: int = 1 << 18) -> np.ndarray:
    out = np.empty(n, np.uint32)
    padded = np.concatenate((data, np.zeros(4, np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded[:4].view("<u4"), (len(padded) - 3,), (1,)) if len(padded) >= 4 else padded.view("<u4")
    at = 0
    for c in range(0, len(control), block):
        lengths = LENGTHS[control[c : c + block]].ravel()[: n - 4 * c]
        ends = at + np.cumsum(lengths, dtype=np.int64)
        out[4 * c : 4 * c + len(lengths)] = words[ends - lengths] & MASKS[lengths]
        at = int(ends[-1]) if len(ends) else at
    return out


def unpack(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """doc_ids, tokens per document, all ids, code bytes."""
    if blob[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    at = len(MAGIC)

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(blob, kind, n, at)
        at += got.nbytes
        return got

    docs, n, ranks, controls, size, _ = map(int, take("<u8", 6))
    keys, null, counts, ids = take("<i8", docs), take("u1", docs), take("<u4", docs), take("<u4", ranks)
    control, data = take("u1", controls), take("u1", size)
    flat = ids[unpack_ranks(control, data, n)] if n else np.zeros(0, "<u4")
    return [None if z else int(k) for k, z in zip(keys, null, strict=True)], counts.astype(np.int64), flat.astype("<u4"), controls + size


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = 4_000_000) -> DataFrame:
    """Write the ids of every text below ``folder``; the manifest, one row per file, is a table stored beside the files."""
    spark = docs.sparkSession
    common.ensure_workers(spark)
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, end = TaskContext.get().partitionId(), encoder(vocabulary), np.array([end_id])
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        held = seq = 0

        def slices(batches: Iterator[pa.RecordBatch], chars: int = 1 << 21) -> Iterator[list]:
            for batch in batches:
                names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for some in common.groups([x or "" for x in texts], chars):
                    yield zip(names[some.start : some.stop], encode.many([texts[k] or "" for k in some]), strict=True)

        def flush() -> pa.RecordBatch:
            nonlocal keys, ids, held, seq
            name = f"tokens-{part:06d}-{seq:05d}.bin"
            common.write_file(folder, name, pack(keys, ids))
            row = (part, seq, name, len(keys), held)
            keys, ids, held, seq = [], [], 0, seq + 1
            return common.to_batch([row], schema)

        for key, text in ((k, t) for some in slices(batches) for k, t in some):
            found = np.concatenate((text, end.astype(text.dtype)))
            if held and held + len(found) > file_tokens:
                yield flush()
            keys.append(key)
            ids.append(found)
            held += len(found)
        if keys:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document from the files: id, start among all ids, counts and checksum."""
    common.ensure_workers(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(DECODED.names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, name in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                keys, counts, flat, size = unpack(common.read_file(folder, name))
                ends = np.cumsum(counts)
                raw, data = memoryview(flat).cast("B") if len(flat) else memoryview(b""), []
                for e, n in zip(ends.tolist(), counts.tolist(), strict=True):
                    data.append(zlib.crc32(raw[4 * (e - n) : 4 * e]))
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(([part] * n, [seq] * n, keys, ends - counts, counts, data, [size] * n), kinds, strict=True)], schema=schema)

    # running totals in two steps, within blocks of parts and over the blocks, so that no task orders all files
    block = F.expr(f"part DIV {PARTS_A_BLOCK}").alias("block")
    inside = Window.partitionBy("block").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    blocks = manifest.select(block, "n_ids").groupBy("block").agg(F.sum("n_ids").alias("n"))
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    starts = manifest.select("part", "seq", block, "n_ids").withColumn("within_block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(F.broadcast(blocks), "block")
    starts = starts.select("part", "seq", (F.col("start") + F.col("within_block")).cast("long").alias("before"))
    cores = max(spark.sparkContext.defaultParallelism, 1)
    decoded = manifest.select("part", "seq", "file").repartition(4 * cores, "file").mapInArrow(run, DECODED)
    return decoded.join(F.broadcast(starts) if _few(manifest) else starts, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def _few(manifest: DataFrame, limit: int = 200_000) -> bool:
    """Whether the manifest (about 50 bytes a row) is small enough to broadcast; beyond it the join shuffles."""
    return manifest.count() <= limit


def token_digest(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and return the per-document digest read back from them."""
    spark = docs.sparkSession
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    folder = folder or common.staging(spark, "tokens")
    write_tokens(docs, folder, vocabulary)
    return read_tokens(spark, folder)
