"""Shared helpers of the training-data operators: shared folders, tables and Arrow plumbing."""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word in the whitespace-word definition ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"


def ensure_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when only the driver's path has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; set here only where a local session has none."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="quillspark-shared-")
        spark.sparkContext.setCheckpointDir(given)
    return given


def staging(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/quillspark/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors.

    Where the number of rows is about known, the files are sized by it: 200,000 rows a file instead of one per partition.
    """
    path = staging(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(rows // 200_000 + 1)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a counted table is broadcast, and the least rows of a key that is dealt over several tasks.
BROADCAST_ROWS = 50_000
HOT_ROWS = 10_000


def hinted(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the table's rows, counted, are few; otherwise the optimiser's own choice."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def skew_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner", n: str = "n") -> DataFrame:
    """Join with a stored table that holds each key once, with the number ``n`` of left rows that have it.

    Few rows are broadcast. Otherwise both sides are shuffled, and a hot key (over ``HOT_ROWS`` rows and over a ten
    thousandth of all, so that there are fewer than 10,000 such keys at any size) is dealt over as many tasks as it needs
    by a hash of the ``spread`` columns.
    """
    rows, total = right.agg(F.count(F.lit(1)), F.sum(n)).first()
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    limit = max(HOT_ROWS, (total or 0) // 10_000)
    salts = F.ceil(F.col(n) / F.lit(limit)).cast("int")
    hot = right.filter(F.col(n) > limit).select(*on, salts.alias("_salts"))
    dealt = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_column(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; empty for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.array_remove(F.split(flat, " "), "")


def filesystem(uri: str):
    """pyarrow filesystem and path of a shared-folder URI (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, data: bytes) -> None:
    """Write under a name of this attempt, then move into place, so that a retried task never leaves a torn file."""
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    part = posixpath.join(path, f".{name}.{uuid.uuid4().hex[:8]}")
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, posixpath.join(path, name))


def read_file(folder: str, name: str) -> bytes:
    system, path = filesystem(folder)
    with system.open_input_file(posixpath.join(path, name)) as src:
        return src.read()


def column_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batches_of(items: Iterator[tuple], schema: pa.Schema, rows: int = 4096, size: int = 1 << 24, weigh=None) -> Iterator[pa.RecordBatch]:
    """Collect row tuples into record batches of bounded rows and bytes."""
    held: list[tuple] = []
    weight = 0
    for item in items:
        held.append(item)
        weight += weigh(item) if weigh else 0
        if len(held) >= rows or weight >= size:
            yield to_batch(held, schema)
            held, weight = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def groups(items: list, size: int) -> Iterator[range]:
    """Runs of consecutive indices whose items' lengths add up to about ``size``, one item at least."""
    at = weight = 0
    for k, x in enumerate(items):
        if k > at and weight + len(x) > size:
            yield range(at, k)
            at, weight = k, 0
        weight += len(x)
    if len(items) > at:
        yield range(at, len(items))


def delta_bytes(values: np.ndarray) -> bytes:
    """Ascending integers as LEB128-coded gaps, vectorised."""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    if not len(gaps):
        return b""
    parts, rest, more = [], gaps, np.ones(len(gaps), bool)
    while more.any():
        low = (rest & np.uint64(127)).astype(np.uint8)
        rest = rest >> np.uint64(7)
        following = more & (rest > 0)
        parts.append((more, np.where(following, low | 128, low).astype(np.uint8)))
        more = following
    keep = np.stack([p[0] for p in parts], 1).ravel()
    return np.stack([p[1] for p in parts], 1).ravel()[keep].tobytes()


def delta_values(data: bytes) -> np.ndarray:
    """Inverse of :func:`delta_bytes`."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = raw < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts))
