"""Embeddings by feature hashing: deterministic, without a model; whole numbers, so that sums and products are exact."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of lower-cased text: runs of these signs, and runs of others than ASCII.
SIGNS = b"abcdefghijklmnopqrstuvwxyz0123456789_"
BEYOND = re.compile(rb"[\x80-\xff]+")
SPACED = bytes(c if c in SIGNS or c > 127 else 32 for c in range(256))
#: The window of a model that takes no longer texts; no query has one.
MAX_WORDS = 8192
#: Characters of a text that are cut into words at a time, and words that are held before they are added up.
PIECE, HELD = 1 << 20, 1 << 18


def feature(word: str) -> tuple[int, int]:
    """The place (16 bits of the digest) and the sign of a word."""
    found = SIGNED[word.encode()]
    return found >> 1, 1 - 2 * (found & 1)


class Signed(dict):
    """Place and sign of a word in UTF-8 as one number: the place doubled, and 1 more for minus. Begins anew when it is full."""

    most = 1 << 16

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        digest = hashlib.md5(word).digest()
        self[word] = found = digest[0] << 9 | digest[1] << 1 | digest[2] >> 7
        return found


SIGNED = Signed()


def words_of(text: str) -> list[bytes]:
    """All words, in UTF-8."""
    data = text.lower().encode()
    if not data.isascii():
        data = BEYOND.sub(rb" \g<0> ", data)
    return data.translate(SPACED).split()


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of bounded size, cut at spaces."""
    at = 0
    while len(text) - at > PIECE and (end := text.find(" ", at + PIECE)) >= 0:
        yield text[at:end]
        at = end
    yield text[at:]


def embedded(texts: list[str], dimensions: int, most: int | None = MAX_WORDS) -> np.ndarray:
    """A row of ``dimensions`` whole numbers per text: signed counts of its words, all of them where ``most`` is None."""
    total = np.zeros(len(texts) * dimensions)
    found, sizes, rows = [], [], []

    def add() -> None:
        marks = np.array(found, np.int64)
        cell = np.repeat(np.array(rows, np.int64) * dimensions, sizes) + (marks >> 1) % dimensions
        total[:] += np.bincount(cell, 1.0 - 2 * (marks & 1), len(total))
        for held in (found, sizes, rows):
            held.clear()

    for row, text in enumerate(texts):
        for part in pieces(text) if most is None else [text]:
            words = words_of(part)[:most]
            found.extend(map(SIGNED.__getitem__, words))
            sizes.append(len(words))
            rows.append(row)
            if len(found) >= HELD:
                add()
    add()
    return total.reshape(len(texts), dimensions).astype(np.float32)


def embed(text: Column, dimensions: int = 64, prefix: str = "", batch: int = 64) -> Column:
    """The embedding of a whole text behind a prefix (of queries or passages); null and empty texts give zeros."""

    @F.arrow_udf("array<float>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            values = np.zeros((len(part), dimensions), np.float32)
            for at in range(0, len(part), batch):
                values[at : at + batch] = embedded([prefix + (x or "") for x in part[at : at + batch].to_pylist()], dimensions, None)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * dimensions), pa.array(values.reshape(-1)))

    return run(text)


#: The same in DuckDB SQL, for a list of words.
FEATURE_SQL = "CAST(('0x' || left(md5({w}), 4)) AS INTEGER) % {d}"
SIGN_SQL = "CASE WHEN ('0x' || substr(md5({w}), 5, 2))::INTEGER >= 128 THEN -1 ELSE 1 END"
