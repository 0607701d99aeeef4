"""Splitting text into parents and children under a token budget.

A text is a row of blocks: headers, tables and paragraphs, parted by blank lines. Parents pack consecutive blocks while their
words fit; a table is never cut and begins no overlap; a longer paragraph is cut at sentences, then at words. A new parent
repeats the last sentences of the one before that fit ``overlap`` words, back to a table at most, unless it begins with one. Every parent knows
the headers above its first own block. Children pack the sentences of a parent in the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = re.compile(r"^(#+)[ \t]+(\S.*)$")
TABLE_ROW = re.compile(r"^\s*\|.*\|\s*$")
#: White space behind an end of a sentence; beginning with the space keeps the search quick.
SENTENCE_END = re.compile(r"\s(?<=[.!?]\s)\s*")
#: Texts that a task cuts before it hands their chunks on.
TEXTS = 64
CHUNKS = pa.schema([("file_id", pa.int64()), ("parent", pa.int32()), ("child", pa.int32()), ("content", pa.string()), ("section", pa.string()), ("place", pa.int32()), ("n_words", pa.int32())])


def blocks(text: str) -> Iterator[tuple[str, int, str]]:
    """(kind, place of the first character, text) of each block; kinds are header, table and paragraph."""
    held: list[str] = []
    kind, begin, at = "", 0, 0
    for line in [*text.split("\n"), ""]:
        new = "header" if HEADER.match(line) else "table" if TABLE_ROW.match(line) else "paragraph" if line.strip() else ""
        if held and (new != kind or new == "header"):
            yield kind, begin, "\n".join(held)
            held = []
        if new:
            if not held:
                kind, begin = new, at
            held.append(line)
        at += len(line) + 1


def tail(text: str, overlap: int) -> str:
    """The last whole sentences of a text that fit ``overlap`` words."""
    kept: list[str] = []
    for line in reversed(text.strip().split("\n")):
        for sentence in reversed(SENTENCE_END.split(line.strip())):
            overlap -= len(sentence.split())
            if overlap < 0 or TABLE_ROW.match(sentence):
                return " ".join(reversed(kept))
            kept.append(sentence)
    return " ".join(reversed(kept))


def pieces(text: str, budget: int) -> Iterator[tuple[str, int]]:
    """(piece, its words) of a paragraph cut at sentences, and a sentence over the budget at words."""
    for sentence in SENTENCE_END.split(text.strip()):
        words = sentence.split()
        if len(words) <= budget:
            if words:
                yield sentence, len(words)
            continue
        for at in range(0, len(words), budget):
            yield " ".join(words[at : at + budget]), min(budget, len(words) - at)


def packed(parts: Iterable[tuple[str, int, bool]], budget: int, overlap: int, joint: str) -> Iterator[tuple[int, str, int]]:
    """(number of the first own part, text, its words): joins consecutive (text, words, whole) parts while their words fit."""
    held: list[str] = []
    size = first = 0
    for k, (part, n, whole) in enumerate(parts):
        if held and size + n > budget:
            yield first, joint.join(held), size
            again = "" if whole else tail(joint.join(held), min(overlap, budget - n))
            held, size, first = ([again] if again else []), len(again.split()), k
        held.append(part)
        size += n
    if held:
        yield first, joint.join(held), size


def chunk_text(text: str, parent_budget: int, child_budget: int, overlap: int = 0) -> list[tuple[int, int, str, str, int]]:
    """(parent, child or -1, content, section path, place in the text); blank text gives nothing, any other one chunk at least."""
    return [x[:-1] for x in counted_chunks(text, parent_budget, child_budget, overlap)]


def counted_chunks(text: str, parent_budget: int, child_budget: int, overlap: int = 0) -> list[tuple[int, int, str, str, int, int]]:
    """The same with the words of each chunk, which are counted once, where a text is cut into pieces."""
    parts: list[tuple[str, int, bool]] = []
    about: list[tuple[str, int]] = []
    stack: list[tuple[int, str]] = []
    for kind, place, body in blocks(text):
        if kind == "header":
            level, name = len(HEADER.match(body)[1]), HEADER.match(body)[2].strip()
            stack = [x for x in stack if x[0] < level] + [(level, name)]
        n = len(body.split())
        for piece, size in [(body, n)] if kind != "paragraph" or n <= parent_budget else pieces(body, parent_budget):
            parts.append((piece, size, kind == "table"))
            about.append((" > ".join(x for _, x in stack), place))
    rows = []
    for p, (first, parent, size) in enumerate(packed(parts, parent_budget, overlap, "\n")):
        rows.append((p, -1, parent, *about[first], size))
        sentences = ((x, n, False) for x, n in pieces(parent, child_budget))
        rows += [(p, c, child, *about[first], n) for c, (_, child, n) in enumerate(packed(sentences, child_budget, overlap, " "))]
    return rows


def budget_chunks(docs: DataFrame, parent_budget: int = 512, child_budget: int = 150, overlap: int = 60) -> DataFrame:
    """(file_id, parent, child, content, section, place, n_words) in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # few texts at a time, so that what a task holds doesn't grow with a batch's chunks
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                rows = [(i, *x) for i, t in zip(*(c.to_pylist() for c in part.columns), strict=True) for x in counted_chunks(t or "", parent_budget, child_budget, overlap)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CHUNKS, strict=True)], schema=CHUNKS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "file_id long, parent int, child int, content string, section string, place int, n_words int")
