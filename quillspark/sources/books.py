"""Text of EPUB books: the archive is opened per row, its chapters become text by expressions."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

BOOK = "title string, language string, chapters array<string>, error string, retryable boolean"
#: Names of a book's parts, and the most bytes of text that are unpacked of one.
CONTAINER, OPF, DC = "{urn:oasis:names:tc:opendocument:xmlns:container}", "{http://www.idpf.org/2007/opf}", "{http://purl.org/dc/elements/1.1/}"
CHAPTER_TYPES = ["application/xhtml+xml", "text/html"]
MOST_BYTES = 256 << 20


def opened(data: bytes) -> tuple[str | None, str | None, list[str]]:
    """(title, language, chapters as HTML) in reading order, then chapters that the order leaves out; the contents page is none."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        if any(x.flag_bits & 1 for x in book.infolist()) or "META-INF/rights.xml" in names:
            raise PermissionError("encrypted")
        root = ElementTree.fromstring(book.read("META-INF/container.xml")).find(f".//{CONTAINER}rootfile").attrib["full-path"]
        package = ElementTree.fromstring(book.read(root))
        items = {x.get("id"): x for x in package.iter(f"{OPF}item")}
        pages = {k: x for k, x in items.items() if x.get("media-type") in CHAPTER_TYPES and "nav" not in (x.get("properties") or "").split()}
        order = [x.get("idref") for x in package.iter(f"{OPF}itemref") if x.get("idref") in pages]
        order = list(dict.fromkeys([*order, *pages]))
        paths = [posixpath.normpath(posixpath.join(posixpath.dirname(root), unquote(pages[k].get("href")))) for k in order]
        if "META-INF/encryption.xml" in names and any(x.encode() in book.read("META-INF/encryption.xml") for x in paths):
            raise PermissionError("encrypted")
        paths = [x for x in paths if x in names]
        if sum(book.getinfo(x).file_size for x in paths) > MOST_BYTES:
            raise OverflowError("too large")
        first = lambda tag: next((x.text for x in package.iter(f"{DC}{tag}") if x.text), None)
        return first("title"), first("language"), [book.read(x).decode("utf-8", "replace") for x in paths]


def unpacked(content: Column) -> Column:
    """A book's title, language and chapters, or the fault that keeps them away."""

    @F.pandas_udf(BOOK)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([row(x) for x in part], columns=["title", "language", "chapters", "error", "retryable"])

    def row(data: bytes | None) -> tuple:
        if not data:
            return None, None, [], "file_empty", False
        try:
            return *opened(bytes(data)), None, None
        except PermissionError:
            return None, None, [], "epub_encrypted_or_drm", False
        except OverflowError:
            return None, None, [], "file_too_large", False
        except (zipfile.BadZipFile, KeyError, AttributeError, ElementTree.ParseError, EOFError, NotImplementedError, ValueError):
            return None, None, [], "epub_invalid_or_corrupt", False

    return run(content)


def book_texts(scanned: DataFrame) -> DataFrame:
    """Adds title, language, chapter_count, text, error and retryable to scanned files with ``content``."""
    rows = scanned.withColumn("_book", unpacked(F.col("content")))
    parts = F.filter(F.transform("_book.chapters", T.html_to_text), lambda x: x != "")
    rows = rows.withColumn("chapter_count", F.size("_book.chapters")).withColumn("text", F.array_join(parts, "\n\n"))
    none = F.col("_book.error").isNull() & (F.col("text") == "")
    error = F.when(none, "epub_no_text_extracted").otherwise(F.col("_book.error"))
    return rows.withColumn("title", F.col("_book.title")).withColumn("language", F.col("_book.language")).withColumn("error", error).withColumn("retryable", F.when(none, F.lit(False)).otherwise(F.col("_book.retryable"))).drop("_book")
