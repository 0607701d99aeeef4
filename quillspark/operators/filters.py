"""Typed filter algebra and listings of files."""

from __future__ import annotations

import base64
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_pattern

FIELDS = ("filename", "path", "extension", "category", "year", "size_bytes")
SORTS = ("filename", "path", "size_bytes", "year", "extension", "category")


def predicate(filters: list[tuple[str, str, Any]]) -> Column:
    """AND of (field, operator, value); unknown fields and operators and empty lists are ignored.

    Operators: EQ NE GT GTE LT LTE IN LIKE CONTAINS_ANY.
    """
    parts = []
    for field, op, value in filters:
        if field not in FIELDS or (isinstance(value, (list, tuple)) and not value):
            continue
        c = F.col(field)
        many = list(value) if isinstance(value, (list, tuple)) else [value]
        found = {
            "EQ": lambda: c == value,
            "NE": lambda: c != value,
            "GT": lambda: c > value,
            "GTE": lambda: c >= value,
            "LT": lambda: c < value,
            "LTE": lambda: c <= value,
            "IN": lambda: c.isin(many),
            "LIKE": lambda: c.ilike(value),
            "CONTAINS_ANY": lambda: reduce(lambda a, b: a | b, (c.ilike(like_pattern(x, escape=False)) for x in many)),
        }.get(op)
        if found:
            parts.append(found())
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def list_files(files: DataFrame, category: str | None = None, extensions: list[str] | None = None, search: str | None = None, tag: str | None = None, excluded_providers: list[str] = (), sort_by: str = "filename", descending: bool = False) -> DataFrame:
    """Filtered files in a whitelisted order with the primary key as last sort key; page it with limit and offset."""
    rows = files
    if category:
        rows = rows.filter(F.col("category") == category)
    if extensions:
        rows = rows.filter(F.col("extension").isin(extensions))
    if search:
        pattern = like_pattern(search)
        rows = rows.filter(F.col("filename").ilike(pattern) | F.col("path").ilike(pattern))
    if tag:
        rows = rows.filter(F.array_contains("tags", tag))
    if excluded_providers:
        rows = rows.filter(~F.col("source_provider").isin(list(excluded_providers)))
    key = F.col(sort_by if sort_by in SORTS else "filename")
    return rows.orderBy(key.desc() if descending else key.asc(), "id")


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return rows.offset(max(0, offset)).limit(max(1, limit))


def after_cursor(rows: DataFrame, created_at: Any, ident: int, limit: int) -> DataFrame:
    """Keyset page, newest first: rows strictly before (created_at, id)."""
    cursor = F.struct(F.lit(created_at).cast("timestamp").alias("created_at"), F.lit(ident).cast("long").alias("id"))
    return rows.filter(F.struct("created_at", "id") < cursor).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def encode_cursor(created_at: str, ident: int) -> str:
    return base64.urlsafe_b64encode(f"{created_at}|{ident}".encode()).decode()


def decode_cursor(cursor: str) -> tuple[str, int] | None:
    try:
        at, _, ident = base64.urlsafe_b64decode(cursor).decode().rpartition("|")
        return at, int(ident)
    except (ValueError, UnicodeDecodeError):
        return None


def byte_capped(rows: DataFrame, order: list, cap: int) -> DataFrame:
    """The leading rows of an already limited page whose JSON stays within a number of bytes."""
    from pyspark.sql.window import Window

    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_bytes", F.sum(F.octet_length(F.to_json(F.struct("*")))).over(w)).filter(F.col("_bytes") <= cap).drop("_bytes")
