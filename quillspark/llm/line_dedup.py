"""Line deduplication over overlapping three-line windows, in DataFrame expressions only.

Every run of three consecutive lines (``\\n``-split) of a document is hashed to 128 bits; windows without any word don't
count. A window whose lines also start earlier (smaller ``doc_id``, or the same document at an earlier line) is a repeat;
the lines that repeats cover, merged by position, are removed. Windows are judged on the input.

The first place and the count of each window come from a partial aggregate. Its repeated windows are joined with all
places; a window of a third of all documents is dealt over many tasks there.

Null text has no lines; texts of fewer than three lines lose none. A null ``doc_id`` comes after all others, rows of null id
in the order of their texts' hashes; rows that repeat an id (null ids: and a text) are one document whose windows start at
equal places, so none of them is a repeat of the other; an empty table gives no row; other columns are kept out of the
digest and carried by ``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import skew_join, staged

WINDOW = 3


def document_key(id_col: str, text_col: str) -> Column:
    """Orders documents: those with an id by it, then those without by their texts' hashes."""
    ident = F.col(id_col).cast("long")
    return F.struct(ident.isNull().alias("null_id"), F.coalesce(ident, F.xxhash64(F.col(text_col).cast("string"))).alias("id"))


def repeats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_key, text_key, starts): the first lines of each document's repeated windows."""
    text = F.col(text_col).cast("string")
    rows = docs.select(document_key(id_col, text_col).alias("doc_key"), F.xxhash64(text).alias("text_key"), F.split(text, "\n", -1).alias("lines"))
    windows = F.expr(
        f"""filter(transform(sequence(0, size(lines) - {WINDOW}), i -> struct(i AS at,
              xxhash64(lines[i], '\\n', lines[i + 1], '\\n', lines[i + 2]) AS h1,
              xxhash64(1, lines[i], '\\n', lines[i + 1], '\\n', lines[i + 2]) AS h2,
              length(translate(concat(lines[i], lines[i + 1], lines[i + 2]), ' \\t\\u000b\\u000c\\r', '')) AS chars)),
            x -> x.chars > 0)"""
    )
    windows = rows.filter(F.size("lines") >= WINDOW).select("doc_key", "text_key", F.explode(windows).alias("w")).select("doc_key", "text_key", "w.at", "w.h1", "w.h2")
    firsts = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_key", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2", "first", "n")
    found = skew_join(windows, staged(firsts, "windows"), ["h1", "h2"], ["doc_key", "at"])
    late = found.filter("doc_key > first.doc_key OR (doc_key = first.doc_key AND at > first.at)")
    return late.groupBy("doc_key", "text_key").agg(F.collect_set("at").alias("starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns, with ``kept_text``, ``n_lines`` and ``n_removed``."""
    found = repeats(docs, id_col, text_col)
    text = F.col(text_col).cast("string")
    held = docs.select(F.struct("*").alias("row"), document_key(id_col, text_col).alias("doc_key"), F.xxhash64(text).alias("text_key"), text.alias("body"))
    joined = held.join(found, ["doc_key", "text_key"], "left")
    covered = ", ".join(f"p + {k}" for k in range(WINDOW))
    rows = joined.withColumn("lines", F.split("body", "\n", -1))
    rows = rows.withColumn("kept", F.expr(f"CASE WHEN starts IS NOT NULL THEN array_except(sequence(0, size(lines) - 1), flatten(transform(starts, p -> array({covered})))) END"))
    kept = F.when(F.col("kept").isNull(), F.coalesce(F.col("body"), F.lit(""))).otherwise(F.array_join(F.expr("transform(kept, k -> lines[k])"), "\n"))
    n_lines = F.when(F.col("body").isNull(), 0).otherwise(F.size("lines")).cast("long")
    removed = F.when(F.col("kept").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long")
    added = {"kept_text": kept, "n_lines": n_lines, "n_removed": removed}
    return rows.select(*(F.col("row").getField(x).alias(x) for x in docs.columns if x not in added), *(c.alias(x) for x, c in added.items()))


def line_digest(docs: DataFrame) -> DataFrame:
    rows = dedup_lines(docs.select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(lines) - 1)) AS pos, lines FROM l WHERE len(lines) >= 3),
k AS (SELECT doc_id, pos, lines[pos] || chr(10) || lines[pos + 1] || chr(10) || lines[pos + 2] AS win FROM w),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM k
      WHERE trim(translate(win, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')) <> ''),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS line FROM r WHERE nth > 1),
e AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS body FROM l),
s AS (SELECT e.doc_id, string_agg(CASE WHEN c.line IS NULL THEN body END, chr(10) ORDER BY e.line) AS kept,
             count(c.line) AS gone FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.line = e.line GROUP BY 1)
SELECT l.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM l LEFT JOIN s ON s.doc_id = l.doc_id
"""
