"""Quality rules with cross-document line frequency, in DataFrame expressions only.

Base rules look at one text: a document fails with fewer than 20 words, or with over 30 % of its words in 8-word windows
that the text repeats. The method then counts, for each host, the distinct documents that hold a normalised line (lower case,
digits as 0, white space collapsed), lines of any length. A line that more than ``min_docs`` documents and more than
``max_share`` of the host's documents hold is removed wherever the host shows it; a document that thereby loses more than
``max_removed`` of its words is depleted and rejected.

Null text has no words and fails the base rules; a null host is a host of its own, apart from the empty one; rows that share
an id are one document, rows of null id and equal text too; rows with equal id, host and text get equal verdicts; an empty
table gives no row; other columns are ignored, or handed on by ``filter_quality``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, skew_join, staged, words_column

SYMBOLS = "#*$%&|<>"
#: Base verdict: least words, and most per cent of words in repeated windows.
MIN_WORDS = 20
MAX_REPEAT = 30
WINDOW = 8
#: A line is frequent on more documents than these, and on more than this share of the host's; most words to lose.
MIN_DOCS = 10
MAX_SHARE = 0.1
MAX_REMOVED = 0.7


def repeated_windows(words: str, n: int) -> str:
    """SQL for the hashes of the n-word windows of an array column, in order."""
    hashes = f"transform(sequence(0, size({words}) - {n}), i -> xxhash64(slice({words}, i + 1, {n})))"
    return f"CASE WHEN size({words}) > {n} THEN {hashes} ELSE CAST(array() AS array<bigint>) END"


def base_columns(docs: DataFrame) -> DataFrame:
    """Adds n_words and the base measures of column ``text`` to a table of (doc_id, host, text_key, text)."""
    text, n = F.coalesce(F.col("text"), F.lit("")), WINDOW
    word_lines = "filter(split(coalesce(text, ''), '\\n', -1), x -> length(translate(x, ' \\t\\u000b\\u000c\\r', '')) > 0)"
    rows = docs.withColumn("words", words_column(F.col("text"))).withColumn("lines", F.expr(word_lines))
    rows = rows.select(
        "doc_id", "host", "text_key", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    rows = rows.withColumn("grams", F.expr(repeated_windows("words", n))).drop("words")
    rows = rows.withColumn("pairs", F.expr("CASE WHEN size(grams) > size(array_distinct(grams)) THEN sort_array(transform(grams, (h, i) -> struct(h, i))) END")).drop("grams")
    rows = rows.withColumn("places", F.expr("sort_array(transform(filter(pairs, (x, k) -> get(pairs, k - 1).h <=> x.h OR get(pairs, k + 1).h <=> x.h), x -> x.i))")).drop("pairs")
    covered = f"coalesce(aggregate(transform(places, (p, k) -> IF(k = 0, {n}, least({n}, p - get(places, k - 1)))), 0L, (a, x) -> a + x), 0L)"
    rows = rows.withColumn("n_repeat_words", F.expr(covered)).drop("places")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def normalised_lines(text: Column) -> Column:
    """The ``\\n``-split lines in lower case, digits as 0, white space collapsed; as many as the text has."""
    flat = F.translate(F.lower(text), "123456789" + SPACES[1:].replace("\n", ""), "0" * 9 + " " * 4)
    flat = F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " {2,}", " ")).otherwise(flat)
    return F.split(flat, "\n", -1)


def line_key(line: Column) -> tuple[Column, Column]:
    """128 bits of a normalised line."""
    return F.xxhash64(F.trim(line)), F.xxhash64(F.lit(1), F.trim(line))


def lines_of(docs: DataFrame) -> DataFrame:
    """A row per line with a word: the document's keys, the line's place, key and number of words."""
    lines = docs.select("doc_id", "host", "text_key", F.posexplode(normalised_lines(F.col("text"))).alias("place", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    l1, l2 = line_key(F.col("line"))
    return lines.select("doc_id", "host", "text_key", "place", l1.alias("l1"), l2.alias("l2"), (F.length("line") - F.length(F.translate("line", " ", "")) + 1).cast("long").alias("line_words"))


def frequent_lines(docs: DataFrame, lines: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """(host, l1, l2, n) of the lines above the limits, with the number of documents that hold them; a stored table."""
    document = F.when(F.col("doc_id").isNull(), F.col("text_key")).otherwise(F.col("doc_id")).alias("document")
    key = ["host", "l1", "l2"]
    counts = lines.select(*key, document).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_docs)
    hosts = docs.select("host", document).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    return staged(counts.join(hosts, "host").filter(F.col("n") > max_share * F.col("host_docs")).select(*key, "n"), "frequent")


def removed_lines(docs: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """(doc_id, host, text_key, gone, gone_lines, lines) of documents with frequent lines: words and number of these, their keys."""
    lines, doc = lines_of(docs), ["doc_id", "host", "text_key"]
    found = skew_join(lines, frequent_lines(docs, lines, min_docs, max_share).select("host", "l1", "l2", "n"), ["host", "l1", "l2"], ["doc_id", "text_key"])
    found = found.select(*doc, "place", "l1", "l2", "line_words").distinct()  # repeated rows count once
    return found.groupBy(*doc).agg(F.sum("line_words").alias("gone"), F.count(F.lit(1)).alias("gone_lines"), F.collect_set(F.struct("l1", "l2")).alias("lines"))


def without_lines(text: Column, lines: Column) -> Column:
    """The text without its lines of these keys; null keys leave it as it is."""
    pairs = F.zip_with(F.split(text, "\n", -1), normalised_lines(text), lambda raw, line: F.struct(raw.alias("raw"), line.alias("line")))

    def stays(pair: Column) -> Column:
        l1, l2 = line_key(pair["line"])
        return ~F.array_contains(lines, F.struct(l1.alias("l1"), l2.alias("l2")))

    return F.when(lines.isNull(), text).otherwise(F.array_join(F.transform(F.filter(pairs, stays), lambda x: x["raw"]), "\n"))


def keys_of(id_col: str, text_col: str, host_col: str) -> list[Column]:
    """doc_id, host (null apart from empty) and text_key."""
    host = F.coalesce(F.concat(F.lit("s"), F.col(host_col).cast("string")), F.lit(""))
    return [F.col(id_col).cast("long").alias("doc_id"), host.alias("host"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key")]


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_removed: float = MAX_REMOVED) -> DataFrame:
    """A row per document: base measures, ``base_failed``, lines and words that go, ``depleted`` and ``kept``."""
    rows = docs.select(*keys_of(id_col, text_col, host_col), F.col(text_col).cast("string").alias("text"))
    gone = removed_lines(rows, min_docs, max_share).drop("lines")
    joined = base_columns(rows).alias("b").join(gone.alias("g"), _same("b", "g"), "left")
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    removed = [F.coalesce(f"g.{x}", F.lit(0)).cast("long").alias(y) for x, y in (("gone_lines", "n_removed_lines"), ("gone", "n_removed_words"))]
    depleted = F.coalesce(F.col("g.gone") > max_removed * F.col("b.n_words"), F.lit(False))
    return joined.select("b.doc_id", *(f"b.{x}" for x in measures), *removed, depleted.alias("depleted"), (~F.col("b.base_failed") & ~depleted).alias("kept"))


def _same(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")), F.col(f"{a}.host") == F.col(f"{b}.host"), F.col(f"{a}.text_key") == F.col(f"{b}.text_key")]


def filter_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_removed: float = MAX_REMOVED) -> DataFrame:
    """The documents that pass, with all their columns; the text is without the lines that are frequent on the host."""
    keys = keys_of(id_col, text_col, host_col)
    rows = docs.select(*keys, F.col(text_col).cast("string").alias("text"))
    gone = removed_lines(rows, min_docs, max_share)
    held = docs.select(F.struct("*").alias("row"), *keys)
    # the verdict stands above an aggregate: a filter right above the measures would be pushed into them and copy them
    base = base_columns(rows).groupBy("doc_id", "host", "text_key").agg(F.max("base_failed").alias("base_failed"), F.max("n_words").alias("n_words"))
    judged = base.alias("b").join(gone.alias("g"), _same("b", "g"), "left")
    bad = F.col("b.base_failed") | F.coalesce(F.col("g.gone") > max_removed * F.col("b.n_words"), F.lit(False))
    found = judged.filter(bad | F.col("g.lines").isNotNull()).select("b.doc_id", "b.host", "b.text_key", bad.alias("bad"), "g.lines")
    kept = held.alias("h").join(found.alias("f"), _same("h", "f"), "left").filter(~F.coalesce("f.bad", F.lit(False)))
    field = lambda x: F.col("h.row").getField(x)
    return kept.select(*((without_lines(field(x).cast("string"), F.col("f.lines")) if x == text_col else field(x)).alias(x) for x in docs.columns))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce('s' || source, '') AS host, coalesce(text, '') AS body,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS pos FROM t WHERE len(words) >= 8),
g AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, array_to_string(words[pos:pos + 7], ' ')) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 8)) AS w FROM g WHERE n > 1) GROUP BY 1),
u AS (SELECT doc_id, host, body, unnest(string_split(body, chr(10))) AS raw FROM t),
d AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM u
      WHERE trim(translate(raw, chr(9) || chr(11) || chr(12) || chr(13), '    ')) <> '' GROUP BY 1),
l AS (SELECT doc_id, host, body, trim(regexp_replace(translate(lower(raw), '123456789', '000000000'), '[ \x09\x0b\x0c\x0d]+', ' ', 'g')) AS line FROM u),
v AS (SELECT doc_id, host, body, line, len(string_split(line, ' ')) AS line_words FROM l WHERE line <> ''),
c AS (SELECT host, line, count(DISTINCT doc_id) AS n FROM v GROUP BY 1, 2),
h AS (SELECT host, count(DISTINCT doc_id) AS host_docs FROM t GROUP BY 1),
f AS (SELECT c.host, line FROM c JOIN h ON h.host = c.host WHERE n > 10 AND n > 0.1 * host_docs),
x AS (SELECT v.doc_id, count(f.line) AS gone_lines, sum(CASE WHEN f.line IS NOT NULL THEN line_words ELSE 0 END) AS gone,
             sum(CASE WHEN f.line IS NOT NULL THEN line_words ELSE 0 END) > 0.7 * sum(line_words) AS depleted
      FROM v LEFT JOIN f ON f.host = v.host AND f.line = v.line GROUP BY 1),
b AS (SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(body) - length(translate(body, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(gone_lines, 0) AS BIGINT) AS n_removed_lines, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed_words, coalesce(depleted, false) AS depleted
      FROM t LEFT JOIN d ON d.doc_id = t.doc_id LEFT JOIN r ON r.doc_id = t.doc_id LEFT JOIN x ON x.doc_id = t.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_removed_lines, n_removed_words, depleted,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT depleted AS kept
FROM b
"""
