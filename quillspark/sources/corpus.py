"""Corpus tables from a folder of Parquet tables, and file ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

EXTENSIONS = [".pdf", ".md", ".txt", ".csv", ".html"]
#: Room for chunk ids of one file, and of one of its lines: the parent comes first there, then its children.
CHUNK_ROOM, LINE_ROOM = 10**12, 10**6


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """One file per document, with names, paths, categories and years derived from its id, and ``more`` of the document's columns."""
    d = table(spark, folder, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 5 + 1).cast("int"))
    year = F.when(F.col("doc_id") % 7 != 0, (1990 + F.col("doc_id") % 35).cast("int"))
    rows = d.select(
        F.col("doc_id").alias("id"), ext.alias("extension"), year.alias("year"), F.col("n_chars").alias("size_bytes"), "lang", "source",
        F.sha2("text", 256).alias("content_hash"), F.when(F.col("doc_id") % 11 == 0, "upload.local").otherwise("filesystem").alias("source_provider"), F.lit("file").alias("entity_type"),
        F.array("lang", "source").alias("tags"), *more,
    )
    name = F.concat(F.lit("doc_"), F.lpad(F.col("id").cast("string"), 8, "0"), F.coalesce(F.concat(F.lit("_"), F.col("year").cast("string")), F.lit("")), F.col("extension"))
    rows = rows.withColumn("filename", name).withColumn("path", F.concat(F.lit("/corpus/"), "lang", F.lit("/"), "source", F.lit("/"), "filename"))
    return rows.withColumn("category", T.category_of(F.col("extension")))


def parents(spark: SparkSession, folder: str) -> DataFrame:
    """Non-blank lines of the documents."""
    d = table(spark, folder, "documents")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = d.select(F.col("doc_id").alias("file_id"), F.posexplode(lines).alias("chunk_index", "content"))
    return rows.select((F.col("file_id") * CHUNK_ROOM + F.col("chunk_index").cast("long") * LINE_ROOM).alias("id"), "file_id", "chunk_index", "content", F.lit(None).cast("long").alias("parent_id"))


def children(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of the parents."""
    rows = parents(spark, folder).select("file_id", F.col("id").alias("parent_id"), F.posexplode(T.sentences(F.col("content"))).alias("chunk_index", "content"))
    return rows.select((F.col("parent_id") + 1 + F.col("chunk_index")).alias("id"), "file_id", "chunk_index", "content", "parent_id")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return parents(spark, folder).unionByName(children(spark, folder))


def vec_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Embedded chunks: 64 dimensions, dealt over 200 files."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 200).alias("file_id"), F.col("embedding").alias("vector"), "label")


def chat_messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("chat_id"), "turn", "role", F.col("text").alias("content"))


def log_events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    channel = F.when(F.col("event_type") == "error", "system").when(F.col("event_type").isin("signup", "purchase"), "audit").otherwise("activity")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), channel.alias("channel"), "event_type", F.concat(F.lit("user"), (F.col("user_id") % 20).cast("string")).alias("source"), "value", "props")


#: Taxonomies of the diagnostics table.
QUERY_TYPES = ["focused", "coverage", "metadata", "simple", "unknown"]
QUESTIONS = ["What is in report 7.pdf", "Why so", "Please tell me in some detail what all of these many documents say", "Summarize notes.md for every one of the people who will come tomorrow morning"]


def diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    kind = F.element_at(F.array(*map(F.lit, QUERY_TYPES)), (F.col("event_id") % 5 + 1).cast("int"))
    flags = {"timeout": F.col("event_type") == "error", "empty_answer": F.col("event_id") % 17 == 0, "refusal_bias": F.col("event_id") % 23 == 0, "insufficient_retrieval": F.col("event_id") % 9 < 2}
    issues = F.array_compact(F.array(*(F.when(x, k) for k, x in flags.items())))
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), F.when(F.col("user_id") % 2 == 0, "chat").otherwise("api").alias("type"), kind.alias("query_type"),
        (F.col("value") / 100).alias("generation_seconds"), (F.col("event_id") % 9).alias("sources_count"), (F.col("event_id") % 30).alias("raw_chunks_count"), issues.alias("detected_issues"),
        flags["timeout"].alias("timeout_occurred"), flags["empty_answer"].alias("has_empty_answer"), flags["refusal_bias"].alias("has_refusal_pattern"),
        F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("event_id") % 4 + 1).cast("int")).alias("question"), F.when(F.col("event_id") % 19 == 0, " ").otherwise("text").alias("answer"),
        (F.col("event_id") % 60).alias("answer_length"), F.when(F.col("event_id") % 13 == 0, 1).otherwise(0).alias("unsupported_claim_count"),
    )


#: The same tables in DuckDB SQL, as common table expressions.
VIEWS_SQL = {
    "files": """files AS (SELECT *, '/corpus/' || lang || '/' || source || '/' || filename AS path,
 CASE extension WHEN '.pdf' THEN 'document' WHEN '.md' THEN 'plaintext' WHEN '.txt' THEN 'plaintext' WHEN '.csv' THEN 'data' ELSE 'web' END AS category
 FROM (SELECT *, 'doc_' || lpad(CAST(id AS VARCHAR), 8, '0') || coalesce('_' || CAST(year AS VARCHAR), '') || extension AS filename
 FROM (SELECT doc_id AS id, ['.pdf', '.md', '.txt', '.csv', '.html'][CAST(doc_id % 5 AS INTEGER) + 1] AS extension,
 CASE WHEN doc_id % 7 <> 0 THEN CAST(1990 + doc_id % 35 AS INTEGER) END AS year, n_chars AS size_bytes, lang, source, sha256(text) AS content_hash,
 CASE WHEN doc_id % 11 = 0 THEN 'upload.local' ELSE 'filesystem' END AS source_provider, 'file' AS entity_type, [lang, source] AS tags FROM documents)))""",
    "parents": r"""plines AS (SELECT doc_id AS file_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
parents AS (SELECT file_id * 1000000000000 + i * CAST(1000000 AS BIGINT) AS id, file_id, i AS chunk_index, content, CAST(NULL AS BIGINT) AS parent_id
 FROM (SELECT file_id, unnest(l) AS content, CAST(unnest(range(len(l))) AS INTEGER) AS i FROM plines))""",
    "children": r"""csents AS (SELECT file_id, id AS parent_id, list_filter(regexp_split_to_array(content, '[.!?]\s+'), lambda x: trim(x) <> '') AS s FROM parents),
children AS (SELECT parent_id + 1 + i AS id, file_id, i AS chunk_index, content, parent_id
 FROM (SELECT file_id, parent_id, unnest(s) AS content, CAST(unnest(range(len(s))) AS INTEGER) AS i FROM csents))""",
    "chunks": "chunks AS (SELECT * FROM parents UNION ALL SELECT * FROM children)",
    "vec_chunks": "vec_chunks AS (SELECT vec_id AS chunk_id, vec_id % 200 AS file_id, embedding AS vector, label FROM embeddings)",
    "chat_messages": "chat_messages AS (SELECT conv_id AS chat_id, turn, role, text AS content FROM conversations)",
    "log_events": """log_events AS (SELECT event_id AS id, ts AS created_at, CASE WHEN event_type = 'error' THEN 'system' WHEN event_type IN ('signup', 'purchase') THEN 'audit' ELSE 'activity' END AS channel,
 event_type, 'user' || CAST(user_id % 20 AS VARCHAR) AS source, value, props FROM events)""",
    "diagnostics": """diagnostics AS (SELECT event_id AS id, ts AS created_at, CASE WHEN user_id % 2 = 0 THEN 'chat' ELSE 'api' END AS type,
 ['focused', 'coverage', 'metadata', 'simple', 'unknown'][CAST(event_id % 5 AS INTEGER) + 1] AS query_type, value / 100 AS generation_seconds, event_id % 9 AS sources_count, event_id % 30 AS raw_chunks_count,
 list_filter([CASE WHEN event_type = 'error' THEN 'timeout' END, CASE WHEN event_id % 17 = 0 THEN 'empty_answer' END, CASE WHEN event_id % 23 = 0 THEN 'refusal_bias' END, CASE WHEN event_id % 9 < 2 THEN 'insufficient_retrieval' END], lambda x: x IS NOT NULL) AS detected_issues,
 event_type = 'error' AS timeout_occurred, event_id % 17 = 0 AS has_empty_answer, event_id % 23 = 0 AS has_refusal_pattern,
 ['What is in report 7.pdf', 'Why so', 'Please tell me in some detail what all of these many documents say', 'Summarize notes.md for every one of the people who will come tomorrow morning'][CAST(event_id % 4 AS INTEGER) + 1] AS question,
 CASE WHEN event_id % 19 = 0 THEN ' ' ELSE 'text' END AS answer, event_id % 60 AS answer_length, CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS unsupported_claim_count FROM events)""",
}
NEEDS = {"children": ["parents"], "chunks": ["parents", "children"]}


def with_views(sql: str, *views: str) -> str:
    """SQL with the common table expressions of these views in front."""
    names: list[str] = []
    for view in views:
        names += [x for x in [*NEEDS.get(view, []), view] if x not in names]
    return "WITH " + ",\n".join(VIEWS_SQL[x] for x in names) + ("," if sql.lstrip().startswith("+") else "") + "\n" + sql.lstrip().removeprefix("+")


def scan_folder(spark: SparkSession, roots: list[str], extensions: list[str], ignore: list[str] = (), max_bytes: int = 500 << 20) -> DataFrame:
    """Files below the roots: path, filename, extension, size, mtime and content hash (a pseudo-hash for oversized ones).

    ``ignore`` holds glob patterns in the manner of ignore files; a leading ``!`` takes a path back in. The last pattern
    that fits a path decides. Files without any byte are not listed, as Spark's readers leave them out.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    rows = found.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), T.extension_of(F.col("path")).alias("extension"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    rows = rows.filter(F.col("extension").isin([x.lower() for x in extensions]))
    if ignore:
        out = F.lit(False)
        for pattern in ignore:
            out = F.when(F.col("path").rlike(glob_regex(pattern.removeprefix("!"))), F.lit(not pattern.startswith("!"))).otherwise(out)
        rows = rows.filter(~out)
    big = F.sha2(F.concat_ws(":", F.lit("oversized"), F.col("size_bytes").cast("string"), F.unix_timestamp("modified_at").cast("string")), 256)
    return rows.withColumn("content_hash", F.when(F.col("size_bytes") > max_bytes, big).otherwise(F.sha2("content", 256)))


def glob_regex(pattern: str) -> str:
    """Regular expression of an ignore pattern: ``**`` any depth, ``*`` and ``?`` within a name."""
    import re

    anchored, body = pattern.startswith("/"), pattern.strip("/")
    out = ""
    for part in re.split(r"(\*\*/?|\*|\?)", body):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return ("^[a-z]*:?/*" if anchored else "(?:^|/)") + out + ("/" if pattern.endswith("/") else "(?:/|$)")


def extracted_text(scanned: DataFrame) -> DataFrame:
    """Adds ``text`` and ``error`` by extension: decoded text, page text of HTML, or a reason."""
    decoded = F.expr("try_validate_utf8(content)")
    body = F.when(F.col("extension").isin(".html", ".htm"), T.html_to_text(decoded)).otherwise(decoded)
    error = F.when(F.col("size_bytes") == 0, "empty").when(decoded.isNull(), "charset").when(T.longest_line(decoded) > 200_000, "long_line")
    return scanned.withColumn("error", error).withColumn("text", F.when(F.col("error").isNull(), body))
