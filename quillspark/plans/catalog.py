"""Named queries over the test tables, and the same queries in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import answers as A
from ..functions import blocks
from ..functions import rules as R
from ..functions import text as T
from ..functions import vectors as V
from ..functions import embedding
from ..operators import batch_search, changes, chats, chunking, expansion, filters, fulltext, gates, indexing, ranges, retrieval, scopes, stats, terms
from ..operators.lineage import staging
from ..sources import corpus
from ..sources.corpus import with_views
from ..sources.versions import Store
from ..streaming import cache, watch

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Builder], Builder]:
    """Register a query under its function's name."""

    def add(f: Builder) -> Builder:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def query_vector(spark: SparkSession, folder: str) -> list[float]:
    """The vector of chunk 0: one row."""
    return list(corpus.vec_chunks(spark, folder).filter("chunk_id = 0").select("vector").first()[0])


DISTANCE = "round(list_cosine_distance(CAST(vector AS DOUBLE[]), (SELECT CAST(vector AS DOUBLE[]) FROM vec_chunks WHERE chunk_id = 0)), 6)"
NOW = "2024-02-01 00:00:00"


# retrieval


@query(with_views(f"""+h AS (SELECT chunk_id, v.file_id, {DISTANCE} AS distance FROM vec_chunks v JOIN files f ON f.id = v.file_id WHERE extension IN ('.pdf', '.md') AND year >= 2000
 ORDER BY 3, 1 LIMIT 10) SELECT chunk_id, file_id, distance, filename, category, year FROM h JOIN files ON files.id = h.file_id""", "vec_chunks", "files"))
def semantic_search(spark: SparkSession, folder: str) -> DataFrame:
    files = corpus.files(spark, folder)
    wanted = files.filter(filters.predicate([("extension", "IN", [".pdf", ".md"]), ("year", "GTE", 2000)])).select(F.col("id").alias("file_id"))
    hits = retrieval.nearest(corpus.vec_chunks(spark, folder).join(wanted, "file_id", "left_semi"), query_vector(spark, folder), 10)
    return retrieval.with_files(hits, files).select("chunk_id", "file_id", "distance", "filename", "category", "year")


@query(with_views(f"""+h AS (SELECT chunk_id, file_id, {DISTANCE} AS distance FROM vec_chunks WHERE file_id IN (SELECT id FROM files WHERE source_provider <> 'upload.local') ORDER BY 3, 1 LIMIT 30),
 r AS (SELECT h.*, filename, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY distance, chunk_id) AS nth FROM h JOIN files f ON f.id = h.file_id WHERE category = 'plaintext')
 SELECT chunk_id, file_id, distance, filename FROM r WHERE nth = 1 ORDER BY distance, chunk_id LIMIT 10""", "vec_chunks", "files"))
def semantic_search_scoped_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    rows = retrieval.scoped_search(corpus.vec_chunks(spark, folder), corpus.files(spark, folder), query_vector(spark, folder), 10, category="plaintext", excluded=["upload.local"])
    return rows.select("chunk_id", "file_id", "distance", "filename")


@query(with_views(f"""SELECT chunk_id, file_id, label, distance FROM (SELECT chunk_id, file_id, label, {DISTANCE} AS distance FROM vec_chunks)
 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY distance, chunk_id) = 1""", "vec_chunks"))
def top1_chunk_per_file(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.top_chunk_per_file(corpus.vec_chunks(spark, folder), query_vector(spark, folder))


@query(with_views(f"""+h AS (SELECT chunk_id, {DISTANCE} AS distance FROM vec_chunks ORDER BY 2, 1 LIMIT 20),
 t AS (SELECT chunk_id, 1.0 AS score FROM vec_chunks WHERE label = 3 AND chunk_id NOT IN (SELECT chunk_id FROM h) ORDER BY chunk_id LIMIT 10)
 SELECT chunk_id, CAST(distance AS DOUBLE) AS score FROM h UNION ALL SELECT chunk_id, CAST(score AS DOUBLE) FROM t""", "vec_chunks"))
def pool_union_overlap(spark: SparkSession, folder: str) -> DataFrame:
    v = corpus.vec_chunks(spark, folder)
    first = retrieval.nearest(v, query_vector(spark, folder), 20).withColumnRenamed("distance", "score")
    return retrieval.pool(first, v.filter("label = 3"), 10)


SEARCH = ["the", "of", "erst"]
WORDS_SQL = r"list_filter(string_split_regex(trim(regexp_replace(lower(content), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')), ' +'), lambda x: x <> '')"


@query(with_views(rf"""+w AS (SELECT id, {WORDS_SQL} AS words FROM parents), tot AS (SELECT count(*) AS n_all, avg(len(words)) AS mean FROM w),
 h AS (SELECT id, len(words) AS length, term, count(*) AS tf FROM (SELECT id, words, unnest(words) AS term FROM w) WHERE term IN ('the', 'of', 'erst') GROUP BY ALL),
 d AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
 s AS (SELECT id, round(sum(ln(1 + (n_all - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score, count(*) AS n_terms FROM h JOIN d USING (term), tot GROUP BY 1)
 SELECT id, score, n_terms FROM s WHERE n_terms = 3 ORDER BY score DESC, id LIMIT 20""", "parents"))
def fts_candidates_unstemmed(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.bm25(corpus.parents(spark, folder), SEARCH, 20)


# many questions at once


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """All items of the benchmark (even numbers) and all turns of users (odd numbers) as (query_id, question)."""
    items = corpus.table(spark, folder, "benchmark").select((2 * F.col("item_id")).alias("query_id"), F.col("text").alias("question"))
    turns = corpus.chat_messages(spark, folder).filter("role = 'user'").select((2000 * F.col("chat_id") + 2 * F.col("turn") + 1).alias("query_id"), F.col("content").alias("question"))
    return items.unionByName(turns)


DIMENSIONS = 64
QUESTIONS_SQL = "asked AS (SELECT 2 * item_id AS query_id, text AS question FROM benchmark UNION ALL SELECT 2000 * conv_id + 2 * turn + 1, text FROM conversations WHERE role = 'user')"


def embed_sql(name: str, key: str, c: str, table: str) -> str:
    """(key, dim, value) of the places that aren't zero."""
    word = rf"unnest(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9_]+|[^\x00-\x7f]+')) AS w"
    return f"{name} AS (SELECT {key}, {embedding.FEATURE_SQL.format(w='w', d=DIMENSIONS)} AS dim, sum({embedding.SIGN_SQL.format(w='w')}) AS value FROM (SELECT {key}, {word} FROM {table}) GROUP BY ALL HAVING value <> 0)"


@query(f"WITH {embed_sql('e', 'doc_id', 'text', 'documents')} SELECT doc_id, CAST(dim AS INTEGER) AS dim, CAST(value AS FLOAT) AS value FROM e")
def embedded_documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.table(spark, folder, "documents").select("doc_id", embedding.embed(F.col("text"), DIMENSIONS).alias("vector"))
    return rows.select("doc_id", F.posexplode("vector").alias("dim", "value")).filter("value <> 0")


@query(f"""WITH {QUESTIONS_SQL}, {embed_sql('q', 'query_id', 'question', 'asked')}, {embed_sql('d', 'doc_id', 'text', 'documents')},
 nq AS (SELECT query_id, sum(value * value) AS n FROM q GROUP BY 1), nd AS (SELECT doc_id, sum(value * value) AS n FROM d GROUP BY 1),
 x AS (SELECT query_id, doc_id, sum(q.value * d.value) AS dot FROM q JOIN d USING (dim) GROUP BY 1, 2),
 s AS (SELECT nq.query_id, nd.doc_id AS chunk_id, round(coalesce(dot, 0) / sqrt(nq.n * nd.n), 6) AS score FROM nq CROSS JOIN nd LEFT JOIN x ON x.query_id = nq.query_id AND x.doc_id = nd.doc_id)
 SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 8""")
def nearest_all_questions(spark: SparkSession, folder: str) -> DataFrame:
    """The eight nearest documents of every question."""
    rows = corpus.table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), embedding.embed(F.col("text"), DIMENSIONS).alias("vector"))
    asked = questions(spark, folder).select("query_id", embedding.embed(F.col("question"), DIMENSIONS).alias("vector"))
    return batch_search.nearest_of_all(rows, asked, 8)


@query()
def fts_all_questions(spark: SparkSession, folder: str) -> DataFrame:
    """For every question the documents that hold all its stems, by BM25."""
    rows = corpus.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return batch_search.matches_of_all(rows, questions(spark, folder), 8)


def retrieval_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of all documents as chunks with their place (the line)."""
    rows = corpus.children(spark, folder)
    return rows.withColumn("place", F.col("parent_id")).withColumn("block_type", F.when(F.col("content").contains("|"), "table").otherwise("narrative"))


@query()
def retrieve_all_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Passages for every question: both searches over all sentences, then filters, scores and selection; questions of the
    benchmark spread over files. The section of a sentence is its document's first line."""
    files = corpus.files(spark, folder, "text").withColumn("section", F.split("text", "\n", 2)[0])
    wide = F.col("query_id") % 2 == 0
    return batch_search.retrieve(questions(spark, folder), retrieval_chunks(spark, folder), files, corpus.parents(spark, folder), 8, coverage=wide, allowed=F.col("source_provider") != "upload.local")


@query()
def fts_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Build the stored index of all parents, then search its stems: all of them, and any of them."""
    place = staging(spark, "full-text")
    fulltext.build(corpus.parents(spark, folder), place)
    index = fulltext.Index(spark, place)
    every = fulltext.search(index, SEARCHED, 20).withColumn("every", F.lit(True))
    return every.unionByName(fulltext.search(index, SEARCHED, 20, every=False).withColumn("every", F.lit(False)))


SEARCHED = "erste AND Zeiten"


# indexing


def scanned_documents(spark: SparkSession, folder: str) -> DataFrame:
    d = corpus.files(spark, folder, "text").filter("id IS NOT NULL")
    return d.select(F.col("id").alias("file_id"), "path", "filename", "extension", F.col("size_bytes").cast("long").alias("size_bytes"), "content_hash", "text")


@query(r"""WITH t AS (SELECT doc_id AS file_id, sha256(text) AS h, regexp_matches(coalesce(text, ''), '\S') AS "some", doc_id % 7 = 3 AS edited, doc_id % 11 = 5 AS huge, doc_id % 13 = 2 AS gone FROM documents)
 SELECT file_id, CASE WHEN edited AND NOT huge THEN sha256(h) ELSE h END AS content_hash, true AS whole FROM t WHERE "some" AND NOT gone""")
def indexed_versions(spark: SparkSession, folder: str) -> DataFrame:
    """All documents indexed; then a second batch that edits some, fails on some (too large: the old version stays) and removes
    some; what readers see at the end, and whether each file has a vector for every child."""
    store = Store(spark, staging(spark, "store"))
    rows = scanned_documents(spark, folder)
    indexing.index_files(store, rows)
    edited, huge = F.col("file_id") % 7 == 3, F.col("file_id") % 11 == 5
    again = rows.withColumn("content_hash", F.when(edited | huge, F.sha2("content_hash", 256)).otherwise(F.col("content_hash"))).withColumn("text", F.when(edited, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))).withColumn("size_bytes", F.when(huge, indexing.MAX_BYTES + 1).otherwise(F.col("size_bytes")))
    indexing.index_files(store, again, rows.filter("file_id % 13 = 2").select("file_id"))
    children = store.read("chunks").filter("parent_id IS NOT NULL").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    held = F.when(F.col("vector").isNotNull(), True).alias("held")
    vectors = store.read("vectors", columns=["file_id", held]).groupBy("file_id").agg(F.count("held").alias("m"))
    seen = store.read("files").join(children, "file_id", "left").join(vectors, "file_id", "left")
    return seen.select("file_id", "content_hash", F.coalesce(F.col("n") == F.col("m"), F.lit(False)).alias("whole"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines, len(text) AS n FROM documents), p AS (SELECT doc_id, n, unnest(lines) AS line, unnest(range(len(lines))) AS i, lines FROM l),
 c AS (SELECT doc_id, i, list_sum(list_transform(lines[1:i], lambda x: len(x) + 1))::BIGINT AS start, len(line) AS size, n FROM p),
 s AS (SELECT doc_id, i, coalesce(start, 0) AS a, coalesce(start, 0) + size - 1 AS z, size, n FROM c)
 SELECT doc_id AS file_id, i AS chunk_id, CASE WHEN size > 0 AND a % 400 < CASE WHEN a // 400 % 3 = 2 THEN 360 ELSE 400 END THEN CAST(a // 400 AS INTEGER) END AS start_value,
  CASE WHEN size > 0 AND z % 400 < CASE WHEN z // 400 % 3 = 2 THEN 360 ELSE 400 END THEN CAST(z // 400 AS INTEGER) END AS end_value FROM s""")
def line_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of the first and last character of every line; pages have 400 characters, every third only 360 of them."""
    d = corpus.table(spark, folder, "documents").select(F.col("doc_id").alias("file_id"), "text")
    page = F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 400).cast("int"))).alias("value")
    pages = d.filter("text IS NOT NULL").select("file_id", page).withColumn("start", F.col("value").cast("long") * 400).withColumn("end", F.col("start") + F.when(F.col("value") % 3 == 2, 360).otherwise(400))
    lines = d.select("file_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("file_id", F.col("i").cast("long").alias("chunk_id"), F.length("line").cast("long").alias("size"))
    before = F.sum(F.col("size") + 1).over(Window.partitionBy("file_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1))
    chunks = lines.withColumn("start", F.coalesce(before, F.lit(0))).withColumn("end", F.col("start") + F.col("size"))
    return ranges.spans(chunks, pages).select("file_id", "chunk_id", "start_value", "end_value")


@query()
def repeated_answers(spark: SparkSession, folder: str) -> DataFrame:
    """All answers of all chats, and all documents as answers of one chat per source."""
    docs = corpus.table(spark, folder, "documents").select((-1 - F.floor(F.col("doc_id") / 100)).alias("chat_id"), F.col("doc_id").cast("int").alias("turn"), F.lit("assistant").alias("role"), F.col("text").alias("content"))
    return chats.repeated_answers(corpus.chat_messages(spark, folder).select("chat_id", F.col("turn").cast("int").alias("turn"), "role", "content").unionByName(docs))


WATCHED_SQL = "'/watched/u' || CAST(user_id AS VARCHAR) || '.md'"


@query(f"""WITH e AS (SELECT {WATCHED_SQL} AS path, ts, event_type = 'error' AS gone FROM events), l AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM e WINDOW w AS (PARTITION BY path ORDER BY ts)),
 b AS (SELECT *, sum(first) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM l)
 SELECT path, CASE WHEN bool_or(gone) THEN 'delete' ELSE 'index' END AS action, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n_events FROM b GROUP BY path, burst""")
def watched_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Events as events of one file per user; bursts with six quiet hours after them."""
    e = corpus.table(spark, folder, "events")
    path = F.concat(F.lit("/watched/u"), F.col("user_id").cast("string"), F.lit(".md"))
    rows = e.select("event_id", F.col("ts").cast("timestamp").alias("created_at"), F.when(F.col("event_type") == "error", "deleted").otherwise("modified").alias("kind"), path.alias("path"), F.lit(None).cast("string").alias("dest"), F.lit(False).alias("is_directory"))
    found = watch.flushed(watch.path_actions(rows, [".md"]), "6 hours")
    return found.withColumn("first_at", F.col("first_at").cast("timestamp_ntz")).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))


@query()
def cached_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of users asked of the caches, five seconds apart in the order of chats."""
    turns = corpus.chat_messages(spark, folder).filter("role = 'user'")
    rows = turns.select((1000 * F.col("chat_id") + F.col("turn")).alias("event_id"), F.timestamp_seconds(5 * (F.col("chat_id") + 7 * F.col("turn"))).alias("created_at"), F.col("content").alias("question"))
    return cache.cached_embeddings(rows, shards=8).select("shard", "event_id", "hit", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x).alias("square"))


@query(with_views("""+h AS (SELECT id AS chunk_id, CAST(chunk_index AS DOUBLE) AS score FROM children),
 r AS (SELECT coalesce(p.id, c.id) AS id, c.file_id, coalesce(p.content, c.content) AS content, score, chunk_id FROM h JOIN children c ON c.id = h.chunk_id LEFT JOIN parents p ON p.id = c.parent_id)
 SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id) = 1""", "children"))
def parent_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    kids = corpus.children(spark, folder)
    hits = kids.select(F.col("id").alias("chunk_id"), F.col("chunk_index").cast("double").alias("score"))
    return retrieval.parent_chunks(hits, kids, corpus.parents(spark, folder))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.vec_chunks(spark, folder).select((F.col("chunk_id") % 20).alias("query_id"), "chunk_id", (F.col("chunk_id") % 7).alias("file_id"), (F.col("chunk_id") % 3).alias("place"), F.col("chunk_id").alias("rank"))
    return rows.withColumn("score", 1 / (1 + F.col("rank") % 11)).withColumn("query", F.lit("report of doc year")).withColumn("filename", F.concat(F.lit("doc "), F.col("file_id").cast("string"), F.lit(" report.pdf"))).withColumn("content", F.when(F.col("chunk_id") % 13 == 0, "Table of Contents").otherwise("text"))


CANDIDATES_SQL = "cand AS (SELECT vec_id % 20 AS query_id, vec_id AS chunk_id, vec_id % 7 AS file_id, vec_id % 3 AS place, vec_id AS rank, 1 / (1 + vec_id % 11) AS score, vec_id % 13 = 0 AS toc FROM embeddings)"


def passages(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates from the given texts: 50 documents a question, the first question of a conversation.

    A document's first characters are its file's name, its first line is the section.
    """
    asked = corpus.table(spark, folder, "conversations").filter("role = 'user'").groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("query"))
    d = corpus.table(spark, folder, "documents").select(F.floor(F.col("doc_id") / 50).alias("query_id"), F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 2).alias("file_id"), F.col("doc_id").alias("rank"), (1 / (1 + F.col("doc_id") % 11)).alias("score"), F.col("text").alias("content"))
    line = F.split("content", "\n", 2)[0]
    d = d.withColumn("section", line).withColumn("filename", F.concat(F.substring(line, 1, 60), F.lit(".pdf"))).withColumn("block_type", F.when(F.col("content").contains("|"), "Table").otherwise("narrative"))
    return d.join(asked, "query_id", "left")


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in words)


def any_sql(c: str, patterns: list[str]) -> str:
    """The rule of patterns as SQL, each pattern on its own."""
    return "(" + " OR ".join(f"regexp_matches({c}, '{x}', 'i')" for x in patterns) + ")"


def terms_sql(c: str) -> str:
    found = f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9][a-z0-9''_-]{{2,}}'), lambda x: x NOT IN ({quoted(R.TITLE_STOPWORDS)}))"
    return f"list_distinct(list_concat({found}, list_transform(list_filter({found}, lambda x: x LIKE '%s' AND len(x) > 4), lambda x: left(x, len(x) - 1))))"


PASSAGES_SQL = f"""asked AS (SELECT conv_id AS query_id, min_by(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY 1),
 named AS (SELECT doc_id // 50 AS query_id, doc_id AS chunk_id, doc_id // 2 AS file_id, doc_id AS rank, 1 / (1 + doc_id % 11) AS score, text AS content, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS body, split_part(text, chr(10), 1) AS section FROM documents),
 pass AS (SELECT n.*, query, count(*) OVER (PARTITION BY n.query_id) AS many, left(section, 60) || '.pdf' AS filename, content LIKE '%|%' AS tabular FROM named n LEFT JOIN asked a ON a.query_id = n.query_id),
 shared AS (SELECT *, len(list_intersect({terms_sql("query")}, {terms_sql("filename")})) AS n_shared FROM pass)"""


@query(f"""WITH {PASSAGES_SQL}, s AS (SELECT *, CASE WHEN many = 1 THEN 0.0 ELSE CASE WHEN tabular THEN 0.08 ELSE 0.0 END + CASE WHEN {any_sql("section", R.STRUCTURAL_SECTIONS)} THEN 0.15 ELSE 0.0 END
 + CASE WHEN {any_sql("left(body, 1200)", R.STRUCTURAL_TEXTS)} THEN 0.35 ELSE 0.0 END + CASE WHEN len(regexp_extract_all(left(body, 1200), '{R.CHAPTER}', 0, 'i')) >= 4 THEN 0.35 ELSE 0.0 END
 + CASE WHEN body <> '' AND len(body) < 180 AND len(body) - len(replace(body, chr(10), '')) < 3 THEN 0.04 ELSE 0.0 END END AS penalty FROM pass),
 r AS (SELECT query_id, chunk_id, rank, round(score - penalty, 6) AS score FROM s) SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS new_rank FROM r""")
def bias_substantive(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.substantive_bias(passages(spark, folder)).select("query_id", "chunk_id", "score", F.col("new_rank").cast("long").alias("new_rank"))


@query(f"""WITH {PASSAGES_SQL}, r AS (SELECT query_id, chunk_id, rank, round(score + CASE WHEN many > 1 THEN least(0.2, 0.05 * n_shared) ELSE 0 END, 6) AS score FROM shared)
 SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS new_rank FROM r""")
def bias_title(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.title_bias(passages(spark, folder)).select("query_id", "chunk_id", "score", F.col("new_rank").cast("long").alias("new_rank"))


@query(f"""WITH {PASSAGES_SQL}, r AS (SELECT query_id, chunk_id, rank, round(score + CASE WHEN many = 1 THEN 0 WHEN n_shared > 0 THEN least(0.5, 0.12 * n_shared) WHEN max(n_shared) OVER (PARTITION BY query_id) > 0 THEN -0.3 ELSE 0 END, 6) AS score FROM shared)
 SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS new_rank FROM r""")
def bias_title_strict(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.title_bias(passages(spark, folder), strict=True).select("query_id", "chunk_id", "score", F.col("new_rank").cast("long").alias("new_rank"))


@query(r"""WITH l AS (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body, list_filter(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)), lambda x: trim(x) <> '') AS lines FROM documents),
 n AS (SELECT *, len(lines) AS n, len(list_filter(lines, lambda x: regexp_matches(x, '^\s*\|.*\|\s*$'))) AS t FROM l)
 SELECT doc_id, coalesce(len(body) >= 50 AND t > 0.7 * n AND (len(text) < 300 OR n - t < 3), false) AS header_only FROM n""")
def header_only_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.table(spark, folder, "documents").select("doc_id", F.coalesce(R.header_only(F.col("text")), F.lit(False)).alias("header_only"))


@query(f"""WITH {CANDIDATES_SQL}, s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, file_id, place ORDER BY rank) > 1 THEN 1 ELSE 0 END AS second FROM cand)
 SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY second, rank) AS nth FROM s QUALIFY nth <= 8""")
def select_focused_diverse(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.focused_selection(candidates(spark, folder), 8).select("query_id", "chunk_id", F.col("nth").cast("long").alias("nth"))


@query()
def select_coverage_diverse(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.coverage_selection(candidates(spark, folder), 8)


@query(with_views(f"+d AS (SELECT {DISTANCE} AS distance FROM vec_chunks) SELECT round(avg(1 / (1 + exp(-distance))), 6) AS mean_score, CAST(count(*) AS BIGINT) AS n FROM d", "vec_chunks"))
def sigmoid_scores(spark: SparkSession, folder: str) -> DataFrame:
    d = F.round(V.cosine_distance(F.col("vector"), query_vector(spark, folder)), 6)
    return corpus.vec_chunks(spark, folder).agg(F.round(F.avg(T.sigmoid(d)), 6).alias("mean_score"), F.count(F.lit(1)).alias("n"))


# files


@query(with_views("""SELECT id, filename, path, extension, category, year FROM files WHERE category = 'plaintext' AND extension IN ('.md', '.txt') AND (filename ILIKE '%doc\\_%' ESCAPE '\\' OR path ILIKE '%doc\\_%' ESCAPE '\\')
 AND list_contains(tags, 'en') AND source_provider NOT IN ('upload.local') ORDER BY filename, id LIMIT 25 OFFSET 5""".replace("\\\\", "\\"), "files"))
def files_list_filtered_page(spark: SparkSession, folder: str) -> DataFrame:
    rows = filters.list_files(corpus.files(spark, folder), category="plaintext", extensions=[".md", ".txt"], search="doc_", tag="en", excluded_providers=["upload.local"])
    return filters.page(rows, 25, 5).select("id", "filename", "path", "extension", "category", "year")


@query(with_views("SELECT count(*) AS n FROM files WHERE category <> 'web' AND year > 1995 AND year <= 2020 AND (filename ILIKE '%1%' OR filename ILIKE '%7%')", "files"))
def files_count_filtered(spark: SparkSession, folder: str) -> DataFrame:
    where = filters.predicate([("category", "NE", "web"), ("year", "GT", 1995), ("year", "LTE", 2020), ("filename", "CONTAINS_ANY", ["1", "7"]), ("owner", "EQ", "x"), ("extension", "IN", [])])
    return corpus.files(spark, folder).filter(where).agg(F.count(F.lit(1)).alias("n"))


@query(with_views("SELECT min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS n_years FROM files", "files"))
def files_date_range(spark: SparkSession, folder: str) -> DataFrame:
    return stats.date_range(corpus.files(spark, folder))


@query(with_views("SELECT year, count(*) AS n_files FROM files WHERE year IS NOT NULL GROUP BY 1", "files"))
def files_per_year(spark: SparkSession, folder: str) -> DataFrame:
    return stats.per_year(corpus.files(spark, folder))


@query(with_views("SELECT year, count(*) AS n_files FROM files WHERE year IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", "files"))
def files_comparative_most(spark: SparkSession, folder: str) -> DataFrame:
    return stats.comparative(corpus.files(spark, folder), "year")


@query(with_views("SELECT category, count(*) AS n_files FROM files GROUP BY 1 ORDER BY 2, 1 LIMIT 1", "files"))
def files_comparative_fewest(spark: SparkSession, folder: str) -> DataFrame:
    return stats.comparative(corpus.files(spark, folder), "category", most=False)


@query(with_views("SELECT DISTINCT year FROM files WHERE year IS NOT NULL", "files"))
def distinct_years(spark: SparkSession, folder: str) -> DataFrame:
    return stats.distinct_values(corpus.files(spark, folder), "year")


@query(with_views("SELECT DISTINCT category FROM files", "files"))
def distinct_categories(spark: SparkSession, folder: str) -> DataFrame:
    return stats.distinct_values(corpus.files(spark, folder), "category")


@query(with_views("SELECT DISTINCT extension FROM files", "files"))
def distinct_extensions(spark: SparkSession, folder: str) -> DataFrame:
    return stats.distinct_values(corpus.files(spark, folder), "extension")


@query(with_views("""SELECT DISTINCT 'category' AS kind, lower(trim(category)) AS value FROM files WHERE source_provider <> 'upload.local'
 UNION SELECT DISTINCT 'extension', lower(trim(extension)) FROM files WHERE source_provider <> 'upload.local'""", "files"))
def filter_options(spark: SparkSession, folder: str) -> DataFrame:
    return stats.filter_options(corpus.files(spark, folder), ["upload.local"])


@query(with_views("""SELECT (SELECT count(*) FROM files) AS n_files, (SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) FROM files) AS total_bytes, (SELECT count(*) FROM files WHERE source_provider = 'upload.local') AS n_uploads,
 (SELECT count(*) FROM chunks) AS n_chunks, (SELECT count(*) FROM chunks WHERE parent_id IS NULL) AS n_parents, (SELECT count(*) FROM vec_chunks) AS n_vectors""", "files", "chunks", "vec_chunks"))
def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return stats.corpus_stats(corpus.files(spark, folder), corpus.chunks(spark, folder), corpus.vec_chunks(spark, folder))


@query(with_views("SELECT source_provider, count(DISTINCT f.id) AS n_files, count(c.id) AS n_chunks FROM files f LEFT JOIN parents c ON c.file_id = f.id GROUP BY 1", "files", "parents"))
def scope_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.scope_counts(corpus.files(spark, folder), corpus.parents(spark, folder))


# chats


def title_sql(c: str) -> str:
    raw = rf"regexp_replace(string_split({c}, chr(10))[1], '^\s+|\s+$', '', 'g')"
    line = rf"regexp_replace({raw}, '^\s{{0,3}}#{{1,6}}\s+', '')"
    for pattern, put in ((r"\[([^\]]+)\]\([^)]+\)", r"\1"), ("[*_`~]+", ""), (r"^\s*[-+*>\s]+", ""), (r"\s+", " ")):
        line = f"regexp_replace({line}, '{pattern}', '{put}', 'g')"
    line = f"coalesce(nullif(trim({line}), ''), {raw})"
    return f"CASE WHEN {line} <> '' THEN CASE WHEN length({line}) > 50 THEN trim(substring({line}, 1, 50)) || '...' ELSE {line} END END"


CHATS_SQL = f"""u AS (SELECT chat_id, count(*) AS n_messages, max(turn) AS last_turn, max(CASE WHEN role = 'user' THEN turn END) AS last_user_turn, arg_max(content, turn) AS last_message,
 arg_min(content, turn) FILTER (role = 'user') AS first_user_message FROM chat_messages GROUP BY 1), t AS (SELECT *, {title_sql("coalesce(first_user_message, last_message)")} AS title FROM u)"""


@query(with_views(f"+{CHATS_SQL} SELECT * FROM t", "chat_messages"))
def chat_list(spark: SparkSession, folder: str) -> DataFrame:
    return chats.chat_list(corpus.chat_messages(spark, folder))


@query(with_views(f"+{CHATS_SQL} SELECT * FROM t WHERE lower(title) LIKE '%the%' OR lower(last_message) LIKE '%the%' OR lower(first_user_message) LIKE '%the%'", "chat_messages"))
def chat_list_search(spark: SparkSession, folder: str) -> DataFrame:
    return chats.chat_list(corpus.chat_messages(spark, folder), search="The")


@query(with_views(f"+{CHATS_SQL} SELECT count(*) AS n FROM t WHERE lower(title) LIKE '%the%' OR lower(last_message) LIKE '%the%' OR lower(first_user_message) LIKE '%the%'", "chat_messages"))
def chat_count_search(spark: SparkSession, folder: str) -> DataFrame:
    return chats.chat_list(corpus.chat_messages(spark, folder), search="The").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("""SELECT chat_id, turn, role, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_question FROM chat_messages""", "chat_messages"))
def chat_previous_user_question(spark: SparkSession, folder: str) -> DataFrame:
    return chats.previous_user_question(corpus.chat_messages(spark, folder)).drop("content")


@query(with_views("""SELECT chat_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY turn DESC) AS nth,
 sum(length(content)) OVER (PARTITION BY chat_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM chat_messages) WHERE used <= 1500 OR nth = 1""", "chat_messages"))
def chat_history_budget_trim(spark: SparkSession, folder: str) -> DataFrame:
    return chats.trimmed_history(corpus.chat_messages(spark, folder), 1500).select("chat_id", "turn", "used")


@query(with_views("""SELECT chat_id, CAST(floor((nth - 1) / 4) AS BIGINT) AS batch, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM
 (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY turn) AS nth FROM chat_messages) GROUP BY 1, 2""", "chat_messages"))
def chat_turn_batches(spark: SparkSession, folder: str) -> DataFrame:
    return chats.turn_batches(corpus.chat_messages(spark, folder), 4)


@query(with_views("SELECT chat_id, turn, CAST(sum(CASE WHEN role = 'user' AND length(content) > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS generation FROM chat_messages", "chat_messages"))
def chat_scope_generation(spark: SparkSession, folder: str) -> DataFrame:
    return chats.scope_generation(corpus.chat_messages(spark, folder), (F.col("role") == "user") & (F.length("content") > 200)).select("chat_id", "turn", "generation")


def tokens_sql(c: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g')), ' +'), lambda x: x <> ''))"


@query(with_views(f"""+q AS (SELECT chat_id, turn, role, content, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM chat_messages)
 SELECT chat_id, turn, len(list_intersect({tokens_sql("content")}, {tokens_sql("coalesce(before, '')")})) AS overlap FROM q WHERE role = 'user'""", "chat_messages"))
def chat_topic_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return chats.topic_overlap(corpus.chat_messages(spark, folder))


@query()
def query_intent(spark: SparkSession, folder: str) -> DataFrame:
    return chats.query_intent(corpus.chat_messages(spark, folder))


@query()
def answer_sanitised(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns and whole documents as answers made fit for display."""
    rows = corpus.chat_messages(spark, folder).filter("role = 'assistant'").select("chat_id", "turn", "content")
    rows = rows.unionByName(corpus.table(spark, folder, "documents").select((-1 - F.col("doc_id")).alias("chat_id"), F.lit(0).alias("turn"), F.col("text").alias("content")))
    rows = rows.select("chat_id", "turn", A.displayed(F.col("content")).alias("shown"))
    rows = rows.select("chat_id", "turn", T.redact_numbers(F.col("shown.text")).alias("content"), "shown.reasoning_only")
    return rows.select("*", T.incomplete_reason(F.col("content")).alias("incomplete"), T.limit_words(F.col("content"), 50).alias("short"))


@query()
def answer_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of all answers and documents, by kind."""
    rows = corpus.chat_messages(spark, folder).filter("role = 'assistant'").select(F.concat_ws("/", "chat_id", "turn").alias("answer"), "content")
    rows = rows.unionByName(corpus.table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("answer"), F.col("text").alias("content")))
    found = rows.select("answer", F.posexplode(blocks.blocks_of(F.col("content"))).alias("place", "b"))
    return found.select("answer", "place", "b.kind", F.length("b.text").alias("n_chars"), F.size("b.rows").alias("n_rows"), F.size("b.items").alias("n_items"))


@query(f"""WITH c AS (SELECT item_id AS claim_id, unnest({tokens_sql("text")}) AS word FROM benchmark), d AS (SELECT doc_id, unnest({tokens_sql("text")}) AS word FROM documents),
 b AS (SELECT claim_id, doc_id, count(*) AS n FROM c JOIN d USING (word) GROUP BY 1, 2), m AS (SELECT claim_id, max(n) AS n FROM b GROUP BY 1)
 SELECT item_id AS claim_id, coalesce(n, 0) AS shared, coalesce(n, 0) >= 2 AS supported FROM benchmark LEFT JOIN m ON claim_id = item_id""")
def evidence_metrics(spark: SparkSession, folder: str) -> DataFrame:
    claims = corpus.table(spark, folder, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"))
    return retrieval.evidence(claims, corpus.table(spark, folder, "documents").select(F.col("doc_id").alias("source_id"), "text"))


# changes and integrity


@query("""WITH s AS (SELECT CASE WHEN doc_id % 10 = 0 THEN -doc_id - 1 ELSE doc_id END AS path, sha256(text) AS h FROM documents),
 k AS (SELECT CASE WHEN doc_id % 13 = 0 THEN -doc_id - 1000000000 ELSE doc_id END AS path, CASE WHEN doc_id % 17 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents)
 SELECT coalesce(s.path, k.path) AS path, CASE WHEN k.h IS NULL THEN 'new' WHEN s.h IS NULL THEN 'deleted' WHEN s.h = k.h THEN 'unchanged' ELSE 'changed' END AS status FROM s FULL JOIN k ON s.path = k.path""")
def change_set(spark: SparkSession, folder: str) -> DataFrame:
    """All documents on both sides, some under other paths."""
    d = corpus.table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    ident = F.col("doc_id")
    scanned = d.withColumn("path", F.when(ident % 10 == 0, -ident - 1).otherwise(ident))
    known = d.withColumn("path", F.when(ident % 13 == 0, -ident - 10**9).otherwise(ident)).withColumn("content_hash", F.when(ident % 17 == 0, "x").otherwise(F.col("content_hash")))
    return changes.change_set(scanned, known)


def moved(c: str, every: int, rest: int) -> Column:
    """Ids of which one in ``every`` is turned into one that nothing else has; no row is left out."""
    return F.when(F.col(c) % every == rest, -F.col(c) - 1).otherwise(F.col(c))


def moved_sql(c: str, every: int, rest: int) -> str:
    return f"CASE WHEN {c} % {every} = {rest} THEN -{c} - 1 ELSE {c} END"


def faulty(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All files, chunks and vectors, some under ids that the others don't know, some vectors with other copies of a file's columns."""
    files = corpus.files(spark, folder).withColumn("id", moved("id", 29, 3))
    chunks = corpus.chunks(spark, folder).withColumn("id", moved("id", 31, 5)).withColumn("file_id", moved("file_id", 41, 7))
    copies = corpus.files(spark, folder).select(F.col("id").alias("file_id"), "path", F.when(F.col("id") % 19 == 0, "old").otherwise(F.col("filename")).alias("filename"), "extension", "category", F.when(F.col("id") % 23 != 0, F.col("year")).alias("year"))
    vectors = corpus.children(spark, folder).select(moved("id", 37, 1).alias("chunk_id"), "file_id").join(copies, "file_id")
    return files, chunks, vectors


FAULTY_SQL = f"""f AS (SELECT * REPLACE ({moved_sql('id', 29, 3)} AS id) FROM files), c AS (SELECT * REPLACE ({moved_sql('id', 31, 5)} AS id, {moved_sql('file_id', 41, 7)} AS file_id) FROM chunks),
 v AS (SELECT {moved_sql('k.id', 37, 1)} AS chunk_id, file_id, path, CASE WHEN x.id % 19 = 0 THEN 'old' ELSE filename END AS filename, extension, category, CASE WHEN x.id % 23 <> 0 THEN year END AS year FROM children k JOIN files x ON x.id = k.file_id)"""


@query(with_views(f"""+{FAULTY_SQL}, b AS (SELECT v.path <> f.path AS a1, v.filename <> f.filename AS a2, v.extension <> f.extension AS a3, v.category <> f.category AS a4, coalesce(v.year, -1) <> coalesce(f.year, -1) AS a5 FROM v JOIN f ON f.id = v.file_id)
 SELECT 'orphan_chunks' AS check_name, count(*) AS n FROM c ANTI JOIN f ON f.id = c.file_id UNION ALL SELECT 'orphan_vectors_chunk', count(*) FROM v ANTI JOIN c ON c.id = v.chunk_id
 UNION ALL SELECT 'orphan_vectors_file', count(*) FROM v ANTI JOIN f ON f.id = v.file_id UNION ALL SELECT 'missing_parent', count(*) FROM (SELECT * FROM c WHERE parent_id IS NOT NULL) x ANTI JOIN c p ON p.id = x.parent_id
 UNION ALL SELECT 'files_without_chunks', count(*) FROM f ANTI JOIN c ON c.file_id = f.id UNION ALL SELECT 'child_without_vector', count(*) FROM (SELECT * FROM c WHERE parent_id IS NOT NULL) x ANTI JOIN v ON v.chunk_id = x.id
 UNION ALL SELECT 'drift_path', count(*) FILTER (a1) FROM b UNION ALL SELECT 'drift_filename', count(*) FILTER (a2) FROM b UNION ALL SELECT 'drift_extension', count(*) FILTER (a3) FROM b UNION ALL SELECT 'drift_category', count(*) FILTER (a4) FROM b
 UNION ALL SELECT 'drift_year', count(*) FILTER (a5) FROM b UNION ALL SELECT 'drift_file_id', count(*) FROM v JOIN c ON c.id = v.chunk_id WHERE v.file_id <> c.file_id""", "files", "chunks"))
def integrity_checks(spark: SparkSession, folder: str) -> DataFrame:
    return changes.integrity_checks(*faulty(spark, folder))


@query()
def integrity_repaired_counts(spark: SparkSession, folder: str) -> DataFrame:
    return changes.integrity_checks(*changes.repaired(*faulty(spark, folder)))


@query("""WITH k AS (SELECT 'filesystem' AS source_provider, CAST(doc_id AS VARCHAR) AS source_item_id, sha256(text) AS content_hash, CASE WHEN doc_id % 3 > 0 THEN 'e' || CAST(doc_id % 3 AS VARCHAR) END AS error_code, doc_id % 5 AS failures FROM documents),
 m AS (SELECT CASE WHEN doc_id % 6 = 5 THEN 'upload.local' ELSE 'filesystem' END AS source_provider, CAST(doc_id AS VARCHAR) AS source_item_id, CASE WHEN doc_id % 8 = 0 THEN 'y' ELSE sha256(text) END AS content_hash, CASE WHEN doc_id % 3 > 0 THEN 'e' || CAST((doc_id + doc_id % 5) % 3 AS VARCHAR) END AS error_code FROM documents)
 SELECT coalesce(k.source_provider, m.source_provider) AS source_provider, coalesce(k.source_item_id, m.source_item_id) AS source_item_id, CASE WHEN m.source_item_id IS NULL THEN k.content_hash ELSE m.content_hash END AS content_hash,
 CASE WHEN m.source_item_id IS NULL THEN k.error_code ELSE m.error_code END AS error_code, CASE WHEN m.source_item_id IS NULL THEN failures WHEN k.content_hash = m.content_hash AND k.error_code IS NOT DISTINCT FROM m.error_code THEN failures + 1 ELSE 1 END AS failures
 FROM k FULL JOIN m ON k.source_item_id = m.source_item_id AND k.source_provider = m.source_provider""")
def failure_merge(spark: SparkSession, folder: str) -> DataFrame:
    d = corpus.table(spark, folder, "documents").select("doc_id", F.lit("filesystem").alias("source_provider"), F.col("doc_id").cast("string").alias("source_item_id"), F.sha2("text", 256).alias("content_hash"))
    code = lambda x: F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("e"), (x % 3).cast("string")))
    known = d.withColumn("error_code", code(F.col("doc_id"))).withColumn("failures", F.col("doc_id") % 5)
    new = d.withColumn("source_provider", F.when(F.col("doc_id") % 6 == 5, "upload.local").otherwise(F.col("source_provider"))).withColumn("content_hash", F.when(F.col("doc_id") % 8 == 0, "y").otherwise(F.col("content_hash"))).withColumn("error_code", code(F.col("doc_id") + F.col("doc_id") % 5))
    return changes.merged_failures(known, new)


@query("SELECT conv_id * 1000 + turn AS key, CASE WHEN turn % 3 = 0 THEN 'inserted' WHEN turn % 3 = 1 THEN 'no_op' ELSE 'conflict' END AS status FROM conversations")
def artifact_idempotent_insert(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.table(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "turn", "text")
    known = rows.filter("turn % 3 <> 0").withColumn("text", F.when(F.col("turn") % 3 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return changes.inserted_once(known, rows, "key", ["text"])


@query("SELECT label, max(vec_id) AS chunk_id FROM embeddings GROUP BY 1")
def vector_sink_last_write(spark: SparkSession, folder: str) -> DataFrame:
    return changes.last_write(corpus.vec_chunks(spark, folder).select("label", "chunk_id"), "label", "chunk_id")


# diagnostics and logs


@query(with_views("""SELECT type, query_type, count(*) AS n, round(avg(CAST(timeout_occurred AS INTEGER)), 6) AS timeout_rate, round(avg(CAST(has_empty_answer AS INTEGER)), 6) AS empty_rate, round(avg(CAST(has_refusal_pattern AS INTEGER)), 6) AS refusal_rate,
 round(avg(generation_seconds), 6) AS avg_seconds, quantile_disc(generation_seconds, 0.95) AS p95_seconds, round(avg(sources_count), 6) AS avg_sources, round(avg(raw_chunks_count), 6) AS avg_chunks, min(created_at) AS first_at, max(created_at) AS last_at
 FROM diagnostics GROUP BY GROUPING SETS ((), (type), (query_type))""", "diagnostics"))
def diagnostics_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = stats.diagnostics_summary(corpus.diagnostics(spark, folder))
    return rows.withColumn("first_at", F.col("first_at").cast("timestamp_ntz")).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))


@query(with_views("SELECT issue, count(*) AS n FROM (SELECT unnest(detected_issues) AS issue FROM diagnostics) GROUP BY 1", "diagnostics"))
def diagnostics_issue_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.issue_counts(corpus.diagnostics(spark, folder))


@query(with_views(r"""+q AS (SELECT *, query_type IN ('focused', 'coverage') AS searched, len(list_filter(string_split_regex(trim(question), '\s+'), lambda x: x <> '')) > 10 OR query_type = 'coverage' AS long_one,
 query_type = 'focused' AND sources_count > 0 AND regexp_matches(question, '(?i)\b(?:what|which|summari[sz]e|describe)\b.*\b[\w\-\s()]+\.[a-z0-9]{2,5}\b') AS one_file FROM diagnostics)
 SELECT id, array_to_string(list_filter([CASE WHEN searched AND raw_chunks_count = 0 THEN 'retrieval_failure' END, CASE WHEN searched AND raw_chunks_count BETWEEN 1 AND 2 AND long_one AND NOT one_file THEN 'insufficient_retrieval' END,
 CASE WHEN has_empty_answer OR trim(answer) = '' THEN 'empty_answer' END, CASE WHEN has_refusal_pattern THEN 'refusal_bias' END, CASE WHEN timeout_occurred THEN 'timeout' END,
 CASE WHEN query_type <> 'simple' AND answer_length BETWEEN 1 AND 19 THEN 'very_short_answer' END, CASE WHEN unsupported_claim_count > 0 THEN 'unsupported_claims_detected' END], lambda x: x IS NOT NULL), ',') AS issues FROM q""", "diagnostics"))
def issue_detection(spark: SparkSession, folder: str) -> DataFrame:
    return stats.detected_issues(corpus.diagnostics(spark, folder)).select("id", F.array_join("issues", ",").alias("issues"))


@query(with_views("+n AS (SELECT type, query_type, count(*) AS k FROM diagnostics GROUP BY 1, 2) SELECT type, round(max(k) / sum(k), 6) AS dominant_share, count(*) AS n_keys FROM n GROUP BY 1", "diagnostics"))
def diagnostics_by_dimension(spark: SparkSession, folder: str) -> DataFrame:
    return stats.dominant_share(corpus.diagnostics(spark, folder), "type", "query_type")


@query(with_views("+m AS (SELECT max(created_at) AS top FROM log_events) SELECT id, channel, event_type, source FROM log_events, m WHERE channel = 'system' AND (created_at < TIMESTAMP '2024-01-15 00:00:00' OR created_at = TIMESTAMP '2024-01-15 00:00:00' AND id < 500) ORDER BY created_at DESC, id DESC LIMIT 40", "log_events"))
def log_page_keyset(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.log_events(spark, folder).filter("channel = 'system'")
    return filters.after_cursor(rows, "2024-01-15 00:00:00", 500, 40).select("id", "channel", "event_type", "source")


@query(with_views("SELECT id FROM log_events WHERE created_at >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 30 DAYS ORDER BY created_at DESC, id DESC LIMIT 500", "log_events"))
def log_retention(spark: SparkSession, folder: str) -> DataFrame:
    return stats.prune_logs(corpus.log_events(spark, folder), F.lit(NOW).cast("timestamp"), 30, 500).select("id")


@query(with_views("SELECT source, event_type, CAST(floor(epoch(created_at) / 3600) AS BIGINT) AS bucket, arg_min(id, (created_at, id)) AS id, count(*) AS n FROM log_events GROUP BY 1, 2, 3", "log_events"))
def log_bucket_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return stats.bucket_dedupe(corpus.log_events(spark, folder), 3600)


@query(with_views("""+p AS (SELECT *, epoch(created_at) - epoch(lag(created_at) OVER w) AS pause FROM log_events WINDOW w AS (PARTITION BY source ORDER BY created_at, id)),
 b AS (SELECT *, sum(CASE WHEN pause IS NULL OR pause > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY created_at, id) AS burst FROM p)
 SELECT source, CAST(burst AS BIGINT) AS burst, min(created_at) AS first_at, max(created_at) AS last_at, count(*) AS n FROM b GROUP BY 1, 2""", "log_events"))
def event_debounce_sessions(spark: SparkSession, folder: str) -> DataFrame:
    rows = stats.debounce(corpus.log_events(spark, folder), "source", 3600)
    return rows.withColumn("first_at", F.col("first_at").cast("timestamp_ntz")).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))


@query()
def rate_limit_admission(spark: SparkSession, folder: str) -> DataFrame:
    return stats.admitted(corpus.log_events(spark, folder), "source", 60, 3600)


# text


@query(with_views("SELECT id, TRY_CAST(regexp_extract(filename, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1) AS INTEGER) AS found FROM files", "files"))
def text_year(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.files(spark, folder).select("id", T.year_of(F.col("filename"), F.col("path")).alias("found"))


@query(with_views("""SELECT id, array_to_string(list_transform(list_filter(string_split(regexp_replace(lower(path), '[^/]*$', ''), '/'), lambda x: length(x) > 1 AND x NOT IN ('library', 'system', 'users', 'home', 'documents')),
 lambda x: replace(replace(x, ' ', '_'), '-', '_')), ',') AS found FROM files""", "files"))
def text_tags(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.files(spark, folder).select("id", F.array_join(T.tags_of(F.col("path")), ",").alias("found"))


@query(with_views("SELECT id, category AS found FROM files", "files"))
def text_category(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.files(spark, folder).select("id", T.category_of(T.extension_of(F.col("filename"))).alias("found"))


@query()
def text_clean_glyphs(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.table(spark, folder, "documents").select("doc_id", F.sha2(T.clean_glyphs(F.col("text")), 256).alias("digest"))


@query(r"""WITH m AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[0-9]+') AS runs, string_split_regex(coalesce(text, ''), '[0-9]+') AS rest FROM documents),
 c AS (SELECT doc_id, rest, list_transform(runs, lambda x: CASE WHEN length(x) IN (10, 11) THEN x[:6] || ' ' || x[7:] WHEN length(x) >= 13 THEN x[:7] || ' ' || x[8:] ELSE x END) AS runs FROM m),
 p AS (SELECT doc_id, unnest(range(1, len(rest) + 1)) AS k, unnest(list_transform(list_zip(rest, runs), lambda x: coalesce(x[1], '') || coalesce(x[2], ''))) AS piece FROM c)
 SELECT doc_id, sha256(string_agg(piece, '' ORDER BY k)) AS digest FROM p GROUP BY 1""")
def text_unglue_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.table(spark, folder, "documents").select("doc_id", F.sha2(T.unglue_numbers(F.coalesce("text", F.lit(""))), 256).alias("digest"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\(?[$€£]?[0-9][0-9,]*(?:\.[0-9]+)?%?\)?') AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS token, CAST(unnest(range(len(l))) AS INTEGER) AS nth FROM t),
 v AS (SELECT *, TRY_CAST(regexp_replace(token, '[$€£,%\s()]', '', 'g') AS DOUBLE) AS bare FROM e)
 SELECT doc_id, nth, token, CASE WHEN regexp_matches(token, '^\s*\(.*\)\s*$') THEN -bare ELSE bare END AS value FROM v WHERE bare IS NOT NULL AND NOT regexp_matches(token, '^\s*(19|20)[0-9]{2}\s*$')""")
def numeric_candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.table(spark, folder, "documents").select("doc_id", F.posexplode(T.numeric_tokens(F.col("text"))).alias("nth", "token"))
    return rows.withColumn("value", T.numeric_value(F.col("token"))).filter("value IS NOT NULL")


@query()
def html_to_text(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.table(spark, folder, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(with_views("SELECT id, file_id, chunk_index, content FROM parents", "parents"))
def parent_chunks_simple(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.parents(spark, folder).select("id", "file_id", "chunk_index", "content")


@query(with_views("SELECT id, file_id, chunk_index, content, parent_id FROM children", "children"))
def child_chunks_simple(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.children(spark, folder)


@query()
def parent_chunks_budget(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.budget_chunks(corpus.table(spark, folder, "documents")).filter("child = -1")


@query()
def child_chunks_budget(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.budget_chunks(corpus.table(spark, folder, "documents")).filter("child >= 0")


# gates and rules


CHUNKS_SQL = "gate AS (SELECT *, CASE WHEN chunk_id % 5 < 2 THEN 'narrative' WHEN chunk_id % 5 = 2 THEN 'Table' WHEN chunk_id % 5 = 3 THEN NULL ELSE 'form' END AS block_type, CASE WHEN query_id % 2 = 0 THEN 'coverage' ELSE 'focused' END AS mode, query_id % 4 = 1 AS anchored, ln(score) * 4 AS logit FROM cand)"


def gate_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = candidates(spark, folder)
    kind = F.col("chunk_id") % 5
    rows = rows.withColumn("block_type", F.when(kind < 2, "narrative").when(kind == 2, "Table").when(kind == 4, "form"))
    return rows.withColumn("score", F.log("score") * 4)


@query(f"""WITH {CANDIDATES_SQL}, {CHUNKS_SQL}, n AS (SELECT query_id, count(*) AS chunk_count, count(*) FILTER (block_type = 'narrative') AS narrative_count, count(*) FILTER (lower(coalesce(block_type, '')) IN ('table', 'form')) AS structural_count FROM gate GROUP BY 1)
 SELECT *, chunk_count - structural_count AS substantive_count, round((chunk_count - structural_count) / chunk_count, 6) AS substantive_ratio, structural_count = chunk_count AS structural_only FROM n""")
def evidence_profile(spark: SparkSession, folder: str) -> DataFrame:
    return gates.evidence_profile(gate_chunks(spark, folder))


@query(f"""WITH {CANDIDATES_SQL}, {CHUNKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM gate),
 g AS (SELECT query_id, mode, anchored, round(avg(CASE WHEN nth <= 3 THEN 1 / (1 + exp(-logit)) END), 6) AS relevance, count(DISTINCT file_id) AS n_sources, count(*) AS n_chunks FROM r GROUP BY ALL)
 SELECT *, CASE WHEN mode = 'coverage' THEN relevance >= 0.02 ELSE anchored OR relevance >= 0.03 END AS relevant, mode <> 'coverage' OR n_sources >= 2 AS diverse, mode = 'coverage' AND n_sources >= 3 AND n_chunks >= 8 AS floor_reached FROM g""")
def retrieval_gates(spark: SparkSession, folder: str) -> DataFrame:
    mode = F.when(F.col("query_id") % 2 == 0, "coverage").otherwise("focused")
    return gates.retrieval_gates(gate_chunks(spark, folder), mode, F.col("query_id") % 4 == 1)


@query(f"""WITH {PASSAGES_SQL}, w AS (SELECT query_id, chunk_id, many, {any_sql("left(content, 1200)", R.STRUCTURAL_TEXTS)} OR len(regexp_extract_all(left(content, 1200), '{R.CHAPTER}', 0, 'i')) >= 4 AS toc FROM pass),
 k AS (SELECT *, count(*) FILTER (NOT toc) OVER (PARTITION BY query_id) AS kept FROM w) SELECT query_id, chunk_id FROM k WHERE NOT toc OR kept < 12 OR many = 1""")
def filter_structural(spark: SparkSession, folder: str) -> DataFrame:
    return gates.without_structural(passages(spark, folder), 12).select("query_id", "chunk_id")


@query(f"""WITH {PASSAGES_SQL}, m AS (SELECT *, max(n_shared) OVER (PARTITION BY query_id, file_id) AS of_file, max(n_shared) OVER (PARTITION BY query_id) AS best FROM shared)
 SELECT query_id, chunk_id FROM m WHERE many = 1 OR best = 0 OR of_file = best""")
def title_focus(spark: SparkSession, folder: str) -> DataFrame:
    return gates.title_focus(passages(spark, folder)).select("query_id", "chunk_id")


@query("SELECT conv_id AS answer_id, 'p' || CAST(turn % 3 AS VARCHAR) AS path, 'f' AS filename, max(turn) AS seq FROM conversations GROUP BY 1, 2, 3")
def merged_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.table(spark, folder, "conversations").select(F.col("conv_id").alias("answer_id"), F.concat(F.lit("p"), (F.col("turn") % 3).cast("string")).alias("path"), F.lit("f").alias("filename"), F.col("turn").alias("seq"))
    return gates.merged_sources(rows)


@query("""WITH s AS (SELECT conv_id AS chat_id, turn, list_distinct(['f' || CAST(turn % 4 AS VARCHAR), CASE WHEN turn % 3 = 0 THEN 'other' ELSE 'f' || CAST(turn % 4 AS VARCHAR) END]) AS names FROM conversations WHERE role = 'assistant')
 SELECT chat_id, arg_max(names[1], turn) AS filename FROM s WHERE len(names) = 1 GROUP BY 1""")
def followup_file(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.lit("f"), (F.col("turn") % 4).cast("string"))
    rows = corpus.table(spark, folder, "conversations").filter("role = 'assistant'").select(F.col("conv_id").alias("chat_id"), "turn", F.array(name, F.when(F.col("turn") % 3 == 0, " other").otherwise(name)).alias("filenames"))
    return gates.followup_file(rows)


@query(with_views("""+x AS (SELECT id AS item, content_hash, CASE WHEN id % 4 = 0 THEN 0 ELSE 1 END AS retryable, CASE WHEN id % 8 = 0 THEN 'old' ELSE content_hash END AS failed_hash FROM files)
 SELECT item, retryable = 0 AND failed_hash = content_hash AS skip, CASE WHEN retryable = 0 AND failed_hash = content_hash THEN 'broken' END AS error_code FROM x""", "files"))
def retry_suppression(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.files(spark, folder).select("id", "source_provider", "entity_type", F.col("id").cast("string").alias("source_item_id"), "content_hash")
    failures = rows.select("source_provider", "entity_type", "source_item_id", F.when(F.col("id") % 4 == 0, 0).otherwise(1).alias("retryable"), F.when(F.col("id") % 8 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.lit("broken").alias("error_code"))
    return gates.retry_suppressed(rows, failures).select(F.col("id").alias("item"), "skip", "error_code")


@query(with_views("""SELECT source, CAST(CASE WHEN q = 'coverage' THEN greatest(least(CAST(floor(n * 0.25) AS BIGINT), 30), base) WHEN p < 500 THEN greatest(10, least(base, 12))
 ELSE greatest(base, least(8 + CAST(floor(log2(greatest(p / 100, 1.0)) * 3) AS BIGINT), 25)) END AS BIGINT) AS top_k, q AS query_type, base
 FROM (SELECT source, count(*) AS n, count(*) * 37 AS p FROM files GROUP BY 1), (SELECT unnest(['focused', 'coverage']) AS q), (SELECT unnest([4, 8, 15]) AS base)""", "files"))
def adaptive_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.files(spark, folder).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("query_type", F.explode(F.array(F.lit("focused"), F.lit("coverage")))).withColumn("base", F.explode(F.array(*map(F.lit, (4, 8, 15)))))
    return rows.select("source", "query_type", "base", stats.adaptive_top_k(F.col("n"), F.col("n") * 37, F.col("query_type"), F.col("base")).alias("top_k"))


@query(r"""SELECT conv_id AS chat_id, turn, regexp_matches(text, '[#*\[\]`]') AS has_markdown, regexp_matches(text, '(?m)^\s*[-*\x{2022}]|\d+\.') AS has_list, regexp_matches(text, '\|.*\|') AS has_table,
 len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS word_count FROM conversations WHERE role = 'assistant'""")
def answer_signals(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.chat_messages(spark, folder).filter("role = 'assistant'")
    return rows.select("chat_id", "turn", T.answer_signals(F.col("content")).alias("s")).select("chat_id", "turn", "s.*")


@query(with_views("SELECT id, CASE WHEN id % 3 = 0 THEN 'failed' ELSE 'completed' END AS status, created_at + CASE WHEN id % 3 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS completed_at FROM log_events", "log_events"))
def stale_scans(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.log_events(spark, folder).select("id", F.when(F.col("id") % 3 == 0, "running").otherwise("completed").alias("status"), F.col("created_at").alias("completed_at"))
    out = stats.stale_scans_failed(rows, F.col("completed_at") + F.expr("INTERVAL 1 HOUR"))
    return out.withColumn("completed_at", F.col("completed_at").cast("timestamp_ntz"))


@query("SELECT conv_id, turn, coalesce(TRY_CAST(trim(CASE WHEN turn % 2 = 0 THEN ' ' || CAST(turn AS VARCHAR) ELSE text END) AS BIGINT), -1) AS n FROM conversations")
def safe_numbers(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" "), F.col("turn").cast("string"))).otherwise(F.col("text"))
    return corpus.table(spark, folder, "conversations").select("conv_id", "turn", T.safe_number(raw, -1).alias("n"))


# terms


def named_parents(spark: SparkSession, folder: str) -> DataFrame:
    """Parents with long forms, acronyms and names put in, as the invented prose has few."""
    say = F.element_at(F.array(*map(F.lit, SAYINGS)), (F.col("chunk_index") % len(SAYINGS) + 1).cast("int"))
    return corpus.parents(spark, folder).withColumn("content", F.concat_ws(" ", "content", say))


SAYINGS = ["The World Health Organization (WHO) met Dr. Jane Roe.", "NASA (National Aeronautics and Space Administration) wrote to Prof. Li.", "Then Bureau of Labor Data (XYZ) came, said Ann B. Cole.", "nothing"]
NAMED_SQL = "named AS (SELECT id, file_id, content || ' ' || [" + ", ".join(f"'{x}'" for x in SAYINGS) + f"][chunk_index % {len(SAYINGS)} + 1] AS content FROM parents)"
def names(spark: SparkSession, folder: str) -> DataFrame:
    return terms.person_names(named_parents(spark, folder)).select(F.lit("person_name").alias("term_type"), F.col("name").alias("canonical"), F.col("name").alias("alias"), "confidence", "file_id", "chunk_id")


@query(with_views(rf"""+{NAMED_SQL}, p AS (SELECT file_id, id, unnest(regexp_extract_all(content, '{terms.PAIR}')) AS x FROM named), r AS (SELECT file_id, id, unnest(regexp_extract_all(content, '{terms.REVERSE}')) AS x FROM named),
 f AS (SELECT file_id, id AS chunk_id, regexp_extract(x, '{terms.PAIR}', 2) AS acronym, regexp_extract(x, '{terms.PAIR}', 1) AS long_form FROM p UNION ALL SELECT file_id, id, regexp_extract(x, '{terms.REVERSE}', 1), regexp_extract(x, '{terms.REVERSE}', 2) FROM r),
 i AS (SELECT *, upper(array_to_string(list_transform(list_filter(string_split_regex(long_form, '\s+'), lambda w: lower(w) NOT IN ('of', 'and', 'for', 'the')), lambda w: w[1]), '')) AS initials FROM f)
 SELECT file_id, chunk_id, acronym, long_form, CAST(CASE WHEN initials = acronym THEN 0.95 WHEN initials[1] = acronym[1] THEN 0.75 ELSE 0.5 END AS DOUBLE) AS confidence FROM i""", "parents"))
def acronym_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return terms.acronym_pairs(named_parents(spark, folder))


# no SQL for the next two: word boundaries beyond ASCII differ there; the tests hold them against brute force


@query()
def term_dictionary_build(spark: SparkSession, folder: str) -> DataFrame:
    return terms.merged_terms(names(spark, folder)).select("term_type", "norm", "canonical", "alias", "confidence", "n_seen", "n_files", "tier")


@query()
def quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    return terms.quality_gate(names(spark, folder))


@query(with_views(rf"""+w AS (SELECT file_id, unnest({WORDS_SQL}) AS norm FROM parents), p AS (SELECT norm, file_id, count(*) AS n FROM w WHERE length(norm) >= 4 GROUP BY 1, 2)
 SELECT norm, CAST(sum(n) AS BIGINT) AS n_seen, count(*) AS n_files FROM p GROUP BY 1""", "parents"))
def term_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return terms.document_terms(corpus.parents(spark, folder))


@query()
def query_expansion(spark: SparkSession, folder: str) -> DataFrame:
    asked = corpus.chat_messages(spark, folder).filter("role = 'user'").select((F.col("chat_id") * 1000 + F.col("turn")).alias("query_id"), F.col("content").alias("query"))
    words = terms.document_terms(corpus.parents(spark, folder), 8).filter("n_files >= 3").select(F.col("norm").alias("alias"), F.col("norm").alias("canonical"))
    return terms.expanded_queries(asked, words)


def dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Words of three files and more, and the first two words of every item of the benchmark, as aliases of terms."""
    norm = F.col("norm")
    words = terms.document_terms(corpus.parents(spark, folder), 5).filter("n_files >= 3").select(norm.alias("alias"), F.concat(F.lit("T "), norm).alias("canonical"), F.when(F.length(norm) % 5 == 0, expansion.PERSON).otherwise("term").alias("term_type"), F.element_at(F.array(F.lit(0.9), F.lit(0.9), F.lit(0.7), F.lit(0.5)), F.length(norm) % 4 + 1).alias("confidence"))
    pair = F.array_join(F.slice(F.split(T.term_text(F.col("text")), " "), 1, 2), " ")
    pairs = corpus.table(spark, folder, "benchmark").select(pair.alias("alias")).filter(F.contains("alias", F.lit(" "))).distinct()
    return words.unionByName(pairs.select("alias", F.concat(F.lit("T "), "alias").alias("canonical"), F.lit("term").alias("term_type"), F.lit(0.9).alias("confidence")))


NORM_SQL = r"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'))"


#: At most one edit, by characters: DuckDB's levenshtein counts bytes.
ONE_EDIT_SQL = """CASE WHEN len({a}) = len({b}) THEN len(list_filter(range(1, len({a}) + 1), lambda i: substr({a}, i, 1) <> substr({b}, i, 1))) <= 1
 WHEN len({a}) > len({b}) THEN list_contains(list_transform(range(1, len({a}) + 1), lambda i: left({a}, i - 1) || substr({a}, i + 1)), {b})
 ELSE list_contains(list_transform(range(1, len({b}) + 1), lambda i: left({b}, i - 1) || substr({b}, i + 1)), {a}) END"""


@query(with_views(f"""+voc AS (SELECT DISTINCT file_id, unnest(string_split({NORM_SQL.format(c='content')}, ' ')) AS norm FROM parents),
 al AS (SELECT norm AS alias, 'T ' || norm AS canonical, CASE WHEN len(norm) % 5 = 0 THEN 'person_name' ELSE 'term' END AS kind, [0.9, 0.9, 0.7, 0.5][len(norm) % 4 + 1] AS conf FROM voc WHERE len(norm) >= 5 GROUP BY norm HAVING count(*) >= 3
  UNION ALL SELECT DISTINCT alias, 'T ' || alias, 'term', 0.9 FROM (SELECT array_to_string(string_split({NORM_SQL.format(c='text')}, ' ')[1:2], ' ') AS alias FROM benchmark) WHERE alias LIKE '% %'),
 k AS (SELECT * FROM al WHERE conf >= 0.65 AND len(alias) >= 3 AND alias NOT IN ({quoted(expansion.BLOCKED)})),
 q AS (SELECT conv_id * 1000 + turn AS query_id, trim(text) AS query, {NORM_SQL.format(c='text')} AS said FROM conversations WHERE role = 'user'),
 a AS (SELECT *, string_split(said, ' ') AS words FROM q), b AS (SELECT *, list_has_any(words, [{quoted(expansion.PERSON_SCOPE)}]) AND list_has_any(words, [{quoted(expansion.PERSON_INTENT)}]) AS persons FROM a),
 w AS (SELECT DISTINCT query_id, persons, said, unnest(words) AS word FROM b),
 r AS (SELECT DISTINCT query_id, persons, CASE WHEN len(word) >= 5 AND regexp_matches(word, '[0-9]') THEN translate(word, '01', 'ol') ELSE word END AS word FROM w),
 m AS (SELECT query_id, alias, canonical, conf, 0 AS how FROM b JOIN k ON alias LIKE '% %' AND contains(' ' || said || ' ', ' ' || alias || ' ') AND (persons OR kind <> 'person_name')
  UNION SELECT query_id, alias, canonical, conf, 1 FROM w JOIN k ON alias = word AND (persons OR kind <> 'person_name')
  UNION SELECT query_id, alias, canonical, conf, 2 FROM r JOIN k ON conf >= 0.85 AND len(alias) >= 5 AND len(word) >= 5 AND alias NOT LIKE '% %' AND abs(len(alias) - len(word)) <= 1 AND levenshtein(alias, word) <= 4 AND {ONE_EDIT_SQL.format(a='alias', b='word')} AND (persons OR kind <> 'person_name')),
 o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id, alias ORDER BY how, conf DESC, canonical) = 1),
 t AS (SELECT * FROM o QUALIFY how < 2 OR row_number() OVER (PARTITION BY query_id, how, lower(canonical) ORDER BY len(alias) DESC, alias) = 1),
 n AS (SELECT * FROM t QUALIFY how < 2 OR row_number() OVER (PARTITION BY query_id, how ORDER BY len(alias) DESC, alias) <= 2),
 l AS (SELECT query_id, list(canonical ORDER BY how, len(alias) DESC, alias) AS every, list(canonical ORDER BY how, len(alias) DESC, alias) FILTER (conf >= 0.85) AS high, count(*) AS n_matches FROM n GROUP BY 1)
 SELECT q.query_id, array_to_string([query] || coalesce(high[1:6], []), ' ') AS embedding_query, array_to_string([query] || coalesce(every[1:10], []), ' ') AS fts_query, coalesce(n_matches, 0) AS n_matches FROM q LEFT JOIN l ON l.query_id = q.query_id""", "parents"))
def term_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of all users with the terms of the dictionary behind them."""
    asked = corpus.chat_messages(spark, folder).filter("role = 'user'").select((F.col("chat_id") * 1000 + F.col("turn")).alias("query_id"), F.col("content").alias("query"))
    return expansion.expanded(asked, dictionary(spark, folder))


@query(with_views(f"""+voc AS (SELECT DISTINCT file_id, unnest(string_split({NORM_SQL.format(c='content')}, ' ')) AS norm FROM parents),
 al AS (SELECT norm AS alias, 'T ' || norm AS canonical, CASE WHEN len(norm) % 5 = 0 THEN 'person_name' ELSE 'term' END AS kind, [0.9, 0.9, 0.7, 0.5][len(norm) % 4 + 1] AS conf FROM voc WHERE len(norm) >= 5 GROUP BY norm HAVING count(*) >= 3
  UNION ALL SELECT DISTINCT alias, 'T ' || alias, 'term', 0.9 FROM (SELECT array_to_string(string_split({NORM_SQL.format(c='text')}, ' ')[1:2], ' ') AS alias FROM benchmark) WHERE alias LIKE '% %'),
 q AS (SELECT conv_id * 1000 + turn AS query_id, trim(text) AS query, {NORM_SQL.format(c='text')} AS said FROM conversations WHERE role = 'user'),
 a AS (SELECT *, string_split(said, ' ') AS words FROM q), b AS (SELECT *, list_has_any(words, [{quoted(expansion.PERSON_SCOPE)}]) AND list_has_any(words, [{quoted(expansion.PERSON_INTENT)}]) AS persons FROM a),
 m AS (SELECT DISTINCT query_id, alias, canonical FROM b JOIN al ON conf >= 0.85 AND (persons OR kind <> 'person_name') AND CASE WHEN alias LIKE '% %' THEN contains(' ' || said || ' ', ' ' || alias || ' ') ELSE list_contains(words, alias) END),
 f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id, canonical ORDER BY len(alias) DESC, alias) = 1),
 l AS (SELECT query_id, list(canonical ORDER BY len(alias) DESC, alias, canonical)[1:4] AS terms FROM f GROUP BY 1)
 SELECT q.query_id, array_to_string([query] || coalesce(terms, []), ' ') AS expanded_query, coalesce(len(terms), 0) AS n_terms FROM q LEFT JOIN l ON l.query_id = q.query_id""", "parents"))
def routing_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of all users with up to four terms behind them, for routing."""
    asked = corpus.chat_messages(spark, folder).filter("role = 'user'").select((F.col("chat_id") * 1000 + F.col("turn")).alias("query_id"), F.col("content").alias("query"))
    return expansion.routed(asked, dictionary(spark, folder)).select("query_id", "expanded_query", F.size("terms").cast("long").alias("n_terms"))


# scopes and endings of turns


@query("""SELECT s_suppkey AS alias_id, lower(s_name) AS normalized_alias, n_name AS canonical_term, 'ORG' AS term_type FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey % 2 = 1 AND n_nationkey % 4 <> 0""")
def active_term_aliases(spark: SparkSession, folder: str) -> DataFrame:
    active = F.when(F.col("n_nationkey") % 4 != 0, "active").otherwise("retired")
    entries = corpus.table(spark, folder, "nation").select(F.col("n_nationkey").alias("term_id"), F.col("n_name").alias("canonical_term"), F.lit("ORG").alias("term_type"), (F.col("n_regionkey") % 2).alias("dict_version"), active.alias("status"))
    aliases = corpus.table(spark, folder, "supplier").select(F.col("s_nationkey").alias("term_id"), F.col("s_suppkey").alias("alias_id"), F.lower("s_name").alias("normalized_alias"))
    return scopes.active_aliases(aliases, entries, spark.range(1).select(F.lit(1).alias("current_version"))).drop("term_id")


@query("""WITH c AS (SELECT n_nationkey AS request_id, n_regionkey AS chat_id, lower(left(n_name, CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 20 END)) AS want FROM nation),
 h AS (SELECT request_id, count_if(lower(n_name) = want) AS e, count_if(contains(lower(n_name), want)) AS p, min(CASE WHEN lower(n_name) = want THEN n_nationkey END) AS e1, min(CASE WHEN contains(lower(n_name), want) THEN n_nationkey END) AS p1
 FROM c JOIN nation ON n_regionkey = chat_id GROUP BY 1)
 SELECT request_id, CASE WHEN e = 1 OR (e = 0 AND p = 1) THEN 'resolved' WHEN e > 1 OR p > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status,
 CASE WHEN e = 1 THEN CAST(e1 AS VARCHAR) WHEN e = 0 AND p = 1 THEN CAST(p1 AS VARCHAR) ELSE '' END AS uploads FROM h""")
def upload_name_resolution(spark: SparkSession, folder: str) -> DataFrame:
    nation = corpus.table(spark, folder, "nation")
    name = F.when(F.col("n_nationkey") % 3 == 0, F.substring("n_name", 1, 2)).otherwise(F.col("n_name"))
    asked = nation.select(F.col("n_nationkey").alias("request_id"), F.col("n_regionkey").alias("chat_id"), F.lit(0).alias("seq"), F.concat(F.lit(" compare "), name, F.lit(",")).alias("candidate"))
    stored = nation.select(F.col("n_regionkey").alias("chat_id"), F.col("n_nationkey").cast("string").alias("upload_id"), F.col("n_name").alias("filename"))
    return scopes.resolved_uploads(asked, stored).select("request_id", "status", F.array_join("upload_ids", ",").alias("uploads"))


@query("""WITH e AS (SELECT user_id AS chat_id, ts AS moment, 1 AS step, CAST(event_id AS VARCHAR) AS upload_id FROM events UNION ALL
 SELECT user_id, ts + INTERVAL 2 HOUR, -1, CAST(event_id AS VARCHAR) FROM events WHERE event_id % 5 <> 0),
 r AS (SELECT *, sum(step) OVER (PARTITION BY chat_id ORDER BY moment, step, upload_id) - step AS prior FROM e)
 SELECT chat_id, max_by(upload_id, (moment, upload_id)) AS anchor FROM r WHERE step = 1 AND prior = 0 GROUP BY 1""")
def upload_session_anchor(spark: SparkSession, folder: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    rows = corpus.table(spark, folder, "events").select(F.col("user_id").alias("chat_id"), F.col("event_id").cast("string").alias("upload_id"), at.alias("uploaded_at"), F.when(F.col("event_id") % 5 != 0, at + F.expr("INTERVAL 2 HOURS")).alias("removed_at"))
    return scopes.upload_anchors(rows)


@query(with_views("""+m AS (SELECT *, max(turn) OVER (PARTITION BY chat_id) AS last FROM chat_messages),
 p AS (SELECT chat_id AS prompt_id, CASE WHEN turn = last THEN 'question' ELSE 'history' END AS kind, turn AS seq, length(content) AS tokens FROM m UNION ALL SELECT chat_id, 'chunk', turn, length(content) // 2 FROM m WHERE role = 'assistant'),
 t AS (SELECT prompt_id, sum(tokens) - 300 AS over, sum(CASE WHEN kind = 'history' THEN tokens ELSE 0 END) AS h, sum(CASE WHEN kind = 'chunk' THEN tokens ELSE 0 END) AS c FROM p GROUP BY 1),
 x AS (SELECT p.*, over, h, c, coalesce((SELECT sum(tokens) FROM p q WHERE q.prompt_id = p.prompt_id AND q.kind = p.kind AND q.seq < p.seq), 0) AS before, coalesce((SELECT sum(tokens) FROM p q WHERE q.prompt_id = p.prompt_id AND q.kind = p.kind AND q.seq > p.seq), 0) AS after FROM p JOIN t USING (prompt_id))
 SELECT prompt_id, kind, seq, tokens, over <= 0 OR h >= over OR c >= over AS fits FROM x
 WHERE over <= 0 OR CASE WHEN h >= over THEN kind <> 'history' OR before >= over WHEN c >= over THEN kind <> 'chunk' OR after >= over ELSE true END""", "chat_messages"))
def prompt_truncation(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.chat_messages(spark, folder).withColumn("last", F.max("turn").over(Window.partitionBy("chat_id")))
    said = rows.select(F.col("chat_id").alias("prompt_id"), F.when(F.col("turn") == F.col("last"), "question").otherwise("history").alias("kind"), F.col("turn").alias("seq"), F.length("content").cast("long").alias("tokens"))
    found = rows.filter("role = 'assistant'").select(F.col("chat_id").alias("prompt_id"), F.lit("chunk").alias("kind"), F.col("turn").alias("seq"), F.expr("length(content) div 2").alias("tokens"))
    return scopes.fitted_prompts(said.unionByName(found), 300)


@query("""WITH d AS (SELECT event_id AS id, event_id % 5 AS m, event_id % 2 = 0 AS t, event_id % 3 AS tr, event_id % 7 = 0 AS rem, event_id % 11 = 0 AS st, event_id % 4 AS r FROM events),
 a AS (SELECT *, CASE m WHEN 0 THEN 'complete' WHEN 1 THEN 'stopped' WHEN 2 THEN 'scoped_complete' ELSE CASE WHEN t THEN 'partial' ELSE 'complete' END END AS mode FROM d),
 b AS (SELECT *, rem OR (t AND tr <> 0) OR mode = 'stopped' AS rest FROM a),
 c AS (SELECT id, t, r, rest, CASE WHEN rest AND mode = 'complete' THEN 'scoped_complete' ELSE mode END AS mode,
 CASE WHEN st THEN 'regenerate' WHEN r = 1 THEN 'none' WHEN r = 2 THEN 'regenerate' WHEN NOT rest THEN 'none' ELSE 'continue' END AS next_action,
 CASE WHEN st THEN 'stopped' WHEN r = 1 THEN NULL WHEN r = 2 THEN 'stalled' WHEN NOT rest THEN NULL WHEN r = 3 THEN 'budget_exhausted' WHEN t THEN 'timeout' ELSE 'unresolved_content' END AS next_action_reason FROM b)
 SELECT id, CASE WHEN (next_action = 'none' OR next_action_reason = 'stalled') AND mode IN ('scoped_complete', 'partial') THEN 'complete' ELSE mode END AS completion_mode,
 CASE WHEN next_action = 'none' OR next_action_reason = 'stalled' THEN false ELSE rest END AS has_remaining_scope, next_action, next_action_reason FROM c""")
def completion_states(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("event_id")
    mode = F.when(i % 5 == 0, " Complete").when(i % 5 == 1, "stopped").when(i % 5 == 2, "scoped_complete").when(i % 5 == 3, "unheard of")
    late, why = F.when(i % 3 == 0, "queue_wait_timeout").otherwise("idle"), F.when(i % 4 == 1, "first_token_watchdog_timeout").when(i % 4 == 2, scopes.STALLED).when(i % 4 == 3, scopes.OUT_OF_PASSES)
    return corpus.table(spark, folder, "events").select(i.alias("id"), scopes.completion(mode, i % 2 == 0, late, i % 7 == 0, i % 11 == 0, why).alias("x")).select("id", "x.*")


@query("SELECT user_id AS chat_id, event_id AS id, ts AS uploaded_at FROM events WHERE event_type IS DISTINCT FROM 'error'")
def chat_uploads(spark: SparkSession, folder: str) -> DataFrame:
    e = corpus.table(spark, folder, "events")
    rows = e.select(F.col("user_id").alias("chat_id"), F.col("event_id").alias("id"), F.col("ts").alias("uploaded_at"), F.when(F.col("event_type") == "error", "deleted").otherwise("active").alias("state"))
    return scopes.uploads_of(rows, rows).drop("state")


@query("""SELECT doc_id, doc_id % 6 < 3 AND coalesce(source, '') <> '' AND NOT (doc_id % 5 = 4) AS allowed FROM documents""")
def upload_policy(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("doc_id")
    ending = F.element_at(F.array(*map(F.lit, [".md", ".TXT", ".tar.pdf", ".exe", "", "pdf"])), (i % 6 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, [" Text/Plain; charset=utf-8", "", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "; q=1", "image/png"])), (i % 5 + 1).cast("int"))
    return corpus.table(spark, folder, "documents").select("doc_id", scopes.uploadable(F.concat(F.coalesce("source", F.lit("")), ending), kind, [".pdf"]).alias("allowed"))


@query("""SELECT conv_id, turn, conv_id % 3 <> 0 OR (turn % 4 <> 3 AND turn % 5 IN (0, 1, 2)) AS seen FROM conversations""")
def history_scope(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("turn")
    said = F.element_at(F.array(*map(F.lit, [" ", "researcher", "", "assistant"])), (t % 4 + 1).cast("int"))
    key = F.element_at(F.array(*map(F.lit, ["indexed_corpus", " indexed_corpus|g:000 ", "indexed_corpus|g:-4", "indexed_corpus|g:10", ""])), (t % 5 + 1).cast("int"))
    mode = F.when(F.col("conv_id") % 3 == 0, "researcher").otherwise("assistant")
    seen = scopes.in_scope(said, F.lit("indexed_corpus"), key, mode, F.lit("indexed_corpus"), F.lit("indexed_corpus|g:0"))
    return corpus.table(spark, folder, "conversations").select("conv_id", "turn", seen.alias("seen"))


# relational base


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.table(spark, folder, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def revenue_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda name: corpus.table(spark, folder, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("n_orders"))

