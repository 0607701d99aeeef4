"""Counts, distributions and dashboards over the corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def per_year(files: DataFrame) -> DataFrame:
    return files.filter("year IS NOT NULL").groupBy("year").agg(F.count(F.lit(1)).alias("n_files"))


def date_range(files: DataFrame) -> DataFrame:
    return files.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("year").alias("n_years"))


def comparative(files: DataFrame, column: str, most: bool = True) -> DataFrame:
    """The value with the most or fewest files; ties go to the smallest value."""
    counts = files.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_files"))
    return counts.orderBy(F.desc("n_files") if most else F.asc("n_files"), column).limit(1)


def distinct_values(files: DataFrame, column: str) -> DataFrame:
    return files.select(column).filter(F.col(column).isNotNull()).distinct()


def filter_options(files: DataFrame, excluded_providers: list[str]) -> DataFrame:
    """(kind, value) choices for filters: categories and extensions outside the excluded providers."""
    rows = files.filter(~F.col("source_provider").isin(excluded_providers))
    return rows.select(F.explode(F.array(F.struct(F.lit("category").alias("kind"), F.lower(F.trim("category")).alias("value")), F.struct(F.lit("extension").alias("kind"), F.lower(F.trim("extension")).alias("value")))).alias("x")).select("x.kind", "x.value").filter("value <> ''").distinct()


def corpus_stats(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of totals; each table is reduced to one row before the rows are put side by side."""
    a = files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"), F.count_if(F.col("source_provider") == "upload.local").alias("n_uploads"))
    b = chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("parent_id").isNull()).alias("n_parents"))
    c = vectors.agg(F.count(F.lit(1)).alias("n_vectors"))
    rows = a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").join(c.withColumn("k", F.lit(1)), "k")
    return rows.drop("k")


def scope_counts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files and chunks by provider; the chunks are counted per file before the join."""
    per_file = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return files.join(per_file, files["id"] == per_file["file_id"], "left").groupBy("source_provider").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"))


def scan_tallies(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("extension").agg(F.count_if(F.col("error").isNull()).alias("n_ok"), F.count_if(F.col("error").isNotNull()).alias("n_failed"))


def diagnostics_summary(rows: DataFrame) -> DataFrame:
    """Totals (type and query_type null) and one row per type and per query type, with rates, averages and p95."""
    sets = rows.groupingSets([[], [F.col("type")], [F.col("query_type")]], F.col("type"), F.col("query_type"))
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return sets.agg(
        F.count(F.lit(1)).alias("n"), rate("timeout_occurred").alias("timeout_rate"), rate("has_empty_answer").alias("empty_rate"), rate("has_refusal_pattern").alias("refusal_rate"),
        F.round(F.avg("generation_seconds"), 6).alias("avg_seconds"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY generation_seconds)").alias("p95_seconds"),
        F.round(F.avg("sources_count"), 6).alias("avg_sources"), F.round(F.avg("raw_chunks_count"), 6).alias("avg_chunks"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
    )


def issue_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("detected_issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def since(rows: DataFrame, now: Column, days: int) -> DataFrame:
    return rows.filter(F.col("created_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


#: A question about a named file, and the limits of the rules.
FILE_QUESTION = r"(?i)\b(?:what|which|summari[sz]e|describe)\b.*\b[\w\-\s()]+\.[a-z0-9]{2,5}\b"
LEAST_CHUNKS, LONG_QUESTION_WORDS, SHORT_ANSWER_CHARS = 3, 10, 20


def detected_issues(rows: DataFrame) -> DataFrame:
    """Adds ``issues``: the seven rules over the measures of a response, in their order."""
    searched = F.col("query_type").isin("focused", "coverage")
    long = (F.size(F.array_remove(F.split(F.trim("question"), r"\s+"), "")) > LONG_QUESTION_WORDS) | (F.col("query_type") == "coverage")
    one_file = (F.col("query_type") == "focused") & F.col("question").rlike(FILE_QUESTION) & (F.col("sources_count") > 0)
    rules = [
        ("retrieval_failure", searched & (F.col("raw_chunks_count") == 0)),
        ("insufficient_retrieval", searched & (F.col("raw_chunks_count") > 0) & (F.col("raw_chunks_count") < LEAST_CHUNKS) & long & ~one_file),
        ("empty_answer", F.col("has_empty_answer") | (F.trim(F.coalesce("answer", F.lit(""))) == "")),
        ("refusal_bias", F.col("has_refusal_pattern")),
        ("timeout", F.col("timeout_occurred")),
        ("very_short_answer", (F.col("query_type") != "simple") & (F.col("answer_length") > 0) & (F.col("answer_length") < SHORT_ANSWER_CHARS)),
        ("unsupported_claims_detected", F.col("unsupported_claim_count") > 0),
    ]
    return rows.withColumn("issues", F.array_compact(F.array(*(F.when(x, name) for name, x in rules))))


def dominant_share(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Largest share of one key among a group's rows, and the number of keys."""
    counts = rows.groupBy(group, key).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.round(F.max("n") / F.sum("n"), 6).alias("dominant_share"), F.count(F.lit(1)).alias("n_keys"))


def adaptive_top_k(n_files: Column, n_parents: Column, query_type: Column, base: Column) -> Column:
    """Results to fetch: a quarter of the files, 30 at most, for coverage; a logarithmic curve over the parent chunks, 25 at
    most, for focused questions; never under the profile's own number, but for small corpora (10 to 12)."""
    coverage = F.when(n_files <= 0, base).otherwise(F.greatest(F.least((n_files * 0.25).cast("long"), F.lit(30)), base))
    curve = 8 + (F.log2(F.greatest(n_parents / 100, F.lit(1.0))) * 3).cast("long")
    focused = F.when(n_parents <= 0, base).when(n_parents < 500, F.greatest(F.lit(10), F.least(base, F.lit(12)))).otherwise(F.greatest(base, F.least(curve, F.lit(25))))
    return F.when(query_type == "coverage", coverage).otherwise(focused).cast("long")


def tuning_is_stale(hours: Column, parents_then: Column, parents_now: Column, most_hours: int = 24, most_drift: float = 0.2) -> Column:
    """Whether cached numbers must be computed anew: by age, or because the corpus has drifted by over a fifth."""
    drift = F.when(parents_then <= 0, parents_now != parents_then).otherwise(F.abs(parents_now - parents_then) / parents_then > most_drift)
    return (hours >= most_hours) | drift


def stale_scans_failed(scans: DataFrame, now: Column) -> DataFrame:
    """Scans still running are marked failed as of now."""
    running = F.col("status") == "running"
    return scans.withColumn("completed_at", F.when(running, now).otherwise(F.col("completed_at"))).withColumn("status", F.when(running, "failed").otherwise(F.col("status")))


def prune_logs(logs: DataFrame, now: Column, days: int, newest: int) -> DataFrame:
    """First rows no older than ``days``, then the newest of them, by (created_at, id)."""
    return since(logs, now, days).orderBy(F.desc("created_at"), F.desc("id")).limit(newest)


def bucket_dedupe(logs: DataFrame, seconds: int) -> DataFrame:
    """One event per source, type and time bucket: the earliest."""
    bucket = F.floor(F.unix_timestamp("created_at") / seconds)
    return logs.groupBy("source", "event_type", bucket.alias("bucket")).agg(F.min_by("id", F.struct("created_at", "id")).alias("id"), F.count(F.lit(1)).alias("n"))


def debounce(events: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """Bursts per key: events with pauses of at most ``gap_seconds`` fall together."""
    w = Window.partitionBy(key).orderBy("created_at", "id")
    pause = F.col("created_at").cast("double") - F.lag("created_at").over(w).cast("double")
    rows = events.withColumn("new", F.when(pause.isNull() | (pause > gap_seconds), 1).otherwise(0)).withColumn("burst", F.sum("new").over(w))
    return rows.groupBy(key, "burst").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.count(F.lit(1)).alias("n"))


def admitted(requests: DataFrame, key: str, limit: int, seconds: int) -> DataFrame:
    """Sliding-window admission: rejected requests don't count. One pass over a key's requests in time order."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from collections import deque

        pdf = pdf.sort_values(["at", "id"])
        recent: deque = deque()
        ok = []
        for t in pdf["at"]:
            while recent and t - recent[0] >= seconds:
                recent.popleft()
            ok.append(len(recent) < limit)
            if ok[-1]:
                recent.append(t)
        return pd.DataFrame({"id": pdf["id"], "key": pdf["key"], "admitted": ok})

    rows = requests.select("id", F.col(key).cast("string").alias("key"), F.col("created_at").cast("double").alias("at"))
    return rows.groupBy("key").applyInPandas(run, "id long, key string, admitted boolean")
