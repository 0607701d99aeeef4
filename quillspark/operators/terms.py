"""Term dictionary: acronyms, person names, merge, quality gate, expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .lineage import staged

PAIR = r"((?:[A-Z][A-Za-z]+(?:\s+(?:of|and|for|the)\s+|\s+)){1,7}[A-Z][A-Za-z]+)\s*\(([A-Z]{2,8})\)"
REVERSE = r"\b([A-Z]{2,8})\s*\(((?:[A-Z][A-Za-z]+(?:\s+(?:of|and|for|the)\s+|\s+)){1,7}[A-Z][A-Za-z]+)\)"
PERSON = r"\b([A-Z][a-z]{1,20}(?:\s+[A-Z]\.)?\s+[A-Z][a-z]{1,20})\b"
TITLED = r"\b(?:Dr|Mr|Mrs|Ms|Prof)\.?\s+([A-Z][a-z]{1,20}(?:\s+[A-Z][a-z]{1,20})?)\b"


def acronym_pairs(chunks: DataFrame) -> DataFrame:
    """(file_id, chunk_id, acronym, long_form, confidence) of both writing orders; initials that fit raise the confidence."""
    both = F.concat(
        F.transform(F.regexp_extract_all("content", F.lit(PAIR), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, PAIR, 2).alias("acronym"), F.regexp_extract(x, PAIR, 1).alias("long_form"))),
        F.transform(F.regexp_extract_all("content", F.lit(REVERSE), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, REVERSE, 1).alias("acronym"), F.regexp_extract(x, REVERSE, 2).alias("long_form"))),
    )
    rows = chunks.select("file_id", F.col("id").alias("chunk_id"), F.explode(both).alias("p")).select("file_id", "chunk_id", "p.*")
    small = ["of", "and", "for", "the"]
    initials = F.upper(F.array_join(F.transform(F.filter(F.split("long_form", r"\s+"), lambda w: ~F.lower(w).isin(small)), lambda w: F.substring(w, 1, 1)), ""))
    return rows.withColumn("confidence", F.when(initials == F.col("acronym"), 0.95).when(F.substring(initials, 1, 1) == F.substring("acronym", 1, 1), 0.75).otherwise(0.5))


def person_names(chunks: DataFrame, stop_words: list[str] = ("The", "This", "That", "And", "For", "With")) -> DataFrame:
    """(file_id, chunk_id, name, confidence): titled names count more."""
    titled = F.transform(F.regexp_extract_all("content", F.lit(TITLED), F.lit(1)), lambda x: F.struct(x.alias("name"), F.lit(0.9).alias("confidence")))
    plain = F.transform(F.regexp_extract_all("content", F.lit(PERSON), F.lit(1)), lambda x: F.struct(x.alias("name"), F.lit(0.6).alias("confidence")))
    rows = chunks.select("file_id", F.col("id").alias("chunk_id"), F.explode(F.concat(titled, plain)).alias("p")).select("file_id", "chunk_id", "p.*")
    return rows.filter(~F.exists(F.split("name", r"\s+"), lambda w: w.isin(list(stop_words)))).groupBy("file_id", "chunk_id", "name").agg(F.max("confidence").alias("confidence"))


def merged_terms(candidates: DataFrame, most_evidence: int = 4) -> DataFrame:
    """Candidates (term_type, canonical, alias, confidence, file_id, chunk_id) by normal form.

    The first spelling seen wins, the highest confidence counts, the best alias spelling is that of the highest
    confidence, and the first few places are kept as evidence. ``slice`` runs over a list that is cut in every task.
    """
    rows = candidates.withColumn("norm", T.term_text(F.col("canonical")))
    w = Window.partitionBy("term_type", "norm").orderBy("chunk_id", "canonical", "alias")
    nth = rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most_evidence)
    places = nth.groupBy("term_type", "norm").agg(F.array_sort(F.collect_list(F.struct("nth", "file_id", "chunk_id"))).alias("evidence"))
    merged = rows.groupBy("term_type", "norm").agg(
        F.min_by("canonical", F.struct("chunk_id", "canonical")).alias("canonical"), F.max("confidence").alias("confidence"),
        F.max_by("alias", F.struct("confidence", F.negative("chunk_id"))).alias("alias"), F.count(F.lit(1)).alias("n_seen"), F.count_distinct("file_id").alias("n_files"),
    )
    return merged.join(places, ["term_type", "norm"]).withColumn("tier", T.confidence_tier(F.col("confidence")))


def quality_gate(candidates: DataFrame, least_confidence: float = 0.65, most_noise: float = 0.5) -> DataFrame:
    """One row: totals, noise rate and whether the build may go live."""
    row = candidates.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("confidence") >= least_confidence).alias("n_kept"))
    noise = F.when(F.col("n_total") == 0, 0.0).otherwise(F.round(1 - F.col("n_kept") / F.col("n_total"), 6))
    return row.withColumn("noise_rate", noise).withColumn("passed", (F.col("noise_rate") <= most_noise) & (F.col("n_kept") > 0))


def term_inventory(entries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Terms with the number of files that show them."""
    n = evidence.groupBy("norm").agg(F.count_distinct("file_id").alias("n_files"), F.count(F.lit(1)).alias("n_places"))
    return entries.join(n, "norm", "left").select("norm", "canonical", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_places", F.lit(0)).alias("n_places"))


def expanded_queries(queries: DataFrame, aliases: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, canonical, how): aliases that a query holds as a phrase (0) or as a word (1), or that are within one edit of
    one of its longer words (2).

    Phrases meet queries on their first word and are then looked for whole; words meet aliases by equality; near words meet
    on variants with one character left out, once for each distinct word. Of a word's near terms the ``most`` first are
    enough: one that a query holds by phrase or word takes a place there.
    """
    words = queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("word"))
    alias = staged(aliases.select(T.term_text(F.col("alias")).alias("alias"), "canonical"), "aliases")
    phrases = alias.filter(F.contains("alias", F.lit(" "))).withColumn("word", F.substring_index("alias", " ", 1))
    said = queries.select("query_id", F.concat(F.lit(" "), T.term_text(F.col("query")), F.lit(" ")).alias("said"))
    phrase = words.join(phrases, "word").join(said, "query_id").filter(F.contains("said", F.concat(F.lit(" "), "alias", F.lit(" ")))).select("query_id", "canonical", F.lit(0).alias("how"))
    exact = words.join(alias, F.col("word") == F.col("alias")).select("query_id", "canonical", F.lit(1).alias("how"))
    by_variant = lambda rows, c: rows.withColumn("variant", F.explode(T.variants(F.col(c))))
    near = by_variant(words.select("word").filter(F.length("word") >= 6).distinct(), "word").join(by_variant(alias.filter(F.length("alias") >= 5), "alias"), "variant")
    near = near.filter((F.col("word") != F.col("alias")) & T.near_word(F.col("word"), F.col("alias"))).select("word", "canonical").distinct()
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("word").orderBy("canonical"))).filter(F.col("nth") <= most)
    rows = phrase.unionByName(exact).unionByName(words.join(near, "word").select("query_id", "canonical", F.lit(2).alias("how"))).groupBy("query_id", "canonical").agg(F.min("how").alias("how"))
    w = Window.partitionBy("query_id").orderBy("how", "canonical")
    return rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most).drop("nth")


def document_terms(chunks: DataFrame, least_length: int = 4) -> DataFrame:
    """Corpus vocabulary: occurrences and files per term.

    The chunks of a file come together before their words are counted, so that texts are shuffled and not a row per word of
    each file; what a task knows of a term leaves it as one row.
    """
    texts = chunks.groupBy("file_id").agg(F.collect_list("content").alias("content"))
    # words of a chunk end with it
    words = F.filter(F.split(T.term_text(F.array_join("content", "\n")), " +"), lambda x: F.length(x) >= least_length)
    one = lambda n, files: lambda x: F.struct(x.alias("norm"), F.lit(n).alias("n"), F.lit(files).alias("files"))
    # the lambda names the words, so that they are split once
    marked = F.transform(F.array(words), lambda w: F.concat(F.transform(w, one(1, 0)), F.transform(F.array_distinct(w), one(0, 1))))[0]
    rows = texts.select(F.explode(marked).alias("x")).select("x.*")
    return rows.groupBy("norm").agg(F.sum("n").alias("n_seen"), F.sum("files").alias("n_files"))
