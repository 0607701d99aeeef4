"""Expansion of questions by a dictionary of terms: phrases, then words, then words one edit away, with caps of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .lineage import staged

#: Most terms added for embedding, for full text and for routing, most near words of a question and of a term.
MOST_EMBEDDED, MOST_SEARCHED, MOST_ROUTED, MOST_NEAR, NEAR_PER_TERM = 6, 10, 4, 2, 1
#: A question with a word of both lists may be expanded by names of persons.
PERSON_SCOPE = ["who", "person", "people", "name", "names"]
PERSON_INTENT = ["mention", "mentions", "mentioned", "list", "identify", "identified"]
#: Aliases that say nothing, and the least length of one; the least length of near words.
BLOCKED = ["a", "about", "an", "and", "book", "document", "entry", "file", "for", "in", "is", "item", "material", "note", "of", "on", "or", "paper", "record", "source", "text", "the", "this", "up"]
LEAST_ALIAS, LEAST_NEAR = 3, 5
PERSON = "person_name"


def read_word(word: Column) -> Column:
    """0 and 1 as o and l in words of five characters and more with a digit."""
    return F.when((F.length(word) >= LEAST_NEAR) & word.rlike("[0-9]"), F.translate(word, "01", "ol")).otherwise(word)


def dictionary(aliases: DataFrame) -> DataFrame:
    """(alias, canonical, term_type, confidence, tier) with aliases in normal form; those of low tier or without a term go."""
    known = aliases.select(T.term_text(F.col("alias")).alias("alias"), "canonical", "term_type", "confidence", T.confidence_tier(F.col("confidence")).alias("tier"))
    # several joins read it
    return staged(known.filter((F.col("alias") != "") & (F.trim("canonical") != "") & (F.col("tier") != "low")), "dictionary")


def asked_words(queries: DataFrame) -> DataFrame:
    """(query_id, said, persons, word): each word of a question beside the whole of it, and whether it asks for persons."""
    asked = queries.select("query_id", T.term_text(F.col("query")).alias("said")).filter("said <> ''")
    asked = asked.select("query_id", "said", F.array_distinct(F.split("said", " ")).alias("words"))
    has = lambda words: F.arrays_overlap("words", F.array(*map(F.lit, words)))
    return asked.select("query_id", "said", (has(PERSON_SCOPE) & has(PERSON_INTENT)).alias("persons"), F.explode("words").alias("word"))


KEPT = ["query_id", "alias", "canonical", "tier", "confidence"]


def may() -> Column:
    """Names of persons are for questions that ask for persons."""
    return F.col("persons") | (F.coalesce("term_type", F.lit("")) != PERSON)


def said_terms(words: DataFrame, known: DataFrame) -> DataFrame:
    """Aliases that a question holds: phrases (how 0), which meet it on their first word, and words (1), by equality."""
    phrase = words.join(known.filter(F.contains("alias", F.lit(" "))).withColumn("word", F.substring_index("alias", " ", 1)), "word")
    phrase = phrase.filter(may() & F.contains(F.concat(F.lit(" "), "said", F.lit(" ")), F.concat(F.lit(" "), "alias", F.lit(" ")))).select(*KEPT, F.lit(0).alias("how"))
    exact = words.join(known.filter(~F.contains("alias", F.lit(" "))), F.col("word") == F.col("alias")).filter(may())
    return phrase.unionByName(exact.select(*KEPT, F.lit(1).alias("how")))


def by_alias() -> list[Column]:
    """Longer aliases first, then by alphabet."""
    return [F.desc(F.length("alias")), F.col("alias")]


def matched_terms(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, alias, canonical, how, tier, place) of (query_id, query) and (alias, canonical, term_type, confidence).

    ``how`` is phrase, exact or fuzzy, ``place`` counts a question's matches in that order, longer aliases first, then by
    alphabet. Aliases of low tier, blocked or too short ones take no part, names of persons only where the question asks for
    persons; an alias counts once, with its smallest canonical of the highest tier. Near words need the high tier; they meet
    on variants with one character left out, so that no key is shared by more than words of one spelling.
    """
    known = dictionary(aliases).filter((F.length("alias") >= LEAST_ALIAS) & ~F.col("alias").isin(BLOCKED))
    words = asked_words(queries)
    high = known.filter(~F.contains("alias", F.lit(" ")) & (F.col("tier") == "high") & (F.length("alias") >= LEAST_NEAR)).withColumn("variant", F.explode(T.variants(F.col("alias"))))
    asked = words.select("query_id", "persons", read_word(F.col("word")).alias("word")).filter(F.length("word") >= LEAST_NEAR).distinct()
    # each distinct word meets the dictionary once, however many questions hold it
    near = asked.select("word").distinct().withColumn("variant", F.explode(T.variants(F.col("word")))).join(high, "variant")
    near = near.filter(F.levenshtein("word", "alias", 1) >= 0).select("word", "alias", "canonical", "term_type", "tier", "confidence").distinct()
    near = asked.join(near, "word").filter(may()).select(*KEPT, F.lit(2).alias("how"))
    once = Window.partitionBy("query_id", "alias").orderBy("how", F.desc("confidence"), "canonical")
    rows = said_terms(words, known).unionByName(near).withColumn("nth", F.row_number().over(once)).filter("nth = 1").drop("nth")
    of_term = Window.partitionBy("query_id", "how", T.term_text(F.col("canonical"))).orderBy(*by_alias())
    rows = rows.withColumn("of_term", F.row_number().over(of_term)).filter((F.col("how") < 2) | (F.col("of_term") <= NEAR_PER_TERM))
    rows = rows.withColumn("of_kind", F.row_number().over(Window.partitionBy("query_id", "how").orderBy(*by_alias()))).filter((F.col("how") < 2) | (F.col("of_kind") <= MOST_NEAR))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("how", *by_alias())))
    name = F.element_at(F.array(F.lit("phrase"), F.lit("exact"), F.lit("fuzzy")), F.col("how") + 1)
    return rows.select("query_id", "alias", "canonical", name.alias("how"), "tier", "place")


def routed(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, expanded_query, terms) for routing: up to four terms of the high tier that a question holds as phrase or word.

    Terms come in the order of their longest alias, equal lengths by alphabet; every alias counts, short and common ones too.
    """
    found = said_terms(asked_words(queries), dictionary(aliases).filter("tier = 'high'"))
    first = found.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "canonical").orderBy(*by_alias()))).filter("nth = 1")
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*by_alias(), "canonical"))).filter(F.col("place") <= MOST_ROUTED)
    held = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "canonical"))), lambda x: x["canonical"]).alias("terms"))
    rows = queries.select("query_id", F.trim("query").alias("query")).join(held, "query_id", "left").withColumn("terms", F.coalesce("terms", F.expr("array()").cast("array<string>")))
    return rows.select("query_id", F.array_join(F.concat(F.array("query"), "terms"), " ").alias("expanded_query"), "terms")


def expanded(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, embedding_query, fts_query, n_matches): the questions with the terms they match behind them.

    Terms of the high tier go to the embedding, all to the full text, each once, in the order of matches and up to the caps. A
    question without a match stays as it is.
    """
    found = matched_terms(queries, aliases)
    held = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "canonical", "tier"))).alias("m"))
    rows = queries.select("query_id", F.trim("query").alias("query")).join(held, "query_id", "left")
    m = F.coalesce("m", F.expr("array()").cast("array<struct<place:int,canonical:string,tier:string>>"))
    terms = lambda x, most: F.slice(F.array_distinct(F.transform(x, lambda y: y["canonical"])), 1, most)
    joined = lambda x: F.array_join(F.concat(F.array("query"), x), " ")
    return rows.select("query_id", joined(terms(F.filter(m, lambda y: y["tier"] == "high"), MOST_EMBEDDED)).alias("embedding_query"), joined(terms(m, MOST_SEARCHED)).alias("fts_query"), F.size(m).cast("long").alias("n_matches"))
