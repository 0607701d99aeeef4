"""Conversations: lists, history and turns. Recency is the turn number."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.rules import stripped


def chat_list(messages: DataFrame, search: str | None = None) -> DataFrame:
    """One row per chat in one aggregation: counts, last message, first user message, title, last user turn."""
    user = F.col("role") == "user"
    rows = messages.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.max("turn").alias("last_turn"), F.max(F.when(user, F.col("turn"))).alias("last_user_turn"),
        F.max_by("content", "turn").alias("last_message"), F.min_by(F.when(user, F.col("content")), F.when(user, F.col("turn"))).alias("first_user_message"),
    )
    rows = rows.withColumn("title", T.chat_title(F.coalesce("first_user_message", "last_message")))
    if search:
        # as the user typed it: no escaping, both sides in lower case
        pattern = f"%{search.lower()}%"
        rows = rows.filter(F.lower("title").like(pattern) | F.lower("last_message").like(pattern) | F.lower("first_user_message").like(pattern))
    return rows


def previous_user_question(messages: DataFrame) -> DataFrame:
    w = Window.partitionBy("chat_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("previous_question", F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(w))


def trimmed_history(messages: DataFrame, budget: int) -> DataFrame:
    """Newest messages first while their characters fit; the newest one always stays."""
    w = Window.partitionBy("chat_id").orderBy(F.desc("turn"))
    rows = messages.withColumn("nth", F.row_number().over(w)).withColumn("used", F.sum(F.length("content")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter((F.col("used") <= budget) | (F.col("nth") == 1)).drop("nth")


def turn_batches(messages: DataFrame, size: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("chat_id").orderBy("turn"))
    rows = messages.withColumn("batch", F.floor((nth - 1) / size))
    return rows.groupBy("chat_id", "batch").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n"))


def topic_overlap(messages: DataFrame) -> DataFrame:
    """User turns with the number of words they share with the previous user turn."""
    rows = previous_user_question(messages).filter(F.col("role") == "user")
    return rows.select("chat_id", "turn", F.size(F.array_intersect(T.tokens(F.col("content")), T.tokens(F.coalesce("previous_question", F.lit(""))))).alias("overlap"))


def scope_generation(messages: DataFrame, shift: F.Column) -> DataFrame:
    """Running number of topic shifts in a chat."""
    w = Window.partitionBy("chat_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("generation", F.sum(F.when(shift, 1).otherwise(0)).over(w))


#: Wording of the intents, most specific first.
INTENTS = [
    ("metadata", r"(?i)\b(how many|count|list (?:all )?files|which files|oldest|newest)\b"),
    ("summary", r"(?i)\b(summari[sz]e|summary|overview)\b"),
    ("coverage", r"(?i)\b(all|every|compare|across|each)\b"),
]


def query_intent(messages: DataFrame) -> DataFrame:
    """Intent, years and extensions that user turns ask for."""
    text = F.col("content")
    intent = F
    for name, pattern in INTENTS:
        intent = intent.when(text.rlike(pattern), name)
    years = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(T.YEAR), F.lit(1)), lambda x: x.cast("int"))))
    kinds = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\b(pdf|docx|xlsx|csv|txt|md|html)\b"), F.lit(1)), lambda x: F.concat(F.lit("."), x))))
    return messages.filter(F.col("role") == "user").select("chat_id", "turn", intent.otherwise("focused").alias("intent"), years.alias("years"), kinds.alias("extensions"))


#: From which length on two answers are compared by their matching blocks, and the ratio of duplicates.
DUPLICATE_LENGTH, DUPLICATE_RATIO = 240, 0.9


@F.pandas_udf(DoubleType())
def matching_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over all characters.

    Blocks are only searched where a bound allows the ratio of duplicates: no more characters can match than both texts have
    of each character. Where it doesn't, the bound is the result.
    """
    from collections import Counter
    from difflib import SequenceMatcher

    def ratio(a: str, b: str) -> float:
        bound = 2 * (Counter(a) & Counter(b)).total() / (len(a) + len(b)) if a or b else 1.0
        return SequenceMatcher(a=a, b=b).ratio() if bound >= DUPLICATE_RATIO else bound

    return pd.Series([None if a is None or b is None else ratio(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def duplicate_continuation(previous: Column, current: Column) -> Column:
    """Whether an answer repeats the one before it: the same, or long and hardly different; empty ones never do.

    Lengths alone rule most pairs out before a text leaves the JVM.
    """
    a, b = stripped(previous), stripped(current)
    n, m = F.length(a), F.length(b)
    close = (F.least(n, m) >= DUPLICATE_LENGTH) & (2 * F.least(n, m) >= DUPLICATE_RATIO * (n + m))
    none = F.lit(None).cast("string")
    ratio = matching_ratio(F.when(close & (a != b), a).otherwise(none), F.when(close & (a != b), b).otherwise(none))
    return (a != "") & ((a == b) | F.coalesce(ratio >= DUPLICATE_RATIO, F.lit(False)))


def repeated_answers(messages: DataFrame) -> DataFrame:
    """(chat_id, turn, duplicate) of every answer against the answer before it in its chat."""
    answers = messages.filter("role = 'assistant'")
    before = F.lag("content").over(Window.partitionBy("chat_id").orderBy("turn"))
    rows = answers.withColumn("before", before)
    return rows.select("chat_id", "turn", F.coalesce(duplicate_continuation(F.col("before"), F.col("content")), F.lit(False)).alias("duplicate"))
