"""What a turn may see and how it ends: active aliases, uploads and their sessions, prompts under a budget, completion states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Modes of completion, reasons of timeouts that end a turn, reasons of continuations, next actions.
MODES = ["complete", "partial", "scoped_complete", "stopped"]
TERMINAL_TIMEOUTS = ["queue_wait_timeout", "first_token_watchdog_timeout"]
STALLED, OUT_OF_PASSES = "duplicate_continuation_detected", "continuation_pass_budget_exhausted"


def active_aliases(aliases: DataFrame, entries: DataFrame, state: DataFrame) -> DataFrame:
    """Aliases of the active terms of the current dictionary version, the longest first; ``state`` is a single row."""
    current = F.broadcast(state.select("current_version"))
    live = entries.filter("status = 'active'").join(current, F.col("dict_version") == F.col("current_version"), "left_semi").select("term_id", "canonical_term", "term_type")
    return aliases.join(live, "term_id").orderBy(F.desc(F.length("normalized_alias")), "normalized_alias")


def filename_token(name: Column) -> Column:
    """A file name as it is compared: single spaces, no punctuation around it, no leading word of comparison, lower case."""
    bare = lambda x: F.regexp_replace(x, r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", "")
    words = bare(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")))
    return F.lower(bare(F.trim(F.regexp_replace(words, r"(?i)^(?:compare|vs|versus|and|with|between)\s+", ""))))


def resolved_uploads(asked: DataFrame, attachments: DataFrame) -> DataFrame:
    """(request_id, status, upload_ids) of (request_id, chat_id, seq, candidate): one exact name, or else one that holds the
    candidate; the first candidate with several or none decides the status, and then nothing is selected.

    Requests meet the uploads of their own chat only.
    """
    want = asked.select("request_id", "chat_id", "seq", filename_token(F.col("candidate")).alias("want"))
    have = attachments.select("chat_id", "upload_id", filename_token(F.col("filename")).alias("have"))
    rows = want.join(have, "chat_id", "left")
    exact, part = F.col("want") == F.col("have"), F.contains("have", "want")
    rows = rows.groupBy("request_id", "seq").agg(F.count_if(exact).alias("n_exact"), F.count_if(part).alias("n_part"), F.min(F.when(exact, F.col("upload_id"))).alias("one"), F.min(F.when(part, F.col("upload_id"))).alias("other"))
    n = F.when(F.col("n_exact") > 0, F.col("n_exact")).otherwise(F.col("n_part"))
    rows = rows.withColumn("status", F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unmatched")).withColumn("upload_id", F.when(F.col("n_exact") > 0, F.col("one")).otherwise(F.col("other")))
    out = rows.groupBy("request_id").agg(F.min_by("status", F.when(F.col("status") != "resolved", F.col("seq"))).alias("failed"), F.array_sort(F.collect_set("upload_id")).alias("ids"))
    return out.select("request_id", F.coalesce("failed", F.lit("resolved")).alias("status"), F.when(F.col("failed").isNull(), F.col("ids")).otherwise(F.expr("array()").cast("array<string>")).alias("upload_ids"))


def upload_anchors(attachments: DataFrame) -> DataFrame:
    """(chat_id, anchor): the upload that began the chat's newest session, that is the last one added while none was active.

    Removals come before additions of the same time. The number of active uploads never falls below zero, so that it is the
    running sum less its lowest point so far.
    """
    added = attachments.filter("uploaded_at IS NOT NULL").select("chat_id", F.col("uploaded_at").alias("at"), F.lit(1).alias("step"), "upload_id")
    removed = attachments.filter("removed_at IS NOT NULL").select("chat_id", F.col("removed_at").alias("at"), F.lit(-1).alias("step"), "upload_id")
    order = Window.partitionBy("chat_id").orderBy("at", "step", "upload_id")
    rows = added.union(removed).filter("trim(upload_id) <> ''").withColumn("sum", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("prior", F.col("sum") - F.col("step")).withColumn("low", F.least(F.lit(0), F.min("sum").over(before)))
    begun = rows.filter("step = 1 AND prior = coalesce(low, 0)")
    return begun.groupBy("chat_id").agg(F.max_by("upload_id", F.struct("at", "upload_id")).alias("anchor"))


def fitted_prompts(parts: DataFrame, budget: int) -> DataFrame:
    """Parts (prompt_id, kind, seq, tokens) that stay under the budget; kinds are system, chunk, history and question.

    The oldest history goes first, as far as needed, if that is enough by itself. Otherwise all history stays and chunks go
    from the end. Where neither helps, all parts stay and ``fits`` is false.
    """
    whole = Window.partitionBy("prompt_id")
    kind = Window.partitionBy("prompt_id", "kind").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    of = lambda name: F.sum(F.when(F.col("kind") == name, F.col("tokens")).otherwise(0)).over(whole)
    rows = parts.withColumn("_over", F.sum("tokens").over(whole) - budget).withColumn("_history", of("history")).withColumn("_chunks", of("chunk")).withColumn("_sum", F.sum("tokens").over(kind))
    by_history = (F.col("_over") > 0) & (F.col("_history") >= F.col("_over"))
    by_chunks = (F.col("_over") > F.col("_history")) & (F.col("_chunks") >= F.col("_over"))
    # a message goes while those before it aren't enough; a chunk goes while those after it aren't
    old = by_history & (F.col("kind") == "history") & (F.col("_sum") - F.col("tokens") < F.col("_over"))
    last = by_chunks & (F.col("kind") == "chunk") & (F.col("_chunks") - F.col("_sum") < F.col("_over"))
    return rows.withColumn("fits", (F.col("_over") <= 0) | by_history | by_chunks).filter(~old & ~last).drop("_over", "_history", "_chunks", "_sum")


def completion(asked_mode: Column, timed_out: Column, timeout_reason: Column, remaining: Column, stopped: Column, reason: Column) -> Column:
    """(completion_mode, has_remaining_scope, next_action, next_action_reason) of a turn, made consistent."""
    plain = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    mode = F.when(plain(asked_mode).isin(MODES), plain(asked_mode)).when(timed_out, "partial").otherwise("complete")
    left = remaining | (timed_out & ~plain(timeout_reason).isin(TERMINAL_TIMEOUTS)) | (mode == "stopped")
    mode = F.when(left & (mode == "complete"), "scoped_complete").otherwise(mode)
    why = plain(reason)
    none = why.isin(TERMINAL_TIMEOUTS)
    action = F.when(stopped, "regenerate").when(none, "none").when(why == STALLED, "regenerate").when(~left, "none").otherwise("continue")
    note = F.when(stopped, "stopped").when(none, None).when(why == STALLED, "stalled").when(~left, None).when(why == OUT_OF_PASSES, "budget_exhausted").when(timed_out, "timeout").otherwise("unresolved_content")
    over = (action == "none") | F.coalesce(note == "stalled", F.lit(False))
    final = F.when(over & mode.isin("scoped_complete", "partial"), "complete").when((action == "continue") & (mode == "complete"), "scoped_complete").otherwise(mode)
    scope = F.when(over, False).when(action == "continue", True).otherwise(left)
    return F.struct(final.alias("completion_mode"), scope.alias("has_remaining_scope"), action.alias("next_action"), note.alias("next_action_reason"))


def heading_key(heading: Column) -> Column:
    text = F.trim(F.regexp_replace(F.regexp_replace(heading, r"^\s*#{1,6}\s*", ""), r"\s+", " "))
    return F.lower(F.regexp_replace(text, r"^[ .:]+|[ .:]+$", ""))


def missing_headings(answer: Column, required: Column) -> Column:
    """Required headings that an answer lacks, in their order."""
    present = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"(?m)^\s{0,3}#{1,6}\s+(.+?)\s*$"), F.lit(1)), heading_key)
    return F.filter(required, lambda x: ~F.array_contains(present, heading_key(x)))


#: The kind of scope that is the whole indexed corpus, and types of content that may be uploaded.
CORPUS_SCOPE = "indexed_corpus"
UPLOAD_TYPES = ["text", "application/pdf", "application/epub+zip", "application/json", "application/xml", "application/vnd.openxmlformats-officedocument", "application/vnd.ms-excel", "application/vnd.ms-powerpoint", "application/msword"]


def uploads_of(attachments: DataFrame, chats: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Uploads of the given chats in the order they came, those in state ``deleted`` only on demand."""
    rows = attachments if include_deleted else attachments.filter("state <> 'deleted'")
    return rows.join(chats.select("chat_id").distinct(), "chat_id", "left_semi").orderBy("chat_id", "uploaded_at", "id")


def uploadable(filename: Column, content_type: Column, extensions: list[str]) -> Column:
    """Whether a file's last extension is among those supported (``.txt`` and ``.md`` always) and its type, if told, is too."""
    name = F.element_at(F.split(F.coalesce(filename, F.lit("")), "/", -1), -1)
    ext = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    base = F.trim(F.substring_index(F.lower(F.trim(F.coalesce(content_type, F.lit("")))), ";", 1))
    known = [base.startswith(x) for x in UPLOAD_TYPES]
    typed = base == ""
    for one in known:
        typed = typed | one
    return ext.isin(sorted({*extensions, ".txt", ".md"})) & typed


def scope_key(kind: Column, key: Column) -> Column:
    """A scope's key as it is compared: that of the whole corpus carries its generation, 0 where it is not told or negative."""
    plain, given = F.trim(F.coalesce(key, F.lit(""))), rf"^{CORPUS_SCOPE}\|g:\s*([+-]?)0*([0-9]+)$"
    number = F.when(F.regexp_extract(plain, given, 1) == "-", "0").otherwise(F.regexp_extract(plain, given, 2))
    corpus = F.when(plain == CORPUS_SCOPE, f"{CORPUS_SCOPE}|g:0").when(plain.rlike(given), F.concat(F.lit(f"{CORPUS_SCOPE}|g:"), number)).otherwise(plain)
    return F.when(kind == CORPUS_SCOPE, corpus).otherwise(plain)


def in_scope(said_mode: Column, said_kind: Column, said_key: Column, mode: Column, kind: Column, key: Column) -> Column:
    """Whether a message belongs to a turn's history: all do, but in mode ``researcher`` those of another mode or scope, or of none, don't."""
    plain = lambda x: F.trim(F.coalesce(x, F.lit("")))
    same_mode = plain(said_mode).isin("", "researcher")
    told = (plain(said_kind) != "") & (plain(said_key) != "")
    same = (plain(said_kind) == kind) & (scope_key(plain(said_kind), said_key) == scope_key(kind, key))
    return F.coalesce(mode != "researcher", F.lit(True)) | (same_mode & told & F.coalesce(same, F.lit(False)))
