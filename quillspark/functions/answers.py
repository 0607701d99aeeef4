"""Answers made fit for display, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import stripped

#: What is shown where an answer was nothing but reasoning.
FALLBACK = "I could not generate a final answer from the model output. Please try rephrasing your question."
#: Signs that stand for states, and their words.
STATE_SIGNS = {"✅": "Yes", "☑️": "Yes", "✔️": "Yes", "✔": "Yes", "❌": "No", "✖️": "No", "✗": "No", "⚠️": "Warning", "⚠": "Warning"}
#: Marks of sources, in text and on lines of their own.
SOURCE_MARKS = [
    r"(?i)\[source:\s*\d+\]",
    r"(?i)\(\s*source\s*\d+(?:\s*,\s*source\s*\d+)*\s*\)",
    r"(?i)\(\s*sources?\s*\d+(?:\s*,\s*\d+)*\s*\)",
    r"(?im)^\s*sources?\s*:\s*.*$",
    r"(?im)^\s*source\s+\d+(?:\s*,\s*source\s+\d+)*\s*$",
]
#: Boxes of task lists, and requests that want them kept.
TASK_BOX = r"(?im)^([ \t]*(?:[-*+]|\d+\.)[ \t]+)\[(?: |x)\][ \t]+"
TASK_REQUEST = r"(?is)\b(checkbox(?:es)?|task[\s\-]*list|todo|to[\s\-]*do|check[\s\-]*list\s+with\s+checkbox(?:es)?|markdown\s+task\s+list|\-\s*\[\s*x\s*\])\b"
#: The label of an answer, plain or bold, at the start of the text or of a paragraph.
ANSWER_LABELS = [
    r"(?im)(^|\n{2,}[ \t]*)\*\*[ \t]*answer[ \t]*:[ \t]*\*\*[ \t]*",
    r"(?im)(^|\n{2,}[ \t]*)(?:\*\*)?[ \t]*answer[ \t]*(?:\*\*)?[ \t]*:[ \t]*",
]
#: A sentence that repeats what the answer has said of the documents, and that saying.
OUTSIDE = r"(?is)\bhowever,\s*this information is not (?:contained|present|available)\s+in\s+the\s+provided\s+documents\.?"
SAID_OUTSIDE = r"(?is)\b(?:documents?|context)\b.{0,120}\b(?:do\s+not|does\s+not|cannot|can't|not)\b.{0,120}\b(?:contain|include|cover|mention|provide)\b"
#: An opening that only hedges, what may come after it, and a heading sentence.
HEDGE = r"(?is)^\s*(?:(?:based on the provided text|the provided text)[^.]*\.\s*(?:[^.]*\.\s*){0,2}|(?:based on the provided text)[^.]*cannot[^.]*\.\s*)(?=(?:based on the available|from the available|however,|the following|[\*\-]\s|\d+\.\s))"
FOLLOWING = r"(?is)^\s*(?:the\s+)?following\s+[^:\n]{3,140}:\s*"
#: Beginnings of paragraphs about the scope of an answer.
SCOPE_NOTES = ["limitations of the provided text", "note on scope", "scope note"]
#: The rule below a table's head.
TABLE_RULE = r"^\s*\|(?:\s*:?-{3,}:?\s*\|)+\s*$"
#: The signs of line breaks, and the ends of a text that may need stripping.
BREAK_SIGNS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
FIRST_SIGNS = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
LAST_SIGNS = [*FIRST_SIGNS, "\x85", "\u2028", "\u2029"]
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """A step that needs its text more than once gets it through a lambda, so that it is computed once."""
    return F.transform(F.array(x), f)[0]


def holding(text: Column, signs: list[str], step: Callable[[Column], Column], lower: bool = False) -> Column:
    """The step for texts that hold one of the signs (of the lower-cased text, if asked for); others stay as they are.

    A step's patterns need one of its signs, and most texts have none: searching for them is far quicker than a pattern.
    """

    def guarded(x: Column) -> Column:
        low, found = F.lower(x) if lower else x, F.lit(False)
        for sign in signs:
            found = found | low.contains(sign)
        return F.when(found, step(x)).otherwise(x)

    return once(text, guarded)


def ends_stripped(text: Column) -> Column:
    """``stripped`` for texts with something to strip at an end."""
    return once(F.coalesce(text, F.lit("")), lambda x: F.when(F.substring(x, 1, 1).isin(FIRST_SIGNS) | F.substring(x, -1, 1).isin(LAST_SIGNS), stripped(x)).otherwise(x))


def without_thoughts(text: Column) -> Column:
    """Without reasoning in think tags (single or double brackets); an unclosed one reaches to the end, an unopened one to the start."""
    return ends_stripped(holding(text, ["think>"], _without_thoughts, lower=True))


def _without_thoughts(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?is)<{1,2}think>{1,2}.*?<{1,2}/think>{1,2}", "")
    text = F.regexp_replace(text, r"(?is)^.*</think>{1,2}", "")
    return F.regexp_replace(text, r"(?is)<{1,2}think>.*$", "")


def without_sources(text: Column) -> Column:
    def step(x: Column) -> Column:
        for pattern in SOURCE_MARKS:
            x = F.regexp_replace(x, pattern, "")
        return x

    return holding(text, ["source"], step, lower=True)


def without_scope_notes(text: Column) -> Column:
    """Paragraphs about the scope go; a heading of this kind without a colon takes the next paragraph along."""
    start = F.struct(F.expr("array()").cast("array<string>").alias("kept"), F.lit(False).alias("skip"))

    def step(state: Column, paragraph: Column) -> Column:
        body = F.lower(stripped(paragraph))
        note = F.lit(False)
        for words in SCOPE_NOTES:
            note = note | body.startswith(words)
        kept = F.when(state["skip"] | note, state["kept"]).otherwise(F.concat(state["kept"], F.array(paragraph)))
        return F.struct(kept.alias("kept"), (~state["skip"] & note & ~body.contains(":")).alias("skip"))

    def judged(x: Column) -> Column:
        low, found = F.lower(x), F.lit(False)
        for words in SCOPE_NOTES:
            found = found | low.contains(words)
        kept = F.aggregate(F.split(x, r"\n{2,}"), start, step, lambda state: F.array_join(state["kept"], "\n\n"))
        # without a note the paragraphs are only put together again
        return F.when(found, kept).otherwise(holding(x, ["\n\n\n"], lambda y: F.regexp_replace(y, r"\n{3,}", "\n\n")))

    return once(text, judged)


def without_torn_row(text: Column) -> Column:
    """Table rows cut off at the end go, if the table has the rule below its head."""
    lines = F.split(text, "\n")
    torn = lambda x: F.trim(x).startswith("|") & ~F.rtrim(x).endswith("|")
    place = F.transform(lines, lambda x, k: F.when((F.trim(x) != "") & ~torn(x), k).otherwise(-1))
    last = F.array_max(place)
    whole = text.contains("---") & F.exists(lines, lambda x: x.rlike(TABLE_RULE))
    return F.when(whole, F.array_join(F.filter(lines, lambda x, k: (k <= last) | ~torn(x)), "\n")).otherwise(text)


def display_answer(text: Column, request: Column | None = None) -> Column:
    """An answer without reasoning, source marks, labels, hedges and torn rows; null counts as empty.

    ``request`` is the question: one that asks for check boxes keeps them.
    """
    out = without_sources(without_thoughts(F.coalesce(text, F.lit(""))))
    boxes = lambda x: F.regexp_replace(x, TASK_BOX, "$1")
    if request is not None:
        boxes = lambda x: F.when(F.coalesce(request, F.lit("")).rlike(TASK_REQUEST), x).otherwise(F.regexp_replace(x, TASK_BOX, "$1"))
    out = holding(out, ["[ ]", "[x]", "[X]"], boxes)
    for sign, word in STATE_SIGNS.items():
        out = F.replace(out, F.lit(sign), F.lit(word))

    def unlabelled(x: Column) -> Column:
        for pattern in ANSWER_LABELS:
            x = F.regexp_replace(x, pattern, "$1")
        return x

    out = holding(out, ["answer"], unlabelled, lower=True)
    out = holding(out, ["however,"], lambda x: F.when(x.rlike(SAID_OUTSIDE), F.regexp_replace(x, OUTSIDE, "")).otherwise(x), lower=True)
    out = holding(out, ["<br", "<BR", "<Br", "<bR"], lambda x: F.regexp_replace(x, r"(?i)<br\s*/?>", "; "))
    out = holding(out, BREAK_SIGNS, lambda x: F.regexp_replace(x, BREAKS, "\n"))
    out = holding(out, ["  ", "\t"], lambda x: F.regexp_replace(x, r"(?<=[^ \t\n])[ \t]{2,}", " "))

    def unhedged(x: Column) -> Column:
        rest = F.regexp_replace(stripped(F.regexp_replace(x, HEDGE, "")), r"(?is)^however,\s*", "")
        return F.when(x.rlike(HEDGE) & (rest != ""), rest).otherwise(x)

    out = F.regexp_replace(once(out, unhedged), FOLLOWING, "")
    out = once(without_scope_notes(out), without_torn_row)
    return ends_stripped(holding(out, ["\n\n\n"], lambda x: F.regexp_replace(x, r"\n{3,}", "\n\n")))


def displayed(text: Column, request: Column | None = None) -> Column:
    """(text, reasoning_only): the answer for display, or the fallback where only reasoning was there."""
    shown = display_answer(text, request)
    empty = lambda x: (x == "") & F.lower(text).rlike("<{1,2}think>")
    return F.transform(F.array(shown), lambda x: F.struct(F.when(empty(x), F.lit(FALLBACK)).otherwise(x).alias("text"), empty(x).alias("reasoning_only")))[0]
