"""Rules about what a passage is made of and how a file's name fits a question, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns (case ignored) of section names that hold no substance.
STRUCTURAL_SECTIONS = [
    r"\b(table\s+of\s+contents?|contents?)\b",
    r"\b(index|appendix|appendices|glossary)\b",
    r"\b(references?|bibliography|citations?)\b",
    r"\b(copyright|license|legal(?:\s+notice)?)\b",
    r"\b(acknowledg(?:e)?ments?)\b",
    r"\b(changelog|revision\s+history|release\s+notes?)\b",
    r"\b(title\s+page|cover\s+page|front\s+matter)\b",
]
#: Patterns (case ignored) of texts around a book, and how often a heading of this kind makes a list of chapters.
STRUCTURAL_TEXTS = [
    r"\*\*\*\s*start\s+of\s+the\s+project\s+gutenberg\s+ebook",
    r"\bproject\s+gutenberg\s+ebook\b",
    r"\bthis\s+ebook\s+is\s+for\s+the\s+use\s+of\s+anyone\b",
    r"\bother\s+information\s+and\s+formats?\b",
    r"\bcredits?:\b",
    r"\blanguage:\s*[A-Za-z]",
]
#: What each of these patterns needs, in lower case: most texts hold none of it.
SECTION_SIGNS = ["content", "index", "appendi", "glossary", "reference", "bibliography", "citation", "copyright", "license", "legal", "acknowledg", "changelog", "revision", "release", "title", "cover", "front"]
TEXT_SIGNS = ["ebook", "information", "credit", "language:"]
CHAPTER, CHAPTERS = r"\bchapter\s+[ivxlcdm0-9]+\b", 4
HEAD_CHARS = 1200
#: Penalties of a candidate, and what counts as a short text.
SECTION_PENALTY, BLOCK_PENALTY, TEXT_PENALTY, SHORT_PENALTY = 0.15, 0.08, 0.35, 0.04
SHORT_CHARS, SHORT_LINES = 180, 3
STRUCTURAL_BLOCKS = ["table", "form"]
#: Words of questions that say nothing about a title.
TITLE_STOPWORDS = [
    "a", "an", "and", "as", "at", "attachment", "by", "compare", "description", "describe", "document",
    "entry", "file", "for", "from", "give", "in", "is", "it", "item", "later", "material", "note", "of",
    "on", "or", "paper", "record", "source", "text", "the", "to", "vs", "versus", "what", "with",
]
#: Bonus for each word shared with a title and its limit, plain and strict; the strict penalty for none.
TITLE_BONUS, TITLE_MOST, STRICT_BONUS, STRICT_MOST, STRICT_PENALTY = 0.05, 0.20, 0.12, 0.50, 0.30
#: Lines of tables; from which share of them, and below how many characters or other lines, a text is all heading.
TABLE_ROW, TABLE_RULE = r"^\s*\|.*\|\s*$", r"^\s*\|[\s\-:]+\|\s*$"
HEADER_SHARE, HEADER_CHARS, HEADER_LINES, HEADER_LEAST = 0.7, 300, 3, 50


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def any_of(text: Column, patterns: list[str], signs: list[str]) -> Column:
    """One pass with all patterns, over texts that hold one of their signs: searching for these is far quicker."""
    low, held = F.lower(text), F.lit(False)
    for sign in signs:
        held = held | low.contains(sign)
    return F.when(held, text.rlike("(?i)" + "|".join(patterns))).otherwise(F.lit(False))


def structural_snippet(text: Column) -> Column:
    """Contents, licence heads and the like, judged by the first characters."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, HEAD_CHARS)
    return any_of(head, STRUCTURAL_TEXTS, TEXT_SIGNS) | (F.regexp_count(head, F.lit(f"(?i){CHAPTER}")) >= CHAPTERS)


def structural_penalty(text: Column, section: Column, block_type: Column) -> Column:
    """What a candidate loses: block, section, text around a book, list of chapters, shortness; each on its own."""
    body = stripped(text)
    head = F.substring(body, 1, HEAD_CHARS)
    lines = F.regexp_count(body, F.lit("\n")) + 1
    part = lambda condition, penalty: F.when(condition, penalty).otherwise(0.0)
    return (
        part(F.lower(stripped(block_type)).isin(STRUCTURAL_BLOCKS), BLOCK_PENALTY)
        + part(any_of(stripped(section), STRUCTURAL_SECTIONS, SECTION_SIGNS), SECTION_PENALTY)
        + part(any_of(head, STRUCTURAL_TEXTS, TEXT_SIGNS), TEXT_PENALTY)
        + part(F.regexp_count(head, F.lit(f"(?i){CHAPTER}")) >= CHAPTERS, TEXT_PENALTY)
        + part((body != "") & (F.length(body) < SHORT_CHARS) & (lines <= SHORT_LINES), SHORT_PENALTY)
    )


def title_terms(text: Column) -> Column:
    """Distinct words of three characters or more that may name a title; plurals also without their s."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9][a-z0-9'_-]{2,})"), F.lit(1)))
    terms = F.array_except(found, F.array(*map(F.lit, TITLE_STOPWORDS)))
    plural = F.filter(terms, lambda x: x.endswith("s") & (F.length(x) > 4))
    return F.array_union(terms, F.transform(plural, lambda x: F.substring(x, F.lit(1), F.length(x) - 1)))


def header_only(text: Column) -> Column:
    """Mostly table rows and rules, with little text or few other lines; too short a text can't tell."""
    body = stripped(text)
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    n = F.size(lines)
    tabular = F.size(F.filter(lines, lambda x: x.rlike(TABLE_ROW) | x.rlike(TABLE_RULE)))
    heads = (F.length(body) >= HEADER_LEAST) & (tabular > HEADER_SHARE * n) & ((F.length(text) < HEADER_CHARS) | (n - tabular < HEADER_LINES))
    # without a bar no line is tabular: such texts are not cut into lines (a branch, as Spark computes what repeats in a conjunction up front)
    return F.when(text.contains("|"), heads).otherwise(F.lit(False))
