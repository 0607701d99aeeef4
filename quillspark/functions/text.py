"""Text and value functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories of file extensions.
CATEGORIES = {
    ".pdf": "document", ".docx": "document", ".epub": "document", ".pptx": "document", ".txt": "plaintext", ".md": "plaintext", ".rst": "plaintext", ".log": "plaintext",
    ".json": "plaintext", ".yaml": "plaintext", ".yml": "plaintext", ".toml": "plaintext", ".csv": "data", ".xlsx": "data", ".html": "web", ".htm": "web",
}
#: Directory names that never become tags.
SYSTEM_DIRECTORIES = ["library", "applications", "system", "users", "home", ".git", ".venv", ".env", "node_modules", "__pycache__", "desktop", "documents", "downloads", "movies", "music", "pictures"]
#: Trace keys that hold such a word are redacted.
SENSITIVE_KEYS = "question|answer|content|prompt|chunk|source|message"
MAX_TRACE_CHARS = 8000
MAX_TAGS = 5
#: What a text that needs its glyphs cleaned holds: an end of ``GLYPH<``, white space that makes a line of its own
#: or a sign that goes; and the first bytes of U+E000 to U+FFFF in UTF-8.
GLYPH_SIGNS = ["h<", "h&", "H<", "H&", "\t", "\x0b", "\f", "\r", "\x85", "\u2028", "\u2029", "\u200b"]
GLYPH_BYTES = [bytearray(b"\xee"), bytearray(b"\xef")]
YEAR = r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"
REFUSALS = r"(?i)\b(i can(?:no|')t|i am unable|not able to|no information|cannot find)\b"


def extension_of(path: Column) -> Column:
    """Lower-case extension with its dot, or empty."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def normalised_extension(extension: Column) -> Column:
    x = F.lower(F.trim(extension))
    return F.when(x == "", "").when(x.startswith("."), x).otherwise(F.concat(F.lit("."), x))


def category_of(extension: Column) -> Column:
    out = F
    for name, category in CATEGORIES.items():
        out = out.when(extension == name, category)
    return out.otherwise("other")


def year_of(*sources: Column) -> Column:
    """First year 1900-2099 between non-digits, in the first source that holds one."""
    return F.coalesce(*(F.expr("int(null)") if x is None else F.regexp_extract(x, YEAR, 1).try_cast("int") for x in sources))


def tags_of(path: Column) -> Column:
    """Up to five distinct directory names, lower-case, with spaces and hyphens as underscores; names of one character and
    system directories are left out."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(path), r"[^/]*$", ""), "/"), lambda x: (F.length(x) > 1) & ~x.isin(SYSTEM_DIRECTORIES))
    return F.slice(F.array_distinct(F.transform(parts, lambda x: F.translate(x, " -", "__"))), 1, MAX_TAGS)


def normalised_path(path: Column) -> Column:
    """Absolute path without empty, ``.`` and ``..`` parts."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    up = F.aggregate(parts, F.expr("cast(array() as array<string>)"), lambda held, x: F.when(x == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.array_append(held, x)))
    return F.concat(F.lit("/"), F.array_join(up, "/"))


def safe_number(value: Column, default: float | int, kind: str = "long") -> Column:
    """The value as a number, or the default where it is none."""
    return F.coalesce(F.trim(value.cast("string")).try_cast(kind), F.lit(default).cast(kind))


def term_text(text: Column) -> Column:
    """Normal form of terms: lower case, other characters than letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\w]+|_+", " "))


def tokens(text: Column) -> Column:
    """Distinct lower-case words in order."""
    return F.array_distinct(F.array_remove(F.split(term_text(text), " +"), ""))


def like_pattern(search: str, escape: bool = True) -> str:
    """``%search%``, with ``\\``, ``%`` and ``_`` taken literally if asked for."""
    if escape:
        search = search.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%{search}%"


def clean_glyphs(text: Column) -> Column:
    """Without ``GLYPH<..>`` remains, private-use characters and lines of replacement signs only; most texts hold none of these
    and are only searched for the signs in question, which is far quicker than the patterns."""
    found = F.regexp_replace(text, r"(?i)GLYPH[<&][^>;\s]*[>;]?", "")
    found = F.regexp_replace(found, r"[\x{E000}-\x{F8FF}\x{200B}\x{FEFF}]", "")
    lines = F.filter(F.split(found, "\n"), lambda x: ~x.rlike(r"^[\x{FFFD}\s]+$") | (F.trim(x) == ""))
    suspect = ~F.is_valid_utf8(text)
    for sign in GLYPH_SIGNS:
        suspect = suspect | text.contains(sign)
    for byte in GLYPH_BYTES:
        suspect = suspect | F.contains(text.cast("binary"), F.lit(byte))
    return F.when(suspect, F.array_join(lines, "\n")).otherwise(text)


def unglue_numbers(text: Column) -> Column:
    """Runs of digits that a scan has glued: 10 or 11 digits part after six, 13 and more after seven."""
    text = F.regexp_replace(text, r"(?<![0-9])([0-9]{6})([0-9]{4,5})(?![0-9])", "$1 $2")
    return F.regexp_replace(text, r"(?<![0-9])([0-9]{7})([0-9]{6,})(?![0-9])", "$1 $2")


def confidence_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.65, "medium").otherwise("low")


def ocr_token(token: Column) -> Column:
    """0 and 1 read as o and l in words of five characters and more that mix letters with digits."""
    mixed = (F.length(token) >= 5) & token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    return F.when(mixed, F.translate(token, "01", "ol")).otherwise(token)


def near_word(a: Column, b: Column, distance: int = 1) -> Column:
    return F.levenshtein(a, b, distance) != -1


def variants(word: Column) -> Column:
    """The word, and the word without each of its characters: words one edit apart share one."""
    cut = lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, F.length(word)))
    return F.array_distinct(F.array_append(F.transform(F.sequence(F.lit(1), F.length(word)), cut), word))


def numeric_value(token: Column) -> Column:
    """Number of ``(1,234.5)``, ``$12``, ``7%`` and the like; bare years give null."""
    bare = F.regexp_replace(token, r"[$€£,%\s()]", "")
    value = bare.try_cast("double")
    value = F.when(token.rlike(r"^\s*\(.*\)\s*$"), -value).otherwise(value)
    return F.when(token.rlike(r"^\s*(19|20)[0-9]{2}\s*$"), None).otherwise(value)


def numeric_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\(?[$€£]?[0-9][0-9,]*(?:\.[0-9]+)?%?\)?"), F.lit(0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"[.!?]\s+"), lambda x: F.trim(x) != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def token_count(text: Column) -> Column:
    """Stand-in for a subword tokenizer's count: words and punctuation marks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\w+|[^\w\s]"))


def limit_words(text: Column, n: int) -> Column:
    """At most n words, cut back to the last sentence end among them if there is one."""
    head = F.regexp_extract(text, rf"^(?:\s*\S+){{0,{n}}}", 0)
    whole = F.regexp_extract(head, r"^([\s\S]*[.!?])(?:\s|$)", 1)
    # looks no further than the word behind the last that may stay
    more = text.rlike(rf"\A\s*+(?:\S++\s++){{{n}}}+\S")
    return F.when(~F.coalesce(more, F.lit(False)), text).when(whole != "", whole).otherwise(head)


def chat_title(text: Column, n: int = 50) -> Column:
    """First line without Markdown headings, links, decorators and list signs, at most n characters and three dots; null if
    nothing is left of it."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    raw = strip(F.split(text, "\n", 2)[0])
    line = F.regexp_replace(raw, r"^\s{0,3}#{1,6}\s+", "")
    for pattern, put in ((r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"[*_`~]+", ""), (r"^\s*[-+*>\s]+", ""), (r"\s+", " ")):
        line = F.regexp_replace(line, pattern, put)
    # lambdas name what is used more than once, as branches would compute it again
    once = lambda x, f: F.transform(F.array(x), f)[0]
    line = once(strip(line), lambda x: F.when(x != "", x).otherwise(raw))
    return once(line, lambda x: F.when(x == "", None).when(F.length(x) > n, F.concat(strip(F.substring(x, 1, n)), F.lit("..."))).otherwise(x))


def answer_signals(answer: Column) -> Column:
    """Whether an answer has Markdown, a list, a table, and its words; null counts as empty."""
    text = F.coalesce(answer, F.lit(""))
    return F.struct(text.rlike(r"[#*\[\]`]").alias("has_markdown"), text.rlike(r"(?m)^\s*[-*\x{2022}]|\d+\.").alias("has_list"), text.rlike(r"\|.*\|").alias("has_table"), word_count(text).alias("word_count"))


def redact_numbers(text: Column) -> Column:
    """Social-security-like numbers masked."""
    return F.regexp_replace(text, r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[redacted]")


def incomplete_reason(text: Column) -> Column:
    """Why an answer looks cut off, or null."""
    last = F.element_at(F.split(F.rtrim(text), "\n"), -1)
    return F.when(F.trim(text) == "", "empty").when(F.regexp_count(text, F.lit("```")) % 2 == 1, "open_code_block").when(last.rlike(r"^\s*(?:[-*]|[0-9]+\.)\s*$"), "dangling_list_item").when(last.rlike(r"[,;:]\s*$"), "trailing_separator")


def parsed_timestamp(text: Column) -> Column:
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd"]
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(x)) for x in forms))


def json_strings(text: Column) -> Column:
    """JSON array of strings; anything else gives an empty array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.expr("array()").cast("array<string>"))


def event_id(*parts: Column, bucket_seconds: int = 60, created_at: Column) -> Column:
    """16 hex digits over the parts and the time bucket."""
    bucket = F.floor(F.unix_timestamp(created_at) / bucket_seconds).cast("string")
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(x, F.lit("")) for x in parts), bucket), 256), 1, 16)


def redacted(value: Column, key: Column, mode: str) -> Column:
    """Trace strings: cut at ``MAX_TRACE_CHARS``; those of sensitive keys cut to 500 characters (minimal) or to their length
    (strict)."""
    size = F.length(value).cast("string")
    plain = F.when(F.length(value) > MAX_TRACE_CHARS, F.concat(F.substring(value, 1, MAX_TRACE_CHARS), F.lit("... (truncated)"))).otherwise(value)
    brief = F.when(F.length(value) > 500, F.concat(F.substring(value, 1, 500), F.lit("... [REDACTED_TAIL length="), size, F.lit("]"))).otherwise(value)
    hidden = {"off": plain, "minimal": brief, "strict": F.concat(F.lit("[REDACTED length="), size, F.lit("]"))}[mode]
    return F.when(F.lower(F.trim(key)).rlike(SENSITIVE_KEYS), hidden).otherwise(plain)


def scan_timeout(size_bytes: Column, base: float = 90, per_mib: float = 22, least: float = 30, most: float = 600) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.lit(base) + F.lit(per_mib) * size_bytes / F.lit(1048576.0)))


def longest_line(text: Column) -> Column:
    return F.array_max(F.transform(F.split(text, "\n"), F.length))


def html_to_text(html: Column) -> Column:
    """Text of a page by expressions only: scripts and styles dropped, a line per block element."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?i)</?(p|div|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|br|blockquote|pre|title)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " "))), lambda x: x != "")
    return F.array_join(lines, "\n")
