"""Markdown answers as blocks for display: text, code, tables, lists, quotes and notes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS = "array<struct<kind:string,text:string,language:string,columns:array<string>,rows:array<array<string>>,ordered:boolean,items:array<struct<text:string,level:int,checked:boolean>>>>"
FIELDS = ("kind", "text", "language", "columns", "rows", "ordered", "items")

#: What lines of each kind look like.
FENCE = re.compile(r"```\s*(?P<language>[\w+#.-]*)")
ITEM = re.compile(r"(?P<indent>\s*)(?:[-*+]|(?P<number>\d+[.)]))\s+(?P<body>.+)")
BOX = re.compile(r"\[(?P<state>[xX ])\]\s+(?P<body>.+)")
QUOTE = re.compile(r"\s*>\s?(?P<body>.*)")
NOTE = re.compile(r"\s*(?:#{1,6}\s*)?(?:\*\*)?\s*Disclaimer\s*:\s*(?P<body>.*?)\s*(?:\*\*)?\s*", re.IGNORECASE)
RULE = re.compile(r"\s*(?:-{3,}|\*{3,}|_{3,})\s*")
TABLE_RULE = re.compile(r"\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?")
CELL_ENDS = re.compile(r"((?:[^\\|]|\\.)*\\?)(?:\||$)")


def cells(line: str) -> list[str]:
    """Cells of a table row; a backslash takes the next sign as it is."""
    body = line.strip()
    body = body.removeprefix("|")
    body = body.removesuffix("|")
    found = [m[1] for m in CELL_ENDS.finditer(body)]
    if len(found) > 1 and not body.endswith("|"):
        found.pop()  # the empty match at the end
    return [re.sub(r"\\(.?)", r"\1", x).strip() for x in found]


def block(kind: str, **values) -> tuple:
    return tuple({"kind": kind, **values}.get(x) for x in FIELDS)


class Lines:
    """The lines of an answer, read one after another."""

    def __init__(self, lines: list[str]):
        self.lines, self.at = lines, 0

    def here(self, ahead: int = 0) -> str | None:
        return self.lines[self.at + ahead] if self.at + ahead < len(self.lines) else None

    def while_(self, holds) -> Iterator[str]:
        while (line := self.here()) is not None and holds(line):
            self.at += 1
            yield line


def code(lines: Lines) -> tuple:
    """Up to the closing fence, or to the end of the answer."""
    language = FENCE.match(lines.here().strip())["language"] or None
    lines.at += 1
    body = "\n".join(lines.while_(lambda x: not x.strip().startswith("```")))
    lines.at += 1
    return block("code", text=body, language=language)


def table(lines: Lines) -> tuple:
    """Rows as wide as the head, up to a line without a bar."""
    head = cells(lines.here())
    lines.at += 2
    rows = [cells(x)[: len(head)] for x in lines.while_(lambda x: "|" in x)]
    return block("table", columns=head, rows=[r + [""] * (len(head) - len(r)) for r in rows])


def entries(lines: Lines) -> tuple:
    """Items of one sort of list with their indented lines; an indented item of the other sort belongs to it, blank lines don't end it."""
    ordered = ITEM.fullmatch(lines.here())["number"] is not None
    items: list[list] = []
    while (line := lines.here()) is not None:
        item = ITEM.fullmatch(line)
        if item and not ((item["number"] is not None) != ordered and not item["indent"]):
            box = BOX.fullmatch(item["body"].strip())
            text = (box["body"] if box else item["body"]).strip()
            items.append([text, len(item["indent"]) // 2, box["state"] in "xX" if box else None])
        elif not item and line.strip() and line.startswith(" "):
            items[-1][0] += "\n" + line.strip()
        elif item or line.strip():
            break
        lines.at += 1
    return block("list", ordered=ordered, items=[tuple(x) for x in items])


def quote(lines: Lines) -> tuple | None:
    """Quoted lines, blank ones between them left out."""
    body = "\n".join(QUOTE.fullmatch(x)["body"] for x in lines.while_(lambda x: QUOTE.fullmatch(x) or not x.strip()) if x.strip()).strip()
    return block("quote", text=body) if body else None


def note(lines: Lines) -> tuple | None:
    """A disclaimer up to a blank line or another block, as one line."""
    first = NOTE.fullmatch(lines.here())["body"].strip().removeprefix("**").removesuffix("**").strip()
    lines.at += 1
    rest = lines.while_(lambda x: x.strip() and not ITEM.fullmatch(x) and not QUOTE.fullmatch(x) and not FENCE.match(x.strip()))
    parts = [x for x in [first, *(y.strip() for y in rest if not RULE.fullmatch(y))] if x]
    return block("callout", text=f"Disclaimer: {' '.join(parts)}") if parts else None


def starts(lines: Lines):
    """What reads the block that begins here; nothing for text."""
    line, after = lines.here(), lines.here(1)
    if FENCE.match(line.strip()):
        return code
    if after is not None and "|" in line and TABLE_RULE.fullmatch(after.strip()):
        return table
    return next((f for f, pattern in ((entries, ITEM), (quote, QUOTE), (note, NOTE)) if pattern.fullmatch(line)), None)


def display_blocks(answer: str | None) -> list[tuple]:
    """Blocks of an answer in order; a null or empty answer has none. Rules and blank lines before a disclaimer go."""
    lines, out, text = Lines((answer or "").splitlines()), [], []

    def flush() -> None:
        if body := "\n".join(text).strip("\n"):
            out.append(block("text", text=body))
        text.clear()

    while lines.here() is not None:
        read = starts(lines)
        if read is None:
            text.append(lines.here())
            lines.at += 1
            continue
        while read is note and text and (not text[-1].strip() or RULE.fullmatch(text[-1])):
            text.pop()
        flush()
        if (found := read(lines)) is not None:
            out.append(found)
    flush()
    return out


def blocks_of(answer: Column) -> Column:
    """The blocks of an answer as an array of structs."""

    @F.pandas_udf(BLOCKS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda x: [dict(zip(FIELDS, b, strict=True)) | {"items": None if b[6] is None else [dict(zip(("text", "level", "checked"), i, strict=True)) for i in b[6]]} for b in display_blocks(x)])

    return run(answer)
