"""Display blocks: goldens of every kind, and conservation of words over the given chats and documents."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.functions import blocks
from quillspark.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def shown(answer):
    return [{k: v for k, v in zip(blocks.FIELDS, b, strict=True) if v is not None} for b in blocks.display_blocks(answer)]


def item(text, level=0, checked=None):
    return (text, level, checked)


GOLDENS = [
    (None, []), ("", []), ("\n\n", []),
    ("Plain\n\ntext", [{"kind": "text", "text": "Plain\n\ntext"}]),
    ("a\n```python\nx = 1\n\n- y\n```\nb", [{"kind": "text", "text": "a"}, {"kind": "code", "text": "x = 1\n\n- y", "language": "python"}, {"kind": "text", "text": "b"}]),
    ("```\nopen", [{"kind": "code", "text": "open"}]),
    ("| A | B |\n|---|:-:|\n", [{"kind": "text", "text": "| A | B |\n|---|:-:|"}]),
    ("Before\n| A | B \\| C |\n|---|:---:|\n| 1 | 2 | 3 |\n| 4 |\n\nAfter", [{"kind": "text", "text": "Before"}, {"kind": "table", "columns": ["A", "B | C"], "rows": [["1", "2"], ["4", ""]]}, {"kind": "text", "text": "After"}]),
    ("A | B\n--- | ---\nx | y", [{"kind": "table", "columns": ["A", "B"], "rows": [["x", "y"]]}]),
    ("- one\n  more\n\n- two\n    * deep\n1. other", [{"kind": "list", "ordered": False, "items": [item("one\nmore"), item("two"), item("deep", 2)]}, {"kind": "list", "ordered": True, "items": [item("other")]}]),
    ("1) a\n   - nested\n2. b\nend", [{"kind": "list", "ordered": True, "items": [item("a"), item("nested", 1), item("b")]}, {"kind": "text", "text": "end"}]),
    ("* [ ] open\n* [X] done", [{"kind": "list", "ordered": False, "items": [item("open", 0, False), item("done", 0, True)]}]),
    ("> q1\n\n>q2\nend\n> ", [{"kind": "quote", "text": "q1\nq2"}, {"kind": "text", "text": "end"}]),
    ("Body\n\n---\n**Disclaimer: not advice**\nmore of it\n\nrest", [{"kind": "text", "text": "Body"}, {"kind": "callout", "text": "Disclaimer: not advice more of it"}, {"kind": "text", "text": "rest"}]),
    ("## Disclaimer:\n\nx", [{"kind": "text", "text": "x"}]),
    ("disclaimer: a\n- item", [{"kind": "callout", "text": "Disclaimer: a"}, {"kind": "list", "ordered": False, "items": [item("item")]}]),
]


@pytest.mark.parametrize("answer, want", GOLDENS)
def test_goldens(answer, want):
    assert shown(answer) == want


def test_cells():
    for line, want in (("| a | b |", ["a", "b"]), ("a|b", ["a", "b"]), ("||", [""]), ("| a || b |", ["a", "", "b"]), ("a \\| b | c\\\\", ["a | b", "c\\"]), ("|x|", ["x"]), ("", [""])):
        assert blocks.cells(line) == want, line


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")
def test_all_words_are_shown(spark):
    rows = catalog.corpus.chat_messages(spark, FOLDER).select("content").union(catalog.corpus.table(spark, FOLDER, "documents").select("text"))
    for text, found in rows.select("content", blocks.blocks_of(F.col("content")).alias("b")).collect():
        words = []
        for b in found:
            words += re.findall(r"\w+", " ".join([b.text or "", *(b.columns or []), *(c for r in b.rows or [] for c in r), *(i.text for i in b["items"] or [])]))
        plain = re.sub(r"(?m)^\s*(?:\d+[.)]|[-*+])\s+(?:\[[xX ]\]\s+)?(?=\S)|^\s*>", " ", text or "")
        if "```" not in (text or "") and "|" not in (text or "") and "isclaimer" not in (text or ""):
            assert sorted(words) == sorted(re.findall(r"\w+", plain))
