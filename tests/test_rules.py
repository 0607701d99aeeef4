"""Rules for passages, titles and answers: every pattern, on small frames."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import answers, rules, text
from quillspark.operators import gates, retrieval


def each(spark, f, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.v for r in rows.select("k", f(F.col("t")).alias("v")).orderBy("k").collect()]


def test_structural_snippets(spark):
    yes = ["*** START of the  Project Gutenberg eBook X", "the Project Gutenberg EBook of Y", "This ebook is for the use of anyone", "Other information and format", "Credits:someone", "Language: English", "CHAPTER I\nchapter 2\nChapter iv\nchapter X", "x" * 1100 + " credits:y"]
    no = ["Table of contents", "chapter one chapter two chapter three chapter four", "chapter 1 chapter 2 chapter 3", "x" * 1300 + " credits:y", "credits: y", "", None, "discredits: no", "language: 5"]
    assert each(spark, rules.structural_snippet, yes) == [True] * len(yes)
    assert each(spark, rules.structural_snippet, no) == [False] * len(no)


def test_structural_penalties(spark):
    long = "word " * 60
    cases = [
        (long, "Body", "narrative", 0), (long, "Table of Contents", None, 0.15), (long, "II > Legal notice", " TABLE ", 0.23), (long, "appendices", "form", 0.23), (long, "revision  history", "", 0.15),
        ("short", None, None, 0.04), ("a\nb\nc\nd", "", "", 0), ("", "Index", "form", 0.23), (None, None, None, 0), (f"credits:{long} chapter 1 chapter 2 chapter 3 chapter 4", "Glossary", "table", 0.93),
        (f"   credits:{'y' * 190}", "Title Page", "text", 0.5), (long, "indexes", "text", 0),
    ]
    rows = spark.createDataFrame([(k, *c[:3], float(c[3])) for k, c in enumerate(cases)], "k int, t string, s string, b string, want double")
    got = rows.select("k", F.round(rules.structural_penalty(F.col("t"), F.col("s"), F.col("b")), 6).alias("v")).orderBy("k").collect()
    assert [r.v for r in got] == [pytest.approx(c[3]) for c in cases]


def test_title_terms(spark):
    got = each(spark, lambda c: F.sort_array(rules.title_terms(c)), ["Compare the Reports of 2019 vs. Tom's-Notes.pdf", "a an IT", None, "glass bus classes"])
    assert got == [sorted(["reports", "report", "2019", "tom's-notes", "tom's-note", "pdf"]), [], [], sorted(["glass", "glas", "bus", "classes", "classe"])]


CANDIDATES = "query_id int, chunk_id int, file_id int, filename string, query string, content string, section string, block_type string, score double, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(q, c, f, name, ask, text, None, None, s, c) for q, c, f, name, ask, text, s in rows], CANDIDATES)


def test_title_bias_and_focus(spark):
    long = "word " * 60
    ask = "Describe the annual reports"
    rows = frame(spark, [
        (1, 1, 1, "annual report 2020.pdf", ask, long, 0.1), (1, 2, 2, "report.pdf", ask, long, 0.3), (1, 3, 3, "other.pdf", ask, long, 0.2), (1, 4, None, "annual reports.pdf", ask, long, 0.0),
        (2, 5, 1, "x.pdf", ask, long, 0.5), (2, 6, 2, "y.pdf", ask, long, 0.6), (3, 7, 1, "zzz.pdf", ask, "credits:x", 0.5), (4, 8, 1, "annual.pdf", "what is it", long, 0.5), (4, 9, 1, "annual.pdf", None, long, 0.5),
    ])
    score = lambda df: {r.chunk_id: (round(r.score, 6), r.new_rank) for r in df.collect()}
    assert score(retrieval.title_bias(rows)) == {1: (0.2, 2), 2: (0.35, 1), 3: (0.2, 3), 4: (0.15, 4), 5: (0.5, 2), 6: (0.6, 1), 7: (0.5, 1), 8: (0.5, 1), 9: (0.5, 2)}
    assert score(retrieval.title_bias(rows, strict=True)) == {1: (0.34, 3), 2: (0.42, 1), 3: (-0.1, 4), 4: (0.36, 2), 5: (0.5, 2), 6: (0.6, 1), 7: (0.5, 1), 8: (0.5, 1), 9: (0.5, 2)}
    assert {r.chunk_id for r in gates.title_focus(rows).collect()} == {1, 5, 6, 7, 8, 9}
    assert score(retrieval.substantive_bias(rows))[7] == (0.5, 1)  # a single candidate is left alone


def test_structural_filter(spark):
    rows = [(1, k, k, "f", "q", "credits:x" if k % 2 else "body", 0.1) for k in range(20)] + [(2, 100 + k, k, "f", "q", "credits:x" if k % 2 else "body", 0.1) for k in range(14)] + [(3, 200, 1, "f", "q", "credits:x", 0.1)]
    got = {r.chunk_id for r in gates.without_structural(frame(spark, rows), 3).collect()}
    assert got == {*range(0, 20, 2), *range(100, 114), 200}


def test_header_only(spark):
    head = "| Name | Value | Unit |\n|------|:----:|---|\n| Other | Column | More |"
    got = each(spark, rules.header_only, [head, "| a |\n|---|", None, "", head + "\nThis line says something of the table", "plain " * 20, head + "\n" + "\n".join(f"line {k}" for k in range(9)), "\n".join(f"| row {k} | with some text in it |" for k in range(20)), "\n".join([f"| row {k} | with some text in it |" for k in range(20)] + ["a b", "c d", "e f"])])
    assert got == [True, False, False, False, True, False, False, True, False]


ANSWERS = {
    "<think>secret</think>Shown (Source 1)\nSources: 1": "Shown",
    "Begins.\n<think>never closed": "Begins.",
    "<<think>>inner</think>>Outer": "Outer",
    "left over</think>Kept": "Kept",
    "One<br/>Two [source: 2]\nsource 2, source 3": "One; Two",
    "As told (sources 1, 2) and (source 1, source 4).": "As told  and .".replace("  ", " "),
    "| F | V |\n|---|:---:|\n| A | 10 |\n| B | 20": "| F | V |\n|---|:---:|\n| A | 10 |",
    "| F | V |\n| B | 20": "| F | V |\n| B | 20",
    "| F | V |\n|---|---|\n| A | 1 |\n| B | 2\n\n| C": "| F | V |\n|---|---|\n| A | 1 |",
    "Answer: It was 1776.": "It was 1776.",
    "Not said.\n\n**Answer:** 1776.": "Not said.\n\n1776.",
    "The documents do not contain it.\n\n**Answer**: It was so. However, this information is not present in the provided documents.": "The documents do not contain it.\n\nIt was so.",
    "It was so. However, this information is not present in the provided papers.": "It was so. However, this information is not present in the provided papers.",
    "Based on the provided text, no summary is there. However, the following points can be made:\n\n- First.": "- First.",
    "The following things are listed here:\n1. One": "1. One",
    "Body.\n\nLimitations of the Provided Text\nSome chapters lack.\n\nNote on scope: two works.\n\nEnd.": "Body.\n\nEnd.",
    "Body.\n\nScope note\n\nThis one goes too.\n\nNote on Scope\n\nAnd this.\n\nEnd.": "Body.\n\nEnd.",
    "- [ ] Look\n* [x] Done\n1. [X] Written": "- Look\n* Done\n1. Written",
    "✅ done ❌ not ⚠️ beware ✔️": "Yes done No not Warning beware Yes",
    "a   b\n    code   here\n\n\n\nend": "a b\n    code here\n\nend",
    "": "",
    None: "",
}


def test_answers_need_few_patterns(spark):
    """Every pattern stands behind its sign, and the limit of words looks no further than it must."""
    plan = lambda f: spark.range(1).select(f(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString().lower()
    assert plan(answers.display_answer).count("contains(") >= 12 and "regexp_count" not in plan(lambda c: text.limit_words(c, 50))
    seen = ["", " ", "a", "a b", "a b ", " a b c", "a. b c", None, "a\tb\n\nc d", "a b\x85c d"]
    assert each(spark, lambda c: text.limit_words(c, 2), seen) == ["", " ", "a", "a b", "a b ", " a b", "a.", None, "a\tb", "a b\x85c"]
    odd = {"End.\x85": "End.", " \x85a": "a", "a \u2028": "a", "\na\n\n\n\nb\t": "a\n\nb", "a<BR >b\x1dc": "a; b\nc", "<THINK>no</THINK> [X] yes": "[X] yes", "- [X] \tyes": "- yes", "A\n\n\nSCOPE NOTE: no\n\n\nB": "A\n\nB"}
    assert each(spark, answers.display_answer, list(odd)) == list(odd.values())


def test_display_answers(spark):
    assert each(spark, answers.display_answer, list(ANSWERS)) == list(ANSWERS.values())
    rows = spark.createDataFrame([("- [ ] Look", "Make a checklist with checkboxes"), ("- [ ] Look", "todo list please"), ("- [ ] Look", None)], "a string, q string")
    assert [r[0] for r in rows.select(answers.display_answer(F.col("a"), F.col("q"))).collect()] == ["- [ ] Look", "- [ ] Look", "- Look"]
    got = each(spark, answers.displayed, ["<think>only</think>", "text", " "])
    assert [tuple(r) for r in got] == [(answers.FALLBACK, True), ("text", False), ("", False)]


def test_signs_of_patterns(spark):
    """Every pattern holds one of the signs that are searched for first, in any case of its letters."""
    sections = ["TABLE  of content", "Contents", "INDEX", "Appendix A", "appendices", "glossaRy", "Reference", "references", "Bibliography", "CITATION", "citations", "Copyright", "licensE", "legal", "Legal Notice", "Acknowledgments", "acknowledgement", "ChangeLog", "Revision\thistory", "release note", "Title Page", "COVER page", "front  matter"]
    heads = ["*** Start of the project Gutenberg EBOOK", "PROJECT gutenberg ebook", "this EBOOK is for the use of anyone", "Other INFORMATION and formats", "CREDITS:x", "credit:y", "LANGUAGE: e"]
    for texts, patterns, signs in ((sections, rules.STRUCTURAL_SECTIONS, rules.SECTION_SIGNS), (heads, rules.STRUCTURAL_TEXTS, rules.TEXT_SIGNS)):
        assert each(spark, lambda c, p=patterns, s=signs: rules.any_of(c, p, s), [*texts, "none of them", "İ"]) == [True] * len(texts) + [False] * 2


def test_penalty_is_no_branch(spark):
    """What a candidate loses is computed once a row, below the count of candidates, not within the branch on that count."""
    rows = frame(spark, [(1, 1, 1, "a.pdf", "a", "credits:x", 0.1)])
    plan = retrieval.substantive_bias(rows)._jdf.queryExecution().optimizedPlan()
    branches = [str(x) for x in plan.toString().split("\n") if "> 1)" in x]
    assert branches and not any("credits" in x or "regexp_replace" in x for x in branches)
