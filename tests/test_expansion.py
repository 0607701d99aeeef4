"""Expansion of questions: order, tiers, gates, near words and caps."""

import re

from quillspark.operators import expansion, terms


def expand(spark, questions, aliases):
    q = spark.createDataFrame(list(enumerate(questions)), "query_id int, query string")
    a = spark.createDataFrame(aliases, "alias string, canonical string, term_type string, confidence double")
    return {r.query_id: r for r in expansion.expanded(q, a).collect()}, {(r.query_id, r.alias): (r.how, r.place) for r in expansion.matched_terms(q, a).collect()}


def test_expansion(spark):
    aliases = [
        ("Annual Report", "AR", "org", 0.9), ("report", "Report", "term", 0.9), ("budget", "Budget", "term", 0.7), ("plan", "Plan", "term", 0.6), ("Ada Lovelace", "Ada L.", "person_name", 0.95), ("ada", "Ada L.", "person_name", 0.95),
        ("is", "IS", "term", 0.99), ("item", "Item", "term", 0.99), ("it", "IT", "term", 0.9), ("revenue", "Revenue", "term", 0.9), ("revenues", "REVENUE", "term", 0.9), ("profit", "Profit", "term", 0.9), ("income", "Income", "term", 0.9), ("costs", "Costs", "term", 0.7), ("", "x", "term", 0.9), ("asset", " ", "term", 0.9),
    ]
    questions = ["What is in the annual report: BUDGET, plan or item", "Ada Lovelace and ada", "which people mention Ada Lovelace", "revenu of the cost", "revenua profif incame", "pr0fit annual  report-s", "", None, "pr0f1t"]
    rows, matches = expand(spark, questions, aliases)
    assert {k: v for k, v in matches.items() if k[0] == 0} == {(0, "annual report"): ("phrase", 1), (0, "budget"): ("exact", 2), (0, "report"): ("exact", 3)}
    assert rows[0].embedding_query == questions[0] + " AR Report" and rows[0].fts_query == questions[0] + " AR Budget Report"
    assert rows[1].n_matches == 0 and rows[1].embedding_query == questions[1]
    assert {a: h for (q, a), (h, _) in matches.items() if q == 2} == {"ada lovelace": "phrase", "ada": "exact"} and rows[2].fts_query == questions[2] + " Ada L."
    assert {a: h for (q, a), (h, _) in matches.items() if q == 3} == {"revenue": "fuzzy"}  # costs is of medium tier
    # the two longest of three near words; revenues and revenue are one term
    assert {a for (q, a), _ in matches.items() if q == 4} == {"revenues", "income"} or {a for (q, a), _ in matches.items() if q == 4} == {"revenue", "income"}
    assert {a: h for (q, a), (h, _) in matches.items() if q == 5} == {"profit": "fuzzy", "annual report": "phrase", "report": "exact"}
    assert rows[6].embedding_query == "" and rows[7].n_matches == 0 and not [1 for q, _ in matches if q in (6, 7)]
    assert matches[8, "profit"][0] == "fuzzy"


def test_caps(spark):
    aliases = [(f"termword{chr(97 + k)}", f"T{k:02}", "term", 0.9 if k % 2 else 0.7) for k in range(26)]
    question = " ".join(a for a, *_ in aliases)
    rows, _ = expand(spark, [question], aliases)
    assert len(rows[0].fts_query.split()) == 26 + 10 and len(rows[0].embedding_query.split()) == 26 + 6 and rows[0].n_matches == 26


def test_routing(spark):
    aliases = [("annual report", "AR", "org", 0.9), ("report", "AR", "term", 0.9), ("it", "IT", "term", 0.9), ("budget", "Budget", "term", 0.7), ("ada", "Ada", "person_name", 0.9), *((f"word{x}", f"W{x}", "term", 0.9) for x in "abcde")]
    q = spark.createDataFrame([(0, "Annual report on it, the budget and Ada"), (1, "worde wordd wordc wordb worda"), (2, "nothing"), (3, None), (4, "list people: ada")], "query_id int, query string")
    a = spark.createDataFrame(aliases, "alias string, canonical string, term_type string, confidence double")
    got = {r.query_id: r for r in expansion.routed(q, a).collect()}
    assert {k: r.terms for k, r in got.items()} == {0: ["AR", "IT"], 1: ["Wa", "Wb", "Wc", "Wd"], 2: [], 3: [], 4: ["Ada"]}
    assert got[0].expanded_query.endswith("Ada AR IT") and got[2].expanded_query == "nothing"


def test_dictionary_is_computed_once(spark):
    """Phrases, words and near words share one pass over the dictionary, however it comes about."""
    for expand in (terms.expanded_queries, expansion.expanded):
        seen = spark.sparkContext.accumulator(0)

        def counted(x, seen=seen):
            seen.add(1)
            return (x, x.upper(), "term", 0.9)

        q = spark.createDataFrame([(0, "revenue of the annuel report")], "query_id int, query string")
        a = spark.createDataFrame(spark.sparkContext.parallelize(["revenue", "annual", "annual report"], 1).map(counted), "alias string, canonical string, term_type string, confidence double")
        assert expand(q, a).collect() and seen.value == 3


def test_vocabulary_of_many_chunks(spark):
    """Words that files share, repeat and part over chunks; a row per file and word doesn't leave a task."""
    rows = [(f, f"Alpha beta{c}\nalpha; {'gamma' if f == 1 else ''}" if c else None) for f in (0, 1, 2, None) for c in range(3)]
    out = terms.document_terms(spark.createDataFrame(rows, "file_id long, content string"))
    assert {r.norm: (r.n_seen, r.n_files) for r in out.collect()} == {"alpha": (16, 4), "beta1": (4, 4), "beta2": (4, 4), "gamma": (2, 1)}
    assert not re.search(r"hashpartitioning\(norm#\d+L?, file_id", out._jdf.queryExecution().executedPlan().toString())
