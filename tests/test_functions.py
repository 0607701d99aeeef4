import re

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import vectors as V
from quillspark.operators import changes, chunking, filters, gates, stats, terms
from quillspark.sources import corpus
from quillspark.streaming import events


def one(spark, f, *values):
    names = [f"c{k}" for k in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(f(*map(F.col, names)).alias("x")).first().x


def test_text(spark):
    assert one(spark, T.year_of, "report_2021.pdf") == 2021 and one(spark, T.year_of, "120211.pdf") is None
    assert one(spark, T.term_text, "  A-b  Ç_x ") == "a b ç x"
    assert one(spark, T.numeric_value, "(1,234.5)") == -1234.5 and one(spark, T.numeric_value, "2020") is None
    assert one(spark, T.ocr_token, "f1oor0") == "flooro" and one(spark, T.ocr_token, "2020") == "2020"
    assert one(spark, T.unglue_numbers, "1234567890") == "123456 7890" and one(spark, T.unglue_numbers, "123") == "123"
    assert one(spark, T.chat_title, "## **Hello** world\nmore") == "Hello world"
    assert one(spark, T.incomplete_reason, "a\n```\nb") == "open_code_block" and one(spark, T.incomplete_reason, "Done.") is None
    assert one(spark, lambda c: T.limit_words(c, 4), "One two. three four five") == "One two."
    assert one(spark, T.html_to_text, "<p>a &amp; b</p><script>x</script><div>c</div>") == "a & b\nc"
    assert one(spark, T.json_strings, '["a"]') == ["a"] and one(spark, T.json_strings, "oops") == []
    assert one(spark, T.clean_glyphs, "aGLYPH<12>bc​") == "abc"
    assert one(spark, lambda a, b: T.near_word(a, b), "abc", "abd") and not one(spark, lambda a, b: T.near_word(a, b), "abc", "xyz")
    assert one(spark, T.parsed_timestamp, "2024-01-02T03:04:05") is not None


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0]), (4, [0.0, 0.0])], "id int, v array<float>")
    got = {r.id: r.d for r in rows.select("id", V.cosine_distance(F.col("v"), [3.0, 0.0]).alias("d")).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: None, 4: None}


def test_ignore_patterns_and_scan(spark, tmp_path):
    (tmp_path / "a" / "skip").mkdir(parents=True)
    for name, body in (("a/x.txt", b"hello"), ("a/skip/y.txt", b"no"), ("a/skip/keep.txt", b"yes"), ("a/e.txt", b""), ("a/p.html", b"<p>t</p>"), ("a/b.bin", b"\x00"), ("a/bad.txt", b"\xff\xfe")):
        (tmp_path / name).write_bytes(body)
    rows = corpus.extracted_text(corpus.scan_folder(spark, [str(tmp_path)], [".txt", ".html"], ["skip/", "!**/keep.txt"]))
    got = {r.filename: (r.text, r.error) for r in rows.collect()}
    assert got == {"x.txt": ("hello", None), "keep.txt": ("yes", None), "p.html": ("t", None), "bad.txt": (None, "charset")}


def test_cursor_and_caps(spark):
    assert filters.decode_cursor(filters.encode_cursor("2024-01-01", 7)) == ("2024-01-01", 7) and filters.decode_cursor("??") is None
    rows = spark.range(10).withColumn("t", F.lit("x" * 20))
    assert filters.byte_capped(rows, ["id"], 3 * len('{"id":0,"t":""}') + 60).count() == 3


def test_upserts(spark):
    known = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, None), (3, "c", "z")], "k int, v string, w string")
    got = sorted(tuple(r) for r in changes.upserted(known, new, ["k"], ["v"]).collect())
    assert got == [(1, "a", "x"), (2, "b", None), (3, "c", "z")]


def test_repairs_leave_no_faults(spark):
    files = spark.createDataFrame([(1, "p", "n", ".t", "c", 2000), (2, "q", "m", ".t", "c", None)], "id long, path string, filename string, extension string, category string, year int")
    chunks = spark.createDataFrame([(10, 1, None), (11, 1, 10), (12, 1, 999), (13, 999, None)], "id long, file_id long, parent_id long")
    vectors = spark.createDataFrame([(11, 1, "old", "n", ".t", "c", 2000), (999, 1, "p", "n", ".t", "c", 2000), (11, 999, "p", "n", ".t", "c", 2000)], "chunk_id long, file_id long, path string, filename string, extension string, category string, year int")
    before = {r.check_name: r.n for r in changes.integrity_checks(files, chunks, vectors).collect()}
    assert before["orphan_chunks"] == 1 and before["missing_parent"] == 1 and before["files_without_chunks"] == 1 and before["drift_path"] >= 1
    after = changes.integrity_checks(*changes.repaired(files, chunks, vectors))
    assert sum(r.n for r in after.collect()) == 0


def test_chunking():
    rows = chunking.chunk_text("one two three. four five.\n\n" + "w " * 25, 10, 3)
    parents = [x for x in rows if x[1] == -1]
    assert all(len(x[2].split()) <= 10 for x in parents) and all(len(x[2].split()) <= 3 for x in rows if x[1] >= 0)
    assert " ".join(x[2] for x in parents).split() == ("one two three. four five. " + "w " * 25).split()
    assert chunking.chunk_text(" \n ", 5, 5) == []
    text = "# One\nFirst sentence here. Second one is longer now.\n\n## Two\n| a | b |\n| c | d |\n\n" + " ".join(f"Number {k} says so." for k in range(12)) + "\n# Three\nend."
    rows = chunking.chunk_text(text, 16, 8, 4)
    parents = [x for x in rows if x[1] == -1]
    assert sum("| a | b |\n| c | d |" in x[2] for x in parents) == 1
    assert parents[0][3] == "One" and parents[-1][3] in ("One > Two", "Three") and any(x[3] == "One > Two" for x in parents)
    assert all(len(x[2].split()) <= 16 for x in parents) and all(len(x[2].split()) <= 8 for x in rows if x[1] >= 0)
    said = [re.findall(r"Number (\d+) says so", x[2]) for x in parents]
    said = [x for x in said if x]
    assert all(a[-1] == b[0] for a, b in zip(said, said[1:])) and {int(k) for x in said for k in x} == set(range(12))
    assert chunking.tail("One two. Three four five. Six.", 4) == "Three four five. Six." and chunking.tail("One two three.", 2) == ""


def test_rules(spark):
    assert one(spark, T.tags_of, "/home/x/My-Docs/a b/Downloads/my-docs/t.txt") == ["my_docs", "a_b"]
    assert one(spark, T.chat_title, "- [x](http://y) **b**  c\nd") == "x b c" and one(spark, T.chat_title, "\nx") is None
    assert one(spark, T.chat_title, "w" * 60) == "w" * 50 + "..."
    assert one(spark, T.normalised_path, "/a//b/./c/../d") == "/a/b/d" and one(spark, T.normalised_path, "../x") == "/x"
    assert one(spark, lambda v: T.redacted(v, F.lit("user_question"), "strict"), "abc") == "[REDACTED length=3]"
    assert one(spark, lambda v: T.redacted(v, F.lit("prompt"), "minimal"), "x" * 600) == "x" * 500 + "... [REDACTED_TAIL length=600]"
    assert one(spark, lambda v: T.redacted(v, F.lit("name"), "strict"), "x" * 9000) == "x" * 8000 + "... (truncated)"
    assert one(spark, lambda v: T.redacted(v, F.lit("answer"), "off"), "abc") == "abc"
    assert one(spark, lambda v: T.safe_number(v, 5), "x1") == 5 and one(spark, lambda v: T.safe_number(v, 5), " 7 ") == 7
    gate = lambda p, c: gates.continuation_gate(F.split(p, ","), F.split(c, ","), F.lit(True), F.lit(False)).alias("g")
    assert tuple(one(spark, gate, "a,b", "b,c")) == (True, 1) and tuple(one(spark, gate, "a", "c")) == (False, 0)
    stale = spark.range(1).select(*(stats.tuning_is_stale(F.lit(h), F.lit(a), F.lit(b)) for h, a, b in ((25, 10, 10), (1, 10, 12), (1, 10, 13), (1, 0, 1)))).first()
    assert tuple(stale) == (True, False, True, True)


def test_upload_orphans(spark):
    listed = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "d")], "chat_id string, stored_name string")
    held = spark.createDataFrame([("c", "a", None), ("c", "b", "2024")], "chat_id string, stored_name string, deleted_at string")
    assert sorted(r.stored_name for r in gates.upload_orphans(listed, held).collect()) == ["b", "d"]


def test_terms(spark):
    rows = spark.createDataFrame([(1, 10, "The World Health Organization (WHO) and NASA (National Aeronautics and Space Administration) met Dr. Jane Roe."), (2, 11, "nothing here")], "file_id long, id long, content string")
    got = {(r.acronym, r.confidence) for r in terms.acronym_pairs(rows).collect()}
    assert ("NASA", 0.95) in got and any(a == "WHO" for a, _ in got)
    assert {r.name for r in terms.person_names(rows).collect()} >= {"Jane Roe"}
    asked = spark.createDataFrame([(1, "organisatoin of health")], "query_id long, query string")
    aliases = spark.createDataFrame([("health", "Health"), ("organisation", "Organisation"), ("heart", "Heart")], "alias string, canonical string")
    assert {r.canonical for r in terms.expanded_queries(asked, aliases).collect()} == {"Health"}
    gate = terms.quality_gate(spark.createDataFrame([(0.9,), (0.1,), (0.1,)], "confidence double")).first()
    assert gate.noise_rate == 0.666667 and not gate.passed


def test_admission_ignores_rejected(spark):
    rows = spark.createDataFrame([(k, "a", float(t)) for k, t in enumerate([0, 1, 2, 9, 10, 11])], "id long, source string, at double").withColumn("created_at", F.col("at").cast("timestamp"))
    got = {r.id: r.admitted for r in stats.admitted(rows, "source", 2, 10).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True}


def test_streams_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k % 40, f"2024-01-01 00:{k % 30:02d}:00", "view", 1.0) for k in range(120)], "event_id long, t string, event_type string, value double").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "event_type", "value")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = events.event_stream(spark, f"{tmp_path}/in", rows.schema, 10)
    events.run_available(events.deduplicated(stream, "event_id", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/c1")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40
    seen = []
    events.upsert_batches(stream, lambda batch, epoch: seen.append(batch.count()), f"{tmp_path}/c2")
    assert sum(seen) == 120


def test_upload_sessions_and_headings(spark):
    from pyspark.sql import functions as F

    from quillspark.operators import scopes

    rows = [(1, "a", 1, 3), (1, "b", 3, None), (2, "c", 1, 4), (2, "d", 2, 6), (2, "e", 5, 7), (3, "x", None, 1), (3, "y", 2, None), (3, "z", 3, None)]
    df = spark.createDataFrame(rows, "chat_id int, upload_id string, uploaded_at int, removed_at int")
    assert {r.chat_id: r.anchor for r in scopes.upload_anchors(df).collect()} == {1: "b", 2: "c", 3: "y"}
    df = spark.createDataFrame([("# One\n text\n## The  second. \n",), (None,)], "a string")
    found = df.select(scopes.missing_headings(F.col("a"), F.array(F.lit("one:"), F.lit("Third"), F.lit("the second"))).alias("m")).collect()
    assert [r.m for r in found] == [["Third"], ["one:", "Third", "the second"]]


def test_upload_rules_and_history_scope(spark):
    from pyspark.sql import functions as F

    from quillspark.operators import scopes

    rows = [("a.md", None, True), ("dir.x/README", "text/plain", False), (".bashrc", "", False), ("a.PDF", " Application/PDF ; v=1", True), ("a.txt", "image/png", False), (None, None, False), ("a.", None, False)]
    df = spark.createDataFrame(rows, "name string, kind string, want boolean")
    assert not df.filter(scopes.uploadable(F.col("name"), F.col("kind"), [".pdf"]) != F.col("want")).count()
    up = spark.createDataFrame([(1, 2, 5, "deleted"), (1, 3, 4, "active"), (2, 1, 1, "active"), (1, 1, 4, "ready")], "chat_id int, id int, uploaded_at int, state string")
    chats = spark.createDataFrame([(1,), (1,), (None,)], "chat_id int")
    assert [r.id for r in scopes.uploads_of(up, chats).collect()] == [1, 3]
    assert [r.id for r in scopes.uploads_of(up, chats, include_deleted=True).collect()] == [1, 3, 2]
    corpus, other = "indexed_corpus", "uploads"
    rows = [(None, corpus, "indexed_corpus|g:07", corpus, "indexed_corpus|g:7", True), ("researcher", other, "indexed_corpus", other, "indexed_corpus|g:0", False), ("x", other, "k", other, " k", False),
            ("", other, "k", other, " k", True), ("", other, None, other, None, False), ("", corpus, "indexed_corpus|g:x", corpus, "indexed_corpus", False)]
    df = spark.createDataFrame(rows, "m string, k string, s string, kind string, key string, want boolean")
    seen = lambda mode: scopes.in_scope(F.col("m"), F.col("k"), F.col("s"), F.lit(mode), F.col("kind"), F.col("key"))
    assert [r.x for r in df.select(seen("researcher").alias("x")).collect()] == [r[5] for r in rows]
    assert df.filter(seen("assistant")).count() == len(rows)


def test_query_expansion_against_brute_force(spark):
    import re

    from quillspark.operators import terms

    queries = [(1, "Annual Report-2020 of the health  board"), (2, "the healt reports, annual"), (3, ""), (4, None), (5, "report annual report"), (6, "heealth annual_report"), (6, "boards")]
    aliases = [("annual report", "Report, annual"), ("Report 2020", "R20"), ("health", "Health"), ("board", "Board"), ("report", "Report"), ("annual report", "Yearly"), ("reports annual", "X"), ("of the", "The")]
    norm = lambda x: re.sub(r"[\W_]+", " ", (x or "").lower()).strip()

    def one_edit(a, b):
        cut = [(a[:k], a[k:]) for k in range(len(a) + 1)]
        near = {x + y[1:] for x, y in cut if y} | {x + c + y[1:] for x, y in cut if y for c in b} | {x + c + y for x, y in cut for c in b}
        return b in near and a != b

    want = {}
    for query_id, query in queries:
        words = norm(query).split()
        for alias, canonical in ((norm(a), c) for a, c in aliases):
            how = 0 if " " in alias and f" {alias} " in f" {norm(query)} " else 1 if alias in words else 2 if len(alias) >= 5 and any(len(w) >= 6 and one_edit(w, alias) for w in words) else None
            if how is not None:
                want[query_id, canonical] = min(how, want.get((query_id, canonical), 9))
    got = terms.expanded_queries(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(aliases, "alias string, canonical string"), most=20)
    assert {(r.query_id, r.canonical): r.how for r in got.collect()} == want and {0, 1, 2} <= set(want.values())
