"""Stems, the stored index, batched retrieval and embeddings against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import embedding, stems
from quillspark.operators import batch_search, fulltext
from quillspark.operators.lineage import staging

#: Examples of the published algorithm.
PORTER = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "hesitanci": "hesit", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile", "analogousli": "analog",
    "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "homologou": "homolog", "communism": "commun", "activate": "activ",
    "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil",
}


def test_stems():
    assert {w: stems.stem(w) for w in PORTER} == PORTER
    assert [stems.stem(x) for x in ("as", "é", "x1s", "a" * 70 + "s", "")] == ["as", "é", "x1s", "a" * 70 + "s", ""]
    assert stems.index_terms("Straßen, ÉCOLES_running 3D-Flies!") == ["straßen", "ecol", "run", "3d", "fli"]
    assert stems.search_terms('"running" AND NOT near(flies) OR Running') == ["run", "fli"] and stems.search_terms(None) == []


def corpus(seed=3, n=400):
    rng = random.Random(seed)
    words = ["running", "run", "runs", "nation", "national", "Écoles", "tables", "table", "x1", *(f"w{k}" for k in range(30))]
    rows = [(k, " ".join(rng.choices(words, weights=[8, 4, 3, 2, 2, 1, 3, 1, 1] + [1] * 30, k=rng.randrange(0, 40)))) for k in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, rows[5][1]), (n + 3, "running " * 500)]


def brute_bm25(rows, terms, every, k1=1.2, b=0.75):
    held = {i: stems.index_terms(t or "") for i, t in rows}
    mean = sum(map(len, held.values())) / len(held)
    df = Counter(t for x in held.values() for t in set(x))
    found = []
    for i, x in held.items():
        here = [t for t in terms if t in x]
        if here and (not every or len(here) == len(terms)):
            score = sum(math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5)) * x.count(t) * (k1 + 1) / (x.count(t) + k1 * (1 - b + b * len(x) / mean)) for t in here)
            found.append((-round(score, 6), i, len(here)))
    return sorted(found)


@pytest.mark.parametrize("block_rows", [128, 3])
def test_stored_index(spark, block_rows):
    rows = corpus()
    place = staging(spark, "test-index")
    fulltext.build(spark.createDataFrame(rows, "id long, content string").repartition(5), place, buckets=8, block_rows=block_rows)
    index = fulltext.Index(spark, place, 8)
    for question in ("running", "Nations and tables", "runs x1 w3", "w1 w2 w3 w4 running", "ecole", "missing", "running missing", "", "and or"):
        terms = stems.search_terms(question)
        for every in (True, False):
            got = [(-round(r.score, 6), r.id, r.n_terms) for r in fulltext.search(index, question, 10, every).collect()]
            assert got == brute_bm25(rows, terms, every)[:10], (question, every)
    assert index.totals()[0] == len(rows)


def test_searches_read_their_buckets_only(spark):
    place = staging(spark, "test-pruning")
    fulltext.build(spark.createDataFrame(corpus(), "id long, content string"), place, buckets=16)
    rows = fulltext.Index(spark, place, 16).blocks(["run"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,run)" in plan
    assert {f"bucket={fulltext.bucket_of('run', 16)}" in x for x in rows.inputFiles()} >= {True} and {r.term for r in rows.collect()} == {"run"}


def test_index_of_nothing(spark):
    place = staging(spark, "test-nothing")
    fulltext.build(spark.createDataFrame([], "id long, content string"), place)
    assert fulltext.search(fulltext.Index(spark, place), "anything", 5, every=False).count() == 0


def test_embedding(spark):
    texts = ["a b a", None, "", "A  b,a", "ü_x Ü"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: np.array(r.v) for r in rows.select("k", embedding.embed(F.col("t"), 16).alias("v")).collect()}
    a, b = embedding.feature("a"), embedding.feature("b")
    want = np.zeros(16)
    want[a[0] % 16] += 2 * a[1]
    want[b[0] % 16] += b[1]
    assert (got[0] == want).all() and (got[3] == want).all() and not got[1].any() and not got[2].any() and np.abs(got[4]).sum() in (1, 3)
    prefixed = rows.select(embedding.embed(F.col("t"), 16, prefix="b ").alias("v")).collect()
    assert np.array(prefixed[1].v)[b[0] % 16] == b[1]
    long = embedding.embedded(["w " * 9000], 16)
    assert np.abs(long).sum() == embedding.MAX_WORDS


def test_nearest_of_all(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [(k, rng.integers(-3, 4, 8 if k % 9 else 5).astype(float).tolist()) for k in range(500)] + [(600, [0.0] * 8), (601, None), (602, [None] * 8), (None, [1.0] * 8)]
    asked = [(k, rng.integers(-3, 4, 8).astype(float).tolist()) for k in range(40)] + [(50, [0.0] * 8), (51, None), (52, [1.0] * 5), (53, [1.0] * 3)]
    got = batch_search.nearest_of_all(spark.createDataFrame(vectors, "chunk_id long, vector array<double>").repartition(3), spark.createDataFrame(asked, "query_id long, vector array<double>"), 7)
    want = []
    for q, v in asked:
        hits = []
        for c, x in vectors:
            if v and x and c is not None and None not in x and len(x) == len(v) and any(x) and any(v):
                dot, norm = sum(map(float.__mul__, v, x)), math.sqrt(sum(y * y for y in v) * sum(y * y for y in x))
                hits.append((-round(dot / norm, 6), c))
        want += [(q, c, -s, r + 1) for r, (s, c) in enumerate(sorted(hits)[:7])]
    assert sorted((r.query_id, r.chunk_id, round(r.score, 6), r.rank) for r in got.collect()) == sorted((q, c, round(s, 6), r) for q, c, s, r in want)


def test_matches_of_all(spark):
    rows = corpus(5)
    asked = [(k, q) for k, q in enumerate(["running", "nations tables", "run x1", "missing run", "", None, "w1 w2", "and"])]
    got = batch_search.matches_of_all(spark.createDataFrame(rows, "id long, content string").repartition(3), spark.createDataFrame(asked, "query_id long, question string"), 6)
    want = []
    for q, question in asked:
        terms = stems.search_terms(question)
        want += [(q, i, -s, r + 1) for r, (s, i, _) in enumerate(brute_bm25(rows, terms, True)[:6])] if terms else []
    assert sorted((r.query_id, r.chunk_id, round(r.score, 6), r.rank) for r in got.collect()) == sorted(want) and len(want) > 15


def test_retrieval_of_all(spark):
    """The composition on a small corpus, step by step in plain Python."""
    long = "filler words to make this chunk longer than a short one so that nothing is taken away from what it scores " * 2
    texts = {1: f"alpha beta {long}", 2: f"alpha beta {long}", 3: f"gamma delta {long}", 4: "credits:alpha", 5: f"epsilon {long}", 6: f"alpha zeta {long}", 7: f"beta gamma {long}"}
    chunks = [(k, 10 + k % 3, 100 + k // 3 if k < 7 else None, t, "Index" if k == 2 else "Body", "narrative", k) for k, t in texts.items()]
    files = [(10, "alpha notes.pdf", "x"), (11, "other.pdf", "x"), (12, "hidden.pdf", "upload")]
    f = spark.createDataFrame(files, "id long, filename string, source_provider string")
    c = spark.createDataFrame(chunks, "id long, file_id long, parent_id long, content string, section string, block_type string, place long")
    parents = spark.createDataFrame([(100,), (101,)], "id long")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "query_id long, question string")
    got = batch_search.retrieve(asked, c, f, parents, top_k=3, pool=2, text_limit=2, allowed=F.col("source_provider") != "upload").collect()
    seen = {q: [(r.chunk_id, r.passage_id) for r in sorted(got, key=lambda r: r.nth) if r.query_id == q] for q in (1, 2)}
    assert all(r.file_id != 12 for r in got) and all(r.nth >= 1 for r in got)

    def cosine(a, b):
        x, y = embedding.embedded([a, b], 64).astype(float)
        return round(float(x @ y / math.sqrt((x @ x) * (y @ y))), 6)

    for q, question in ((1, "alpha beta"), (2, "gamma")):
        allowed = [x for x in chunks if x[1] != 12]
        near = sorted((-cosine(question, x[3]), x[0]) for x in allowed)[:6]
        words = [i for _, i, _ in brute_bm25([(x[0], x[3]) for x in allowed], stems.search_terms(question), True) if i not in {k for _, k in near}][:2]
        scored = []
        for place, (s, k) in enumerate([*near, *((0.0, k) for k in words)]):
            x = next(y for y in chunks if y[0] == k)
            score = -s - (0.15 if x[4] == "Index" else 0) - (0.35 + 0.04 if k == 4 else 0)
            scored.append([score, place, x])
        scored.sort(key=lambda y: (-round(y[0], 6), y[1]))
        for place, y in enumerate(scored):
            name = next(z[1] for z in files if z[0] == y[2][1])
            y[0], y[1] = y[0] + 0.05 * len({"alpha", "beta", "gamma"} & set(question.split()) & set(name.replace(".", " ").split())), place
        scored.sort(key=lambda y: (-round(y[0], 6), y[1]))
        want = []
        for _, _, x in scored[:3]:
            passage = x[2] if x[2] in (100, 101) else x[0]
            if passage not in [p for _, p in want]:
                want.append((x[0], passage))
        assert seen[q] == want


def test_term_counts():
    text = "Running runs run, RÜN rün; the The tHe 12 12 x_y"
    terms = stems.index_terms(text)
    assert stems.term_counts(text) == (len(terms), {t: terms.count(t) for t in dict.fromkeys(terms)})


def test_floors_keep_hits_few(spark, monkeypatch):
    """Tasks return what reaches the k-th best of a sixteenth of the chunks, not k hits of each of their blocks."""
    monkeypatch.setattr(batch_search, "CHUNK_BLOCK", 64)
    sizes, merged = [], batch_search.merged
    monkeypatch.setattr(batch_search, "merged", lambda hits, k: (sizes.append(hits.count()), merged(hits, k))[1])
    r = np.random.default_rng(5)
    m, q = r.integers(-9, 10, (8192, 8)), r.integers(-9, 10, (6, 8))
    frame = lambda x, name: spark.createDataFrame([(k, v.astype(float).tolist()) for k, v in enumerate(x)], f"{name} long, vector array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        got = batch_search.nearest_of_all(frame(m, "chunk_id"), frame(q, "query_id"), 5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    cosine = np.round(q @ m.T / np.sqrt((q * q).sum(1)[:, None] * (m * m).sum(1)), 6)
    assert {(x.query_id, x.rank): (x.chunk_id, x.score) for x in got} == {(a, k + 1): (c, cosine[a, c]) for a in range(6) for k, c in enumerate(np.lexsort((np.arange(8192), -cosine[a]))[:5].tolist())}
    assert sizes[-1] < 6 * 5 * 8192 // 64 // 4


def test_frequent_stems_are_not_scored(spark, monkeypatch):
    """Chunks are followed from a question's rarest stem: pairs at hand are its postings, not those of the frequent ones."""
    monkeypatch.setattr(batch_search, "PAIR_BLOCK", 16)
    docs = spark.createDataFrame([(k, f"the of and {'w%d' % (k % 500)} {'v%d' % (k % 7)}") for k in range(2000)], "id long, content string")
    asked = spark.createDataFrame([(k, f"the of w{k} v{k % 7} the") for k in range(40)] + [(99, "the w3 nowhere")], "query_id long, question string")
    got = {}
    for x in batch_search.matches_of_all(docs, asked, 2).collect():
        got.setdefault(x.query_id, []).append(x.chunk_id)
    assert got == {k: w[:2] for k in range(40) if (w := [d for d in range(2000) if d % 500 == k and d % 7 == k % 7])}


def test_retrieve_reads_chunks_once(spark):
    """Both searches and the selection share one pass over the chunks."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    chunks = spark.range(300).select("id", (F.col("id") % 10).alias("file_id"), F.lit(None).cast("long").alias("parent_id"), counted(F.concat(F.lit("word w"), F.col("id"))).alias("content"), F.lit("s").alias("section"), F.lit("narrative").alias("block_type"), F.col("id").alias("place"))
    files = spark.range(10).select("id", F.concat(F.lit("f"), "id").alias("filename"))
    asked = spark.createDataFrame([(1, "word w7"), (2, "w8")], "query_id long, question string")
    rows = batch_search.retrieve(asked, chunks, files, spark.range(0).select("id"), 3).collect()
    assert {r.chunk_id for r in rows if r.nth == 1} >= {7, 8} and seen.value == 300


def test_retrieve_searches_each_text_once(spark, monkeypatch):
    """Copies of a text are one row of both searches and come back as chunks; a section may come with the files."""
    rng = random.Random(7)
    texts = ["alpha beta", "alpha", "beta gamma", "alpha beta gamma delta", "Beta, alpha", None, ""]
    rows = [(k, k % 4, None, rng.choice(texts), "narrative", k) for k in range(900, 0, -1)]
    chunks = spark.createDataFrame(rows, "id long, file_id long, parent_id long, content string, block_type string, place long")
    sections = {0: "Body", 1: "Index", 2: "Body", 3: "Glossary"}
    files = spark.createDataFrame([(k, f"f{k}.pdf", s) for k, s in sections.items()], "id long, filename string, section string")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "nothing of it"), (4, "beta gamma delta")], "query_id long, question string")
    parents, seen = spark.range(0).select("id"), []
    for name in ("nearest_of_all", "matches_of_all"):
        search = getattr(batch_search, name)
        monkeypatch.setattr(batch_search, name, lambda x, *a, f=search: (seen.append(x.count()), f(x, *a))[1])
    hits = lambda c, f: sorted(tuple(r) for r in batch_search.retrieve(asked, c, f, parents, top_k=20, pool=30, text_limit=15).collect())
    got = hits(chunks, files)
    assert seen == [len(texts)] * 2
    section = files.select(F.col("id").alias("file_id"), "section")
    assert got == hits(chunks.join(section, "file_id"), files.drop("section"))

    def cosine(a, b):
        x, y = embedding.embedded([a, b or ""], 64).astype(float)
        return round(float(x @ y / math.sqrt((x @ x) * (y @ y))), 6) if y.any() else None

    for q, question in ((1, "alpha beta"), (2, "gamma"), (4, "beta gamma delta")):
        near = sorted((-s, r[0], r[1]) for r in rows if (s := cosine(question, r[3])) is not None)[:40]
        mine = {i: f for _, i, f in near}
        # counts of chunks, not of texts, weigh the stems
        more = [i for _, i, _ in brute_bm25([(r[0], r[3]) for r in rows], stems.search_terms(question), True)[:55] if i not in mine][:15]
        place = {r[0]: r for r in rows}
        scored = [(round(-s - (0.15 if sections[f] != "Body" else 0) - 0.04, 6), n, i) for n, (s, i, f) in enumerate(near)] + [(round(0 - (0.15 if sections[place[i][1]] != "Body" else 0) - 0.04, 6), 10**6 + n, i) for n, i in enumerate(more)]
        want = [i for _, _, i in sorted(scored, key=lambda y: (-y[0], y[1]))[:20]]
        assert [r[2] for r in got if r[0] == q] == want


def test_copies_count(spark):
    """Statistics of rows that stand for several are those of all of them."""
    rows = corpus(9)
    asked = spark.createDataFrame([(k, q) for k, q in enumerate(["running", "nations tables", "run x1", "w1 w2"])], "query_id long, question string")
    times = {i: 1 + i % 3 for i, _ in rows}
    some = spark.createDataFrame([(i, t, times[i]) for i, t in rows], "id long, content string, copies int")
    every = spark.createDataFrame([(i * 10 + n, t) for i, t in rows for n in range(times[i])], "id long, content string")
    got = {(r.query_id, r.chunk_id): r.score for r in batch_search.matches_of_all(some, asked, 500).collect()}
    want = {(r.query_id, r.chunk_id // 10): r.score for r in batch_search.matches_of_all(every, asked, 2000).collect()}
    assert got == want and len(got) > 15


def long_texts(folder):
    """Tables with texts beyond any window: what counts most stands at their ends."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = ["a b " * 6000 + "zebra " * 30000, "a b", "x" * 300 + " a", None, "Été " * 9000 + "fin", "zebra b", "q, " * 8192 + "zebra"]
    tables = {
        "documents": {"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())},
        "benchmark": {"item_id": pa.array([1, 2], pa.int64()), "text": ["zebra", "w " * 9000 + "fin " * 10000]},
        "conversations": {"conv_id": pa.array([1], pa.int64()), "turn": pa.array([0], pa.int64()), "role": ["user"], "text": ["a b"]},
    }
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), folder / f"{name}.parquet")
    return texts


def words_by_place(text):
    """Signed counts of all words of a text, one by one."""
    import hashlib
    import re

    out = Counter()
    for word, n in Counter(re.findall(r"[a-z0-9_]+|[^\x00-\x7f]+", (text or "").lower())).items():
        digest = hashlib.md5(word.encode()).digest()
        out[(digest[0] << 8 | digest[1]) % 64] += -n if digest[2] >= 128 else n
    return {k: v for k, v in out.items() if v}


def by_sql(folder, name):
    import duckdb
    from quillspark.plans import catalog

    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return sorted(con.sql(catalog.ORACLES[name]).fetchall())


def test_whole_texts_are_embedded(spark, tmp_path):
    from quillspark.plans import catalog

    texts = long_texts(tmp_path)
    got = sorted((r.doc_id, r.dim, r.value) for r in catalog.embedded_documents(spark, str(tmp_path)).collect())
    assert got == sorted((k, dim, n) for k, t in enumerate(texts) for dim, n in words_by_place(t).items())
    assert got == by_sql(tmp_path, "embedded_documents")


def test_pieces_of_long_texts(monkeypatch):
    """Texts are cut and added up by parts of bounded size, with the same sums."""
    rng = random.Random(11)
    texts = ["".join(rng.choice(["ab ", "ΑΣ ", "Σ", "x", "é", " ", "\n", "Zz_9 ", "日 "]) for _ in range(rng.randrange(0, 400))) for _ in range(50)] + ["", " " * 50, "x" * 200]
    whole = embedding.embedded(texts, 64, None)
    monkeypatch.setattr(embedding, "PIECE", 7)
    monkeypatch.setattr(embedding, "HELD", 5)
    assert all("".join(embedding.pieces(t)) == t for t in texts) and max(len(list(embedding.pieces(t))) for t in texts) > 20
    assert (embedding.embedded(texts, 64, None) == whole).all()
    assert [{k: v for k, v in enumerate(row) if v} for row in whole.tolist()] == [words_by_place(t) for t in texts]


def test_nearest_of_whole_texts(spark, tmp_path):
    """The ends of long documents and questions decide what is near."""
    from quillspark.plans import catalog

    texts = long_texts(tmp_path)
    got = sorted((r.query_id, r.chunk_id, r.score, r.rank) for r in catalog.nearest_all_questions(spark, str(tmp_path)).collect())
    held = {k: v for k, t in enumerate(texts) if (v := words_by_place(t))}
    asked = {2: "zebra", 4: "w " * 9000 + "fin " * 10000, 2001: "a b"}
    want = []
    for q, question in asked.items():
        x = words_by_place(question)
        norm = lambda v: sum(y * y for y in v.values())
        scores = sorted((-round(sum(x.get(d, 0) * y for d, y in v.items()) / math.sqrt(norm(x) * norm(v)), 6) + 0.0, k) for k, v in held.items())
        want += [(q, k, -s, n + 1) for n, (s, k) in enumerate(scores[:8])]
    assert [(*r[:2], round(r[2], 6), r[3]) for r in got] == [(*r[:2], round(r[2], 6), r[3]) for r in sorted(want)]
    assert got == by_sql(tmp_path, "nearest_all_questions")
    assert next(r[1] for r in got if r[0] == 2 and r[3] == 1) == 0
