"""Versioned indexing, watching and caching: killed batches, replays, conflicts, shuffled and late events, restarts."""

import random
import re
from collections import OrderedDict
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.functions import embedding, rules, text
from quillspark.operators import chunking, indexing
from quillspark.operators.lineage import clear, run_folder, staging
from quillspark.plans import catalog
from quillspark.sources.versions import Conflict, Store, new_batch
from quillspark.streaming import cache, watch

SCANNED = "file_id long, path string, filename string, extension string, size_bytes long, content_hash string, text string"


def scanned(spark, texts, size=100, extension=".md"):
    rows = [(k, f"/home/x/Notes/{2000 + k % 20}/f{k}{extension}", f"f{k}{extension}", extension, size, f"h{hash(t)}" if t is None else f"h{t[:40]}{len(t)}", t) for k, t in texts.items()]
    return spark.createDataFrame(rows, SCANNED)


def seen(store):
    files = {r.file_id: r.content_hash for r in store.read("files").collect()}
    chunks = store.read("chunks").collect()
    vectors = {r.chunk_id: r.vector for r in store.read("vectors").collect()}
    assert {c.file_id for c in chunks} == set(files)
    children = [c for c in chunks if c.parent_id is not None]
    assert {c.id for c in children} == set(vectors) and {c.parent_id for c in children} <= {c.id for c in chunks if c.parent_id is None}
    assert len({c.id for c in chunks}) == len(chunks)
    return files


def body(k, n=40):
    return f"Head {k} of all. " + " ".join(f"word{k}x{j}." for j in range(n))


@pytest.fixture
def store(spark):
    return Store(spark, staging(spark, "test-store"))


def test_all_or_nothing(spark, store):
    texts = {k: body(k) for k in range(8)}
    assert indexing.index_files(store, scanned(spark, texts)) == 1
    first = seen(store)
    assert set(first) == set(texts)
    row = store.read("files").filter("file_id = 3").first()
    assert (row.category, row.year, row.tags) == ("plaintext", 2003, ["notes", "2003"])
    assert indexing.index_files(store, scanned(spark, texts)) == 1  # nothing to do, no new version
    # file 1 changes, 2 goes, 3 breaks while it is embedded, 9 is new, 10 blank, 11 too large: each as a whole
    broken = lambda c: F.when(~c.contains("BROKEN"), embedding.embed(c))
    again = {0: texts[0], 1: body(100), 3: body(3, 600) + " BROKEN", 9: body(9, 900), 10: " \n"}
    rows = scanned(spark, again).union(scanned(spark, {11: body(11)}, size=indexing.MAX_BYTES + 1)).union(scanned(spark, {12: body(12)}, extension=".exe")).union(scanned(spark, {13: "x" * 200_001}))
    gone = spark.createDataFrame([(2,), (77,)], "file_id long")
    assert indexing.index_files(store, rows, gone, embed=broken) == 2
    now = seen(store)
    assert set(now) == {0, 1, 3, 4, 5, 6, 7, 9} and now[3] == first[3] and now[1] != first[1]
    faults = {r.file_id: (r.error_code, r.retryable) for r in indexing.failures(store).collect()}
    assert faults == {3: ("vector_missing", True), 10: ("empty_text", True), 11: ("file_too_large", False), 12: ("no_extractor", False), 13: ("text_pathological_line_length", False)}
    # what failed for good isn't tried again, the rest is, and heals
    assert indexing.index_files(store, rows) == 3
    assert set(seen(store)) == {0, 1, 3, 4, 5, 6, 7, 9} and seen(store)[3] != first[3]
    left = {r.file_id: r.failed for r in indexing.failures(store).collect()}
    assert left == {10: 2, 11: 1, 12: 1, 13: 1}


def test_killed_batches_leave_the_old_version(spark, store):
    indexing.index_files(store, scanned(spark, {k: body(k) for k in range(4)}))
    before = seen(store)

    class Killed(Store):
        at = ""

        def stage(self, batch, table, rows):
            found = super().stage(batch, table, rows)
            if table == self.at:
                raise RuntimeError("killed")
            return found

    for Killed.at in ("scanned", "chunks", "vectors", "failures", "files", "changes"):
        with pytest.raises(RuntimeError, match="killed"):
            indexing.index_files(Killed(spark, store.root), scanned(spark, {0: body(50), 8: body(8)}), spark.createDataFrame([(1,)], "file_id long"))
        assert seen(store) == before and store.manifest()["version"] == 1
    indexing.index_files(store, scanned(spark, {0: body(50), 8: body(8)}), spark.createDataFrame([(1,)], "file_id long"))
    assert set(seen(store)) == {0, 2, 3, 8}


def test_torn_manifests_conflicts_and_compaction(spark, store):
    indexing.index_files(store, scanned(spark, {k: body(k) for k in range(4)}))
    base = store.manifest()
    with open(store.root.removeprefix("file:").replace("//", "/") + "/versions/0000000002.json", "w") as torn:
        torn.write('{"version": 2, "batc')
    assert store.manifest()["version"] == 1 and set(seen(store)) == {0, 1, 2, 3}
    assert indexing.index_files(store, scanned(spark, {0: body(60)})) == 3
    with pytest.raises(Conflict):  # a writer that started from version 1 comes too late
        store.commit(new_batch(), [], spark.createDataFrame([(1, False)], "file_id long, live boolean"), base)
    held = store.manifest()
    before = seen(store)
    assert store.compact() == 4 and seen(store) == before and len(store.manifest()["batches"]) == 1
    assert {r.file_id for r in store.read("files", held).collect()} == set(before)  # readers of the old version go on
    indexing.index_files(store, scanned(spark, {5: body(5)}), spark.createDataFrame([(0,)], "file_id long"))
    assert set(seen(store)) == {1, 2, 3, 5}


def test_indexing_odd_batches(spark, store):
    none = scanned(spark, {0: body(0)}).filter("file_id > 5")
    assert indexing.index_files(store, none) == 0 and store.manifest()["batches"] == []
    twice = scanned(spark, {1: body(1)}).union(scanned(spark, {1: "another text of the same file. " * 3})).withColumn("batch", F.lit("x")).withColumn("ordinal", F.lit(1)).drop("batch", "ordinal")
    indexing.index_files(store, twice.union(scanned(spark, {2: None})), spark.createDataFrame([(9,), (9,)], "file_id long"))
    assert seen(store) == {1: min(r.content_hash for r in twice.collect())}
    indexing.index_files(store, scanned(spark, {1: body(2)}), spark.createDataFrame([(1,)], "file_id long"))
    assert seen(store) == {}


def test_texts_travel_once(spark, store):
    """A second batch deals texts by file only, readers name what travels, and documents are scanned once."""
    plans = []

    class Watched(Store):
        def stage(self, batch, table, rows):
            if table == "scanned":
                plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
            return super().stage(batch, table, rows)

    indexing.index_files(Watched(spark, store.root), scanned(spark, {k: body(k) for k in range(4)}))
    indexing.index_files(Watched(spark, store.root), scanned(spark, {0: body(0), 1: body(50), 2: None}))
    assert seen(store).keys() == {0, 1, 2, 3} and "content_hash" not in " ".join(x for x in plans[1].split("\n") if "Join" in x and "Window" not in x)
    held = store.read("vectors", columns=["file_id", F.col("vector").isNotNull().alias("held")])
    assert held.columns == ["file_id", "held"] and held.count() == store.read("vectors").count() == held.filter("held").count()
    folder = "/root/testdata/sf0.001"
    plan = catalog.scanned_documents(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("parquet") == 1


ODD = ["plain text\nof two lines", "a\x85", " \x85\nb", "\t\nb", "\r\nb", "b\n \u2028", "\ufffd \nb", "x\ue000y", "x\uf8ffy\n\ufffd", "\u200bz\n\ufeff", "glypH<7>q\n", "GLYPH&x;q", "H<1", "  \n\n x", "", None, "日本，語\nü"]


def test_quick_ways_give_the_same(spark):
    """Guards before patterns, words counted once, words cut from bytes: as the plain rules have it."""

    def cleaned(t):
        t = re.sub(r"(?ia)GLYPH[<&][^>;\s]*[>;]?", "", t)
        t = re.sub("[\ue000-\uf8ff\u200b\ufeff]", "", t)
        return "\n".join(x for x in t.split("\n") if not re.search("^[\ufffd \t\x0b\f\r]+(?:\r\n|[\n\r\x85\u2028\u2029])?\\Z", x) or x.strip(" ") == "")

    rows = spark.createDataFrame(list(enumerate(ODD)), "k int, t string").select("k", text.clean_glyphs(F.col("t")).alias("c"), rules.header_only(F.col("t")).alias("h"))
    got = rows.orderBy("k").collect()
    assert [r.c for r in got] == [None if t is None else cleaned(t) for t in ODD] and not any(r.h for r in got)
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b. ", "! ", "\n", "\n\n", "| ", "|", "# ", "é", "ß", "_", "9", "X y ", "\x85", "\u3000", "?\n", "日本"]) for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    for t in texts:
        chunks = chunking.counted_chunks(t, 9, 5, 3)
        assert [len(c[2].split()) for c in chunks] == [c[-1] for c in chunks] and [c[:-1] for c in chunks] == chunking.chunk_text(t, 9, 5, 3)
        assert [w.decode() for w in embedding.words_of(t)] == re.findall(r"[a-z0-9_]+|[^\x00-\x7f]+", t.lower())
    assert embedding.Signed.most == 1 << 16


START = datetime(2024, 5, 1, tzinfo=UTC)
EVENTS = "event_id long, created_at timestamp, kind string, path string, dest string, is_directory boolean"


def watch_events(seed=2, n=300):
    rng = random.Random(seed)
    rows, at = [], 0.0
    for k in range(n):
        at += rng.choice([0.1, 0.4, 1.1, 2.0, 2.5])
        kind = rng.choices(["created", "modified", "deleted", "moved", "opened"], [2, 5, 1, 1, 1])[0]
        name = lambda: f"/w/{rng.choice(['a', 'b', 'c', 'tmp/d', 'e'])}.{rng.choice(['md', 'md', 'MD', 'exe'])}"
        rows.append((k, START + timedelta(seconds=at), kind, name() if k % 50 else None, name() if kind == "moved" else None, k % 41 == 0))
    return rows


def brute_watch(rows):
    acts = []
    for ident, at, kind, path, dest, folder in {r[0]: r for r in rows}.values():
        if path is None or folder:
            continue
        for p, remove in {"created": [(path, False)], "modified": [(path, False)], "deleted": [(path, True)], "moved": [(path, True), (dest, False)]}.get(kind, []):
            if p.lower().endswith(".md") and (remove or "/tmp/" not in p):
                acts.append((p, at, remove, ident))
    if any(x[0] == y[0] and x[3] == y[3] for k, x in enumerate(acts) for y in acts[:k]):
        acts = list({(a[3], a[0]): a for a in reversed(acts)}.values())
    found, last = [], {}
    for p, at, remove, _ in sorted(acts, key=lambda a: a[1]):
        if p in last and at - last[p][3] <= timedelta(seconds=2):
            last[p][1:] = [last[p][1] or remove, last[p][2], at, last[p][4] + 1]
        else:
            last[p] = [p, remove, at, at, 1]
            found.append(last[p])
    return sorted((p, "delete" if r else "index", a, z, n) for p, r, a, z, n in found)


def plain(rows):
    return sorted((r.path, r.action, r.first_at.replace(tzinfo=None), r.last_at.replace(tzinfo=None), r.n_events) for r in rows)


def test_watching_tables_and_streams(spark, tmp_path):
    rows = [r for r in watch_events() if not (r[2] == "moved" and r[3] == r[4])]
    want = [(p, a, x.replace(tzinfo=None), y.replace(tzinfo=None), n) for p, a, x, y, n in brute_watch(rows)]
    frame = spark.createDataFrame(rows, EVENTS)
    got = watch.flushed(watch.path_actions(frame, [".md"], ["tmp/"])).collect()
    assert plain(got) == want and {a for _, a, *_ in want} == {"index", "delete"}
    # the same events shuffled within five seconds, some twice, in several files, and with a restart in between
    rng = random.Random(1)
    late = sorted([*rows, *rows[::7]], key=lambda r: r[1] + timedelta(seconds=5 * rng.random()))
    end = [(10**6, START + timedelta(days=1), "modified", "/w/end.md", None, False)]
    source, out, point = (str(tmp_path / x) for x in ("in", "out", "point"))
    parts = [late[k : k + 60] for k in range(0, len(late), 60)]

    def put(k, part):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
        query = watch.flushed(watch.path_actions(stream, [".md"], ["tmp/"])).writeStream.format("parquet").option("path", out).option("checkpointLocation", point).trigger(availableNow=True).start()
        query.awaitTermination()

    for k, part in enumerate(parts[: len(parts) // 2]):
        put(k, part)
    run()
    for k, part in enumerate(parts[len(parts) // 2 :] + [end]):
        put(k, part)
        if k % 2:
            run()
    run()
    got = [r for r in plain(spark.read.parquet(out).collect()) if r[0] != "/w/end.md"]
    assert got == want


def test_watching_keeps_an_index(spark, store, tmp_path):
    """Events in two runs with a restart; a batch that is applied twice changes nothing."""
    disk = {"/w/a.md": body(1), "/w/b.md": body(2), "/w/c.md": body(3)}
    ids = F.xxhash64("path")

    def load(paths):
        rows = [(p, t) for p, t in disk.items()]
        files = spark.createDataFrame(rows, "path string, text string")
        return paths.join(files, "path").select("file_id", "path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(".md").alias("extension"), F.length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("content_hash"), "text")

    source, point = str(tmp_path / "in"), str(tmp_path / "point")
    event = lambda k, at, kind, path, dest=None: (k, START + timedelta(seconds=at), kind, path, dest, False)

    def run(rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        watch.watch(spark.readStream.schema(EVENTS).parquet(source), store, load, ids, point, [".md"])
        return {r.path for r in store.read("files").collect()} if store.manifest()["batches"] else set()

    assert run([event(1, 0, "created", "/w/a.md"), event(2, 1, "created", "/w/b.md"), event(3, 1, "created", "/w/gone.md"), event(4, 100, "modified", "/w/x.exe"), event(5, 100, "modified", "/w/c.md")]) in ({"/w/a.md", "/w/b.md"}, set())
    disk["/w/d.md"] = disk.pop("/w/b.md")
    assert run([event(6, 200, "moved", "/w/b.md", "/w/d.md"), event(7, 201, "modified", "/w/a.md"), event(8, 202, "deleted", "/w/a.md"), event(9, 500, "modified", "/w/c.md")]) >= {"/w/c.md"}
    assert run([event(10, 900, "modified", "/w/c.md")]) == {"/w/c.md", "/w/d.md"}
    version = store.manifest()["version"]
    actions = spark.createDataFrame([("/w/d.md", "index", START), ("/w/a.md", "index", START), ("/w/a.md", "delete", START + timedelta(seconds=9))], "path string, action string, last_at timestamp")
    watch.apply_batch(store, load, ids)(actions, 0)
    assert {r.path for r in store.read("files").collect()} == {"/w/c.md", "/w/d.md"} and store.manifest()["version"] <= version + 1


def brute_cache(rows, most, live):
    held, found = OrderedDict(), {}
    for ident, at, q in sorted(rows, key=lambda r: (r[1], r[0])):
        t = at.timestamp()
        found[ident] = q in held and t - held[q] <= live
        if not found[ident]:
            held[q] = t
        held.move_to_end(q)
        if len(held) > most:
            held.popitem(last=False)
    return found


def test_question_cache(spark, tmp_path):
    rng = random.Random(7)
    rows, at = [], 0.0
    for k in range(400):
        at += rng.choice([0.5, 3, 20])
        rows.append((k, START + timedelta(seconds=at), f"question {min(rng.randrange(40), rng.randrange(40))}"))
    schema = "event_id long, created_at timestamp, question string"
    want = brute_cache(rows, 5, 100)
    assert 50 < sum(want.values()) < 300
    frame = spark.createDataFrame([*rows, (999, START, None)], schema)
    got = cache.cached_embeddings(frame, shards=1, most=5, live=100).collect()
    assert {r.event_id: r.hit for r in got} == want
    assert all(r.vector == embedding.embedded([r.question], 64)[0].tolist() for r in got)
    sharded = cache.cached_embeddings(frame, shards=4, most=5, live=100).collect()
    for shard in range(4):
        mine = {r.event_id for r in sharded if r.shard == shard}
        assert {r.event_id: r.hit for r in sharded if r.shard == shard} == brute_cache([r for r in rows if r[0] in mine], 5, 100)
    source, out, point = (str(tmp_path / x) for x in ("in", "out", "point"))
    for k in range(0, 400, 100):
        spark.createDataFrame(rows[k : k + 100], schema).coalesce(1).write.mode("append").parquet(source)
        stream = cache.cached_embeddings(spark.readStream.schema(schema).parquet(source), shards=1, most=5, live=100)
        stream.drop("vector").writeStream.format("parquet").option("path", out).option("checkpointLocation", point).trigger(availableNow=True).start().awaitTermination()
    assert {r.event_id: r.hit for r in spark.read.parquet(out).collect()} == want


def test_run_folders_can_be_cleared(spark):
    path = staging(spark, "test-clear")
    spark.range(3).write.parquet(path)
    assert path.startswith(run_folder(spark)) and spark.read.parquet(path).count() == 3
    assert callable(clear)
