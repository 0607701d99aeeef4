"""Every catalogued query with an SQL counterpart gives the same rows as DuckDB; the others run and give rows."""

import math
import re
from pathlib import Path

import duckdb
import pytest

from quillspark.functions import text as T
from quillspark.operators import chats, chunking, terms
from quillspark.plans import catalog

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test data")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return int(v) if isinstance(v, bool) else v if isinstance(v, int) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    rows = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    if name not in catalog.ORACLES:
        assert rows
        return
    found = duck.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(rows, key=key) == sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=key)


def test_names_against_brute_force(spark):
    best, where = {}, {}
    for r in catalog.named_parents(spark, str(FOLDER)).select("id", "file_id", "content").collect():
        for pattern, confidence in ((terms.TITLED, 0.9), (terms.PERSON, 0.6)):
            for m in re.finditer(pattern, r.content):
                if not {"The", "This", "That", "And", "For", "With"} & set(m[1].split()):
                    key = (r.file_id, r.id, m[1])
                    best[key] = max(best.get(key, 0), confidence)
    for (file_id, chunk_id, name), confidence in best.items():
        where.setdefault(name.lower().replace(".", "").replace("  ", " "), []).append((chunk_id, name, confidence, file_id))
    got = {r.norm: r for r in catalog.term_dictionary_build(spark, str(FOLDER)).collect()}
    assert got.keys() == {re.sub(r"\s+", " ", x) for x in where}
    for norm, places in where.items():
        r = got[re.sub(r"\s+", " ", norm)]
        assert (r.n_seen, r.n_files, r.confidence, r.canonical) == (len(places), len({p[3] for p in places}), max(p[2] for p in places), min(places)[1])
    gate = catalog.quality_gate(spark, str(FOLDER)).first()
    kept = sum(x >= 0.65 for x in best.values())
    assert (gate.n_total, gate.n_kept, gate.noise_rate) == (len(best), kept, round(1 - kept / len(best), 6))


def test_admission_and_selection_against_brute_force(spark):
    seen, want = {}, {}
    rows = catalog.corpus.log_events(spark, str(FOLDER)).select("id", "source", "created_at").collect()
    for r in sorted(rows, key=lambda r: (r.created_at, r.id)):
        recent = seen.setdefault(r.source, [])
        want[r.id] = sum((r.created_at - t).total_seconds() < 3600 for t in recent) < 60
        if want[r.id]:
            recent.append(r.created_at)
    assert {r.id: r.admitted for r in catalog.rate_limit_admission(spark, str(FOLDER)).collect()} == want
    found, want = {}, {}
    for r in catalog.candidates(spark, str(FOLDER)).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.chunk_id, r.file_id, r.place))
    for q, held in found.items():
        taken = []
        for cap, fresh in ((1, True), (2, True), (2, False), (99, False)):
            for x in sorted(held):
                if len(taken) < 8 and x not in taken and sum(t[2] == x[2] for t in taken) < cap and not (fresh and any(t[2:] == x[2:] for t in taken)):
                    taken.append(x)
        want |= {(q, x[1]): n + 1 for n, x in enumerate(taken)}
    assert {(r.query_id, r.chunk_id): r.nth for r in catalog.select_coverage_diverse(spark, str(FOLDER)).collect()} == want


def test_texts_against_brute_force(spark):
    """Queries whose patterns SQL can't express, row by row in Python."""
    docs = {r.doc_id: r.text for r in catalog.corpus.table(spark, str(FOLDER), "documents").collect()}
    import hashlib

    for r in catalog.text_clean_glyphs(spark, str(FOLDER)).collect():
        text = re.sub("[\ue000-\uf8ff\u200b\ufeff]", "", re.sub(r"(?i)GLYPH[<&][^>;\s]*[>;]?", "", docs[r.doc_id]))
        text = "\n".join(x for x in text.split("\n") if not re.fullmatch(r"[\ufffd\s]+", x) or not x.strip(" "))
        assert r.digest == hashlib.sha256(text.encode()).hexdigest()
    chunks: dict = {}
    for r in catalog.parent_chunks_budget(spark, str(FOLDER)).union(catalog.child_chunks_budget(spark, str(FOLDER))).collect():
        chunks.setdefault(r.file_id, []).append((r.parent, r.child, r.content, r.section, r.place))
    assert {k: sorted(x) for k, x in chunks.items()} == {k: sorted(chunking.chunk_text(t, 512, 150, 60)) for k, t in docs.items() if t and t.strip()}
    asked = {(r.chat_id, r.turn): r.content for r in catalog.corpus.chat_messages(spark, str(FOLDER)).filter("role = 'user'").collect()}
    got = {(r.chat_id, r.turn): (r.intent, r.years, r.extensions) for r in catalog.query_intent(spark, str(FOLDER)).collect()}
    for key, text in asked.items():
        intent = next((name for name, pattern in chats.INTENTS if re.search(pattern, text)), "focused")
        assert got[key] == (intent, sorted({int(x) for x in re.findall(T.YEAR, text)}), sorted({"." + x for x in re.findall(r"\b(pdf|docx|xlsx|csv|txt|md|html)\b", text.lower())}))
    assert got.keys() == asked.keys()


def test_repairs_leave_nothing(spark):
    rows = catalog.integrity_repaired_counts(spark, str(FOLDER)).collect()
    assert len(rows) == 12 and not any(r.n for r in rows)
