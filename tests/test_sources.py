"""Books, content providers, positions and repeated answers against plain Python."""

import io
import os
import random
import time
import zipfile
from difflib import SequenceMatcher
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chats, ranges
from quillspark.plans import catalog
from quillspark.sources import books, content

FOLDER = "/root/testdata/sf0.001"


def book(pages, order=None, title="A Title", extra=(), root="OEBPS/content.opf", encrypt=None):
    out = io.BytesIO()
    order = order if order is not None else list(pages)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", f'<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="{root}"/></rootfiles></container>')
        items = "".join(f'<item id="{k}" href="{k}.xhtml" media-type="application/xhtml+xml" properties="{"nav" if k == "nav" else ""}"/>' for k in pages)
        refs = "".join(f'<itemref idref="{k}"/>' for k in order)
        z.writestr(root, f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{title}</dc:title><dc:language>en</dc:language></metadata><manifest>{items}<item id="css" href="a.css" media-type="text/css"/></manifest><spine>{refs}<itemref idref="gone"/></spine></package>')
        for k, body in pages.items():
            z.writestr(f"OEBPS/{k}.xhtml", body)
        for name, data in extra:
            z.writestr(name, data)
    return out.getvalue()


def test_books(spark):
    pages = {"nav": "<p>contents</p>", "one": "<html><head><style>x</style></head><body><h1>One</h1><p>First  text</p></body></html>", "two": "<p>Second &amp; last</p>", "left": "<p>unlisted</p>"}
    whole = book(pages, ["two", "one"])
    cases = {
        "whole": whole, "empty": b"", "none": None, "torn": whole[: len(whole) // 2], "text": b"no archive", "blank": book({"one": "<p> </p>"}), "locked": book(pages, extra=[("META-INF/rights.xml", "x")]),
        "sealed": book(pages, extra=[("META-INF/encryption.xml", '<CipherReference URI="OEBPS/one.xhtml"/>')]), "fonts": book(pages, ["one"], extra=[("META-INF/encryption.xml", '<CipherReference URI="OEBPS/font.otf"/>')]),
        "no package": book(pages, root="other.opf"), "bytes": book({"one": b"<p>\xff ok</p>"}),
    }
    rows = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in cases.items()], "name string, content binary").withColumn("language", F.lit("x"))
    got = {r.name: r for r in books.book_texts(rows).collect()}
    assert (got["whole"].text, got["whole"].title, got["whole"].language, got["whole"].chapter_count, got["whole"].error) == ("Second & last\n\nOne\nFirst text\n\nunlisted", "A Title", "en", 3, None)
    assert got["fonts"].text.startswith("One") and got["bytes"].text == "� ok"
    faults = {k: r.error for k, r in got.items() if r.error}
    assert faults == {"empty": "file_empty", "none": "file_empty", "torn": "epub_invalid_or_corrupt", "text": "epub_invalid_or_corrupt", "blank": "epub_no_text_extracted", "locked": "epub_encrypted_or_drm", "sealed": "epub_encrypted_or_drm", "no package": "epub_no_text_extracted"}
    assert all(got[k].text == "" and got[k].retryable is False for k in faults)


def test_content_providers(spark, tmp_path):
    folder, out, point = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "point")
    old = time.time() - 1000

    def put(name, data, age):
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
        os.utime(path, (old - age, old - age))

    for k in range(12):
        put(f"d{k % 3}/f{k}.md", b"x" * (k * 1000), 100 - k)
    for name in ("d0/zero.md", "d1/UP.MD", "d1/skip.exe", ".hidden/a.md", "_b.md"):
        put(name, b"", 50)
    assert content.register(spark) == ["filesystem"]
    table = content.content(spark, "filesystem", f"file://{folder}", extensions=".md", partitionBytes=20_000)
    rows = table.collect()
    want = {str(p): p.read_bytes() for p in Path(folder).rglob("*.[mM]*") if not any(x.startswith((".", "_")) for x in p.relative_to(folder).parts)}
    assert {r.path: bytes(r.content) for r in rows} == want and len(rows) == 14 and all(r.size_bytes == len(r.content) for r in rows)
    assert table.filter("size_bytes = 0").count() == 3 and 3 < table.rdd.getNumPartitions() < 14
    assert {r.extension for r in rows} == {".md"} and {(r.provider, r.item_type) for r in rows} == {("filesystem", "file")}

    def run():
        stream = content.content(spark, "filesystem", f"file://{folder}", stream=True, extensions=".md")
        stream.select("path", "size_bytes").writeStream.format("parquet").option("path", out).option("checkpointLocation", point).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.path, r.size_bytes) for r in spark.read.parquet(out).collect())

    first = run()
    assert first == sorted((p, len(d)) for p, d in want.items())
    assert run() == first  # a restart reads nothing twice
    put("d0/f0.md", b"changed", -10)
    put("d9/new.md", b"", -20)
    (folder / "d9/young.md").write_bytes(b"too young")
    os.utime(folder / "d9/young.md", (time.time() + 60, time.time() + 60))
    more = run()
    assert sorted(set(more) - set(first)) == sorted([(str(folder / "d0/f0.md"), 7), (str(folder / "d9/new.md"), 0)]) and len(more) == len(first) + 2
    found = {r.provider: (r.known, r.reachable, r.items) for r in content.health(spark, {"filesystem": f"file://{folder}", "mail": "x"}).collect()}
    assert found["mail"] == (False, False, None) and found["filesystem"][:2] == (True, True)
    assert content.health(spark, {"filesystem": "file:///nowhere/at/all"}).first().reachable is False
    with pytest.raises(KeyError):
        content.content(spark, "mail", "x")


def test_positions(spark):
    rng = random.Random(3)
    held, asked = [], []
    for f in range(6):
        at = rng.randrange(5)
        for v in range(rng.randrange(0, 9)):
            end = at + rng.randrange(1, 9)
            held.append((f, at, end, f"v{v}"))
            at = end + rng.choice([0, 0, 3])
        asked += [(f, k, p) for k, p in enumerate([*range(-1, at + 3), None])]
    asked.append((99, 0, 5))
    got = ranges.valued(spark.createDataFrame(asked, "file_id int, k int, position long").withColumn("value2", F.lit(1)), spark.createDataFrame(held, "file_id int, start int, end int, value string"))
    want = {(f, k): next((v for g, a, z, v in held if g == f and p is not None and a <= p < z), None) for f, k, p in asked}
    assert {(r.file_id, r.k): r.value for r in got.collect()} == want and len({v for v in want.values()}) > 4
    chunks = [(f, k, p, p + n) for f, k, p in asked if p is not None for n in [rng.randrange(0, 7)]]
    spans = ranges.spans(spark.createDataFrame(chunks, "file_id int, chunk_id int, start long, end long"), spark.createDataFrame(held, "file_id int, start int, end int, value string"))
    at = lambda f, p: next((v for g, a, z, v in held if g == f and a <= p < z), None)
    assert {(r.file_id, r.chunk_id): (r.start_value, r.end_value) for r in spans.collect()} == {(f, k): (at(f, a), at(f, z - 1)) if z > a else (None, None) for f, k, a, z in chunks}


def test_repeated_answers(spark):
    def plain(left, right):
        a, b = (left or "").strip(), (right or "").strip()
        return bool(a and b) and (a == b or min(len(a), len(b)) >= 240 and SequenceMatcher(a=a, b=b).ratio() >= 0.9)

    rng = random.Random(5)
    base = " ".join(f"word{rng.randrange(40)}" for _ in range(80))
    edited = lambda n: " ".join(f"x{k}" if rng.random() < n else w for k, w in enumerate(base.split()))
    texts = [base, base + " ", None, "", " ", base, *(edited(n) for n in (0.01, 0.02, 0.05, 0.1, 0.2)), base, base[::-1], base, base[:200], base[:200], base[:239], base[1:240], base[:200] + "y", "same", "same", base * 2, base]
    rows = [(1, k, "assistant", t) for k, t in enumerate(texts)] + [(1, 100, "user", texts[-1]), (2, 0, "assistant", texts[-1])]
    got = {(r.chat_id, r.turn): r.duplicate for r in chats.repeated_answers(spark.createDataFrame(rows, "chat_id int, turn int, role string, content string")).collect()}
    assert got == {(1, k): k > 0 and plain(texts[k - 1], t) for k, t in enumerate(texts)} | {(2, 0): False} and sum(got.values()) >= 4


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")
def test_repeated_answers_of_all_chats(spark):
    got = {(r.chat_id, r.turn): r.duplicate for r in catalog.repeated_answers(spark, FOLDER).collect()}
    docs = {r.doc_id: r.text for r in catalog.corpus.table(spark, FOLDER, "documents").select("doc_id", "text").collect()}
    ids, want = sorted(docs), {}
    for before, now in zip([None, *ids], ids, strict=False):
        a, b = (docs.get(before) or "").strip() if before is not None and before // 100 == now // 100 else "", (docs[now] or "").strip()
        bound = 2 * min(len(a), len(b)) / max(1, len(a) + len(b))
        want[-1 - now // 100, now] = bool(a and b) and (a == b or min(len(a), len(b)) >= 240 and bound >= 0.9 and SequenceMatcher(a=a, b=b).ratio() >= 0.9)
    assert {k: v for k, v in got.items() if k[0] < 0} == want
