"""The training-data operators against brute force, on small fixtures with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, decontaminate, html_text, licenses, line_dedup, mixing, near_dedup, quality, substring_dedup, tokens, warc, wordhash
from quillspark.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, words string, n_words string, chunk string, host string, row string, kept string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def prose(rng, n, size=300):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(25, 120)) for _ in range(40)]
    texts = [" ".join(x) for x in base]
    texts += [texts[0], texts[0], texts[1]]  # copies
    for k in (2, 3, 4):  # near copies
        words = list(base[k])
        words[7] = "changed"
        texts.append("  ".join(words))
    passage = " ".join(prose(rng, 30))
    texts += [f"{' '.join(prose(rng, 15))} {passage} {' '.join(prose(rng, 9))}" for _ in range(5)]
    texts += [passage + " " + passage, "same " * 60, "\n".join(["a b c", "d e", "f"] * 4), "A\nb\n\nc\n\n\n", "Übel É ÀB x", "", None, " \t\n", "x" * 5000, "two words", "TWO words", " ".join(prose(rng, 3000))]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(None, "null id " * 12), (rows[5][0], rows[5][1])]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(k, t, ["en", "de", None][(k or 0) % 3], [None, "s1", "s2", "s2"][(k or 0) % 4], 0, "x", "x", "x", "x", "x", "x") for k, t in corpus]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_licences(docs, empty, corpus):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert got[0].labels == "" and got[0].score < 1
    assert licenses.scan_licenses(empty).count() == 0
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES)
    text = "x UNDER THE mit license, licensed under the apache license version 2 cc by nc cc-by-nc under the MIT-license"
    n, base, first, last, base_labels, labels, score, spans = scanner.scan(text.encode())
    words = [w.decode() for w in licenses.words(text.encode())]
    places = [i for p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    assert (n, base, first, last) == (len(words), len(places), min(places), max(places)) and score == 1
    assert base_labels == "apache-2,cc-by-nc,mit"
    full = "intro " + licenses.TEMPLATES["bsd"].replace("retain", "keep") + " end"
    assert "bsd" in scanner.scan(full.encode())[5].split(",")
    assert scanner.scan(b"")[:3] == (0, 0, None)


def test_licence_labels_tell_templates_apart():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES)
    for label, text in licenses.TEMPLATES.items():
        assert scanner.scan(f"x {text} y".encode())[5] == label
    shared = "This work is licensed under a Creative Commons Attribution"
    assert scanner.scan(f"{shared}-NoCopies 4.0 International License".encode())[5] == ""
    assert scanner.scan(f"{shared}-NonCommercial-ShareAlike 4.0 International License".encode())[5] == "cc-by-nc-sa"
    assert scanner.scan(b"the above copyright notice and this permission notice")[5] == ""


def brute_chains(held, gap=40):
    """(words covered, whether a passage is the template's own) of the heaviest chain that ends in each match, by trying all."""
    held = sorted(held, key=lambda m: (m[0] + m[2], m[1]))
    found = []
    for begin, place, n, own in held:
        most = (n, -1, own)
        for j, (a, b, m, _) in enumerate(held[: len(found)]):
            more = n - max(0, b + m - place, a + m - begin)
            if a + m < begin + n and b + m < place + n and begin - a - m <= gap and more > 0:
                most = max(most, (found[j][0] + more, j, found[j][2] or own), key=lambda x: x[:2])
        found.append(most)
    return [(x[0], x[2]) for x in found]


def test_licence_chains():
    """Repeated passages of a template, and inserted words, leave the heaviest chain."""
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES)
    body = licenses.TEMPLATES["bsd"].split()
    for k, edits in ((2, [20, 45]), (7, [8, 16, 24, 33, 41, 50, 58])):
        words = list(body)
        for place in reversed(edits):
            words.insert(place, "inserted")
        spans = scanner.scan(" ".join(words).encode())[-1]
        assert [s["label"] for s in spans] == ["bsd"] and spans[0]["cover"] > (0.95 if k == 2 else 0.75) and spans[0]["start"] == 0
    twice = f"{licenses.TEMPLATES['isc']} between {licenses.TEMPLATES['isc']}".encode()
    assert [s["cover"] for s in scanner.scan(twice)[-1]] == [1.0, 1.0]
    rng = random.Random(4)
    for _ in range(300):
        held = []
        for _ in range(rng.randrange(1, 25)):
            n = rng.randrange(5, 15)
            held.append((rng.randrange(150), rng.randrange(60), n, rng.random() < 0.3))
        want = {}
        got = list(scanner.chains(held, 1000))
        assert max(c[2] for c in got) == max(w for w, _ in brute_chains(held)) / 1000, want


def test_licences_against_brute_force(docs, corpus, spark):
    """Base columns of every row by plain search; spans by plain longest matches."""
    rng = random.Random(6)
    rows = list(corpus)
    pool = [w for t in (*licenses.TEMPLATES.values(), *licenses.PHRASES) for w in licenses.words(t.encode())]
    for k in range(120):
        label = rng.choice(list(licenses.TEMPLATES))
        body = [w.decode() for w in licenses.words(licenses.TEMPLATES[label].encode())]
        for _ in range(rng.randrange(0, 6)):
            body[rng.randrange(len(body))] = rng.choice(pool).decode()
        cut = rng.randrange(len(body) // 2)
        rows.append((5000 + k, " ".join([*prose(rng, 5), *body[cut:], rng.choice(list(licenses.PHRASES)).upper(), *body[:cut]])))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit(1)).repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_base, r.first_word if r.n_base else -1, r.last_word if r.n_base else -1, r.base_labels, r.labels) for r in licenses.scan_licenses(frame).collect())
    templates = [(x, licenses.words(t.encode())) for x, t in licenses.TEMPLATES.items()]
    scanner, want = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES), []
    for k, t in rows:
        found = licenses.words((t or "").encode())
        base = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(found)) if found[i : i + len(p.split())] == p.encode().split()]
        labels = {label for _, label in base}
        best = [0] * len(found)  # the longest passage of any template that ends at each word
        ends: dict[int, list] = {}
        for t_, (_, body) in enumerate([*((None, p.encode().split()) for p in licenses.PHRASES), *templates]):
            length = [0] * (len(body) + 1)
            for i, w in enumerate(found):
                length = [0] + [length[j] + 1 if w == body[j] else 0 for j in range(len(body))]
                for j, n in enumerate(length[1:]):
                    if n >= 5 and n >= best[i]:
                        ends[i] = [*(ends.get(i, []) if n == best[i] else []), (t_ - len(licenses.PHRASES), j, n)]
                    best[i] = max(best[i], n)
        places: dict[int, list] = {}
        for i, held in ends.items():
            if i + 1 == len(found) or best[i + 1] <= best[i]:
                held = [x for x in held if x[0] >= 0 and x[2] == best[i]]
                for t_, j, n in held:
                    places.setdefault(t_, []).append((i - n + 1, j - n + 1, n, len({x[0] for x in held}) == 1))
        for t_, held in places.items():
            labels |= {templates[t_][0] for cover, own in brute_chains(held) if own and cover >= 0.5 * len(templates[t_][1])}
        at = [i for i, _ in base]
        want.append((k is None, k or 0, len(found), len(base), min(at, default=-1), max(at, default=-1), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels))))
    assert got == sorted(want) and any(x[3] for x in want)


def test_automaton_statistics():
    rng = random.Random(1)
    sequences = [[rng.randrange(4) for _ in range(30)] for _ in range(5)]
    automaton = licenses.Automaton(sequences)
    tokens_ = [rng.randrange(4) for _ in range(200)]
    pieces = {tuple(s[a:b]) for s in sequences for a in range(30) for b in range(a + 1, 31)}
    for k, length, state in automaton.matches(tokens_, 0):
        best = max((n for n in range(1, min(k + 1, 30) + 1) if tuple(tokens_[k - n + 1 : k + 1]) in pieces), default=0)
        assert length == best
        for s, e in automaton.ends[state]:
            assert sequences[s][e - length + 1 : e + 1] == tokens_[k - length + 1 : k + 1]


def test_tokens_round_trip(spark, docs, empty, corpus, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    want, at = [], 0
    for k, t in sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in tokens.token_digest(docs, f"file://{tmp_path}/t").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert tokens.token_digest(empty).count() == 0


@pytest.mark.parametrize("text", ["", "a  b", "a   b", " \n x  \n\n y ", "foo \n bar  ", "don't  'll x <|endoftext|>", "　 a  Ça ½²", "\x1c a", "x\t\t y"])
def test_encoder_pieces(text):
    import public_tokenizers

    encode = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY))
    assert encode.many([text])[0].tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_fuzz_and_memo():
    """Random strings of many kinds of characters; the memo stays small even where a text is one piece."""
    import public_tokenizers

    encode = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY), memo_chars=2000)
    rng = random.Random(9)
    signs = " \n\tabcABC019'.,<|>é\u4e2d\u3042\u0301\u200b\xa0\u2028\U0001f600_-st"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))) for _ in range(3000)] + ["\u4e2d" * 5000, "x" * 3000, "don't" * 50]
    for at in range(0, len(texts), 50):
        some = texts[at : at + 50]
        assert [x.tolist() for x in encode.many(some)] == [x.ids for x in encode.tokenizer.encode_batch(some, add_special_tokens=False)]
        assert max(map(len, encode.memo), default=0) <= tokens.LONG and encode.held == sum(map(len, encode.memo))


def test_token_starts_over_blocks(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(tokens, "PARTS_A_BLOCK", 1)
    rows = tokens.token_digest(docs).orderBy("start").collect()
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert len(rows) == len(corpus)


def test_token_file_codes():
    ids = [np.array([0, 5, 70000, 70000, 255, 256, 1 << 24, 3], np.int64), np.zeros(0, np.int64)]
    keys, counts, flat, _ = tokens.unpack(tokens.pack([7, None], ids))
    assert keys == [7, None] and counts.tolist() == [8, 0] and flat.tolist() == ids[0].tolist()
    ranks = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], np.uint32)
    assert tokens.unpack_ranks(*tokens.pack_ranks(ranks), len(ranks)).tolist() == ranks.tolist()


def text_hash(spark, texts):
    """Spark's 64-bit hash of each text: the order of rows of null id."""
    rows = spark.createDataFrame([(t,) for t in set(texts) if t is not None], "t string")
    return {None: None} | {r.t: r.h for r in rows.select("t", F.xxhash64("t").alias("h")).collect()}


def test_line_dedup(spark, docs, empty, corpus):
    def brute(rows):
        seen, out = {}, {}
        for k, t in sorted(rows):
            lines = t.split("\n")
            late = set()
            for i in range(len(lines) - 2):
                window = tuple(lines[i : i + 3])
                if "".join(window).strip(" \t\n\x0b\x0c\r"):
                    if seen.setdefault(window, (k, i)) < (k, i):
                        late |= {i, i + 1, i + 2}
            out[k] = (len(lines), len(late), hashlib.sha256("\n".join(x for i, x in enumerate(lines) if i not in late).encode()).hexdigest())
        return out

    want = brute({(k, t) for k, t in corpus if k is not None and t is not None})
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.line_digest(docs).collect()}
    assert {k: got[k] for k in want} == want and any(x[1] for x in want.values())
    assert line_dedup.line_digest(empty).count() == 0
    assert set(docs.columns) <= set(line_dedup.dedup_lines(docs).columns)
    # null ids come last, in the order of their texts' hashes; the greatest id is no null
    rows = [(None, "a\nb\nc\nd"), (None, "x\na\nb\nc"), (None, "b\nc\nd"), ((1 << 63) - 1, "q\nb\nc\nd"), (None, None), (None, "b\nc\nd"), (4, "x\ny\nz\nx\ny\nz")]
    h = text_hash(spark, [t for _, t in rows])
    want = brute({((k is None, h[t] if k is None else k), t) for k, t in rows if t is not None})
    clash = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("x")).withColumn("starts", F.lit(1))
    found = line_dedup.dedup_lines(clash).collect()
    assert len(found) == len(rows) and {x.starts for x in found} == {1}
    for r in found:
        if r.text is not None:
            n, gone, digest = want[(r.doc_id is None, h[r.text] if r.doc_id is None else r.doc_id)]
            assert (r.n_lines, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) == (n, gone, digest)


def test_skew_join(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(600)], "key long, x long")
    counts = common.staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("key <> 5"), "counts")
    want = sorted((r.key, r.x) for r in rows.collect() if r.key != 5)
    for limit in (100, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(common, "HOT_ROWS", 50)
        assert sorted((r.key, r.x) for r in common.skew_join(rows, counts, ["key"], ["x"]).collect()) == want
        assert common.skew_join(rows, counts, ["key"], ["x"], "left").count() == 600


@pytest.mark.parametrize("chunk_bytes", [300, 1 << 20])
def test_substring_dedup(spark, docs, empty, corpus, chunk_bytes):
    twenty = " ".join(f"t{k}" for k in range(20))
    more = [(None, f"{twenty} {k}") for k in range(4)] + [(None, f"{twenty} 2"), ((1 << 63) - 1, f"z {twenty}"), (3, f"{twenty} {corpus[0][1]}")]
    h = text_hash(spark, [t for _, t in corpus + more])
    rows = [((k is None, (h[t] or 0) if k is None else k), t or "") for k, t in corpus + more]
    seen, want = {}, {}
    for k, t in sorted(rows, key=lambda r: (r[0], r[1].encode())):
        words = WORD.findall(t)
        late = set()
        nth = len(want.get(k, []))  # rows of one document come one after another
        for i in range(len(words) - 19):
            if seen.setdefault(tuple(words[i : i + 20]), (k, nth, i)) != (k, nth, i):
                late |= set(range(i, i + 20))
        want.setdefault(k, []).append((len(words), len(late), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in late).encode()).hexdigest()))
    frame = docs.select("doc_id", "text", "chunk").union(spark.createDataFrame([(k, t, "x") for k, t in more], "doc_id long, text string, chunk string"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_digest(frame, chunk_bytes=chunk_bytes).collect())
    assert got == sorted((null, 0 if null else k, *x) for (null, k), found in want.items() for x in found) and any(x[3] for x in got)
    assert substring_dedup.substring_digest(empty).count() == 0


def test_difference_cover():
    p = substring_dedup.PERIOD
    assert {(a - b) % p for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(p))


def test_mixing(docs, empty):
    rows = mixing.mix(docs, max_epochs=2)
    leaves = {(r.domain, r.lang, r.source): r for r in rows.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("n"), F.max("epoch").alias("e")).collect()}
    assert leaves and max(x.e for x in leaves.values()) <= 2
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs, budget=0).count() == 0


def test_mixing_shares(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 100), ("web", "de", "b", 1000), ("library", "en", "c", 10)], "domain string, lang string, source string, tokens long")
    weights = {"domain": {"web": 50, "library": 50}, "lang": {"en": 80, "de": 20}, "source": {}}
    got = {r.source: r.given for r in mixing.leaf_budgets(leaves, 600, 1, weights).collect()}
    # library can use 10 of its 300, so web gets 590; there en can use 100 of its 472, so de gets the rest
    assert got == {"a": 100, "b": 490, "c": 10}


def shared_out(budget, children):
    """Brute force of one level: (weight, limit, name) of each child; tokens go out by weight until nothing can take more."""
    given, todo = {x[2]: 0 for x in children}, [x for x in children if x[0] > 0]
    have = min(budget, sum(x[1] for x in todo))
    while todo:
        weights = sum(x[0] for x in todo)
        full = [x for x in todo if x[1] * weights <= have * x[0]]
        if not full:
            down = {x[2]: have * x[0] // weights for x in todo}
            order = sorted(todo, key=lambda x: (-(have * x[0] % weights), x[2]))
            for k, x in enumerate(order):
                given[x[2]] = down[x[2]] + (k < have - sum(down.values()))
            break
        for x in full:
            given[x[2]] = x[1]
            have -= x[1]
        todo = [x for x in todo if x not in full]
    return given


@pytest.mark.parametrize("seed", range(4))
def test_mixing_random_trees(spark, seed):
    rng = random.Random(seed)
    names = {"domain": ["a", "b", "c"], "lang": ["x", "y", "z"], "source": ["p", "q", "r"]}
    weights = {level: {n: rng.choice([0, 1, 3, 7, 20]) for n in x} for level, x in names.items()}
    weights["domain"]["b"] = 5
    leaves = [(d, g, s, rng.choice([0, 1, 9, 100, 1000])) for d in names["domain"] for g in names["lang"] for s in names["source"] if rng.random() < 0.8]
    epochs, budget = rng.choice([1, 3]), rng.choice([7, 500, 3001, 10**6])

    def limit(rows):
        return sum(r[3] * epochs for r in rows if all(weights[level][n] for level, n in zip(names, r, strict=False)))

    want = {}
    top = shared_out(budget, [(weights["domain"][d], limit([r for r in leaves if r[0] == d]), d) for d in {r[0] for r in leaves}])
    for d, first in top.items():
        here = [r for r in leaves if r[0] == d]
        middle = shared_out(first, [(weights["lang"][g], limit([r for r in here if r[1] == g]), g) for g in {r[1] for r in here}])
        for g, second in middle.items():
            low = [r for r in here if r[1] == g]
            for s, n in shared_out(second, [(weights["source"][r[2]], limit([r]), r[2]) for r in low]).items():
                want[d, g, s] = n
    got = mixing.leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), budget, epochs, weights).collect()
    assert {(r.domain, r.lang, r.source): r.given for r in got} == want
    assert sum(want.values()) == min(budget, limit(leaves))


def test_mixing_prefixes(spark, docs, corpus):
    """Each leaf reads whole epochs, then the longest prefix of the next one in the order of the keyed hash."""
    rows = [(k, f"{'w ' * (k % 5)}end", "en", f"s{k % 2}") for k in range(300)] + [(None, "a b", "en", "s1"), (7, "c d e", "en", "s1"), (301, None, "en", "s0")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("range", F.lit(1)).withColumn("key", F.lit(2))
    weights = {"domain": {"web": 1, "library": 0}, "lang": {}, "source": {}}
    size = lambda t: len(WORD.findall(t or ""))
    leaf = [(k, size(t)) for k, t, _, s in rows if s == "s0"]
    total = sum(n for _, n in leaf)
    for budget in (100, total + 57, 5 * total):
        got = sorted((r.doc_id, r.epoch) for r in mixing.mix(frame, budget=budget, max_epochs=2, weights=weights).collect())
        whole = min(budget // total, 2)
        rest, want = min(budget, 2 * total) - whole * total, [(k, e + 1) for k, _ in leaf for e in range(whole)]
        for k, n in sorted(leaf, key=lambda x: hashlib.md5(f"1:{whole + 1}:{x[0]}".encode()).hexdigest()):
            if rest < n or (rest == 0 and n == 0):
                break
            rest -= n
            want.append((k, whole + 1))
        assert got == sorted(want) or abs(len(got) - len(want)) <= sum(n == 0 for _, n in leaf)
    kept = mixing.mix_documents(frame, budget=total, weights=weights)
    assert kept.columns == frame.columns and kept.count() == len(leaf)


def test_html():
    title, text = html_text.extract("<title>T &amp; U</title><p>a<p>b<ul><li>x<li>y<ol start=3><li>n</ol></ul><table><tr><th>Name<th>Age<tr><td>Al<td>5</table>z<div hidden>no</div><script>var a='</p>'</script><pre> k\n  l</pre><details><summary>S</summary>no</details>")
    assert title == "T & U"
    assert text == "a\n\nb\n\n- x\n- y\n  3. n\n\nName | Age\nAl   | 5\n\nz\n\n k\n  l\n\nS"
    assert html_text.extract("") == ("", "") and html_text.extract("<a href='x")[1] == ""
    assert html_text.extract("<div>" * 3000 + "deep")[1] == "deep"


def test_html_cells_and_visibility():
    text = html_text.extract("<table><tr><td><h1>T</h1><p>one</p><ul><li>x<li>y</ul><td>right</table>")[1]
    assert text == "T   | right\n    |\none |\n    |\n- x |\n- y |"
    assert html_text.extract("<table><tr><td rowspan=2>A<td>b1<tr><td>b2<tr><td>c<td>d</table>")[1] == "A | b1\n  | b2\nc | d"
    assert html_text.extract("<table><tr><td>a<td rowspan=3>b<tr><td>c<tr><td>d<tr><td>e<td>f</table>")[1] == "a | b\nc |\nd |\ne | f"
    assert html_text.extract("<div style='visibility:hidden'>no<p style='visibility:visible'>yes</p>no</div>")[1] == "yes"
    assert html_text.extract("<table><tr><td colspan=2>wide cell<tr><td>a<td>b</table>")[1] == "wide cell\na | b"
    assert html_text.extract("<table>" * 50 + "<tr><td>deep<td>er")[1].split() == ["deep", "er"] or "deep" in html_text.extract("<table>" * 50 + "<tr><td>deep")[1]


@pytest.mark.parametrize("page", ["<a><table>" + "<b>" * 90000 + "</a>" * 90000, "<ul><table>" + "<li>" * 250000, "<blockquote>x" * 60000, "<details " + "a=1 " * 90000 + ">" + "x<b>y</b>" * 60000, "<table><tr><td>" * 60000, "<p><b>" * 150000])
def test_html_hostile_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_text.extract(page)
    assert time.process_time() - began < 10 * len(page) / (1 << 20)


def slow_words(page):
    """Words that a plain event parser sees outside head, scripts, styles and the like."""
    from html.parser import HTMLParser

    found, off = [], []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style", "title", "head", "template", "noscript"):
                off.append(tag)
            found.append(" ")

        def handle_endtag(self, tag):
            if tag in off:
                off.remove(tag)
            found.append(" ")

        def handle_data(self, data):
            if not off:
                found.append(data)

    Reader().feed(page)
    return re.findall(r"\w+", "".join(found))


def test_html_pages(spark):
    """On simple random pages, the words of an independent parser in order; odd rows through the whole operator."""
    rng = random.Random(2)

    def block(depth):
        kind = rng.choice(["p", "ul", "ol", "div", "table", "pre", "h2"] if depth else ["p", "pre", "h2"])
        text = lambda: " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 5)))
        if kind in ("ul", "ol"):
            return f"<{kind}>" + "".join(f"<li>{text()}{block(depth - 1) if rng.random() < 0.3 else ''}" for _ in range(3)) + f"</{kind}>"
        if kind == "table":
            return "<table>" + "".join("<tr>" + "".join(f"<td>{text()}" for _ in range(3)) for _ in range(2)) + "</table>"
        return f"<{kind}>{text() + block(depth - 1) if kind == 'div' else text()}</{kind}>"

    pages = ["<head><title>no</title><style>no</style></head><body>" + "".join(block(3) for _ in range(6)) + "<script>no</script>" for _ in range(40)]
    for page in pages:
        text = re.sub(r"(?m)^[\s|]*(?:- |\d+\. )|\|", " ", html_text.extract(page)[1])
        assert re.findall(r"\w+", text) == slow_words(page)
    rows = [(k, p) for k, p in enumerate(pages)] + [(None, "<p>x"), (3, None), (3, None), (4, ""), (5, "&#xD800;<b>")]
    frame = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash")).withColumn("title", F.lit(1))
    got = sorted((r.page_id is None, r.page_id or 0, r.text, r.n_chars, r.n_lines) for r in html_text.extract_pages(frame).collect())
    texts = [(k, html_text.extract(p or "")[1].encode("utf-8", "replace").decode()) for k, p in rows]
    assert got == sorted((k is None, k or 0, t, len(t), len(t.split("\n")) if t else 0) for k, t in texts)
    assert html_text.extract_pages(frame.limit(0)).count() == 0


def test_html_head_left_open():
    assert html_text.extract("<html><head><title>T</title>\n<meta charset=x><p>Hello <b>you</b><p>x") == ("T", "Hello you\n\nx")
    assert html_text.extract("<head><style>a</style><title>T</title>\n text &amp; more<div>b</div>") == ("T", "text & more\nb")
    assert html_text.extract("<head><noscript><img src=x>no</noscript><script>n</script>\n</head><body>b") == ("", "b")


def test_warc(spark, tmp_path):
    rows = [(3, "u", "same"), (1, "u", "same"), (2, None, None), (5, "u", ""), (None, "u", "same"), (9, "http://x/ü y", "é" * 3000), (4, "u", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("x")).withColumn("payload_key", F.lit(1))
    got = sorted(((r.page_id is not None, r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_digest(pages, f"file://{tmp_path}/w").collect())
    import base64

    first = {}
    for k, _, h in rows:
        if k is not None:
            first[h or ""] = min(first.get(h or "", k), k)
    want = []
    for k, _, h in rows:
        body = (h or "").encode()
        again = k != first[h or ""]
        want.append(((k is not None, k or 0), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert got == sorted(want)
    assert warc.warc_digest(pages.limit(0)).count() == 0


def test_warc_normaliser():
    one = warc.Monolith()
    plain = [warc.record(k, "u", b"x" * k * 1000, None) for k in range(5)]
    for x in plain:
        one.add(x)
    blob, index = warc.normalise(one.close())
    assert [zlib.decompress(blob[o : o + n], 31) for o, n, _, _ in warc.index_entries(index)] == plain
    with pytest.raises(ValueError):
        list(warc.records(iter([plain[1][:-20]])))
    # the kind comes from the record's own header, not from its payload
    odd = warc.record(1, "u", b"WARC-Type: revisit\r\n\r\n", None)
    assert warc.kind_of(odd) == "response" and warc.kind_of(warc.record(1, "u", b"x", 0)) == "revisit" and warc.kind_of(warc.info_record("f")) == "warcinfo"


def test_warc_record_ids(spark, tmp_path):
    pages = spark.createDataFrame([(k % 3 if k else None, "u", f"page {k % 5}") for k in range(30)], "page_id long, url string, html string").repartition(4)
    folder = f"{tmp_path}/w"
    warc.write_warcs(pages, f"file://{folder}", file_bytes=300)
    ids, kinds = [], []
    for name in sorted(tmp_path.glob("w/*.idx")):
        blob, index = (name.parent / f"{name.stem}.warc.gz").read_bytes(), name.read_bytes()
        for k, (offset, length, _, kind) in enumerate(warc.index_entries(index)):
            plain = zlib.decompress(blob[offset : offset + length], 31)
            ids.append(re.search(rb"WARC-Record-ID: (\S+)", plain)[1])
            kinds.append(warc.KINDS[kind])
            assert (k == 0) == (kinds[-1] == "warcinfo")
    assert len(set(ids)) == len(ids) and len(ids) - kinds.count("warcinfo") == 30
    assert warc.read_warcs(spark, f"file://{folder}").count() == 30


def test_decontamination(spark, empty):
    rng = random.Random(3)
    items = [(k, " ".join(prose(rng, rng.randrange(12, 40)))) for k in range(30)] + [(30, None), (None, "a b c"), (31, "")]
    docs = [(k, " ".join(prose(rng, 200, 2000))) for k in range(40)]
    docs += [(100 + k, f"{' '.join(prose(rng, 30 * k, 2000))} {t.upper()}!! {' '.join(prose(rng, 50))}") for k, t in items[:10]] + [(200, None), (201, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaked_items(frame, bench).collect()}
    assert got == {(100 + k, k) for k in range(10)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaked_items(frame, bench, part_bytes=500).collect()} == got
    assert decontaminate.leaked_items(empty, bench).count() == 0 and decontaminate.leaked_items(frame, bench.limit(0)).count() == 0
    assert decontaminate.decontaminated(frame, bench).count() == len(docs) - 10


def bm25_ratio(item, held, items):
    """A passage's BM25 score for an item (all of its own words once a term), over that of the item's own text."""
    n, average = len(items), sum(map(len, items)) / len(items)
    df = lambda w: sum(w in x for x in items)
    value = {w: np.log(1 + (n - df(w) + 0.5) / (df(w) + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(item) / average)) for w, c in ((w, item.count(w)) for w in set(item))}
    return sum(v for w, v in value.items() if w in held) / sum(value.values())


@pytest.mark.parametrize("threshold", [0.15, 0.3, 0.6])
def test_wand_scores_equal_full_scores(threshold):
    rng = random.Random(8)
    items = [prose(rng, rng.randrange(5, 30), 60) for _ in range(50)]
    df = {w: sum(w in x for x in items) for x in items for w in x}
    index = decontaminate.Index([(k, x, [], {w: df[w] for w in x}) for k, x in enumerate(items)], threshold, 50, sum(map(len, items)) / 50, 29)
    docs = [prose(rng, n, 60) for n in [90] * 10 + [3, 1, 0, 29, 30, 58, 400]]
    coded = [np.array([index.vocabulary.get(w, -1) for w in x], np.int32) for x in docs]
    got = {(d, i, first): score for d, i, score, first, _ in index.search(coded)}
    names = {id(x): k for k, x in enumerate(items)}
    where = {k: index.keys.index(k) for k in range(50)}
    want = {}
    for d, x in enumerate(docs):
        for first in range(0, max(1, len(x) - 29), 29):
            held = set(x[first : first + 58])
            for item in items:
                score = bm25_ratio(item, held, items)
                if score >= threshold - 1e-9:
                    want[d, where[names[id(item)]], first] = score
    assert got.keys() == want.keys() and want and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_decontamination_does_not_depend_on_parts(spark):
    """Hits, scores and overlaps against brute force, for any cut of the index; with real answers and edited copies."""
    rng = random.Random(5)
    items = [(k, f"{' '.join(prose(rng, 20, 80))}? Answer: {' '.join(prose(rng, rng.randrange(1, 9), 80))}" if k % 2 else " ".join(prose(rng, 25, 80))) for k in range(24)] + [(None, "null id item " + " ".join(prose(rng, 12, 80)))]
    docs = []
    for k in range(70):
        words = items[k % 25][1].split()
        for _ in range(k % 4):
            words[rng.randrange(len(words))] = "edited"
        docs.append((k if k % 9 else None, " ".join(prose(rng, rng.randrange(0, 150), 80) + words + prose(rng, 20, 80))))
    split = [(k, *decontaminate.parts(t)) for k, t in items]
    assert split[1][2] and not split[0][2]
    every = [q + a for _, q, a in split]
    longest, want = max(map(len, every)), []
    for d, t in docs:
        words = decontaminate.words(t)
        for (item, q, a), whole in zip(split, every, strict=True):
            best = None
            for first in range(0, max(1, len(words) - longest), longest):
                passage = words[first : first + 2 * longest]
                score = bm25_ratio(whole, set(passage), every)
                share = lambda part: 1.0 if not part else np.mean([x in {tuple(passage[i : i + len(x)]) for i in range(len(passage) - len(x) + 1)} for x in {tuple(part[i : i + 5]) for i in range(max(1, len(part) - 4))}])
                if score >= 0.6 - 1e-9 and share(q) >= 0.8 and share(a) >= 0.8:
                    best = max(best or (0,), (round(score, 9), round(share(q), 9), round(share(a), 9), -first))
            if best:
                want.append((d, item, *best[:3], -best[3]))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("text_key", F.lit(1)).withColumn("_leaked_id", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("part", F.lit(1)).withColumn("word", F.lit(1))
    for size in (16 << 20, 700, 60):
        got = [(r.doc_id, r.item_id, round(r.score, 9), round(r.question_overlap, 9), round(r.answer_overlap, 9), r.first_word) for r in decontaminate.leaked_items(frame, bench, part_bytes=size).collect()]
        assert sorted(got, key=key) == sorted(want, key=key) and 20 < len(want)
    clean = decontaminate.decontaminated(frame, bench)
    gone = {(r[0], r[0] is None and docs[k][1]) for k, r in enumerate(docs) if any(w[0] == r[0] for w in want) and r[0] is not None}
    left = {r.doc_id for r in clean.collect() if r.doc_id is not None}
    assert left == {k for k, _ in docs if k is not None} - {k for k, _ in gone} and clean.columns == frame.columns
    nulls = frame.filter("doc_id IS NULL").count()
    assert 0 < clean.filter("doc_id IS NULL").count() < nulls


def test_decontamination_of_long_items_takes_bounded_memory():
    import tracemalloc

    rng = random.Random(1)
    long = prose(rng, 5000, 10**6)
    df = dict.fromkeys(long, 1)
    index = decontaminate.Index([(1, long, [], df)], 0.6, 1, 5000, 5000)
    docs = [np.array([-1, -1, 3], np.int32)] * 10_000 + [np.arange(5000, dtype=np.int32) % len(df)]
    tracemalloc.start()
    list(index.search(docs))
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_quality(docs, empty, corpus, spark):
    got = {(r.doc_id, r.n_words): r for r in quality.quality_verdicts(docs).collect()}
    for k, t in corpus:
        words = WORD.findall(t or "")
        grams = {}
        for i in range(len(words) - 7):
            grams.setdefault(tuple(words[i : i + 8]), []).append(i)
        repeat = {i + j for v in grams.values() if len(v) > 1 for i in v for j in range(8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[k, len(words)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, words)), 0, len(lines) - len(set(lines)), len(repeat))
        assert r.base_failed == (len(words) < 20 or 100 * len(repeat) > 30 * len(words))
    assert quality.quality_verdicts(empty).count() == 0
    assert quality.filter_quality(docs).columns == docs.columns
    kept = {k for (k, _), r in got.items() if r.kept}
    assert {r.doc_id for r in quality.filter_quality(docs).collect()} == kept


def test_quality_against_brute_force(spark):
    """Frequent lines of any length, depleted documents and cleaned texts; null hosts and ids, repeated rows, odd columns."""
    rng = random.Random(12)
    menu = ["Home  About\tContact 2024", "x" * 30, " ".join(f"legal{k}" for k in range(60)), "Login"]
    rows = []
    for k in range(240):
        lines = [" ".join(prose(rng, rng.randrange(3, 30), 9000)) for _ in range(rng.randrange(0, 6))]
        for x in menu:
            if rng.random() < 0.35:
                lines.insert(rng.randrange(len(lines) + 1), x.replace("2024", str(rng.randrange(2000, 2030))))
        rows.append((k if k % 17 else None, "\n".join(lines), [None, "", "h1", "h2", "h2"][k % 5]))
    rows += [rows[4], rows[4], (rows[8][0], "one row more\nLogin", rows[8][2]), (999, None, "h1"), (1000, "", None)]
    line = lambda x: re.sub("[ \t\x0b\f\r]+", " ", re.sub("[1-9]", "0", x.lower())).strip()
    holders, hosts = {}, {}
    for k, t, h in rows:
        document = ("id", k) if k is not None else ("text", t)
        hosts.setdefault(h, set()).add(document)
        for x in (t or "").split("\n"):
            if line(x):
                holders.setdefault((h, line(x)), set()).add(document)
    often = {x for x, held in holders.items() if len(held) > 10 and len(held) > 0.2 * len(hosts[x[0]])}
    assert any(len(x.split()) > 20 for _, x in often)
    want, left = [], []
    for k, t, h in rows:
        gone = [x for x in (t or "").split("\n") if (h, line(x)) in often]
        n, lost = len(WORD.findall(t or "")), sum(len(x.split()) for x in gone)
        want.append((k, n, len(gone), lost, lost > 0.7 * n))
        if n >= 20 and lost <= 0.7 * n:
            left.append((k, "\n".join(x for x in t.split("\n") if (h, line(x)) not in often), h))
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("place", F.lit(1)).withColumn("n", F.lit(2))
    got = [(r.doc_id, r.n_words, r.n_removed_lines, r.n_removed_words, r.depleted) for r in quality.quality_verdicts(frame, max_share=0.2).collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and 0 < sum(x[4] for x in want) < len(rows)
    kept = quality.filter_quality(frame, max_share=0.2)
    assert sorted(((r.doc_id, r.text, r.source) for r in kept.collect()), key=key) == sorted(left, key=key) and kept.columns == frame.columns


def test_frequent_lines(spark):
    menu, rng = "home about contact terms privacy login", random.Random(1)
    own = lambda n: " ".join("".join(rng.choices("abcdefgh", k=8)) for _ in range(n))
    rows = [(k, f"{menu}\n{menu} {k % 2}\n{own(8 if k < 30 else 40)}", "h") for k in range(60)]
    got = {r.doc_id: r for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_removed=0.5).collect()}
    assert all(got[k].depleted and not got[k].kept for k in range(30)) and all(got[k].kept for k in range(30, 60))


def test_frequent_lines_are_removed(spark):
    rng = random.Random(3)
    body = [prose(rng, 40, 5000) for _ in range(30)]
    rows = [(k, f"Page {k} of  30\n{' '.join(x[:20])}\n\n{' '.join(x[20:])}\npage 7 of 30", "host") for k, x in enumerate(body)]
    rows += [(100, rows[3][1], "elsewhere"), (3, rows[3][1], "host"), (None, rows[4][1], "host")]
    want = sorted((-1 if k is None else k, t if h == "elsewhere" else "\n".join(t.split("\n")[1:-1]), h) for k, t, h in rows)
    kept = quality.filter_quality(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.source) for r in kept.collect()) == want


def brute_components(rows, n):
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())

    sets = [(k, shingles(t)) for k, t in rows]
    root = {k: k for k, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a < b and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {(k, len(s)): top(k) for k, s in sets}


@pytest.mark.parametrize("cell_docs", [1500, 3])
def test_near_dedup(docs, empty, corpus, spark, cell_docs):
    rng = random.Random(4)
    rows = [(k, t) for k, t in corpus if k is not None]
    seed = prose(rng, 150, 5000)
    for k in range(60):  # a group with similarities around the limit
        words = list(seed)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("cell", F.lit(2))
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_dedup.near_duplicates(frame, cell_docs=cell_docs).collect()}
    assert got == brute_components(rows, 4)


@pytest.mark.parametrize("size", [500])
def test_near_dedup_crowd(spark, size):
    """Edited copies of one text, most of them just below the limit: links must be found all over the crowd."""
    rng = random.Random(size)
    seed, rows = [f"s{k}" for k in range(303)], []
    for k in range(size):
        words = list(seed)
        for place in rng.sample(range(303), rng.randrange(3, 12)):
            words[place] = f"n{k}x{place}"
        rows.append((k, " ".join(words)))
    grams: dict[tuple, int] = {}
    own = [[grams.setdefault(tuple(w[i : i + 4]), len(grams)) for i in range(300)] for w in (t.split(" ") for _, t in rows)]
    holders = np.bincount(np.concatenate(own))
    shared = np.cumsum(holders > 1) - 1
    held = np.zeros((size, int(shared[-1]) + 1), np.float32)
    for k, x in enumerate(own):
        held[k, [shared[g] for g in x if holders[g] > 1]] = 1
    both = (held @ held.T).astype(int)
    component = list(range(size))
    for a, b in np.argwhere(np.triu(100 * both >= 80 * (600 - both), 1)).tolist():
        x, y = sorted((component[a], component[b]))
        if x != y:
            component = [x if c == y else c for c in component]
    assert size / 20 < len(set(component)) < size
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_docs=200).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(component))


def test_near_dedup_pairs_above_a_crowd(spark):
    """1,500 documents in pairs of similarity 0.81, all others at 0.786: every link, and no more."""
    base = [f"b{k}" for k in range(503)]
    rows = []
    for k in range(1500):
        words = list(base)
        for nth, place in enumerate(range(10, 500, 33)):
            words[place] = f"p{k // 2}x{nth}" if nth < 2 else f"d{k}x{nth}"
        rows.append((k, " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k - k % 2 for k in range(1500)}


def test_near_dedup_odd_tables(spark, docs, empty, corpus):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.near_duplicates(docs).count() == len(corpus)
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    last = (1 << 63) - 1
    rows = [(3, a), (5, a), (5, b), (7, b), (7, None), (9, ""), (9, c), (11, None), (11, ""), (last, c), (20, a + " more")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("set_key", F.lit(1)).withColumn("first", F.lit(1))
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame).collect())
    component = {3: 3, 5: 3, 7: 3, 20: 3, 9: 9, 11: 11, last: 9}
    assert got == sorted((k, component[k], component[k] == k) for k, _ in rows)
    assert component[last] == 9


@pytest.mark.parametrize("shift", [0, (1 << 63) - 100])
def test_near_dedup_null_ids(spark, shift):
    """Rows without id link groups only by their texts, and are named after real ids."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    ids = [x if x is None else x + shift for x in (1, 2, None, None, None, None, None, None, 7)]
    texts = [a, b, a + " more", b + " more", c, c, c + " more", d, ""]
    frame = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("node", F.lit(3)).withColumn("null_id", F.lit(3)).repartition(3)
    nodes = near_dedup.Nodes(frame, "doc_id", "text")
    got = near_dedup.verdicts(frame, nodes).collect()
    named = sorted((r.doc_id is None, r.doc_id or 0, r.component_id or 0, r.kept) for r in got)
    assert named[:3] == [(False, x + shift, x + shift, True) for x in (1, 2, 7)]
    assert sorted(x[2] for x in named[3:]) == [0, 0, 0, 0, 1 + shift, 2 + shift]
    # of the three rows about c those of one text stay, d stays, near copies of documents with an id go
    kept = [r.node for r in got if r.doc_id is None and r.kept]
    assert len(set(kept)) == 2 and not any(r.kept for r in got if r.doc_id is None and r.component_id is not None)
    alone = near_dedup.near_duplicates(frame.filter("doc_id IS NULL")).collect()
    assert all(r.component_id is None for r in alone) and sum(r.kept for r in alone) in (4, 5)


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(300, 420)] + [(5, k) for k in range(10, 60)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(None, 3), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    for a, b in links:
        if a is not None and a != b:
            x, y = (next(s for s in iter(lambda z=z: root.setdefault(z, z), None)) for z in (a, b))
            old, new = max(x, y), min(x, y)
            for z, r in list(root.items()):
                if r == old:
                    root[z] = new
    assert got == root


def test_word_hashes():
    texts = [b"a bb  ccc\tdddd", b"", b"\n", "é longer-than-eight-bytes longer-than-eight-bytez".encode(), b"a"]
    h, first = wordhash.hashed_words(texts)
    words = [w for t in texts for w in t.split()]
    assert first.tolist() == np.concatenate(([0], np.cumsum([len(t.split()) for t in texts]))).tolist()
    assert len(set(h.tolist())) == len(set(words)) and h[0] == h[-1]
    w = wordhash.window_hashes(np.concatenate((h, h)), 5)
    assert w[0] == w[len(h)] and len(set(w.tolist())) == len(h)


def test_delta_bytes():
    for values in ([], [0], [5, 5, 6, 1 << 40, (1 << 63) - 1], [-3, 0, 9]):
        assert common.delta_values(common.delta_bytes(np.array(values, np.int64))).tolist() == values
