"""Source divergence, hard negatives and the n-gram join against brute force; nulls, ties, repeats, clashing columns."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import divergence, hard_negatives, ngram_join

WORD, TERM = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def brute_divergence(rows, least, ranks):
    docs = [(lang or "", source or "", TERM.findall(lowered(text))) for text, lang, source in rows]
    found = []
    for lang in {x[0] for x in docs}:
        here = [x for x in docs if x[0] == lang]
        held = {}
        for _, _, words in here:
            for w in set(words):
                held[w] = held.get(w, 0) + 1
        kept = sorted((w for w, n in held.items() if n >= least), key=str.encode)
        sources = sorted({x[1] for x in here})
        counts = {s: {w: 0 for w in kept} for s in [*sources, None]}
        for _, s, words in here:
            for w in words:
                if w in counts[s]:
                    counts[s][w] += 1
                    counts[None][w] += 1
        share = {s: {w: 1 + int(Fraction(10**9 * (n + 2), sum(c.values()) + 2 * len(kept))) for w, n in c.items()} for s, c in counts.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(-sum(f(share[s][w], share[o][w]) for w in kept), o.encode(), o) for o in sources if o != s]
            found += [(lang, s, "pair", o, -v, r + 1) for r, (v, _, o) in enumerate(sorted(pairs))]
            terms = [(-f(share[s][w], share[None][w]), w.encode(), w) for w in kept if counts[s][w] and share[s][w] > share[None][w]]
            found += [(lang, s, "term", w, -v, r + 1) for r, (v, _, w) in enumerate(sorted(terms)[:ranks])]
    return sorted(found)


@pytest.mark.parametrize("slice_terms, block_groups", [(16_384, 32), (5, 3), (7, 2), (1, 1)])
def test_source_divergence(spark, slice_terms, block_groups):
    rng = random.Random(3)
    rows = []
    for k in range(200):
        source = rng.choice([None, "", "hot", "hot", "hot", "é", *"abcdefg"])
        words = [rng.choice(["Alpha", "beta", "Ünï", "x1y", "gamma", "ß", f"w{rng.randrange(25)}"]) + rng.choice([" ", "-", "\n", "7"]) for _ in range(rng.randrange(0, 40))]
        rows.append(("".join(words) or None, rng.choice(["en", "en", "fr", None]), source))
    rows += [("alpha " * 3000, "en", "long"), ("only once here", "xx", "solo"), (None, "xx", "pair"), *[("rare word", "yy", "s")] * 3, rows[0], rows[0]]
    frame = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit("x")).withColumn("slice", F.lit(1)).repartition(3)
    got = divergence.source_divergence(frame, least_docs=4, ranks=3, slice_terms=slice_terms, block_groups=block_groups)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows, 4, 3)
    assert divergence.source_divergence(frame.limit(0)).count() == 0


def test_shares_of_large_counts_are_exact():
    counts, total, terms = [0, 1, 10**12, 9 * 10**14], 9 * 10**14 + 10**12 + 1, 12345
    got = divergence.shares(np.array(counts, np.int64), total, terms).tolist()
    assert got == [1 + 10**9 * (n + 2) // (total + 2 * terms) for n in counts]


def test_vectors_survive_compression():
    rng = np.random.default_rng(1)
    slots = rng.permutation(70_000)[:500]
    counts = rng.integers(0, 1 << 40, 500)
    got = divergence.blob_parts(divergence.blob_of(slots, counts))
    order = np.argsort(slots)
    assert (got[0] == slots[order]).all() and (got[1] == counts[order]).all()


def brute_negatives(rows, positives=5, negatives=10):
    good = []
    for ident, vector, label in rows:
        if None not in (ident, vector, label) and all(x is not None and np.isfinite(x) for x in vector):
            good.append((ident, (label + 1) % 10 if ident % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in vector]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    found = []
    for a, la, va in good:
        if a % 100 == 0:
            others = sorted((-dot(va, v), i, lab) for i, lab, v in good if i != a)
            for s, p, _ in [x for x in others if x[2] == la][:positives]:
                near = [x for x in others if x[2] != la and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
                found += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(near)]
    return sorted(found)


@pytest.mark.parametrize("block_rows, pivots, batch", [(1024, 32, 256), (7, 5, 3), (50, 1, 2)])
def test_hard_negatives(spark, block_rows, pivots, batch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    rows = []
    for k in range(900):
        v = (centres[rng.integers(6)] + 0.4 * rng.normal(size=12)).astype(np.float32)
        rows.append((k, v.tolist() if k % 3 else centres[0].round(1).tolist(), int(rng.integers(10)) if k % 11 else 3))
    rows += [(1000, [0.0] * 12, 2), (1100, [], 2), (1200, [1.0, 2.0], 2), (1300, None, 1), (1400, [None] * 12, 1), (1500, [float("nan")] * 12, 1), (1600, [float("inf")] * 12, 1), (1700, rows[5][1], None), (None, rows[6][1], 1), rows[200], (300, rows[7][1], 4), (1800, [50.0] * 12, 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("x")).withColumn("pivot", F.lit(1)).repartition(3)
    mine = lambda df: hard_negatives.mine_hard_negatives(df, F.col("id") % 100 == 0, hard_negatives.relabelled(), pivots=pivots, block_rows=block_rows, batch_anchors=batch)
    got = sorted(map(tuple, mine(frame).collect()))
    assert got == brute_negatives(rows) and len(got) > 100
    assert mine(frame.limit(0)).count() == 0 and mine(frame.filter("vec_id % 100 <> 0")).count() == 0


def test_hard_negatives_of_large_components(spark):
    rows = [(k, [3e6 * (1 + k % 5), -1e6 * (k % 3)], k % 4) for k in range(0, 400, 10)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = hard_negatives.mine_hard_negatives(frame, F.col("id") % 100 == 0, hard_negatives.relabelled())
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)
    huge = spark.createDataFrame([(0, [1e30], 1), (1, [1.0], 1)], frame.schema)
    with pytest.raises(ValueError, match="fit a long"):
        hard_negatives.mine_hard_negatives(huge, F.col("id") % 100 == 0)


def test_distance_keys_pass_over_blocks():
    """Clustered anchors read a part of the blocks only, and still find what a full scan finds."""
    rng = np.random.default_rng(2)
    centres = 40 * rng.normal(size=(20, 8))
    data = np.floor(256 * (centres[np.repeat(np.arange(20), 200)] + rng.normal(size=(4000, 8)))).astype(np.int64)
    keys = hard_negatives.Keys(np.zeros((1, 9)), int((data.astype(float) ** 2).sum(1).max()) + 1, 8, "<i8")
    keys.pivots = hard_negatives.fitted_pivots(keys.augmented(data), 20)
    d = np.sqrt(hard_negatives.squared(keys.augmented(data), keys.pivots))
    own = d.argmin(1)
    order = np.lexsort((d[np.arange(4000), own], own))

    class Stored(hard_negatives.Index):
        def __init__(self):
            self.keys, self.cut = keys, np.array_split(order, 100)
            self.cut = [x[own[x] == p] for x in self.cut for p in np.unique(own[x])]
            self.pivot = np.array([own[x[0]] for x in self.cut])
            self.low, self.high = (np.array([f(d[x, own[x]]) for x in self.cut]) for f in (np.min, np.max))
            self.blocks = lambda s: [(self.low[s], self.high[s], 0, 0)]

        def rows(self, segment, block):
            x = np.sort(self.cut[segment])
            return x, x % 2, data[x]

    stored = Stored()
    some = np.arange(0, 200)
    search = hard_negatives.Search(stored, some, some % 2, data[some])
    best = search.positives(5)
    scores = data[some] @ data.T
    for k in some.tolist():
        want = sorted((-int(scores[k, j]), j) for j in range(4000) if j % 2 == k % 2 and j != k)[:5]
        assert [(-int(s), int(i)) for s, i in zip(best.score[k], best.ident[k], strict=True)] == want
    assert search.read < len(stored.cut) / 2


def brute_join(rows, percent=85):
    def shingles(text):
        w = WORD.findall(lowered(text))
        return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) or frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for k, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(k)
    for a in range(len(rows)):
        near = {b for g in sets[a] for b in holders[g] if b > a}
        near |= {b for b in range(a + 1, len(rows)) if rows[a][0] is not None and rows[b][0] == rows[a][0] and sets[a] and sets[b]}
        for b in near:
            both = len(sets[a] & sets[b])
            if rows[a][0] is not None and rows[a][0] == rows[b][0] or 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    least = {}
    for k, (ident, _) in enumerate(rows):
        if ident is not None:
            least[top(k)] = min(least.get(top(k), ident), ident)
    return sorted(((k, len(s), least.get(top(j)) if s else k) for j, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def edited(rng, words, n, tag):
    out = list(words)
    for p in rng.sample(range(len(out)), n):
        out[p] = f"{tag}n{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("block_docs", [256, 9])
def test_ngram_join(spark, block_docs):
    rng = random.Random(6)
    rows = []
    for size in (6, 9, 14, 30, 80, 200, 700):  # near copies around the limit at many sizes
        base = [f"b{size}x{k}" for k in range(size)]
        for _ in range(25):
            words = base[: size - rng.randrange(0, size // 8 + 1)] if rng.random() < 0.5 else base
            rows.append((len(rows), edited(rng, words, rng.randrange(0, 2 + size // 60), "e")))
    last = (1 << 63) - 1
    extra = [(None, rows[30][1]), (None, "a null alone with some words"), (None, "a null alone with some words"), (None, None), (5000, None), (5001, ""), (5002, "one"), (5003, "ONE"), (5004, "two words"), (5005, rows[100][1]), (5005, rows[3][1]), (5006, "Long " + " ".join(f"l{k}" for k in range(20_000))), (5007, "long " + " ".join(f"l{k}" for k in range(19_000))), (last, rows[40][1]), (-7, rows[60][1].upper()), rows[5], rows[5]]
    rows += extra
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit(1)).withColumn("row", F.lit(2)).repartition(4)
    got = ngram_join.ngram_join(frame, block_docs=block_docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = brute_join(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want and len({x[2] for x in want}) < len(want) - 40
    assert ngram_join.ngram_join(frame.limit(0)).count() == 0


def test_ngram_join_of_a_crowd(spark):
    """600 edited copies of one text, most pairs just below the limit; meetings of guests and residents over many blocks."""
    rng = random.Random(8)
    base = [f"s{k}" for k in range(203)]
    rows = [(k, edited(rng, base, rng.randrange(1, 9), f"d{k}")) for k in range(600)]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), block_docs=64)
    want = brute_join(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want and 5 < len({x[2] for x in want}) < 550


def test_signatures_miss_no_similar_pair():
    rng = np.random.default_rng(9)
    for size in (4, 6, 7, 8, 11, 12, 13, 20, 33, 50, 90, 160, 400, 1500):
        for _ in range(40):
            a = rng.integers(0, 1 << 63, size).astype(np.uint64)
            b = a.copy()
            while True:  # as many edits as the limit allows
                c = np.concatenate((b[1:], rng.integers(0, 1 << 63, int(rng.integers(0, 2))).astype(np.uint64)))
                both = len(np.intersect1d(a, c))
                if 100 * both < 85 * (len(a) + len(c) - both):
                    break
                b = rng.permutation(c)
            sets = [np.sort(a), np.sort(b)]
            sig, own = ngram_join.part_signatures(np.concatenate(sets), np.array([0, len(a), len(a) + len(b)]), 85)
            assert np.array_equal(*sets) or len(np.intersect1d(sig[own == 0], sig[own == 1])), size


def test_shared_counts():
    rng = np.random.default_rng(1)
    left, right = ([np.unique(rng.integers(0, 300, n)).astype(np.uint64) for n in rng.integers(0, 90, m)] for m in (7, 5))
    assert ngram_join.shared_counts(left, right, 16).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]


def test_sketches_never_rule_out_a_similar_set():
    rng = np.random.default_rng(5)
    for size in (3, 40, 900, 1030, 2500, 5000):
        base = rng.integers(0, 1 << 63, size).astype(np.uint64)
        sets = [base]
        for share in (0.02, 0.1, 0.16, 0.3, 1):
            other = base.copy()
            some = rng.random(size) < share
            other[some] = rng.integers(0, 1 << 63, int(some.sum()))
            sets.append(np.concatenate((other, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + size // 10))).astype(np.uint64))))
        bits = ngram_join.differing([ngram_join.sketch(x) for x in sets], [ngram_join.sketch(x) for x in sets])
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                assert bits[i, j] <= len(np.setxor1d(a, b)) and bits[i, j] == bits[j, i] and (i != j or not bits[i, j])
        if size > 100:
            assert bits[0, 5] > (size + len(sets[5])) * 15 // 185
        keep = ngram_join.promising([1, 2], np.array([0, 1]), np.array([size, size]), [ngram_join.sketch(base)] * 2, 85)
        assert keep.all() and not ngram_join.promising([1, 1], np.array([0, 1]), np.array([size, size]), [ngram_join.sketch(base)] * 2, 85).any()
