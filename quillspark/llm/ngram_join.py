"""Exact self-join of documents by the Jaccard similarity of their word n-grams, with PartEnum signatures.

Sets are dealt into size bands so wide that similar sets lie in one band or in neighbours; a set signs for its own band and,
where a partner may lie in the next one, for that too. In a band of sizes up to r, two sets at ``percent`` or more differ in at
most k = floor(2 r (100 - percent) / (100 + percent)) elements. The domain of shingles is cut by hash into n1 partitions, each of
n2 sub-partitions; of the partitions at most k // 2 can hold two differences or more, and in any other the sets agree on a
subset of n2 - 1 sub-partitions. Every subset of n2 - 1 of each partition is a signature: similar sets share one for certain.
n1 is larger than k // 2 by ``spare`` partitions, so that a set with fewer weak partitions than that (a subset holds less than
two of its elements) can leave weak signatures out; other sets keep all.

Sets that share a signature form a star: its least member is the centre, the others are visitors. Visitors meet their centres:
first the least of them, and after links have given labels (components), the others of other labels. Where the visitors of a
centre have several labels, those of its most frequent label are residents, the others guests: guests meet all residents and
each other. Meetings take place in blocks of about ``block_docs`` sets and ``block_values`` shingles, in two steps. First only
parity sketches travel: bit i tells whether an odd number of shingles fall on i, so that two sketches differ in no more bits than
the sets differ in elements, and a set that no other in its block can be similar to leaves. Then the texts of those left
travel, shared shingles are counted by matrix products, and only links that join something leave the block, never pairs.
Nothing is probabilistic but 64-bit hashes (of shingles and of sets).

Documents of equal sets are one class from the start. Null or blank text: empty set, linked with nothing, its component is
its own id. Rows that share an id (not null) are joined. A component is named by its smallest id that isn't null, a component
of null ids by null. Repeated rows give repeated results; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .near_dedup import shingle_sets
from .wordhash import mix

#: Least elements of a signature that is not weak.
STRONG = 2
_PARTITION, _SUB, _CONTENT, _ODD = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def band_limits(largest: int, percent: int, width: float = 0.75) -> list[int]:
    """Largest sizes of the bands up to one that holds ``largest``; a set's partners reach the next band at most."""
    limits = [3]
    while limits[-1] < largest:
        limits.append(max(int(limits[-1] / width), -(-100 * limits[-1] // percent), limits[-1] + 1))
    return limits


def band_plan(limit: int, percent: int) -> tuple[int, int, int]:
    """(n1, n2, spare) of a band of sizes up to ``limit``; n1 is 0 where similar sets are equal."""
    differ = 2 * limit * (100 - percent) // (100 + percent)
    half = differ // 2
    spare = 1 + half // 8
    return (half + spare if differ else 0), (3 if half >= 4 else 6), spare


def part_signatures(values: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets of a chunk, and the set of each."""
    n = np.diff(first)
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    limits = np.array(band_limits(-(-100 * int(n.max()) // percent), percent))
    band = np.searchsorted(limits, n)
    over = 100 * n // percent > limits[band]
    owner = np.repeat(np.arange(len(n)), n)
    found, owners = [], []
    for tag in range(len(limits)):
        inside = (n > 0) & ((band == tag) | over & (band == tag - 1))
        n1, n2, spare = band_plan(int(limits[tag]), percent)
        sets = np.flatnonzero(inside)
        if not n1 or not len(sets):
            continue
        some = inside[owner]
        v, own = values[some], np.searchsorted(sets, owner[some])
        part, sub = ((mix(v + c) >> np.uint64(33)).astype(np.int64) % m for c, m in ((_PARTITION, n1), (_SUB, n2)))
        cell, shape, content = (own * n1 + part) * n2 + sub, (len(sets), n1, n2), mix(v + _CONTENT)
        low, high = (np.bincount(cell, (content >> np.uint64(s) & np.uint64(0xFFFFFFFF)).astype(np.float64), len(sets) * n1 * n2).astype(np.uint64) for s in (0, 32))
        sums, held = (low + (high << np.uint64(32))).reshape(shape), np.bincount(cell, minlength=len(sets) * n1 * n2).reshape(shape)
        # each subset leaves one sub-partition out
        sums, held = sums.sum(2, keepdims=True) - sums, held.sum(2, keepdims=True) - held
        strong = held >= STRONG
        keep = strong | ((~strong.all(2)).sum(1) >= spare)[:, None, None]
        place = mix(np.arange(n1 * n2, dtype=np.uint64) + np.uint64(tag << 32)).reshape(n1, n2)
        found.append(mix(sums * _ODD + place)[keep])
        owners.append(sets[np.nonzero(keep)[0]])
    return (np.concatenate(found), np.concatenate(owners)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def class_key(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(batches: Iterator[pa.RecordBatch], column: int, words: int) -> Iterator[tuple[pa.RecordBatch, range, np.ndarray, np.ndarray]]:
    for batch in batches:
        texts = common.column_bytes(batch.column(column))
        for some in common.groups(texts, 1 << 20):
            yield batch, some, *shingle_sets([texts[k] for k in some], words)


def set_rows(rows: DataFrame, words: int) -> DataFrame:
    """(doc_id, row, n_shingles, class) of (doc_id, row, text); class is null for an empty set."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64())])

    def run(batches):
        for batch, some, values, first in _sets(batches, 2, words):
            keys = [class_key(values[a:b]) if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            part = [batch.column(c).slice(some.start, len(some)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*part, pa.array(np.diff(first), pa.int64()), pa.array(keys, pa.int64())], schema=schema)

    return rows.mapInArrow(run, "doc_id long, row long, n_shingles long, class long")


def star_links(texts: DataFrame, words: int, percent: int, remembered: int = 1 << 20) -> DataFrame:
    """(centre, class) of all sets that share a signature with a smaller class, once for each centre.

    A task signs for a class once (of up to ``remembered`` classes), so that copies cost a row per task.
    """
    signed = pa.schema([("signature", pa.int64()), ("class", pa.int64())])
    linked = pa.schema([("centre", pa.int64()), ("class", pa.int64())])

    def sign(batches):
        seen: set[int] = set()
        for _, some, values, first in _sets(batches, 0, words):
            keys = [class_key(values[a:b]) if b > a else 0 for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            new = []
            for k, key in enumerate(keys):
                if key not in seen:
                    seen.add(key)
                    new.append(k)
            if len(seen) > remembered:
                seen.clear()
            if new:
                take = np.concatenate([np.arange(first[k], first[k + 1]) for k in new])
                sig, own = part_signatures(values[take], np.concatenate(([0], np.cumsum([first[k + 1] - first[k] for k in new]))), percent)
                keys = np.array([keys[k] for k in new], np.int64)[own]
                for at in range(0, len(sig), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(sig[at : at + (1 << 16)].view(np.int64)), pa.array(keys[at : at + (1 << 16)])], schema=signed)

    def link(batches):
        last, centre, known = None, None, np.zeros((0, 2), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, key = (batch.column(c).to_numpy() for c in (0, 1))
            start = np.concatenate(([last is None or sig[0] != last], sig[1:] != sig[:-1]))
            at = np.maximum.accumulate(np.where(start, np.arange(len(sig)), -1))
            least = np.where(at >= 0, key[np.maximum(at, 0)], centre if centre is not None else 0)
            last, centre = sig[-1], least[-1]
            some = least != key
            known = np.unique(np.concatenate((known, np.stack((least[some], key[some]), 1))), axis=0)
            if len(known) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(known[:, 0]), pa.array(known[:, 1])], schema=linked)
                known = known[:0]
        if len(known):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(known[:, c])) for c in (0, 1)], schema=linked)

    rows = texts.mapInArrow(sign, "signature long, class long")
    rows = rows.repartition("signature").sortWithinPartitions("signature", "class")
    return rows.mapInArrow(link, "centre long, class long").distinct()


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many elements every left set shares with every right one, by products of dense column blocks."""
    sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right)]
    code = np.unique(np.concatenate([*left, *right]), return_inverse=True)[1]
    codes = code[: sizes[0].sum()], code[sizes[0].sum() :]
    common_codes = np.intersect1d(*codes)
    out = np.zeros((len(left), len(right)), np.int64)
    held = []
    for n, c in zip(sizes, codes, strict=True):
        place = np.minimum(np.searchsorted(common_codes, c), max(len(common_codes) - 1, 0))
        good = common_codes[place] == c if len(common_codes) else np.zeros(len(c), bool)
        own, place = np.repeat(np.arange(len(n)), n)[good], place[good]
        order = np.argsort(place, kind="stable")
        held.append((own[order], place[order]))
    for at in range(0, len(common_codes), columns):
        width = min(columns, len(common_codes) - at)
        dense = []
        for n, (own, place) in zip(sizes, held, strict=True):
            a, b = np.searchsorted(place, (at, at + width))
            one = np.zeros((len(n), width), np.float32)
            one[own[a:b], place[a:b] - at] = 1
            dense.append(one)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def sketch(values: np.ndarray) -> bytes:
    """Parities of how many elements fall on each of 1,024 bits, or of as many as there are elements."""
    bits = 1024
    while bits < len(values):
        bits *= 2
    return np.packbits(np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1).tobytes()


def differing(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """In how many bits each left sketch differs from each right one; the longer of two is folded onto the shorter."""
    out = np.zeros((len(left), len(right)), np.int64)
    folded: dict[tuple[int, int, int], np.ndarray] = {}

    def rows(side: int, sketches: list[bytes], some: np.ndarray, size: int, to: int) -> np.ndarray:
        if (side, size, to) not in folded:
            held = np.frombuffer(b"".join(sketches[k] for k in some.tolist()), np.uint64).reshape(len(some), size // to, to // 8)
            folded[side, size, to] = np.bitwise_xor.reduce(held, axis=1)
        return folded[side, size, to]

    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    for m in np.unique(sizes[0]).tolist():
        for n in np.unique(sizes[1]).tolist():
            i, j, to = np.flatnonzero(sizes[0] == m), np.flatnonzero(sizes[1] == n), min(m, n)
            a, b = rows(0, left, i, m, to), rows(1, right, j, n, to)
            step = max(1, (1 << 22) // max(1, b.size))
            for at in range(0, len(i), step):
                out[np.ix_(i[at : at + step], j)] = np.bitwise_count(a[at : at + step, None] ^ b[None]).sum(2, dtype=np.int64)
    return out


def promising(labels: list[int], sides: np.ndarray, sizes: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """Which sets of a block may be similar to one of another label on the other side, by sizes and sketches."""
    left, right, name = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0), np.array(labels)
    m, n = sizes[left][:, None], sizes[right]
    may = (name[left][:, None] != name[right]) & (100 * np.minimum(m, n) >= percent * np.maximum(m, n))
    i, j = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    keep = np.zeros(len(labels), bool)
    if len(i):
        bits = differing([sketches[k] for k in left[i].tolist()], [sketches[k] for k in right[j].tolist()])
        may = may[np.ix_(i, j)] & ((100 + percent) * bits <= (100 - percent) * (m[i] + n[j]))
        keep[left[i[may.any(1)]]] = True
        keep[right[j[may.any(0)]]] = True
    return keep


def joined(classes: list[int], labels: list[int], sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between left (side 0, or 2 for both) and right (1 or 2) sets of different labels, without those that join nothing new."""
    left, right = np.flatnonzero(sides != 1).tolist(), np.flatnonzero(sides != 0).tolist()
    if not left or not right:
        return []
    both = shared_counts([sets[k] for k in left], [sets[k] for k in right])
    n, name = np.fromiter(map(len, sets), np.int64, len(sets)), np.array(labels)
    total = n[left][:, None] + n[right]
    near = np.argwhere((100 * both >= percent * (total - both)) & (name[left][:, None] != name[right]))
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = root[x]
        return x

    found = []
    for i, j in near.tolist():
        a, b = top(labels[left[i]]), top(labels[right[j]])
        if a != b:
            root[max(a, b)] = min(a, b)
            found.append((classes[left[i]], classes[right[j]]))
    return found


BLOCK = ["home", "low", "high", "class", "label", "side"]
BLOCK_DDL = "home long, low long, high long, class long, label long, side int"


def in_blocks(rows: DataFrame, traits: DataFrame, columns: list[str], work, schema: pa.Schema, ddl: str) -> DataFrame:
    """What ``work`` makes of each block (home, low, high), one at a time, from its rows with these columns of the traits."""

    def run(batches):
        def found():
            key, held = None, []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if row[:3] != key:
                        yield from work(held) if held else ()
                        key, held = row[:3], []
                    held.append(row)
            yield from work(held) if held else ()

        yield from common.batches_of(found(), schema)

    placed = rows.join(traits.select("class", *columns).hint("merge"), "class").select(*BLOCK, *columns)
    return placed.repartition("home", "low", "high").sortWithinPartitions("home", "low", "high").mapInArrow(run, ddl)


def left_over(rows: DataFrame, traits: DataFrame, percent: int) -> DataFrame:
    """The rows of blocks without sets that can't be similar to any other there."""
    schema = pa.schema([*((x, pa.int64()) for x in BLOCK[:5]), ("side", pa.int32())])

    def work(held):
        keep = promising([r[4] for r in held], np.array([r[5] for r in held]), np.array([r[6] for r in held]), [r[7] for r in held], percent)
        return [held[k][:6] for k in np.flatnonzero(keep).tolist()]

    return in_blocks(rows, traits, ["n_shingles", "sketch"], work, schema, BLOCK_DDL)


def met(rows: DataFrame, traits: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) within the blocks, by full sets."""

    def work(held):
        sets: list[np.ndarray] = []
        texts = [r[6].encode() for r in held]
        for some in common.groups(texts, 1 << 20):
            values, first = shingle_sets([texts[k] for k in some], words)
            sets += [values[first[j] : first[j + 1]].copy() for j in range(len(some))]
        return joined([r[3] for r in held], [r[4] for r in held], np.array([r[5] for r in held]), sets, percent)

    return in_blocks(rows, traits, ["text"], work, pa.schema([("a", pa.int64()), ("b", pa.int64())]), "a long, b long")


def shards(docs: str, values: str, block_docs: int, block_values: int):
    return F.greatest(F.ceil(F.col(docs) / F.lit(block_docs)), F.ceil(F.col(values) / F.lit(block_values))).cast("long")


def each(column: str):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(column) - 1))


def first_meetings(stars: DataFrame, block_docs: int, block_values: int) -> DataFrame:
    """Blocks (high is -1) in which every visitor (centre, class, n_shingles) meets its centre."""
    sizes = stars.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("values")).select("centre", "n", shards("n", "values", block_docs, block_values).alias("rooms"))
    sizes = common.staged(sizes, "stars")
    high = F.lit(-1).cast("long").alias("high")
    centres = sizes.select(F.col("centre").alias("home"), each("rooms").alias("low"), high, F.col("centre").alias("class"), F.col("centre").alias("label"), F.lit(0).alias("side"))
    visits = common.skew_join(stars, sizes, ["centre"], ["class"])
    visits = visits.select(F.col("centre").alias("home"), F.pmod(F.xxhash64("class"), "rooms").alias("low"), high, "class", F.col("class").alias("label"), F.lit(1).alias("side"))
    return centres.union(visits)


def with_centres(visits: DataFrame, rows: DataFrame) -> DataFrame:
    """Visits and the centres of their blocks."""
    return visits.union(rows.filter("side = 0").join(visits.select("home", "low").distinct(), ["home", "low"], "left_semi").select(*BLOCK))


def later_meetings(stars: DataFrame, block_docs: int, block_values: int) -> DataFrame:
    """Blocks in which the visitors of a centre that have other labels than most meet all others of other labels.

    ``stars`` has (centre, class, n_shingles, label); residents of one label never meet each other.
    """
    labels = stars.groupBy("centre", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("values"))
    homes = labels.groupBy("centre").agg(F.sum("n").alias("n"), F.sum("values").alias("all_values"), F.max(F.struct("n", "label", "values")).alias("most")).filter(F.col("n") > F.col("most.n"))
    homes = homes.select("centre", "n", F.col("most.label").alias("home_label"), F.col("most.n").alias("residents"), F.col("most.values").alias("values"), (F.col("n") - F.col("most.n")).alias("guests"), (F.col("all_values") - F.col("most.values")).alias("guest_values"))
    homes = common.staged(homes.select("centre", "n", "home_label", shards("residents", "values", block_docs, block_values).alias("own"), shards("guests", "guest_values", block_docs, block_values).alias("rooms")), "homes")
    rows = common.skew_join(stars, homes, ["centre"], ["class"]).withColumnRenamed("centre", "home")
    part = lambda c: F.pmod(F.xxhash64("class"), F.col(c))
    keep = lambda df, side: df.select("home", "low", "high", "class", "label", side.cast("int").alias("side"))
    residents, guests = rows.filter("label = home_label"), rows.filter("label <> home_label").withColumn("mine", part("rooms"))
    here = residents.withColumn("low", -1 - part("own")).withColumn("high", each("rooms"))
    visits = guests.withColumn("low", each("own")).withColumn("low", -1 - F.col("low")).withColumn("high", F.col("mine"))
    among = guests.withColumn("with", each("rooms")).withColumn("low", F.least("mine", "with")).withColumn("high", F.greatest("mine", "with"))
    side = F.when(F.col("with") == F.col("mine"), 2).when(F.col("mine") < F.col("with"), 0).otherwise(1)
    return keep(here, F.lit(1)).union(keep(visits, F.lit(0))).union(keep(among, side))


def class_traits(rows: DataFrame, sets: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(class, n_shingles, sketch, text) of the wanted classes, from one row each."""
    schema = pa.schema([("class", pa.int64()), ("n_shingles", pa.int64()), ("sketch", pa.binary()), ("text", pa.string())])

    def run(batches):
        for batch, some, values, first in _sets(batches, 0, words):
            ends = first.tolist()
            held = [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([class_key(x) for x in held]), pa.array([len(x) for x in held]), pa.array([sketch(x) for x in held]), batch.column(0).slice(some.start, len(some))], schema=schema)

    one = sets.filter("class IS NOT NULL").groupBy("class").agg(F.min("row").alias("row")).join(wanted, "class", "left_semi")
    # rows that repeat lie together after the join, so that one of them is left without a further shuffle of the texts
    texts = rows.select("row", "text").join(one.select("row").distinct().hint("merge"), "row", "left_semi").dropDuplicates(["row"])
    return texts.select("text").mapInArrow(run, "class long, n_shingles long, sketch binary, text string")


def ngram_links(docs: DataFrame, words: int, percent: int, block_docs: int, block_values: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, n_shingles, class), and links (a, b) of classes that join all classes that similarity connects."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    sets = common.staged(set_rows(rows, words), "sets")
    stars = common.staged(star_links(rows.select("text"), words, percent), "star-links")
    ends = stars.select("class").union(stars.select("centre")).distinct()
    traits = common.staged(class_traits(rows, sets, ends, words), "traits")
    stars = common.staged(stars.join(traits.select("class", "n_shingles"), "class"), "sized-stars")
    open_rows = common.staged(left_over(first_meetings(stars, block_docs, block_values), traits, percent), "first-blocks")
    visits = open_rows.filter("side = 1")
    least = visits.groupBy("class").agg(F.min("home").alias("least"))
    visits = common.staged(visits.join(least, "class").withColumn("first", F.col("home") == F.col("least")).select(*BLOCK, "first"), "visits")
    links = common.staged(met(with_centres(visits.filter("first").select(*BLOCK), open_rows), traits, words, percent), "first-links")
    label = connected_components(links).select(F.col("node").alias("class"), F.col("component").alias("new"))
    renamed = lambda df: df.join(label, "class", "left").withColumn("label", F.coalesce("new", F.col("class"))).drop("new")
    homes = label.select(F.col("class").alias("home"), F.col("new").alias("at"))
    rest = renamed(visits.filter("NOT first").select(*BLOCK)).join(homes, "home", "left").filter(F.col("label") != F.coalesce("at", "home")).select(*BLOCK)
    rest = with_centres(rest, renamed(open_rows))
    later = left_over(later_meetings(renamed(stars.withColumn("label", F.col("class"))), block_docs, block_values), traits, percent)
    again = common.staged(rest.unionByName(later), "later-blocks")
    return sets, links.union(common.staged(met(again, traits, words, percent), "later-links"))


def ngram_join(docs: DataFrame, words: int = 4, percent: int = 85, block_docs: int = 256, block_values: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    common.ensure_workers(docs.sparkSession)
    sets, links = ngram_links(docs, words, percent, block_docs, block_values, id_col, text_col)
    classes = common.staged(sets.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    # ids of several rows join their classes
    again = sets.filter("class IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("z")).filter("a < z")
    repeated = sets.join(again, "doc_id").filter("class <> a").select("a", F.col("class").alias("b"))
    component = common.staged(connected_components(links.union(repeated)), "components")
    names = component.join(classes.select(F.col("class").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("name"), F.count(F.lit(1)).alias("n"))
    named = common.skew_join(component, common.staged(names, "names"), ["component"], ["node"]).select(F.col("node").alias("class"), "name")
    named = classes.join(named, "class", "left").select("class", F.coalesce("name", "least").alias("component_id"), "n")
    found = common.skew_join(sets, common.staged(named, "named"), ["class"], ["row"], "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[pos:pos + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS pos FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common_n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common_n >= 85 * (x.n + y.n - common_n)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM t UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT t.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM t JOIN m ON m.doc_id = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id
"""
