"""Near-duplicate detection with a MinHash LSH forest.

Every document gets the set of its 4-word shingles (words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; fewer words make one
shingle) and a MinHash signature of ``SLOTS`` 16-bit values. Documents of equal sets are one class. The classes are sorted
once per tree, each tree by another order of the slots. In a sorted order, those with the longest common prefix stand next
to each other; every document takes the ``reach`` documents before it as candidates while they share ``least_depth`` slots.
A second pass takes the prefixes of ``least_depth`` slots that more documents share than that window spans. The
largest component of such a crowd is a home, the others are its guests: guests meet all of the home and each other, with
their full sets, in blocks of about ``block_docs`` documents that emit links only. So no pair that shares a prefix is left
out, however crowded it is.

A pair with similarity 0.8 shares two slots in a given tree with probability 0.64, so that 16 trees miss it with
probability 1e-7. Candidates whose signatures or sizes rule the similarity out are let go (signature cut five standard
deviations below), the others are confirmed on the full sets: candidates are grouped by connected component, components
over ``cell_docs`` documents, ``cell_pairs`` pairs or ``cell_values`` shingles are cut into cells by pairs of shards of
documents, and within a cell a pair is compared unless already joined.

Null or blank text: empty set, linked with nothing. Rows that share an id are one node with the links of all its rows (each
row keeps its own set size). A row of null id is a node of its own, together with rows of null id and the same text; its
number is taken where the table has no ids (``Nodes``). A component is named by its smallest real id, one of null ids only by
null; of such a component the rows of one node are kept. An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, wordhash
from .components import connected_components

SLOTS = 128
_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 31, (2, SLOTS), dtype=np.uint32) | np.uint32(1)


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts one after another, sorted within a text; and where each text's begin."""
    h, first = wordhash.hashed_words([x.lower() for x in texts])
    w = wordhash.window_hashes(h, words)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), n)
    good = wordhash.whole_windows(first, words, len(w))
    values, owners = [w[good]], [owner[: len(w)][good]]
    for k in range(1, words):  # shorter texts: all words as one shingle
        some = np.flatnonzero(n == k)
        if len(some):
            values.append(wordhash.window_hashes(h, k)[first[some]] + np.uint64(k))
            owners.append(some)
    value, own = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    value, own = value[new], own[new]
    return value, np.searchsorted(own, np.arange(len(texts) + 1))


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of 16-bit slots per text; rows of empty sets are zero."""
    out = np.zeros((len(first) - 1, SLOTS), np.uint16)
    some = np.flatnonzero(np.diff(first))
    if not len(some):
        return out
    low = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    for k in range(SLOTS):
        x = low * _SEEDS[0, k]
        x ^= x >> np.uint32(15)
        x *= _SEEDS[1, k]
        least = np.minimum.reduceat(x, first[some])
        out[some, k] = (least ^ (least >> np.uint32(16))).astype(np.uint16)
    return out


def tree_orders(trees: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    return np.stack([rng.permutation(SLOTS) for _ in range(trees)])


class Nodes:
    """Numbers of the rows of a table: the id, or for null ids a hash of the text in a range that no id of the table reaches.

    The range lies above the largest id, or below the smallest where there is more room; were there none, a hash could meet
    an id. Ids alone are read for this.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        ident, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        low, high, nulls = docs.agg(F.min(ident), F.max(ident), F.count_if(ident.isNull())).first()
        low, high = low or 0, high or 0
        above, below = (1 << 63) - 1 - high, low + (1 << 63)
        self.nulls, self.last = bool(nulls), above >= min(below, 1 << 40)
        span = max(min(above if self.last else below, 1 << 62), 1)
        self.first = min(high + 1, (1 << 63) - span) if self.last else low - span
        self.end = self.first + span - 1
        self.number = F.coalesce(ident, F.pmod(F.xxhash64(text), F.lit(span)) + F.lit(self.first)) if nulls else ident
        self.is_null = ident.isNull()

    def of_null(self, node: str) -> Column:
        return F.col(node).between(F.lit(self.first), F.lit(self.end)) & F.lit(self.nulls)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """(node, null_id, n_shingles, set_key, signature) of every row (node, null_id, text)."""
    schema = pa.schema([("node", pa.int64()), ("null_id", pa.bool_()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, nulls, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.column_bytes(batch.column(2))
            for some in common.groups(texts, 1 << 20):
                values, first = shingle_sets([texts[k] for k in some], words)
                sig, n = signatures(values, first), np.diff(first)
                keys = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield common.to_batch([(nodes[k], nulls[k], int(n[j]), keys[j], sig[j].tobytes() if n[j] else None) for j, k in enumerate(some)], schema)

    return docs.mapInArrow(run, "node long, null_id boolean, n_shingles long, set_key binary, signature binary")


def shared_trees(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """(node, trees): the trees in which another class shares the first ``depth`` slots."""
    order = tree_orders(trees)
    prefix = pa.schema([("node", pa.int64()), ("tree", pa.int32()), ("prefix", pa.int64())])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SLOTS)
            node = batch.column(0)
            for t in range(trees):
                key = np.full(len(sig), t, np.uint64)
                for k in range(depth):
                    key = wordhash.mix(key + sig[:, order[t, k]])
                yield pa.RecordBatch.from_arrays([node, pa.array(np.full(len(sig), t, np.int32)), pa.array(key.view(np.int64))], schema=prefix)

    keys = classes.select("node", "signature").mapInArrow(prefixes, "node long, tree int, prefix long")
    shared = keys.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("prefix")
    return keys.join(shared, "prefix").groupBy("node").agg(F.collect_set("tree").alias("trees"))


def sorted_orders(classes: DataFrame, found: DataFrame, trees: int) -> DataFrame:
    """(tree, slots, node, n_shingles, label) of every class (with its label) in each of its trees."""
    order = tree_orders(trees)
    placed = pa.schema([("tree", pa.int32()), ("slots", pa.binary()), ("node", pa.int64()), ("n_shingles", pa.int64()), ("label", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(-1, SLOTS)
            rows = []
            for k, (node, n, label, mine) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True)):
                rows += [(t, sig[k, order[t]].tobytes(), node, n, label) for t in mine]
                if len(rows) >= 8192:
                    yield common.to_batch(rows, placed)
                    rows = []
            if rows:
                yield common.to_batch(rows, placed)

    return classes.join(found, "node").select("node", "n_shingles", "label", "signature", "trees").mapInArrow(place, "tree int, slots binary, node long, n_shingles long, label long")


def least_agreement(similarity: float) -> float:
    """The share of equal slots five standard deviations below the similarity."""
    return similarity - 5 * (similarity * (1 - similarity) / SLOTS) ** 0.5


def candidates(placed: DataFrame, depth: int, reach: int, similarity: float) -> DataFrame:
    """(a, b, la, lb) of neighbours of different labels in a sorted order that neither signature nor size rules out; a < b."""
    schema = pa.schema([(x, pa.int64()) for x in ("a", "b", "la", "lb")])
    cut = least_agreement(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SLOTS)
            node, n, label = (batch.column(c).to_numpy() for c in (2, 3, 4))
            new = 0
            if kept is not None:
                new = len(kept[0])
                tree, sig, node, n, label = (np.concatenate(x) for x in zip(kept, (tree, sig, node, n, label), strict=True))
            for k in range(1, reach + 1):
                lo = max(new - k, 0)
                a, b = slice(lo, len(tree) - k), slice(lo + k, None)
                if lo + k >= len(tree):
                    break
                some = np.flatnonzero((tree[a] == tree[b]) & (sig[a][:, :depth] == sig[b][:, :depth]).all(1) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9) & (label[a] != label[b])) + lo
                some = some[(sig[some] == sig[some + k]).mean(1) >= cut] if len(some) else some
                if len(some):
                    swap = node[some] > node[some + k]
                    x, y = np.where(swap, some + k, some), np.where(swap, some, some + k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (node[x], node[y], label[x], label[y])], schema=schema)
            kept = tuple(x[-reach:] for x in (tree, sig, node, n, label))

    ranged = placed.repartitionByRange("tree", "slots", "node").sortWithinPartitions("tree", "slots", "node")
    return ranged.mapInArrow(run, "a long, b long, la long, lb long").distinct()


def crowd_guests(placed: DataFrame, depth: int, reach: int) -> DataFrame:
    """(home, node, n_shingles, label): where more than ``reach`` + 1 classes share a prefix, its largest label is a home, and
    those of other labels are its guests; two members of a crowd that are still apart are guest and home, or guests of one home."""
    rows = placed.withColumn("prefix", F.substring("slots", 1, 2 * depth)).drop("slots")
    labels = rows.groupBy("tree", "prefix", "label").agg(F.count(F.lit(1)).alias("n"))
    crowds = labels.groupBy("tree", "prefix").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most")).filter((F.col("n") > reach + 1) & (F.col("n") > F.col("most.n")))
    rows = rows.join(crowds.select("tree", "prefix", F.col("most.label").alias("home")), ["tree", "prefix"]).filter("label <> home")
    return rows.select("home", "node", "n_shingles", "label").distinct()


def meetings(docs: DataFrame, guests: DataFrame, members: DataFrame, words: int, percent: int, block_docs: int, block_values: int) -> DataFrame:
    """Links of guests with their homes' members, (node, n_shingles, label), and with each other.

    They meet in blocks of bounded documents and shingles, with their full sets; labels that a block has joined aren't
    compared again, and only links leave it, never pairs.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    cut = least_agreement(percent / 100)

    def meet(table: pa.Table) -> pa.Table:
        nodes, labels, sides, bodies = table.column("node").to_pylist(), table.column("label").to_pylist(), table.column("side").to_numpy(), common.column_bytes(table.column("text"))
        sets: list[np.ndarray] = []
        signs = []
        for some in common.groups(bodies, 1 << 20):
            values, first = shingle_sets([bodies[k] for k in some], words)
            sets += [values[first[j] : first[j + 1]].copy() for j in range(len(some))]
            signs.append(signatures(values, first))
        sig, n = np.concatenate(signs), np.fromiter(map(len, sets), np.int64, len(sets))
        label = np.array(labels, np.int64)
        right = np.flatnonzero((sides != 0) & (n > 0))
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = root[x]
            return x

        found = []
        for x in np.flatnonzero((sides != 1) & (n > 0)).tolist():
            near = right[(label[right] != label[x]) & (np.minimum(n[right], n[x]) >= percent / 100 * np.maximum(n[right], n[x]) - 1e-9)]
            near = near[near > x] if sides[x] == 2 else near
            agree = (sig[near] == sig[x]).mean(1)
            for y in near[np.argsort(-agree, kind="stable")[: int((agree >= cut).sum())]].tolist():
                a, b = top(labels[x]), top(labels[y])
                if a != b and similar(sets[x], sets[y], percent):
                    root[max(a, b)] = min(a, b)
                    found.append((nodes[x], nodes[y]))
        return pa.Table.from_batches([common.to_batch(found, schema)] if found else [], schema)

    shards = lambda docs, values: F.greatest(F.ceil(F.col(docs) / F.lit(block_docs)), F.ceil(F.col(values) / F.lit(block_values)))
    homes = guests.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("values")).select("home", shards("n", "values").alias("rooms"))
    members = members.join(homes, F.col("label") == F.col("home"), "left_semi").withColumn("home", F.col("label"))
    sizes = members.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("values")).select("home", shards("n", "values").alias("own"))
    sizes = common.hinted(common.staged(sizes.join(homes, "home"), "homes"))
    part = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    here = members.join(sizes, "home").select("home", "node", "label", F.lit(1).alias("side"), F.negative(part("own") + 1).alias("low"), each("rooms").alias("high"))
    there = guests.join(sizes, "home").withColumn("mine", part("rooms"))
    visits = there.select("home", "node", "label", F.lit(0).alias("side"), each("own").alias("low"), F.col("mine").alias("high")).withColumn("low", F.negative(F.col("low") + 1))
    among = there.withColumn("with", each("rooms"))
    side = F.when(F.col("with") == F.col("mine"), 2).when(F.col("mine") < F.col("with"), 0).otherwise(1)
    among = among.select("home", "node", "label", side.alias("side"), F.least("mine", "with").alias("low"), F.greatest("mine", "with").alias("high"))
    rows = docs.select("node", "text").join(here.union(visits).union(among).hint("merge"), "node")
    return rows.groupBy("home", "low", "high").applyInArrow(meet, "a long, b long")


def confirmed(docs: DataFrame, pairs: DataFrame, classes: DataFrame, words: int, percent: int, cell_docs: int, cell_pairs: int, cell_values: int) -> DataFrame:
    """Links of ``pairs`` that hold on the full sets, without those between documents that a cell has joined already.

    ``s`` shards make ``s * (s + 1) / 2`` cells, each with two shards' documents and a share of the pairs.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    # labels stand for documents that are joined already, so that a large group counts as one node here
    component = connected_components(pairs.select("la", "lb").distinct(), "la", "lb")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("doc"), F.col("la").alias("node")), F.struct(F.col("b").alias("doc"), F.col("lb").alias("node")))).alias("x")).select("x.*").distinct()
    known = ends.join(classes.select(F.col("node").alias("doc"), "n_shingles"), "doc").join(component, "node")
    sizes = known.groupBy("component").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("values"))
    weight = pairs.groupBy(F.col("la").alias("node")).agg(F.count(F.lit(1)).alias("n")).join(component, "node").groupBy("component").agg(F.sum("n").alias("pairs"))
    shards = F.greatest(F.ceil(F.col("docs") / F.lit(cell_docs)), F.ceil(F.sqrt(2 * F.col("pairs") / F.lit(cell_pairs))), F.ceil(2 * F.col("values") / F.lit(cell_values)))
    sizes = sizes.join(weight, "component").select("component", shards.alias("shards"))
    shard = component.join(sizes, "component").select("node", "component", "shards")
    edges = pairs.join(shard.withColumnRenamed("node", "la"), "la")
    of = lambda x: F.pmod(F.xxhash64(x), F.col("shards"))
    edges = common.staged(edges.select("a", "b", "la", "lb", F.xxhash64("component", F.least(of("a"), of("b")), F.greatest(of("a"), of("b"))).alias("cell")), "edges")
    members = edges.select(F.col("a").alias("node"), F.col("cell").alias("home")).union(edges.select(F.col("b").alias("node"), F.col("cell").alias("home"))).distinct()
    texts = docs.select("node", "text").join(members.hint("merge"), "node")

    def check(_key: tuple, links: pa.Table, rows: pa.Table) -> pa.Table:
        nodes, bodies = rows.column("node").to_pylist(), common.column_bytes(rows.column("text"))
        sets: dict[int, list[np.ndarray]] = {}
        for some in common.groups(bodies, 1 << 20):
            values, first = shingle_sets([bodies[k] for k in some], words)
            for j, k in enumerate(some):
                held = sets.setdefault(nodes[k], [])
                mine = values[first[j] : first[j + 1]].copy()
                if not any(np.array_equal(mine, x) for x in held):
                    held.append(mine)
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = root[x]
            return x

        ends = [links.column(x).to_numpy() for x in ("a", "b", "la", "lb")]
        order = np.lexsort((ends[1], ends[0]))
        found = []
        for at in range(0, len(order), 1 << 16):  # crowds have many pairs: few at a time as Python objects
            for a, b, la, lb in zip(*(x[order[at : at + (1 << 16)]].tolist() for x in ends), strict=True):
                x, y = top(la), top(lb)
                if x != y and any(similar(s, t, percent) for s in sets[a] for t in sets[b]):
                    root[max(x, y)] = min(x, y)
                    found.append((a, b))
        return pa.Table.from_batches([common.to_batch(found, schema)] if found else [], schema)

    return edges.groupBy("cell").cogroup(texts.groupBy("home")).applyInArrow(check, "a long, b long")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if not len(a) or not len(b):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def verdicts(docs: DataFrame, nodes: Nodes, words: int = 4, percent: int = 80, trees: int = 16, reach: int = 3, least_depth: int = 2, cell_docs: int = 1500, cell_pairs: int = 20_000, cell_values: int = 8_000_000, block_docs: int = 1000, text_col: str = "text") -> DataFrame:
    """node, doc_id, n_shingles, component_id and kept of every row."""
    common.ensure_workers(docs.sparkSession)
    docs = docs.select(nodes.number.alias("node"), nodes.is_null.alias("null_id"), F.col(text_col).cast("string").alias("text"))
    sketches = common.staged(sketch(docs, words), "sketches")
    full = sketches.filter("n_shingles > 0")
    classes = common.staged(full.groupBy("set_key").agg(F.min("node").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "classes")
    found = common.staged(shared_trees(classes, trees, least_depth), "trees")

    def links_of(pairs: DataFrame) -> DataFrame:
        pairs = common.staged(pairs, "pairs")
        if pairs.isEmpty():
            return pairs.select("a", "b")
        return common.staged(confirmed(docs, pairs, classes, words, percent, cell_docs, cell_pairs, cell_values), "confirmed")

    def placed(component: DataFrame) -> DataFrame:
        label = component.withColumnRenamed("component", "label")
        return sorted_orders(classes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), found, trees)

    firsts = classes.select("set_key", F.col("node").alias("first"))
    # an id with several rows belongs to the classes of all of them
    again = sketches.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")
    links = full.select("node", "set_key").join(again, "node", "left_semi").join(firsts, "set_key").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    links = common.staged(links, "repeated")
    component = connected_components(links)
    links = links.union(links_of(candidates(placed(component), least_depth, reach, percent / 100)))
    component = connected_components(links)
    guests = common.staged(crowd_guests(placed(component), least_depth, reach), "guests")
    if not guests.isEmpty():
        members = classes.join(component.withColumnRenamed("component", "label"), "node", "left").select("node", "n_shingles", F.coalesce("label", "node").alias("label"))
        links = links.union(common.staged(meetings(docs, guests, members, words, percent, block_docs, cell_values), "meetings"))
        component = connected_components(links)
    named = firsts.join(component.withColumnRenamed("node", "first"), "first", "left").select("set_key", F.coalesce("component", "first").alias("component"))
    rows = sketches.select("node", "null_id", "n_shingles", "set_key").join(named, "set_key", "left")
    # a row without a set goes with the other rows of its id
    alone = again.join(component, "node").withColumnRenamed("component", "shared")
    rows = rows.join(alone, "node", "left").withColumn("component", F.coalesce("component", "shared", "node"))
    if nodes.nulls and not nodes.last:
        # numbers of null ids come first here: a component with a real id takes the least of them as its name
        rows = common.staged(rows, "components")
        real = rows.groupBy("component").agg(F.min(F.when(~F.col("null_id"), F.col("node"))).alias("real"), F.count(F.lit(1)).alias("n"))
        rows = common.skew_join(rows, common.staged(real, "named"), ["component"], ["node"]).withColumn("component", F.coalesce("real", "component"))
    return rows.select("node", F.when(~F.col("null_id"), F.col("node")).alias("doc_id"), "n_shingles", F.when(~nodes.of_null("component"), F.col("component")).alias("component_id"), (F.col("node") == F.col("component")).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return verdicts(docs, Nodes(docs, id_col, text_col), text_col=text_col, **limits).drop("node")


ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[pos:pos + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS pos FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common_n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common_n >= 80 * (x.n + y.n - common_n)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM t UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT t.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, t.doc_id = component_id AS kept
FROM t JOIN m ON m.doc_id = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id
"""
