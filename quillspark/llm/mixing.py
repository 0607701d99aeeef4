"""Mixing sources to target weights by hierarchical budgeting, in DataFrame expressions only.

The sources form a tree: domain, language, source. The token budget goes down from the root: a node's budget is shared
among its children in proportion to their weights, no child gets more than its subtree can give (``max_epochs`` times its
tokens), and what such a child can't use goes to its siblings by their weights; only what all siblings together can't use
stays with the parent's level, as the parent's own limit. A subtree without any weight gets nothing and counts in no limit.
All amounts are whole tokens: what rounding down leaves goes out a token each by largest remainder, then by name.

A leaf reads its documents in seeded epochs: each epoch orders them anew by a keyed hash. Whole epochs come first; of the
last one the longest prefix that fits is taken. That prefix ends at one hash value per leaf, which is found by descent: sums
over 4,096 hash ranges, then over the 4,096 parts of the range that holds the end, then the order within a single part; so
documents are chosen by comparing hashes, without sorting a leaf.

Tokens are words ``[^\\x20\\x09-\\x0D]+``. Null language or source is a node named "" of its own; null text has no words and
is chosen with its leaf; documents that share an id share its hash and are chosen together or not at all; an empty table
gives no row. Columns named like the added ones are replaced in ``mix`` and kept as they are in ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hinted, staged, words_column

#: Weights by level; names that a level lacks have weight ``DEFAULT_WEIGHT``.
WEIGHTS = {"domain": {"web": 60, "library": 40}, "lang": {"en": 55, "de": 15, "fr": 15, "es": 15}, "source": {}}
DEFAULT_WEIGHT = 10
LEVELS = ("domain", "lang", "source")
#: Hash characters that tell ranges apart at each step of the descent.
RANGE_CHARS = (3, 6)


def default_domain() -> Column:
    """Sources with an even number are "web", all others "library"."""
    return F.when(F.coalesce(F.col("source"), F.lit("")).rlike("[02468]$"), "web").otherwise("library")


def weight_of(level: str, weights: dict[str, int]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for name, weight in sorted(weights.items()):
        out = F.when(F.col(level) == name, int(weight)).otherwise(out)
    return out.cast("decimal(20,0)")


def share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``given``: the parent's ``budget`` shared among its children by ``weight``, none above its ``limit``."""
    w = Window.partitionBy(*parent).orderBy(F.col("limit") / F.col("weight"), name)
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    rest = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    big = "decimal(20,0)"
    nodes = nodes.withColumn("have", F.least(F.col("budget"), F.sum("limit").over(whole)).cast(big))
    nodes = nodes.withColumn("left", (F.col("have") - F.coalesce(F.sum("limit").over(upto), F.lit(0))).cast(big)).withColumn("weights", F.sum("weight").over(rest).cast(big))
    nodes = nodes.withColumn("full", F.col("limit") * F.col("weights") <= F.col("left") * F.col("weight"))
    # those that can't use their share come first in this order; the first other one fixes the rate of all that follow
    after = F.when(~F.col("full"), F.struct("left", "weights"))
    nodes = nodes.withColumn("rate", F.first(after, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a limit above an exact share is above the share rounded down by one at least, so that a token more always fits
    nodes = nodes.withColumn("down", F.when(F.col("rate").isNotNull(), F.expr("(rate.left * weight) DIV rate.weights")).cast(big)).withColumn("part", F.when(F.col("rate").isNotNull(), F.expr("(rate.left * weight) % rate.weights")))
    nth = F.row_number().over(Window.partitionBy(*parent, F.col("rate").isNull()).orderBy(F.desc("part"), name))
    more = F.when(nth <= F.col("rate.left") - F.sum("down").over(whole), 1).otherwise(0)
    given = F.when(F.col("rate").isNull(), F.col("limit")).otherwise(F.col("down") + more)
    return nodes.withColumn("given", given.cast(big)).drop("have", "left", "weights", "full", "rate", "budget", "weight", "limit", "down", "part")


def leaf_budgets(leaves: DataFrame, budget: int | None, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """(domain, lang, source, tokens, given) of every leaf from (domain, lang, source, tokens); no budget: all tokens once."""
    big = "decimal(20,0)"
    if budget is None:
        budget = leaves.agg(F.sum("tokens")).first()[0] or 0
    every = leaves
    leaves = every.withColumn("limit", (F.col("tokens") * max_epochs).cast(big))
    for level in LEVELS:  # what has no weight takes no part
        leaves = leaves.filter(weight_of(level, weights[level]) > 0)
    top = leaves.groupBy("domain").agg(F.sum("limit").cast(big).alias("limit"))
    given = share(top.withColumn("budget", F.lit(int(budget)).cast(big)).withColumn("weight", weight_of("domain", weights["domain"])).withColumn("root", F.lit(0)), ["root"], "domain")
    for k in (1, 2):
        level, above = LEVELS[k], list(LEVELS[:k])
        nodes = leaves.groupBy(*above, level).agg(F.sum("limit").cast(big).alias("limit"))
        nodes = nodes.join(given.select(*above, F.col("given").alias("budget")), above).withColumn("weight", weight_of(level, weights[level]))
        given = share(nodes, above, level)
    return every.join(given.select(*LEVELS, "given"), list(LEVELS), "left").withColumn("given", F.coalesce("given", F.lit(0).cast(big)).cast("long"))


def epoch_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def plan(rows: DataFrame, budget: int | None, max_epochs: int, weights: dict[str, dict[str, int]], seed: int) -> DataFrame:
    """A row per leaf: tokens, given, whole epochs and the hash at which the last epoch's prefix ends (null: none)."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    given = leaf_budgets(leaves, budget, max_epochs, weights)
    whole = F.when(F.col("tokens") > 0, F.expr("least(given DIV tokens, CAST(%d AS BIGINT))" % max_epochs)).otherwise(0).cast("long")
    given = staged(given.withColumn("whole", whole).withColumn("rest", F.col("given") - F.col("whole") * F.col("tokens")), "leaves")
    held = hinted(given.filter("rest > 0").select(*LEVELS, "whole", "rest"))
    keyed = rows.select(*LEVELS, "doc_id", "n_tokens").join(held, list(LEVELS)).withColumn("key", epoch_key(seed, F.col("whole") + 1, F.col("doc_id"))).withColumn("before", F.lit(0).cast("long"))
    up = lambda c: Window.partitionBy(*LEVELS).orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for chars in RANGE_CHARS:
        ranges = keyed.withColumn("range", F.substring("key", 1, chars)).groupBy(*LEVELS, "range", "before", "rest").agg(F.sum("n_tokens").alias("n"))
        ranges = ranges.withColumn("upto", F.col("before") + F.sum("n").over(up("range")))
        # the first range that does not fit as a whole holds the end; where all fit there is none
        ends = ranges.filter("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("range", (F.col("upto") - F.col("n")).alias("before"))).alias("end"))
        ends = hinted(staged(ends.select(*LEVELS, "end.range", "end.before"), "ends"))
        keyed = keyed.drop("before").withColumn("range", F.substring("key", 1, chars)).join(ends, [*LEVELS, "range"]).drop("range")
    keys = keyed.groupBy(*LEVELS, "key", "before", "rest").agg(F.sum("n_tokens").alias("n"))
    # prefix: all keys before the first one that no longer fits
    over = keys.withColumn("upto", F.col("before") + F.sum("n").over(up("key"))).filter("upto > rest").groupBy(*LEVELS).agg(F.min("key").alias("cut"))
    return given.join(over, list(LEVELS), "left").select(*LEVELS, "tokens", "given", "whole", "rest", "cut")


def leaf_columns(docs: DataFrame, domain: Column | None, lang_col: str, source_col: str) -> list[Column]:
    domain = default_domain() if domain is None else domain
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return [F.coalesce(domain, F.lit("")).alias("domain"), text(lang_col).alias("lang"), text(source_col).alias("source")]


def chosen_epochs(seed: int) -> Column:
    """How often a document is read, from its leaf's plan."""
    fits = (F.col("rest") > 0) & (F.col("cut").isNull() | (epoch_key(seed, F.col("whole") + 1, F.col("doc_id")) < F.col("cut")))
    return F.col("whole") + F.when(fits, 1).otherwise(0)


def mix(docs: DataFrame, budget: int | None = None, max_epochs: int = 2, weights: dict | None = None, seed: int = 1, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A row per document and epoch in which it is read: doc_id, domain, lang, source, n_tokens, epoch (from 1)."""
    weights = WEIGHTS if weights is None else weights
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *leaf_columns(docs, domain, lang_col, source_col), F.size(words_column(F.col(text_col))).cast("long").alias("n_tokens"))
    rows = staged(rows, "mix")
    found = hinted(staged(plan(rows, budget, max_epochs, weights, seed), "plan"))
    read = rows.join(found.select(*LEVELS, "whole", "rest", "cut"), list(LEVELS)).withColumn("epochs", chosen_epochs(seed)).filter("epochs > 0")
    return read.select("doc_id", *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs"))).alias("epoch"))


def mix_documents(docs: DataFrame, budget: int | None = None, max_epochs: int = 2, weights: dict | None = None, seed: int = 1, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents themselves, each as often as the mixture reads it, with their own columns."""
    weights = WEIGHTS if weights is None else weights
    leaf = leaf_columns(docs, domain, lang_col, source_col)
    rows = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), *leaf, F.size(words_column(F.col(text_col))).cast("long").alias("n_tokens")), "mix")
    found = hinted(staged(plan(rows, budget, max_epochs, weights, seed), "plan"))
    held = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), *leaf)
    read = held.join(found.select(*LEVELS, "whole", "rest", "cut"), list(LEVELS)).withColumn("epochs", chosen_epochs(seed)).filter("epochs > 0")
    return read.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs"))).alias("epoch")).select("row.*")


def _level_sql(k: int) -> str:
    """SQL of one level of the tree; k = 0: domains."""
    level, above = LEVELS[k], ", ".join(LEVELS[:k]) or "root"
    cases = {0: "CASE domain WHEN 'web' THEN 60 WHEN 'library' THEN 40 ELSE 10 END", 1: "CASE lang WHEN 'en' THEN 55 WHEN 'de' THEN 15 WHEN 'fr' THEN 15 WHEN 'es' THEN 15 ELSE 10 END", 2: "10"}[k]
    keys = ", ".join(LEVELS[: k + 1])
    budget = "SELECT 0 AS root, (SELECT sum(tokens) FROM leaves) AS budget" if k == 0 else f"SELECT {above}, given AS budget FROM g{k - 1}"
    return f"""
n{k} AS (SELECT {"0 AS root, " if k == 0 else ""}{keys}, CAST(sum(tokens) * 2 AS HUGEINT) AS lim, CAST({cases} AS HUGEINT) AS weight FROM leaves GROUP BY ALL),
b{k} AS ({budget}),
f{k} AS (SELECT n.*, least(CAST(budget AS HUGEINT), CAST(sum(lim) OVER (PARTITION BY {", ".join("n." + x for x in above.split(", "))}) AS HUGEINT)) AS have FROM n{k} n JOIN b{k} b USING ({above})),
l{k} AS (SELECT *, have - CAST(coalesce(sum(lim) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS left_over,
  CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS HUGEINT) AS weights FROM f{k}
  WINDOW w AS (PARTITION BY {above} ORDER BY lim / weight, {level})),
r{k} AS (SELECT *, first_value(CASE WHEN lim * weights > left_over * weight THEN {{'a': left_over, 'b': weights}} END IGNORE NULLS)
  OVER (PARTITION BY {above} ORDER BY lim / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rate FROM l{k}),
d{k} AS (SELECT *, CASE WHEN rate IS NOT NULL THEN (rate.a * weight) // rate.b END AS down, CASE WHEN rate IS NOT NULL THEN (rate.a * weight) % rate.b END AS part FROM r{k}),
g{k} AS (SELECT {keys}, CASE WHEN rate IS NULL THEN lim ELSE down + CASE WHEN row_number() OVER (PARTITION BY {above}, rate IS NULL ORDER BY part DESC, {level})
  <= rate.a - sum(down) OVER (PARTITION BY {above}) THEN 1 ELSE 0 END END AS given FROM d{k}),"""


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(source, ''), '[02468]$') THEN 'web' ELSE 'library' END AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM d GROUP BY ALL),{"".join(_level_sql(k) for k in range(3))}
p AS (SELECT domain, lang, source, tokens, given, CASE WHEN tokens > 0 THEN least(given // tokens, 2) ELSE 0 END AS whole
      FROM leaves JOIN g2 USING (domain, lang, source)),
k AS (SELECT d.*, whole, given - whole * tokens AS rest, md5('1:' || CAST(CAST(whole + 1 AS BIGINT) AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS key
      FROM d JOIN p USING (domain, lang, source)),
u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto FROM k),
c AS (SELECT *, min(CASE WHEN upto > rest THEN key END) OVER (PARTITION BY domain, lang, source) AS cut FROM u),
e AS (SELECT *, whole + CASE WHEN rest > 0 AND (cut IS NULL OR key < cut) THEN 1 ELSE 0 END AS epochs FROM c)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(1, CAST(epochs AS BIGINT) + 1)) AS BIGINT) AS epoch FROM e WHERE epochs > 0
"""
