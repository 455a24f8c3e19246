"""Operator 6, mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A token budget goes down a tree (domain, language, source; any list of columns). A node's budget is split among its
children by weight, but no child gets more than its subtree holds (its tokens times ``max_epochs``): what one
can't take goes to its siblings, by weight again, and only what all of them can't take is left to the parent's siblings.
That split has a closed form: with the children sorted by capacity over weight and
l(i) = (budget - capacities before i) / (weights from i on), each gets min(capacity, weight * max l).

Each leaf then takes the prefix of its token budget from its epochs, one after another. Epoch e is the leaf's documents
in the order of md5(seed:e:doc_id). Whole epochs count as copies; of the last one the documents whose running sum of tokens stays
inside what is left are taken. The order's first digits are buckets, so the running sum of a leaf that holds a
third of all rows is that of its buckets' sums, plus one inside the bucket.

Tokens are words: runs of characters other than blank, tab, newline and return. Nulls in level columns are the value
'none'; null texts have no tokens, and texts without tokens are taken with whole epochs, or if their turn comes before
the budget ends. Rows that share leaf, doc_id and tokens are taken or left together. Values without a weight weigh
``default_weight``. An empty table gives an empty result. Columns other than doc_id, text and the levels are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brainweave.llm import common

#: The weights of the registered query.
WEIGHTS = {
    "domain": {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0},
    "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0},
}
LEVELS = ("domain", "lang", "source")


def with_domain(docs: DataFrame, into: str = "domain") -> DataFrame:
    """The documents table has no domain: it is the source's number modulo 4."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    return docs.withColumn(
        into, F.when(number != "", F.concat(F.lit("domain"), (number.cast("long") % 4).cast("string"))).otherwise("none")
    )


def weight_of(level: str, weights: dict[str, dict[str, float]], default: float):
    found = F.lit(default)
    for value, w in weights.get(level, {}).items():
        found = F.when(F.col(level) == value, F.lit(w)).otherwise(found)
    return found


def leaf_budgets(
    leaves: DataFrame, levels: list[str], weights: dict, fraction: float, max_epochs: int, default_weight: float = 1.0
) -> DataFrame:
    """leaves (levels, supply) with budget: whole tokens per leaf, of fraction * all tokens."""
    plan = leaves.withColumn("cap", F.col("supply").cast("double") * max_epochs)
    root = Window.partitionBy(F.lit(0))
    plan = plan.withColumn("budget", F.floor(F.sum("supply").over(root) * fraction).cast("double"))
    for depth, level in enumerate(levels):
        parent, node = levels[:depth], levels[: depth + 1]
        # one row per node, with its parent's budget
        nodes = plan.groupBy(*node).agg(F.sum("cap").alias("_cap"), F.first("budget").alias("_b"))
        nodes = nodes.withColumn("_w", weight_of(level, weights, default_weight))
        by = Window.partitionBy(*(parent or [F.lit(0)])).orderBy(F.col("_cap") / F.col("_w"), level)
        before = F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing))
        share = (F.col("_b") - before) / rest
        nodes = nodes.withColumn("_l", share)
        top = F.max("_l").over(Window.partitionBy(*(parent or [F.lit(0)])))
        nodes = nodes.withColumn("_got", F.greatest(F.lit(0.0), F.least(F.col("_cap"), F.col("_w") * top)))
        plan = plan.join(nodes.select(*node, "_got"), node).withColumn("budget", F.col("_got")).drop("_got")
    return plan.select(*levels, "supply", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def keys(levels: list[str]) -> list[Column]:
    """What a row is mixed by: doc_id, the levels and its tokens."""
    return [
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in levels],
        F.coalesce(F.regexp_count("text", F.lit("[^ \t\n\r]+")), F.lit(0)).cast("long").alias("n_tokens"),
    ]


def mix_sources(
    docs: DataFrame,
    levels: tuple[str, ...] = LEVELS,
    weights: dict[str, dict[str, float]] = WEIGHTS,
    fraction: float = 0.6,
    max_epochs: int = 2,
    seed: int = 17,
    small: int = 100_000,
) -> DataFrame:
    """doc_id, the levels, n_tokens and copies (0: not taken) per row of docs.

    The table of leaves is broadcast if it has up to ``small`` rows and shuffled beyond that.
    """
    levels = list(levels)
    rows = common.materialise(docs.select(*keys(levels)), "mix-rows")
    leaves = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("supply"))
    plan = common.materialise(leaf_budgets(leaves, levels, weights, fraction, max_epochs), "mix-plan")
    plan = plan.withColumn("epochs", F.when(F.col("supply") > 0, F.least(F.expr("budget div supply"), F.lit(max_epochs))).otherwise(0))
    plan = plan.withColumn("rest", F.when(F.col("epochs") < max_epochs, F.col("budget") - F.col("epochs") * F.col("supply")).otherwise(0))
    plan = plan.select(*levels, "epochs", "rest")
    dealt = rows.join(F.broadcast(plan) if plan.count() <= small else plan, levels)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    dealt = dealt.withColumn("key", key).withColumn("bucket", F.substring("key", 1, 3))
    sums = dealt.groupBy(*levels, "bucket").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*levels, "bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*levels, "bucket").orderBy(F.struct("key", "doc_id", "n_tokens"))
    inside = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)  # alike rows together
    done = dealt.withColumn("upto", F.sum("n_tokens").over(inside)).join(sums, [*levels, "bucket"])
    took = (F.col("before") + F.col("upto") <= F.col("rest")) & (F.col("rest") > 0)
    return done.select("doc_id", *levels, "n_tokens", (F.col("epochs") + took.cast("int")).cast("long").alias("copies"))


def take_mixed(docs: DataFrame, levels: tuple[str, ...] = LEVELS, bound: int = 1_000_000, **how) -> DataFrame:
    """The rows of docs, each as often as mix_sources takes it; with docs' columns.

    Rows that agree in id, levels and tokens are taken alike, so they are found by their id and a hash of these. Up to
    ``bound`` of these pairs (20 bytes each) are broadcast, so that texts aren't shuffled; more are joined by a shuffle.
    """
    names = [*levels, "n_tokens"]
    taken = mix_sources(docs, levels, **how).filter("copies > 0").select("doc_id", F.xxhash64(*names).alias("_of"), F.col("copies").cast("int").alias("_copies"))
    taken = common.materialise(taken.distinct().withColumnRenamed("doc_id", "_id"), "taken", common.files_for(docs.sparkSession, 1))
    own = dict(zip(["doc_id", *names], keys(list(levels)), strict=True))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), own["doc_id"].alias("_d"), F.xxhash64(*[own[c] for c in names]).alias("_h"))
    same = F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_of"))
    return (
        rows.join(F.broadcast(taken) if taken.count() <= bound else taken, same)
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select("_row.*")
    )
