"""Joins of sets by what they share, without joining all that share a common token.

A token that few sets hold joins them directly. For tokens in more than ``HOT`` sets, pairs are not listed per token: those that share rarer ones
get the common tokens' part by looking it up in the two sets, and pairs that share common ones only are found by prefixes. Among a set's common
tokens, rarest first, all but the last ``least - 1`` are its prefix; two sets that share ``least`` tokens share one of both prefixes. So a
token in a third of all sets makes no more pairs than are in the result. What is left of a common token's pairs is dealt by salt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sets that hold a token for it to count as common, and rows of a token that meet in one task.
HOT = 1000
#: Rows or pairs that a task gets, about.
EACH = 500_000


def _salted(left: DataFrame, right: DataFrame, hot: int) -> DataFrame:
    """left (token, a, df, ...) and right (token, b, df, ...) joined by token, the left side of a token in pieces of about ``hot`` rows."""
    parts = F.ceil(F.col("df") / hot).cast("int")
    one = left.withColumn("_part", F.pmod(F.xxhash64("a"), parts.cast("long")).cast("int"))
    two = right.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("df")
    return one.join(two, ["token", "_part"]).drop("_part", "df")


def _held(rows: DataFrame, name: str) -> DataFrame:
    """(name, name_n): a set's tokens with their numbers; as large as the set."""
    return rows.groupBy(F.col("id").alias(name)).agg(F.map_from_entries(F.collect_list(F.struct("token", "n"))).alias(f"{name}_n"))


def _both(one: Column, two: Column) -> Column:
    return F.aggregate(F.map_entries(one), F.lit(0).cast("long"), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(two, e["key"]), F.lit(0)))


def overlaps(sets: DataFrame, least: int, hot: int = HOT) -> DataFrame:
    """(a, b, shared): all pairs a < b of ids whose numbers n, multiplied token by token, sum to ``least`` or more.

    sets: id, token, n, one row per id and token.
    """
    spread = lambda of: of.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1)
    light_pairs = F.when(F.col("df") <= hot, F.expr("df * (df - 1) div 2"))
    size = spread(sets).agg(F.sum("df").alias("rows"), F.sum(light_pairs).alias("pairs")).first()
    parts = lambda n: max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(n or 0) // EACH))
    # dealt out before tokens are counted: the joins by token follow these partitions, which Spark doesn't put together
    rows = sets.join(spread(sets.select("token").repartition(parts(size["rows"]), "token")), "token").select("id", "token", F.col("n").cast("long").alias("n"), "df")
    light, heavy = rows.filter(F.col("df") <= hot), rows.filter(F.col("df") > hot)

    one, two = light.withColumnRenamed("id", "a"), light.select("token", F.col("id").alias("b"), F.col("n").alias("m"))
    near = one.join(two, "token").filter("a < b").select("a", "b", (F.col("n") * F.col("m")).alias("light"))
    # pairs are added up after their shuffle only, as few of them are equal
    near = near.repartition(parts(size["pairs"]), "a", "b").groupBy("a", "b").agg(F.sum("light").alias("light"))
    a_held, b_held = _held(heavy, "a"), _held(heavy, "b")
    more = F.when(F.col("a_n").isNotNull() & F.col("b_n").isNotNull(), _both(F.col("a_n"), F.col("b_n"))).otherwise(0)
    by_light = near.join(a_held, "a", "left").join(b_held, "b", "left").select("a", "b", (F.col("light") + more).alias("shared"))

    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("df"), F.desc("token")))
    prefix = heavy.withColumn("_place", place).filter(F.col("_place") >= least).drop("_place")
    left = lambda r: r.select("token", F.col("id").alias("a"), "df")
    right = lambda r: r.select("token", F.col("id").alias("b"), "df")
    repeated = heavy.filter("n > 1")  # such a token can make a pair by itself
    pairs = _salted(left(prefix), right(prefix), hot).unionByName(_salted(left(repeated), right(heavy), hot))
    pairs = pairs.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    by_heavy = pairs.join(a_held, "a").join(b_held, "b").select("a", "b", _both(F.col("a_n"), F.col("b_n")).alias("shared"))

    every = by_light.unionByName(by_heavy).filter(F.col("shared") >= least)
    return every.groupBy("a", "b").agg(F.max("shared").alias("shared"))  # a pair found both ways: the light way has the whole sum


def best_overlap(names: DataFrame, known: DataFrame, digits: int, hot: int = HOT) -> DataFrame:
    """(name_id, person_id, jaccard): for each set of names the set of known with the largest Jaccard, unless several tie.

    names: name_id, nt; known: person_id, pt (arrays of distinct tokens). Two tokens must be shared, or the one that a name has.
    """
    people = known.select("person_id", F.size("pt").alias("ps"), F.explode("pt").alias("token"))
    # a name of one token: the smallest set that holds it, if there is one; no pair is listed
    sizes = people.groupBy("token", "ps").agg(F.count(F.lit(1)).alias("n"), F.min("person_id").alias("person_id"))
    smallest = sizes.groupBy("token").agg(F.min(F.struct("ps", "n", "person_id")).alias("s")).filter("s.n = 1")
    single = names.filter(F.size("nt") == 1).select("name_id", F.get("nt", F.lit(0)).alias("token"))
    of_one = single.join(smallest, "token").select("name_id", "s.person_id", F.round(1 / F.col("s.ps"), digits).alias("jaccard"))

    # of more: by all tokens but the most common
    spread = people.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    longer = names.filter(F.size("nt") > 1).select("name_id", F.explode("nt").alias("token")).join(spread, "token")
    rarer = lambda rows, key: rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("df"), F.desc("token")))).filter("_place > 1")
    left = rarer(people.select("person_id", "token").join(spread, "token"), "person_id").select("token", F.col("person_id").alias("a"), "df")
    right = rarer(longer, "name_id").select("token", F.col("name_id").alias("b"), "df")
    pairs = _salted(left, right, hot).select(F.col("a").alias("person_id"), F.col("b").alias("name_id")).distinct()
    sets = pairs.join(names, "name_id").join(known.select("person_id", "pt"), "person_id")
    both = F.size(F.array_intersect("nt", "pt"))
    found = sets.filter(both >= 2).select("name_id", "person_id", F.round(both / (F.size("nt") + F.size("pt") - both), digits).alias("jaccard"))
    # the best and the number of ties by aggregation: a common name's pairs never meet in one window
    top = found.groupBy("name_id").agg(F.max(F.struct("jaccard", "person_id")).alias("hi"), F.max(F.struct("jaccard", (-F.col("person_id")).alias("p"))).alias("lo"))
    of_more = top.filter(F.col("hi.person_id") == -F.col("lo.p")).select("name_id", "hi.person_id", "hi.jaccard")
    return of_one.unionByName(of_more)
