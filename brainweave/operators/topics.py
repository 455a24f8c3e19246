"""Topic candidates: near neighbours into clusters, near copies out, and scores for a shortlist. Deterministic throughout.

Topics are joined by a neighbour list (topic, other, similarity), as ``knn.knn_join`` or a stored index (``cells.search_join``) gives it, so no pair
of topics is compared that isn't near. Two topics that have each other in their lists are linked. Clusters come from label propagation: in each round
a topic takes the label with the largest sum of similarities among its neighbours and itself, the smaller label on a tie; at first it has the
smaller id of itself and its nearest neighbour, so that two that are nearest to each other don't swap labels for ever. A round is two
aggregations over links; links and labels are written to the shared folder, and lists are of bounded length, so a large cluster is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brainweave.sources import sinks

#: Weight of a topic's own label among its neighbours' similarities.
OWN = 0.5


def mutual(neighbours: DataFrame, least: float) -> DataFrame:
    """(topic, other, similarity): pairs that are in each other's lists and as like as ``least``, both ways; ids and vectors that repeat count once."""
    near = neighbours.filter((F.col("similarity") >= least) & (F.col("topic") != F.col("other"))).groupBy("topic", "other").agg(F.max("similarity").alias("similarity"))
    back = near.select(F.col("other").alias("topic"), F.col("topic").alias("other"))
    return near.join(back, ["topic", "other"], "left_semi")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read from there."""
    path = sinks.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clusters(topics: DataFrame, links: DataFrame, rounds: int = 10) -> DataFrame:
    """(topic, cluster): labels after so many rounds, or when none changes any more. A topic without links is a cluster of its own."""
    spark = topics.sparkSession
    links = _stored(links, "links")  # every round reads them, and to find them may be the larger part of the work
    nearest = links.groupBy("topic").agg(F.min_by("other", F.struct((-F.col("similarity")).alias("s"), "other")).alias("_other"))
    labels = topics.select("topic").distinct().join(nearest, "topic", "left").select("topic", F.least("topic", "_other").alias("cluster"))
    for _ in range(rounds):
        votes = links.join(labels.withColumnsRenamed({"topic": "other"}), "other").select("topic", "cluster", "similarity")
        own = labels.select("topic", "cluster", F.lit(OWN).alias("similarity"))
        sums = votes.unionByName(own).groupBy("topic", "cluster").agg(F.round(F.sum("similarity"), 9).alias("s"))
        best = sums.groupBy("topic").agg(F.min_by("cluster", F.struct((-F.col("s")).alias("s"), "cluster")).alias("cluster"))
        new = _stored(best, "labels")
        same = new.join(labels.select("topic", F.col("cluster").alias("_old")), "topic").filter("cluster != _old").isEmpty()
        labels = new
        if same:
            break
    return labels


def without_copies(topics: DataFrame, neighbours: DataFrame, like: float = 0.95) -> DataFrame:
    """topics (topic, seen_at, ...) without those that are near copies of an earlier one, or of one as old with a smaller id, in their list."""
    when = topics.select("topic", "seen_at")
    pairs = neighbours.filter(F.col("similarity") >= like).select("topic", "other").join(when, "topic")
    pairs = pairs.join(when.withColumnsRenamed({"topic": "other", "seen_at": "_seen"}), "other")
    later = pairs.filter("_seen < seen_at OR (_seen = seen_at AND other < topic)").select("topic").distinct()
    return topics.join(later, "topic", "left_anti")


def scores(topics: DataFrame, labels: DataFrame, neighbours: DataFrame, as_of: Column, half_life_days: float = 7, digits: int = 6) -> DataFrame:
    """(topic, cluster, novelty, timeliness, support, score) of topics (topic, seen_at, relevance).

    novelty: 1 less the largest similarity to a listed topic of another cluster that was seen before; timeliness halves with each half-life;
    support: the share of a topic's list that is in its own cluster. The score is their mean with the relevance.
    """
    own = topics.select("topic", "seen_at", "relevance").join(labels, "topic")
    other = own.select(F.col("topic").alias("other"), F.col("seen_at").alias("_seen"), F.col("cluster").alias("_cluster"))
    listed = neighbours.filter("topic != other").join(own.select("topic", "seen_at", "cluster"), "topic").join(other, "other")
    earlier = (F.col("_cluster") != F.col("cluster")) & (F.col("_seen") < F.col("seen_at"))
    seen = listed.groupBy("topic").agg(F.max(F.when(earlier, F.col("similarity"))).alias("_like"), F.avg((F.col("_cluster") == F.col("cluster")).cast("double")).alias("_share"))
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("seen_at").cast("timestamp"))) / 86_400e6
    found = own.join(seen, "topic", "left").select(
        "topic", "cluster", F.round(1 - F.coalesce("_like", F.lit(0.0)), digits).alias("novelty"),
        F.round(F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / half_life_days), digits).alias("timeliness"), F.round(F.coalesce("_share", F.lit(0.0)), digits).alias("support"), "relevance",
    )
    mean = (F.col("novelty") + F.col("timeliness") + F.col("support") + F.col("relevance")) / 4
    return found.select("topic", "cluster", "novelty", "timeliness", "support", F.round(mean, digits + 2).alias("score"))
