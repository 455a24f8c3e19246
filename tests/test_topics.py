import datetime as dt
import math
import random

from brainweave.operators import knn, topics
from pyspark.sql import functions as F


def propagate(ids, links, rounds):
    label = {}
    for i in ids:
        own = sorted((-s, b) for a, b, s in links if a == i)
        label[i] = min(i, own[0][1]) if own else i
    for _ in range(rounds):
        new = {}
        for i in ids:
            votes = {label[i]: topics.OWN}
            for a, b, s in links:
                if a == i:
                    votes[label[b]] = votes.get(label[b], 0) + s
            new[i] = min(votes, key=lambda c: (-round(votes[c], 9), c))
        if new == label:
            break
        label = new
    return label


def made(spark, seed=3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = [(i, [x + r.gauss(0, 0.35) for x in centres[i % 4]], dt.datetime(2024, 1, 1 + i % 20), (i % 5) / 5) for i in range(60)]
    rows.append((60, rows[7][1], dt.datetime(2024, 1, 25), 0.0))
    df = spark.createDataFrame(rows, "topic int, v array<double>, seen_at timestamp_ntz, relevance double")
    near = knn.knn_join(df, "topic", "v", df.select(F.col("topic").alias("q"), F.col("v").alias("w")), "q", "w", 6, exclude_self=True)
    return df, near.select(F.col("q").alias("topic"), F.col("topic").alias("other"), "similarity")


def test_clusters_agree_with_propagation_over_all_links(spark):
    df, near = made(spark)
    links = topics.mutual(near, 0.5)
    pairs = {(r.topic, r.other): r.similarity for r in links.collect()}
    listed = {(r.topic, r.other) for r in near.filter("similarity >= 0.5").collect()}
    assert set(pairs) == {(a, b) for a, b in listed if (b, a) in listed} and pairs
    got = {r.topic: r.cluster for r in topics.clusters(df, links, 6).collect()}
    assert got == propagate(sorted(got), [(a, b, s) for (a, b), s in pairs.items()], 6)
    assert len(set(got.values())) < 30 and got[60] == got[7]


def test_copies_and_scores(spark):
    df, near = made(spark)
    assert 60 not in {r.topic for r in topics.without_copies(df, near, 0.999).collect()}
    labels = df.select("topic", (F.col("topic") % 4).alias("cluster"))
    rows = {r.topic: r for r in df.collect()}
    lists = {}
    for r in near.collect():
        lists.setdefault(r.topic, []).append((r.other, r.similarity))
    for s in topics.scores(df, labels, near, F.lit(dt.datetime(2024, 1, 22))).collect():
        own = rows[s.topic]
        before = [x for o, x in lists[s.topic] if o % 4 != s.topic % 4 and rows[o].seen_at < own.seen_at]
        share = sum(o % 4 == s.topic % 4 for o, _ in lists[s.topic]) / len(lists[s.topic])
        age = max(0.0, (dt.datetime(2024, 1, 22) - own.seen_at).total_seconds() / 86_400)
        want = (1 - max(before, default=0.0), 0.5 ** (age / 7), share)
        assert all(math.isclose(a, b, abs_tol=2e-6) for a, b in zip((s.novelty, s.timeliness, s.support), want))
        assert math.isclose(s.score, (sum(want) + own.relevance) / 4, abs_tol=3e-6)


def test_topics_alone_and_none(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 0.5), (2, dt.datetime(2024, 1, 2), 0.5)], "topic int, seen_at timestamp_ntz, relevance double")
    none = spark.createDataFrame([], "topic int, other int, similarity double")
    assert sorted(map(tuple, topics.clusters(df, topics.mutual(none, 0.5)).collect())) == [(1, 1), (2, 2)]
    assert [r.novelty for r in topics.scores(df, topics.clusters(df, none), none, F.lit(dt.datetime(2024, 1, 3))).collect()] == [1.0, 1.0]
    assert topics.clusters(df.limit(0), none).count() == 0


def test_links_are_found_once_for_all_rounds(spark):
    df, near = made(spark)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    links = topics.mutual(near, 0.5)
    found = topics.clusters(df, links.withColumn("similarity", counted("similarity")), 6)
    assert found.count() == 61 and seen.value == links.count() > 0
