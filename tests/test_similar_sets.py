import random
import re
from collections import Counter

import pytest
from brainweave.operators import lifecycle, linker, similar_sets
from pyspark.sql import functions as F


def metrics(spark, df):
    """The rows that every operator of a query put out, after it has run."""
    df.write.format("noop").mode("overwrite").save()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    values = store.executionMetrics(last)
    graph = store.planGraph(last).allNodes()
    out = []
    for i in range(graph.size()):
        ms = graph.apply(i).metrics()
        for j in range(ms.size()):
            m = ms.apply(j)
            if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                out.append(f"{m.name()}: {values.apply(m.accumulatorId())}")
    return "\n".join(out)


def brute(rows, least):
    held = {}
    for i, t, n in rows:
        held.setdefault(i, {})[t] = n
    out = {}
    for a in held:
        for b in held:
            if a < b and (s := sum(n * held[b].get(t, 0) for t, n in held[a].items())) >= least:
                out[a, b] = s
    return out


@pytest.mark.parametrize("least, hot", [(1, 3), (2, 3), (3, 2), (2, 1000)])
def test_overlaps_agree_with_all_pairs(spark, least, hot):
    r = random.Random(least * 10 + hot)
    rows = {(i, t): r.choice([1, 1, 1, 1, 2, 3]) for i in range(60) for t in r.sample("abcdefghijklmnop", r.randint(1, 5)) + (["HOT"] if i % 3 == 0 else [])}
    rows = [(i, t, n) for (i, t), n in rows.items()]
    got = similar_sets.overlaps(spark.createDataFrame(rows, "id int, token string, n int"), least, hot)
    assert {(x.a, x.b): x.shared for x in got.collect()} == brute(rows, least)


def test_a_common_token_lists_no_pairs(spark):
    """1,200 sets that share one token: none has another common one, so no prefix holds it and no pair is listed."""
    rows = [(i, "HOT", 1) for i in range(1200)] + [(i, f"own{i}", 1) for i in range(1200)]
    got = similar_sets.overlaps(spark.createDataFrame(rows, "id int, token string, n int"), 2, 100)
    assert got.count() == 0
    joined = re.findall(r"number of output rows: ([\d,]+)", metrics(spark, got))
    assert max(int(x.replace(",", "")) for x in joined) <= 2 * len(rows)


@pytest.mark.parametrize("hot", [2, 1000])
def test_best_names_agree_with_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(similar_sets, "HOT", hot)
    r = random.Random(7)
    first, last = ["john", "ann", "li", "max"], ["smith", "jones", "wu", "roe", "de la cruz"]
    people = [(i, " ".join(r.sample(first, r.randint(0, 2)) + r.sample(last, r.randint(0, 2)))) for i in range(60)]
    names = [(100 + i, " ".join(r.sample(first, r.randint(0, 2)) + r.sample(last, r.randint(0, 1)))) for i in range(40)] + [(900, ""), (901, "nobody")]
    want = {}
    for n, name in names:
        t = set(name.split())
        found = []
        for p, full in people:
            u = set(full.split())
            if t and len(t & u) >= min(2, len(t)):
                found.append((round(len(t & u) / len(t | u), 9), p))
        best = max((j for j, _ in found), default=None)
        if best is not None and Counter(j for j, _ in found)[best] == 1:
            want[n] = next(p for j, p in found if j == best)
    got = linker.best_names(spark.createDataFrame(names, "name_id int, name string"), spark.createDataFrame(people, "person_id int, full_name string"))
    assert {x.name_id: x.person_id for x in got.collect()} == want and len(want) > 5


def test_first_five_are_limited_before_the_shuffle(spark):
    df = spark.range(20_000).select(F.col("id").alias("amendment_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("user_id"), F.when(F.col("id") % 2 == 0, "new").otherwise("amend").alias("kind"), F.timestamp_seconds(F.lit(10**9) - F.col("id")).alias("committed_at"))
    got = lifecycle.founding(df)
    assert sorted(r.amendment_id for r in got.filter("bypass AND user_id = 'hot'").collect()) == [19984, 19988, 19990, 19994, 19996]
    assert got.count() == 20_000 and "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_tasks_that_share_one_word_make_no_pairs(spark):
    """300 entries and 300 open tasks share one word: no link, so no pair is listed; entry 300 has two words of task 7, and is tagged with one of task 8."""
    entries = [(i, "the garden", ["none"]) for i in range(300)] + [(300, "own7 garden own8 ", ["Tag8"]), (300, None, None), (301, "own9", None), (301, "garden", None)]
    e = spark.createDataFrame(entries, "entry_id int, full_text string, tags array<string>")
    tasks = spark.createDataFrame([(f"t{i}", f"Garden own{i} tag{i}" if i != 8 else "own8 tag8", "needsAction") for i in range(300)], "task_id string, title string, status string")
    got = linker.task_links(e, tasks)
    assert sorted((r.source_id, r.target_id) for r in got.collect()) == [(300, "t7"), (300, "t8"), (301, "t9")]
    joined = re.findall(r"number of output rows: ([\d,]+)", metrics(spark, got))
    assert max(int(x.replace(",", "")) for x in joined) <= 2000


def test_pairs_are_added_up_in_tasks_of_few(spark, monkeypatch):
    """30 tokens in 40 sets each are 23,400 pairs: with 1,000 for a task they go to 24 partitions, however few the session has."""
    monkeypatch.setattr(similar_sets, "EACH", 1000, raising=False)
    rows = [(i, f"t{i % 40 + k * 40 - i % 40}", 1) for i in range(40) for k in range(30)]
    got = similar_sets.overlaps(spark.createDataFrame(rows, "id int, token string, n int"), 2)
    assert {(x.a, x.b): x.shared for x in got.collect()} == brute(rows, 2)
    parts = re.findall(r"RepartitionByExpression \[a#\d+, b#\d+\], (\d+)", got._jdf.queryExecution().optimizedPlan().toString())
    assert parts and set(parts) == {"24"}
