import datetime as dt
import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
from brainweave.operators import cells, fulltext, graph, knn, linker, search
from pyspark.sql import functions as F


def test_knn_leaves_out_zero_and_odd_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, None), (6, [1.0, 0.0])], "id int, e array<float>")
    assert [(r.id, r.similarity, r["rank"]) for r in knn.knn(v, "id", "e", [1.0, 0.0], 3).collect()] == [(1, 1.0, 1), (6, 1.0, 2), (2, 0.0, 3)]
    got = knn.knn_join(v, "id", "e", v.select(F.col("id").alias("q"), F.col("e").alias("w")), "q", "w", 2, exclude_self=True)
    assert sorted((r.q, r.id, r.similarity) for r in got.collect()) == [(1, 2, 0.0), (1, 6, 1.0), (2, 1, 0.0), (2, 6, 0.0), (6, 1, 1.0), (6, 2, 0.0)]


def test_bm25_needs_all_terms(spark):
    d = spark.createDataFrame([(1, "red fox"), (2, "red red fox fox"), (3, "red"), (4, None), (5, "Fox, RED! and more words")], "id int, t string")
    assert [r.id for r in fulltext.bm25(d, "id", "t", "Red fox").collect()] == [2, 1, 5]
    assert fulltext.bm25(d, "id", "t", "日本 the").count() == 0


def test_shared_entities(spark):
    m = spark.createDataFrame([(1, "a", None), (1, "b", 0.5), (1, "c", 0.49), (2, "a", 0.9), (2, "b", 0.9), (3, "b", 0.9), (3, "b", 0.9), (4, "c", 0.9), (4, "a", 0.9)], "artifact int, entity string, salience double")
    assert [(r.artifact, r.shared) for r in graph.shared_entities(m, 1).collect()] == [(2, 2), (3, 2)]
    assert sorted((r.artifact, r.other, r.shared) for r in graph.shared_entity_pairs(m).filter("artifact = 1").collect()) == [(1, 2, 2), (1, 3, 2)]


def _ranking(spark, ids):
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "k string, rank int")


def test_rrf_doesnt_depend_on_the_order_of_retrievers(spark):
    lists = {"a": _ranking(spark, "xyz"), "b": _ranking(spark, "yx"), "c": _ranking(spark, "w")}
    results = [sorted(map(tuple, search.reciprocal_ranks(dict(p), "k").collect())) for p in itertools.permutations(lists.items())]
    assert all(r == results[0] for r in results)
    assert dict((k, s) for k, s, _ in results[0])["y"] == round(1 / 62 + 1 / 61, 9)


def test_hybrid_gives_chunks_their_artifacts_graph_rank_and_keeps_the_artifact_itself(spark):
    c = spark.createDataFrame([(1, "A", "red fox", [1.0, 0.0], "x"), (2, "B", "red fox", [0.0, 1.0], "y"), (3, "C", "blue", None, "y")], "chunk int, artifact string, body string, embedding array<float>, kind string")
    m = spark.createDataFrame([("A", "e"), ("C", "e")], "artifact string, entity string")
    asked = spark.createDataFrame([("e",)], "entity string")
    got = search.hybrid_search(c, m, asked, "red fox", [1.0, 0.0], k=0, where=F.col("kind") == "x").collect()
    assert [(r.artifact, r.chunk, r.sources) for r in got] == [("A", 1, "bm25,graph,vector"), ("A", None, "graph"), ("C", None, "graph")]
    assert got[0].score == round(3 / 61, 9)


def test_people(spark):
    people = spark.createDataFrame([(1, "Frances Li"), (2, "Lee Pak Hong"), (3, "Sam Poe"), (4, "Sam Roe")], "person_id int, full_name string")
    m = spark.createDataFrame(
        [(1, 1, "Frances", [], 1.0), (1, 2, "France Hong", None, 0.5), (1, 3, "Sam", [], 0.5), (1, 4, "李", ["Pak Hong"], 2.0), (1, 5, "Li Frances", [], 0.1), (1, 6, "Sam", ["sam roe"], -1.0)],
        "entry_id int, entity_no int, display_name string, aliases array<string>, salience double",
    )
    got = sorted((r.target_id, r.confidence, r.explanation) for r in linker.people_links(m, people).collect())
    assert got == [
        (1, 0.9, 'Entity "Frances" (salience 1.00) matched contact "Frances Li" (jaccard 0.50)'),
        (2, 0.9, 'Entity "Pak Hong" (salience 2.00) matched contact "Lee Pak Hong" (jaccard 0.67)'),
        (4, 0.5, 'Entity "sam roe" (salience -1.00) matched contact "Sam Roe" (jaccard 1.00)'),
    ]


def test_events_and_tasks(spark):
    t = dt.datetime(2024, 1, 1, 12)
    e = spark.createDataFrame([(1, t, "We plan the gardening and painting", ["Trip"]), (2, t, "a trip", None)], "entry_id int, created_at timestamp_ntz, full_text string, tags array<string>")
    m = spark.createDataFrame([(1, "place", "Garden Hall", None), (1, "work", "Big Garden", ["the fair"])], "entry_id int, entity_type string, display_name string, aliases array<string>")
    ev = spark.createDataFrame([(1, "Garden fair with all friends", t), (2, "Big day", t), (3, "Garden", t + dt.timedelta(days=1)), (4, "Hall", t)], "event_id int, title string, start_at timestamp_ntz")
    assert [(r.target_id, r.confidence) for r in linker.event_links(e, m, ev).collect()] == [(1, 0.6)]
    tasks = spark.createDataFrame(
        [(1, "Paint garden", "needsAction"), (2, "Trip plan", "needsAction"), (3, "plan plan", "needsAction"), (4, "plan it", "needsAction"), (5, "Paint garden", "completed"), (6, "trip", "needsAction")],
        "task_id int, title string, status string",
    )
    for bound in (100, 0):
        assert sorted((r.source_id, r.target_id) for r in linker.task_links(e, tasks, bound).collect()) == [(1, 1), (1, 2), (1, 3)]


def test_event_links_of_copies_are_not_shuffled(spark):
    """300 entries and 300 events of one day, word and title: 90,000 links come of two rows, and repeated rows count as often."""
    t = dt.datetime(2024, 1, 1, 12)
    e = spark.createDataFrame([(i, t) for i in range(300)] + [(0, t), (0, t + dt.timedelta(days=1))], "entry_id int, created_at timestamp_ntz")
    m = spark.createDataFrame([(i, "work", "Big Garden", None) for i in range(300)], "entry_id int, entity_type string, display_name string, aliases array<string>")
    ev = spark.createDataFrame([(i, "Garden fair", t) for i in range(300)] + [(7, "Garden fair", t + dt.timedelta(days=1)), (7, None, t)], "event_id int, title string, start_at timestamp_ntz")
    links = linker.event_links(e, m, ev)
    assert links.count() == 90_000
    odd = {(r.source_id, r.target_id): (r.confidence, r.explanation[-14:]) for r in links.filter("source_id < 2 AND target_id IN (6, 7)").collect()}
    assert odd == {(0, 6): (1.0, "by 2/2 token(s)"[1:]), (0, 7): (1.5, "by 3/2 token(s)"[1:]), (1, 6): (0.6, "by 1/2 token(s)"[1:]), (1, 7): (0.6, "by 1/2 token(s)"[1:])}
    plan = links._jdf.queryExecution().optimizedPlan().toString().splitlines()  # the outermost operator first
    above = [line for line in plan[: next(i for i, line in enumerate(plan) if "Join" in line)]]
    assert any("explode(entry_ids" in line for line in above) and not any("Aggregate" in line for line in above)


def test_links_of_entry_drops_missing_confidence_and_shows_targets_once(spark):
    links = spark.createDataFrame(
        [("entry", 1, "task", 5, "a", 0.6), ("entry", 1, "task", 5, "b", 0.9), ("entry", 1, "task", 6, "a", None), ("entry", 1, "person", 7, "a", 0.9), ("entry", 1, "task", 8, "a", 0.4)],
        "source_type string, source_id int, target_type string, target_id int, link_type string, confidence double",
    )
    targets = spark.createDataFrame([("task", 5, "t5", "family"), ("task", 6, "t6", "family"), ("person", 7, "p7", None)], "target_type string, target_id int, target_title string, target_scope string")
    seen = lambda reader: sorted((r.target_id, r.link_type) for r in graph.links_of_entry(links, 1, targets, reader).collect())
    assert seen("personal") == [(5, "b"), (7, "a")] and seen("family") == [(5, "b")]


def test_links_are_written_strictly_or_as_far_as_they_go(spark, tmp_path):
    schema = "source_id int, target_type string, target_id int, link_type string, confidence double, explanation string"
    good = lambda: spark.createDataFrame([(1, "person", 2, "mentions_person", 0.5, "why")], schema)

    def bad():
        raise RuntimeError("the model is away")

    path = f"file://{tmp_path}/links"
    assert linker.write_links({"a": good, "b": bad, "c": good}, path, strict=False) == {"a": None, "b": "the model is away", "c": None}
    assert sorted((r.matcher, r.source_id, r.target_id) for r in spark.read.parquet(path).collect()) == [("a", "1", "2"), ("c", "1", "2")]
    try:
        linker.write_links({"b": bad}, path)
    except RuntimeError as failure:
        assert str(failure) == "the model is away"
    else:
        raise AssertionError("a strict run goes on")


def test_best_of_many_copies_takes_bounded_memory():
    """4,096 queries and 10,000 items in three groups of copies: a matrix of them is 328 MB, the tiles a tenth; the smaller ids come first."""
    r = np.random.default_rng(1)
    groups = np.linalg.qr(r.normal(size=(8, 8)))[0][:3]
    of, ids = r.integers(0, 3, 10_000), r.permutation(10_000)
    best = knn.Best(3, 6)
    tracemalloc.start()
    best.add_vectors(pa.array(range(4096)), pa.array(ids), groups[np.arange(4096) % 3], groups[of])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    got = best.rows.sort_by([("q", "ascending"), ("i", "ascending")])
    assert got["i"].to_pylist() == [int(i) for q in range(4096) for i in sorted(ids[of == q % 3])[:3]] and set(got["similarity"].to_pylist()) == {1.0}


def test_cells_share_shelves_and_are_probed_alone(spark, tmp_path, monkeypatch):
    """Queries are sent once per shelf, and meet the rows of their own cells only; cells of some files are split."""
    assert cells.shelves(np.array([20_000, 20_000, 0, 20_000, 90_000, 1, 7])).tolist() == [0, 0, 0, 1, 2, 3, 3]
    monkeypatch.setattr(cells, "FILE", 40)
    monkeypatch.setattr(cells, "NUMBERS", 500)
    r = np.random.default_rng(2)
    v = [(i, [float(c) for c in r.normal(size=5)]) for i in range(400)]
    items = spark.createDataFrame(v, "id long, v array<double>")
    index = cells.build(items, "id", "v", f"file://{tmp_path}/index", 5, cells=9, rounds=1)
    of = {row.key: row.cell for row in index.read(spark).collect()}
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in v}
    for probes in (2, 9):
        got = {(g.id, g.key) for g in cells.search_join(index, items.filter("id % 4 = 0"), "id", "v", 3, probes).collect()}
        want = set()
        for q in range(0, 400, 4):
            probed = set(index.nearest(unit[q])[:probes].tolist())
            near = sorted((-round(float(unit[i] @ unit[q]), 6), i) for i in unit if of[i] in probed)
            want |= {(q, i) for _, i in near[:3]}
        assert got == want


def test_few_event_rows_are_told_apart_by_many_tasks(spark):
    day = dt.datetime(2024, 1, 1, 9)
    entries = spark.createDataFrame([(i, day) for i in range(30)], "entry_id int, created_at timestamp")
    mentions = spark.createDataFrame([(i, "person", f"word{i % 3} blue", None) for i in range(30)], "entry_id int, entity_type string, display_name string, aliases array<string>")
    events = spark.createDataFrame([(i, f"word{i % 3} ring", day) for i in range(60)], "event_id int, title string, start_at timestamp")
    links = linker.event_links(entries, mentions, events)
    assert links.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert {(r.source_id, r.target_id) for r in links.collect()} == {(a, b) for a in range(30) for b in range(60) if a % 3 == b % 3}
    assert {r.explanation for r in links.collect()} == {f'Extracted entities overlap event title "word{k} ring" by 1/2 token(s)' for k in range(3)}


def test_many_queries_meet_items_in_many_tasks(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(90, 5)))]
    one = spark.createDataFrame(rows, "id int, e array<double>").coalesce(1)
    asked = one.select(F.col("id").alias("q"), F.col("e").alias("w"))
    few = knn.knn_join(one, "id", "e", asked, "q", "w", 4).collect()
    monkeypatch.setattr(knn, "MANY", 50)
    many = knn.knn_join(one, "id", "e", asked, "q", "w", 4)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(i#" in plan and f", {spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few))


def test_where_is_nonzero():
    r = np.random.default_rng(6)
    for shape in [(1, 1), (3, 5), (8, 8), (7, 33), (0, 4)]:
        mask = r.random(shape) < 0.2
        assert all((a == b).all() for a, b in zip(knn._where(mask), np.nonzero(mask)))
