import os
import random

import numpy as np
import pytest
from brainweave.operators import cells, knn
from pyspark.sql import functions as F

SCHEMA = "id int, e array<float>"


def items(spark, n=1500, dim=16, seed=1, groups=30):
    """Rows around some centres, with ties, copies and vectors that can't be stored."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + 0.5 * rng.normal(size=(n, dim))
    x[5] = x[6] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(9001, None), (9002, [0.0] * dim), (9003, [1.0]), (9004, [float("nan")] * dim), (9005, [None] * dim), (None, [1.0] * dim)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    df = items(spark).cache()
    path = f"file://{tmp_path_factory.mktemp('cells')}/i"
    cells.build(df, "id", "e", path, 16, cells=25, rounds=4)
    return df, cells.opened(spark, path)


def pick(df, key="key"):
    return [(r[key], r.similarity, r["rank"]) for r in df.orderBy("rank").collect()]


def asked(df, ids):
    return [[float(x) for x in r.e] for r in df.filter(F.col("id").isin(ids)).orderBy("id").collect()]


def test_exact_search_agrees_with_a_full_scan(spark, stored):
    df, index = stored
    named = df.filter("id IS NOT NULL")
    for q in asked(df, [0, 5, 77, 800]):
        for k in (1, 10):
            assert pick(cells.search(spark, index, q, k, probes=1, exact=True)) == pick(knn.knn(named, "id", "e", q, k), "id")
        assert pick(cells.search(spark, index, q, 10, probes=25)) == pick(knn.knn(named, "id", "e", q, 10), "id")
    assert pick(cells.search(spark, index, [0.0] * 16, 3)) == pick(cells.search(spark, index, [1.0], 3)) == []
    got = cells.search(spark, index, asked(df, [0])[0], 2000, exact=True)
    assert got.count() == 1500


def test_recall_and_join(spark, stored):
    df, index = stored
    some = df.filter("id % 20 = 0").select(F.col("id").alias("query"), F.col("e").alias("w"))
    want = knn.knn_join(df, "id", "e", some, "query", "w", 10)
    full = cells.search_join(index, some, "query", "w", 10, probes=25)
    rows = lambda d, key: sorted((r.query, r[key], r.similarity, r["rank"]) for r in d.collect())
    assert rows(full, "key") == rows(want, "id")
    few = {(q, i) for q, i, _, _ in rows(cells.search_join(index, some, "query", "w", 10, probes=4), "key")}
    assert len(few & {(q, i) for q, i, _, _ in rows(want, "id")}) >= 0.9 * want.count()


def test_hot_cell_in_many_files_and_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "FILE", 50)
    monkeypatch.setattr(cells, "ASKED", 7)
    df = items(spark, 400, groups=1)
    index = cells.build(df, "id", "e", f"file://{tmp_path}/i", 16, cells=2, rounds=1)
    some = df.filter("id % 10 = 0").select(F.col("id").alias("query"), F.col("e").alias("w"))
    want = knn.knn_join(df.filter("id IS NOT NULL"), "id", "e", some, "query", "w", 5)
    got = cells.search_join(index, some, "query", "w", 5, probes=2)
    assert sorted((r.query, r.key, r["rank"]) for r in got.collect()) == sorted((r.query, r.id, r["rank"]) for r in want.collect())


def parquets(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_unprobed_cells_are_not_read_and_updates_rewrite_only_theirs(spark, tmp_path):
    df = items(spark, 600)
    index = cells.build(df, "id", "e", f"file://{tmp_path}/i", 16, cells=12)
    before = parquets(f"{tmp_path}/i/vectors")
    (new,) = asked(df, [3])
    (old,) = asked(df, [4])
    changed = spark.createDataFrame([(4, new), (700, new)], SCHEMA)
    index = cells.update(index, changed, "id", "e", spark.createDataFrame([(10,)], "id int"))
    near = lambda v: int((index.centres @ (np.array(v) / np.linalg.norm(v))).argmax())
    gone = asked(df, [10])[0]
    moved = {f.split("cell=")[1].split("/")[0] for f in before ^ parquets(f"{tmp_path}/i/vectors")}
    assert moved == {str(near(v)) for v in (new, old, gone)}
    now = df.filter("id NOT IN (4, 10)").unionByName(changed)
    index = cells.opened(spark, index.path)
    assert pick(cells.search(spark, index, new, 8, 1, exact=True)) == pick(knn.knn(now, "id", "e", new, 8), "id")
    found = cells.search(spark, index, new, 8, probes=2)
    want = pick(found)
    kept = {f"cell={c}" for c in index.nearest(np.array(new) / np.linalg.norm(new))[:2]}
    for f in parquets(f"{tmp_path}/i/vectors"):
        if f.split("/")[-2] not in kept:
            os.remove(f)  # a search that read it would fail
    assert pick(cells.search(spark, index, new, 8, probes=2)) == want and len(want) == 8


def test_empty_index_and_one_running_best(spark, tmp_path):
    index = cells.build(spark.createDataFrame([], SCHEMA), "id", "e", f"file://{tmp_path}/i", 4)
    assert cells.search(spark, index, [1.0] * 4, 3, exact=True).count() == 0
    assert cells.search_join(index, items(spark, 9, 4), "id", "e", 3).count() == 0
    import pyarrow as pa

    r, best, every = random.Random(2), knn.Best(4, 2), []
    for _ in range(20):
        n = r.randrange(1, 9)
        ids, sims = [r.randrange(10**6) for _ in range(n)], np.array([[r.randrange(60) / 100 for _ in range(n)] for _ in range(2)])
        best.add(pa.array([1, 2]), pa.array(ids), sims)
        every += [(q + 1, -s, i) for q in (0, 1) for s, i in zip(sims[q], ids)]
    want = [x for q in (1, 2) for x in sorted(e for e in every if e[0] == q)[:4]]
    got = [(x["q"], -x["similarity"], x["i"]) for x in best.table(pa.int64(), pa.int64()).to_pylist()]
    assert [(q, round(s, 6), i) for q, s, i in got] == [(q, round(s, 6), i) for q, s, i in want]
