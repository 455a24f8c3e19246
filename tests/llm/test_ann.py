import numpy as np

from brainweave.llm import ann, common

SCHEMA = "vec_id long, embedding array<float>, label int"
SF = "/root/testdata/sf0.01"
IS_QUERY = "id % 50 = 0"


def brute(rows, k=5):
    """{query: [(vec_id, score)]}, ties to the smaller id."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in good:
        if q % 50 == 0:
            found = [(-(x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)), i) for i, y in good if i != q]
            out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def test_recall_and_scores(spark):
    e = common.table(spark, SF, "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in e.collect()])
    got = {}
    for r in ann.nearest(e, IS_QUERY, shortlist=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [n for n, _, _ in found] == [1, 2, 3, 4, 5] and [s for *_, s in found] == sorted((s for *_, s in found), reverse=True)
        hits += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hits / (5 * len(want)) >= 0.95
    exact = dict((q, dict(v)) for q, v in want.items())
    assert all(abs(s - exact[q][i]) < 1e-12 for q, found in got.items() for _, i, s in found if i in exact[q])


def test_blocks_of_queries_give_the_same(spark):
    e = common.table(spark, SF, "embeddings")
    pick = lambda **how: sorted(map(tuple, ann.nearest(e, IS_QUERY, **how).collect()))
    assert pick() == pick(query_bytes=64 * 8 * 4)


def test_copies_fill_ranks_by_id_and_queries_leave_themselves_out(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(300, 0, -1)] + [(i, [float(i), -1.0], 0) for i in range(301, 330)]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), IS_QUERY).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(by) == {50, 100, 150, 200, 250, 300}
    assert all([i for _, i in sorted(v)] == [1, 2, 3, 4, 5] for v in by.values())


def test_odd_vectors_few_candidates_repeated_ids_and_empty_table(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [nan, 1.0], 1), (6, [1.0], 1), (None, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (50, [0.0, 0.0], 1), (7, [-1.0, 0.0], 1)]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), IS_QUERY).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 7)] and abs(got[0].score - 0.5**0.5) < 1e-12 and got[1].score == -1.0
    assert ann.nearest(spark.createDataFrame([], SCHEMA), IS_QUERY).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [0.0], 1), (1, None, 1)], SCHEMA), IS_QUERY).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0], 1)], SCHEMA), IS_QUERY).count() == 0


def test_every_size_is_searched_on_its_own(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=2 if i % 10 else 3).astype(np.float32)], 0) for i in range(400)]
    rows += [(4000, [1.0], 0), (4001, [0.0, 0.0, 0.0, 0.0], 0), (4050, [], 0)]  # alone, not valid, empty
    rows += [(4100, [1.0, 0.0], 0), (4100, [1.0, 0.0, 0.0], 0)]  # one id, two sizes
    by_size = {}
    for i, v, _ in rows:
        by_size.setdefault(len(v), []).append((i, v))
    want = {}
    for same in by_size.values():
        for q, found in brute(same).items():
            want[q] = sorted(want.get(q, []) + found, key=lambda f: (-f[1], f[0]))[:5]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), IS_QUERY, shortlist=500).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {q for q, found in want.items() if found} == {*range(0, 400, 50), 4100}
    for q, found in got.items():
        assert [i for i, _ in found] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in found], [s for _, s in want[q]], atol=1e-12)


def test_encoding_is_no_worse_with_a_wider_beam():
    x = ann.unit(np.random.default_rng(1).normal(size=(600, 16)))
    q = ann.fit(x, books=4, words=16)
    error = lambda beam: ((q.decode(q.encode(x, beam)) - x) ** 2).sum()
    assert error(8) <= error(1) and error(8) < 0.9 * len(x)
