import math

import numpy as np
import pytest

from brainweave.llm import cap_filters

SCHEMA = "vec_id long, embedding array<double>, copies int, dim string"


def brute(rows, cosine=0.9):
    """rows: (id, vector or None) -> (id, n_links, component_id, kept), all pairs compared."""
    n = len(rows)
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    links = np.zeros((n, n), bool)
    for dim in {len(v) for (_, v), g in zip(rows, good) if g}:
        at = [i for i in range(n) if good[i] and len(rows[i][1]) == dim]
        x = np.array([rows[i][1] for i in at], float)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        links[np.ix_(at, at)] = x @ x.T >= cosine
    np.fill_diagonal(links, False)
    out, label = [], list(range(n))
    for i in range(n):  # union by search
        stack, seen = [i], {i}
        while stack:
            for j in np.flatnonzero(links[stack.pop()]):
                if j not in seen:
                    seen.add(int(j))
                    stack.append(int(j))
        label[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], int(links[i].sum()), label[i], rows[i][0] is not None and rows[i][0] == label[i]))
    return sorted(out, key=repr)


def near(x, cosine, rng):
    """A vector whose cosine with x is just that."""
    g = rng.normal(size=len(x))
    u = x / np.linalg.norm(x)
    g -= (g @ u) * u
    return cosine * u + math.sqrt(1 - cosine * cosine) * g / np.linalg.norm(g)


def table(seed, dim=64, singles=300, clusters=((5, 0.97), (20, 0.95), (90, 0.985))):
    rng = np.random.default_rng(seed)
    vectors = list(rng.normal(size=(singles, dim)))
    for size, cosine in clusters:
        centre = rng.normal(size=dim)
        vectors += [near(centre, math.sqrt(cosine), rng) * rng.uniform(0.5, 2) for _ in range(size)]
    chain = rng.normal(size=dim)
    for _ in range(12):  # neighbours are linked, the ends of the chain are not
        chain = near(chain, 0.96, rng)
        vectors.append(chain)
    order = rng.permutation(len(vectors))
    return [(int(i), vectors[j].tolist()) for i, j in enumerate(order)]


ODD = [
    (9000, None), (9001, []), (9002, [0.0] * 64), (9003, [math.nan] + [1.0] * 63), (9004, [math.inf] * 64), (9005, [None] + [1.0] * 63),
    (9006, [1.0, 2.0]), (9007, [1.0, 2.1]), (9008, [-3.0]), (9009, [-1.0]), (9010, [4.0]), (9011, [1e300] * 64), (9012, [1e-300] * 64),
    (9013, [0.5] * 64), (9013, [0.5] * 64), (9013, [-0.5] * 64), (None, [-0.5] * 64), (None, [7.0, -7.0, 7.0]), (None, None),
]


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 7, "clash") for i, v in rows], SCHEMA).repartition(5)
    got = cap_filters.near_vectors(df, **more)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_agrees_with_brute_force(spark):
    rows = table(1) + ODD
    rows += [(5000 + i, rows[0][1]) for i in range(40)]  # copies
    assert run(spark, rows) == brute(rows)


def test_hot_buckets_in_chunks_and_cells(spark, monkeypatch):
    """With chunks of 16 every cluster is hot: the same result by cells and by pairs of chunks."""
    rows = table(2, singles=150, clusters=((60, 0.985), (60, 0.93), (45, 0.99))) + ODD
    want = brute(rows)
    assert run(spark, rows, chunk=16) == want
    monkeypatch.setattr(cap_filters, "_centres", lambda *a: [])
    assert run(spark, rows, chunk=16) == want


@pytest.mark.parametrize("rows, cosine, least", [(50_000, 0.9, 0.985), (50_000, 0.95, 0.998), (10**6, 0.9, 0.97), (10**9, 0.9, 0.9), (10**9, 0.95, 0.98)])
def test_recall_of_the_code(rows, cosine, least):
    """Pairs at a given cosine share a filter, with the code that a table of so many rows gets."""
    rng = np.random.default_rng(4)
    code = cap_filters.code_for(64, rows, 0.9, 13)
    x = rng.normal(size=(600 if rows < 10**6 else 200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.stack([near(v, cosine, rng) for v in x])
    both = list(zip(code.decode(x), code.decode(y)))
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in both]) >= least
    assert min(len(a) for a, _ in both) >= code.least


def test_list_decoding_finds_all_exceeding_filters():
    rng = np.random.default_rng(6)
    code = cap_filters.code_for(12, 400, 0.9, 1)
    x = rng.normal(size=(40, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    dots = code.dots(x)
    total = dots[0]
    for d in dots[1:]:
        total = (total[:, :, None] + d[:, None, :]).reshape(len(x), -1)
    for row, found in zip(total, code.decode(x)):
        bound = min(code.alpha, np.sort(row)[-code.least])
        assert set(found) == set(np.flatnonzero(row >= bound - 1e-12)) or len(found) == (row >= bound).sum()


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1, True), (2, 0, 2, True)]
