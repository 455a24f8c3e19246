import hashlib
import math

from brainweave.llm import mixing

LEVELS = ["domain", "lang", "source"]


def split(budget, children):
    """children: {name: (capacity, weight)} -> shares; what one can't take goes to the rest, by weight."""
    got, open_ = {}, dict(children)
    while open_:
        total = sum(w for _, w in open_.values())
        full = {n for n, (c, w) in open_.items() if c <= budget * w / total}
        if not full:
            return got | {n: budget * w / total for n, (c, w) in open_.items()}
        for n in full:
            got[n] = open_.pop(n)[0]
            budget -= got[n]
    return got


def brute(rows, weights, fraction, epochs, seed):
    """rows: (doc_id, levels, n) -> {row number: copies}."""
    supply = {}
    for _, leaf, n in rows:
        supply[leaf] = supply.get(leaf, 0) + n
    budgets = {(): math.floor(sum(supply.values()) * fraction)}
    for depth, level in enumerate(LEVELS):
        for node in list(budgets):
            if len(node) == depth:
                kids = {leaf[: depth + 1] for leaf in supply if leaf[:depth] == node}
                cap = {k: sum(v for leaf, v in supply.items() if leaf[: depth + 1] == k) * epochs for k in kids}
                budgets |= split(budgets[node], {k: (cap[k], weights.get(level, {}).get(k[-1], 1.0)) for k in kids})
    out = {}
    for leaf, total in supply.items():
        budget = math.floor(budgets[leaf] + 1e-6)
        own = [(i, d, n) for i, (d, at, n) in enumerate(rows) if at == leaf]
        whole = min(budget // total, epochs) if total else 0
        rest = budget - whole * total if whole < epochs else 0
        key = lambda d: hashlib.md5(f"{seed}:{whole}:{d if d is not None else ''}".encode()).hexdigest()
        own.sort(key=lambda x: (key(x[1]), x[1] is not None, x[1] or 0, x[2]))
        run = 0
        for i, d, n in own:
            run += n
            out[i] = whole + (run <= rest and rest > 0)
    return out


def test_matches_brute_force(spark):
    rows = []
    for i in range(300):
        leaf = (f"domain{i % 7 % 4}", ("en", "en", "de", "fr", "es")[i % 5], f"src{i % 3 if i % 4 else 0}")
        rows.append((i, leaf, (i * 37) % 23))
    df = spark.createDataFrame([(d, " ".join(["w"] * n), *leaf) for d, leaf, n in rows], "doc_id long, text string, domain string, lang string, source string")
    for fraction in (0.1, 0.6, 1.5, 5.0):
        want = brute(rows, mixing.WEIGHTS, fraction, 2, 17)
        got = {r.doc_id: r.copies for r in mixing.mix_sources(df, fraction=fraction).collect()}
        assert got == {rows[i][0]: c for i, c in want.items()}


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "y", "1", 1000), ("b", "x", "1", 1000)], "domain string, lang string, source string, supply long")
    got = {(r.domain, r.lang): r.budget for r in mixing.leaf_budgets(leaves, LEVELS, {}, 0.5, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 492, ("b", "x"): 502}


def test_nulls_empty_texts_repeated_rows_and_empty_table(spark):
    schema = "doc_id long, text string, domain string, lang string, source string, copies int"
    rows = [(None, None, None, None, None, 1), (1, "", "d", "en", "s", 1), (2, "a b", "d", "en", "s", 1), (2, "a b", "d", "en", "s", 1)]
    got = mixing.mix_sources(spark.createDataFrame(rows, schema), fraction=1.0)
    assert sorted((r.doc_id or 0, r.n_tokens, r.copies) for r in got.collect()) == [(0, 0, 0), (1, 0, 1), (2, 2, 1), (2, 2, 1)]
    assert mixing.mix_sources(spark.createDataFrame([], schema)).count() == 0
