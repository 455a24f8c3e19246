import random
import re

from pyspark.sql import functions as F

from brainweave.llm import near_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    """[(doc_id, n_shingles, component)] by comparing all pairs; rows of one doc_id are one node."""
    sets = [(d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, u in sets[:i]:
            if s and u and 100 * len(s & u) >= 80 * len(s | u):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted((d, len(s), root(d)) for d, s in sets)


def check(spark, rows, **how):
    got = near_join.near_components(spark.createDataFrame(rows, "doc_id long, text string"), **how)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def texts(seed, n, vocabulary=400):
    """Texts of which many are near copies of one another, around the limit."""
    r = random.Random(seed)
    rows, common = [], [f"c{i}" for i in range(12)]
    for d in range(n):
        if rows and r.random() < 0.6:
            words = r.choice(rows)[1].split(" ")
            for _ in range(r.choice((0, 1, 1, 2, 3, 5))):
                i = r.randrange(len(words) + 1)
                words[i : i + r.randint(0, 1)] = [f"n{r.randrange(50)}"] * r.randint(0, 1)
        else:
            words = [f"w{r.randrange(vocabulary)}" for _ in range(r.choice((2, 4, 5, 6, 12, 30, 80, 150)))]
            if r.random() < 0.5:
                words += common
        rows.append((d, " ".join(words)))
    r.shuffle(rows)
    return rows


def test_random_near_copies_match_brute_force(spark):
    check(spark, texts(1, 160))


def test_small_frequency_table_gives_the_same(spark):
    check(spark, texts(2, 90), table=8, least=2)


def test_split_lists_give_the_same(spark):
    check(spark, texts(3, 90), hot=6, least=2)


def test_rows_that_repeat_many_times(spark):
    rows = [row for row in texts(4, 24) for _ in range(4)]
    check(spark, rows)


def test_a_large_group_of_near_copies_and_copies(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:k] + [f"x{i % 40}"] + base[k + 1 :])) for i in range(150) for k in [r.choice((0, 1, 58, 59, 30))]]
    check(spark, rows)


def test_limit_is_inclusive(spark):
    words = [f"w{i}" for i in range(13)]  # 9 shingles; one word less: 8; 8 of 9 link, and 8 of 10 too
    check(spark, [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join([*words[:-1], "y"])), (4, " ".join(["y", *words[:12]]))])


def test_short_empty_and_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c d"), (8, "A\nb  c d"), (9, "É b c d e"), (10, "é b c d e"), (11, "x " * 3000), (12, "x " * 5)]
    check(spark, rows)


def test_nulls_repeated_rows_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, n long, gid long, tok long, prefix string"
    rows = [(None, "a b c d e f", 1, 1, 1, ""), (5, "a b c d e f", 1, 1, 1, ""), (5, "a b c d e f", 1, 1, 1, ""), (None, "alone", 1, 1, 1, ""), (None, None, 1, 1, 1, "")]
    got = near_join.near_components(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 0, 0), (0, 1, 0), (0, 2, 5), (5, 2, 5), (5, 2, 5)]
    assert near_join.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    kept = near_join.one_of_each_group(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.n) for r in kept) == [(0, 1), (0, 1), (0, 1), (5, 1)]


def test_unlike_documents_under_one_id_are_documents_of_their_own(spark):
    say = lambda name, *other: " ".join([f"{name}{i}" for i in range(40)] + list(other))
    rows = [(1, say("a")), (1, say("b")), (2, say("b", "x")), (3, say("a", "x")), (4, say("c")), (4, say("c", "x")), (4, say("d")), (4, say("d")), (5, say("d", "x")), (6, None), (6, ""), (0, say("e")), (7, say("e")), (7, say("f"))]
    schema, top = "doc_id long, text string", (1 << 63) - 1
    for far in ([], [(top, say("g"))]):
        df = spark.createDataFrame(rows + far, schema)
        hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
        one = lambda *texts: min(texts, key=hashes.get)  # noqa: E731, B023
        want = {(1, say("a")), (1, say("b")), (4, one(say("c"), say("c", "x"))), (4, say("d")), (6, one(None, "")), (0, say("e")), (7, say("f")), *far}
        for table in (df, df.repartition(5)):
            got = [tuple(r) for r in near_join.one_of_each_group(table).collect()]
            assert len(got) == len(want) and set(got) == want
