import random

from pyspark.sql import functions as F

from brainweave.llm import line_dedup

SCHEMA = "doc_id long, text string, _d string"


def brute(rows, min_lines, min_words):
    """(doc_id, text) -> (lines to delete, cleaned text), by comparing every position with every earlier one."""
    docs = {(d if d is not None else line_dedup.NO_ID, h): t for d, t, h in rows}
    lines = {k: (t.split("\n") if t is not None else []) for k, t in docs.items()}
    at = [(k, i) for k in sorted(lines) for i in range(len(lines[k]))]
    out = {}
    for p, (k, i) in enumerate(at):
        longest = 0
        for q in range(p):
            k2, j = at[q]
            n = 0
            while i + n < len(lines[k]) and j + n < len(lines[k2]) and lines[k][i + n] == lines[k2][j + n]:
                n += 1
            longest = max(longest, n)
        words = sum(x.count(" ") + 1 for x in lines[k][i : i + longest])
        if longest and (longest >= min_lines or words >= min_words):
            out.setdefault(k, set()).update(range(i, i + longest))
    return {
        k: (sorted(gone), "\n".join(x for i, x in enumerate(lines[k]) if i not in gone)) for k, gone in out.items()
    }


def check(spark, rows, min_lines=3, min_words=50, **how):
    df = spark.createDataFrame([(d, t, "own") for d, t in rows], SCHEMA)
    hashes = [r[0] for r in df.select(F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    want = brute([(d, t, h) for (d, t), h in zip(rows, hashes)], min_lines, min_words)
    got = line_dedup.drop_repeated_lines(df.drop("_d"), min_lines, min_words, **how).collect()
    assert len(got) == len(rows)
    for r in got:
        gone = [i for lo, hi in (r["_ranges"] or []) for i in range(lo, hi)]
        key = [k for (d, t), k in zip(rows, zip([d if d is not None else line_dedup.NO_ID for d, _ in rows], hashes)) if d == r["doc_id"]]
        assert any(want.get(k, ([], None))[0] == gone and (k not in want or want[k][1] == r["text"]) for k in key), r


def test_random_texts_match_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for d in range(25):
        lines = [rnd.choice("abcdef") * rnd.choice((1, 1, 2)) for _ in range(rnd.randint(0, 14))]
        rows.append((d, "\n".join(lines)))
    check(spark, rows)


def test_lines_that_most_positions_hold_give_the_same(spark):
    rnd = random.Random(6)
    rows = [(d, "\n".join(rnd.choice(("", "", "", "a", "b")) for _ in range(rnd.randint(1, 16)))) for d in range(30)]
    check(spark, rows, heavy=10)


def test_long_texts_in_several_rows_count_once(spark):
    lines = [f"line {i}" for i in range(40)]
    rows = [(1, "\n".join(lines))] * 5 + [(2, "\n".join(["new", *lines[5:20]]))] * 3 + [(None, "\n".join(lines[30:]))] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_lines, r.deleted) for r in line_dedup.deletions(df).collect())
    assert got == [(0, 10, "")] * 2 + [(1, 40, "30-40")] * 5 + [(2, 16, "1-16")] * 3


def test_one_very_long_text_and_ties(spark):
    long = "\n".join(f"{i % 700} {i // 700}" for i in range(20_000))
    rows = [(1, long), (1, long + "\nend"), (2, "\n".join(long.split("\n")[100:200]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_lines, r.n_deleted) for r in line_dedup.deletions(df).collect()]
    assert sorted(got) in ([(1, 20_000, 0), (1, 20_001, 20_000), (2, 100, 100)], [(1, 20_000, 20_000), (1, 20_001, 0), (2, 100, 100)])


def test_long_single_lines_and_copies(spark):
    passage = " ".join(f"w{i}" for i in range(55))
    rows = [(1, f"one\n{passage}\ntwo"), (2, f"three\n{passage}"), (3, passage), (4, "short\nline"), (5, "short\nline"), (6, f"one\n{passage}\ntwo")]
    check(spark, rows)


def test_nulls_empty_texts_repeated_rows_and_runs_inside_a_text(spark):
    rows = [(None, "a\nb\nc"), (1, None), (2, ""), (3, "a\nb\nc\na\nb\nc\nd"), (4, "x\nx\nx\nx\nx\nx\nx"), (4, "x\nx\nx\nx\nx\nx\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.deleted) for r in line_dedup.deletions(df).collect()}
    assert got == {(None, ""), (1, ""), (2, ""), (3, "0-6"), (4, "1-7")}


def test_empty_table_and_clashing_columns(spark):
    assert line_dedup.deletions(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a\nb\nc", 7, 8), (2, "a\nb\nc\nd", 9, 1)], "doc_id long, text string, w int, len int")
    assert {(r.doc_id, r.text, r.w, r.len) for r in line_dedup.drop_repeated_lines(df).collect()} == {(1, "a\nb\nc", 7, 8), (2, "d", 9, 1)}
