import hashlib
import random
import re

import pytest

from brainweave.llm import fill_middle

SCHEMA = "doc_id long, text string, n long, _key string"


def brute(doc_id, text, percent=100, spm=50):
    text = text or ""
    hexed = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(seed, count=300):
    r = random.Random(seed)
    bits = ["a", "\n", "\n\n", "é", "😀", "\x1e", "\x1f", "\x1f0", "\x1f1", "0", "1", "$1", "\\", "<", "<P", ">", "\r\n", "\t", " ", "\x00", "ab\n"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(0, 14)))) for i in range(count)]
    return rows + [(None, "x\ny"), (-5, None), (7, ""), (8, "a<M>b\n"), (9, "<S>"), (10, "\n" * 5000), (11, "z" * 2_000_000), (12, "line\n" * 100_000), (12, "other"), (12, "other")]


@pytest.mark.parametrize("percent, spm", [(100, 50), (60, 0), (0, 50), (100, 100)])
def test_agrees_with_brute_force(spark, percent, spm):
    rows = rows_of(percent + spm)
    df = spark.createDataFrame([(d, t, 1, "clash") for d, t in rows], SCHEMA)
    got = fill_middle.digests(fill_middle.transform(df, percent=percent, spm_percent=spm))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = []
    for d, t in rows:
        n, form, a, b, out = brute(d, t, percent, spm)
        want.append((d, n, form, a, b, sha(out), sha(t or "")))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_outputs_are_restored_and_joined_by_parts(spark):
    rows = [(i, t) for i, t in rows_of(3) if len(t or "") < 1000]
    got = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.form != "plain":
            assert r.prefix + r.middle + r.suffix == r.text


def test_other_units_and_sentinels(spark):
    df = spark.createDataFrame([(i, "one two  three ") for i in range(40)], "doc_id long, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    got = fill_middle.transform(df, units=r"[^ ]+ *| +", sentinels=marks)
    rows = got.withColumn("back", fill_middle.restore(got["output"], got["form"], marks)).collect()
    assert {r.n for r in rows} == {3} and all(r.back == "one two  three " for r in rows)
    assert len({(r.prefix, r.middle) for r in rows}) > 5


def test_sentinels_that_cannot_be_told_apart():
    for bad in (("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "><", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.check_sentinels(*bad)


def test_empty_table_and_plan(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    out = fill_middle.digests(fill_middle.transform(empty))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
