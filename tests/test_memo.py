import os
import uuid

import pytest
from brainweave.operators import lifecycle, memo, processing
from pyspark.sql import functions as F


class Counted:
    """A stand-in for a service: it writes a file per call, fails on some texts, and now and then for a while."""

    def __init__(self, folder, bad=(), flaky=()):
        self.folder, self.bad, self.flaky = str(folder), bad, flaky

    def __call__(self, texts):
        for t in texts:
            if t in self.flaky and not os.path.exists(f"{self.folder}/flaky-{t}"):
                open(f"{self.folder}/flaky-{t}", "w").close()
                raise TimeoutError("busy")
            if t in self.bad:
                raise ValueError(f"can't take {t}")
        with open(f"{self.folder}/call-{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return [{"size": len(t), "word": t.split()[0] if t.split() else None} for t in texts]

    def calls(self):
        return sorted(t for f in os.listdir(self.folder) if f.startswith("call-") for t in open(f"{self.folder}/{f}").read().split("\n"))


SCHEMA = "struct<size: int, word: string>"


def table(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(2)


@pytest.fixture
def kept(tmp_path):
    os.mkdir(tmp_path / "calls")
    return memo.Memo(f"file://{tmp_path}/memo", size=3, tokens=10, retries=1, pause=0)


def told(df):
    return {r.k: r.a.size if r.a else None for r in df.collect()}


def test_nothing_is_asked_twice(spark, tmp_path, kept, monkeypatch):
    monkeypatch.setattr(memo, "ROUND", 2)  # several rounds
    model = Counted(tmp_path / "calls", flaky=("d",))
    first = kept.ask(table(spark, "a", "bb", "a", None, "d", ""), "t", model, SCHEMA, "a", "sizes")
    assert told(first) == {0: 1, 1: 2, 2: 1, 3: None, 4: 1, 5: 0} and model.calls() == ["", "a", "bb", "d"]
    second = kept.ask(table(spark, "bb", "eee", "a"), "t", model, SCHEMA, "a", "sizes")
    assert told(second) == {0: 2, 1: 3, 2: 1} and model.calls() == ["", "a", "bb", "d", "eee"]
    other = kept.ask(table(spark, "a"), "t", model, SCHEMA, "a", "another")
    assert told(other) == {0: 1} and model.calls().count("a") == 2  # another model's answers are its own


def test_bad_texts_are_quarantined_alone(spark, tmp_path, kept):
    model = Counted(tmp_path / "calls", bad=("bad",))
    df = table(spark, "good", "bad", "fine")
    assert told(kept.ask(df, "t", model, SCHEMA, "a", "m")) == {0: 4, 1: None, 2: 4}
    assert [(r.k, r.error, r.attempts) for r in kept.failed(df, "t", "m").collect()] == [(1, "ValueError: can't take bad", 1)]
    entries = df.select(F.col("k").alias("entry_id"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("last_error"), "t")
    errors = kept.failed(entries, "t", "m").select("entry_id", F.lit(1).alias("ts"), F.col("error").alias("message"))
    marked = {r.entry_id: (r.status, r.last_error) for r in lifecycle.mark_errors(entries, errors, "entry_id").collect()}
    assert marked == {0: ("pending", None), 1: ("error", "ValueError: can't take bad"), 2: ("pending", None)}
    before = model.calls()
    kept.ask(df, "t", model, SCHEMA, "a", "m").collect()
    assert model.calls() == before  # not even the bad one
    assert told(kept.ask(df, "t", Counted(tmp_path / "calls"), SCHEMA, "a", "m", again=True))[1] == 3 and kept.failures(spark, "m").count() == 0


def test_a_round_that_dies_repeats_no_stored_call(spark, tmp_path, kept, monkeypatch):
    monkeypatch.setattr(memo, "ROUND", 1)
    model = Counted(tmp_path / "calls")
    real, rounds = memo.F.lit, []

    def dying(value):
        if isinstance(value, str) and len(value) == 20 and value.isdigit():
            rounds.append(value)
            if len(rounds) == 3:
                raise RuntimeError("the driver was lost")
        return real(value)

    monkeypatch.setattr(memo.F, "lit", dying)
    texts = table(spark, *"abcdefgh")
    with pytest.raises(RuntimeError):
        kept.ask(texts, "t", model, SCHEMA, "a", "m")
    done = model.calls()
    assert 0 < len(done) < 8
    assert len(told(kept.ask(texts, "t", model, SCHEMA, "a", "m"))) == 8 and model.calls() == list("abcdefgh")


def test_vectors_and_batches(spark, tmp_path, kept):
    vectors = lambda texts: [[float(len(t)), 1.0] if t != "odd" else [1.0] for t in texts]
    got = {r.k: r.v for r in kept.embed(table(spark, "ab", "odd", None), "t", vectors, 2, "v", "e").collect()}
    assert got == {0: [2.0, 1.0], 1: None, 2: None}
    assert "2 were expected" in kept.failures(spark, "e").first().error
    assert list(memo.batches(["x" * 16, "x" * 16, "x" * 12, "x" * 100, "", "", "", ""], 3, 8)) == [[0, 1], [2], [3], [4, 5, 6], [7]]


def test_entries_are_processed_through_the_memo(spark, tmp_path, kept):
    def classify(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [{"clean_text": t.upper(), "summary": "s", "language": "de", "tags": ["a"], "primary_type": "note", "primary_type_confidence": 0.4, "suggested_actions": []} for t in texts]

    vectors = lambda texts: [[float(len(t)), 1.0] for t in texts]
    e = spark.createDataFrame([(1, "hello", "pending"), (2, "#aifeedback #Good", "pending"), (3, "bad", "pending"), (4, "x", "processed")], "entry_id int, full_text string, status string")
    by = lambda m: sorted((r.entry_id, r.clean_text, r.primary_type, r.status, r.embedding) for r in processing.process_entries(e.filter("entry_id != 3") if m is None else e, classify, vectors, 2, m).collect())
    assert by(kept) == by(None)
    assert [r.entry_id for r in kept.failed(e, "full_text", "classify").collect()] == [3]
