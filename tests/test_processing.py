import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brainweave.operators import intake, processing

T = dt.datetime(2024, 1, 1)


def vectors(texts):
    assert len(texts) <= 100
    return [[float(len(t)), 1.0] for t in texts]


def short(texts):
    return [[1.0] for _ in texts]


def classify(texts):
    assert not any(t.startswith("#aifeedback") for t in texts)
    return [{"clean_text": t.upper(), "summary": "s", "language": "de", "tags": ["a"], "primary_type": "note", "primary_type_confidence": 0.4, "suggested_actions": []} for t in texts]


def analyse(texts):
    return [{"summary": f"about {t[:5]}", "excerpt": "e", "tags": ["m"], "language": "en"} for t in texts]


def extract(texts):
    return [{"entities": [{"entity_type": "work", "display_name": f" {w} ", "aliases": [], "salience": 0.7} for w in sorted(set(t.split()))]} for t in texts]


def test_embedding_keeps_order_and_checks_sizes(spark):
    df = spark.createDataFrame([(i, "x" * i if i else None) for i in range(250)], "k int, t string").coalesce(1)
    got = {r.k: r.embedding for r in processing.embed(df, "t", vectors, 2).collect()}
    assert got[0] is None and all(got[i] == [float(i), 1.0] for i in range(1, 250))
    with pytest.raises(Exception, match="2 were expected"):
        processing.embed(df, "t", short, 2).collect()


def test_entries(spark):
    e = spark.createDataFrame([(1, "hello", "pending"), (2, "#aifeedback #Good", "pending"), (3, "x", "processed")], "entry_id int, full_text string, status string")
    got = {r.entry_id: r for r in processing.process_entries(e, classify, vectors, 2).collect()}
    assert set(got) == {1, 2} and got[1].clean_text == "HELLO" and got[1].status == "processed" and got[1].embedding == [5.0, 1.0]
    assert (got[2].primary_type, got[2].primary_type_confidence, got[2].summary, got[2].suggested_actions, got[2].language) == ("archive_only", 1.0, None, [], "en")


def test_artifacts_and_cross_links(spark):
    a = spark.createDataFrame([(1, "T", "red fox <b>runs</b>", None, []), (2, "U", "red fox", "own", ["o"]), (3, "V", "blue", None, None)], "artifact int, title string, raw_source string, summary string, tags array<string>")
    out = processing.process_artifacts(a, analyse, vectors, extract, 2)
    rows = {r.artifact: r for r in out["artifacts"].collect()}
    assert [(rows[i].summary, rows[i].tags, rows[i].word_count) for i in (1, 2)] == [("about T\n\nre", ["m"], 3), ("own", ["o"], 2)]
    assert sorted((r.artifact, r.chunk_text, len(r.embedding)) for r in out["chunks"].collect()) == [(1, "red fox runs", 2), (2, "red fox", 2), (3, "blue", 2)]
    links = processing.cross_links(out["mentions"])
    assert sorted((r.source_id, r.target_id, r.explanation) for r in links.collect()) == [(1, 2, "Share 2 entities"), (2, 1, "Share 2 entities")]
    now = spark.createDataFrame([("work", "red", "Red", ["r"], 0)], "entity_type string, normalized_name string, display_name string, aliases array<string>, seq int")
    known = processing.upsert_entities(now, out["mentions"].withColumn("seq", F.col("artifact")))
    assert sorted((r.normalized_name, r.display_name, r.created) for r in known.collect()) == [("blue", " blue ", True), ("fox", " fox ", True), ("red", " red ", False), ("runs", " runs ", True)]


def test_entities_of_two_users_stay_apart(spark):
    schema = "user_id string, entity_type string, normalized_name string, display_name string, aliases array<string>, seq int"
    now = spark.createDataFrame([("u", "work", "red", "Red", ["r"], 0)], schema)
    new = spark.createDataFrame([("u", "work", " RED", [], 2), ("u", "work", "ReD ", ["x"], 3), ("v", "work", "Red", [], 1)], "user_id string, entity_type string, display_name string, aliases array<string>, seq int")
    known = processing.upsert_entities(now, new)
    assert sorted((r.user_id, r.normalized_name, r.display_name, r.aliases, r.created) for r in known.collect()) == [("u", "red", "ReD ", ["x"], False), ("v", "red", "Red", [], True)]
    said = new.withColumn("entities", F.array(F.struct("entity_type", "display_name", "aliases", F.lit(0.5).alias("salience"))))
    assert {r.entity for r in processing.mention_rows(said, "seq").collect()} == {"u:work:red", "v:work:red"}


def test_relink_keeps_other_types(spark):
    schema = "source_id string, target_type string, target_id string, link_type string, confidence double, explanation string"
    old = spark.createDataFrame([("1", "p", "2", "mentions_person", 0.5, "old"), ("1", "p", "2", "made_by_hand", 0.5, "kept")], schema)
    new = spark.createDataFrame([("1", "p", "2", "mentions_person", 0.9, "new"), ("1", "p", "2", "made_by_hand", 0.9, "loses")], schema)
    assert sorted(r.explanation for r in processing.relink(old, new).collect()) == ["kept", "new"]


def test_intake(spark):
    s = spark.createDataFrame([("T", "S", None, ["x"])], "title string, summary string, scope string, labels array<string>")
    entries, events = intake.save_sessions(s, F.lit(T))
    e, v = entries.first(), events.first()
    assert (e.full_text, e.window_end, e.scope) == ("[T]\n\nS\n\n(via x)", T - dt.timedelta(minutes=15), "personal") and v.entry_id == e.entry_id
    m = spark.createDataFrame([(1, "1", "hi", None), (1, "9", "@bot hello", [(0, 5)]), (1, "9", "hello", None), (2, "2", "hi", None)], "user_id int, chat_id string, raw_text string, spans array<struct<start:int,size:int>>")
    members = spark.createDataFrame([(1,)], "user_id int")
    assert sorted(r.raw_text for r in intake.family_messages(m, members, "@bot").collect()) == ["hello", "hi"]
    assert [r.reader for r in intake.reader_scopes(m, 1).collect()] == ["personal", "family", "family", "family"]
    assert spark.range(1).select(intake.reply_text(F.lit("a"), F.array(F.lit("b"))).alias("x")).first().x == "a\n\nSources:\n- b"


def test_models_answers_are_held_in_portions(spark):
    """A batch of 2,500 texts is answered in three portions; rows keep their order and nulls."""
    portions = list(processing._portions(iter([pd.Series(range(2500)), pd.Series(range(3))])))
    assert [len(p) for p in portions] == [1000, 1000, 500, 3]
    df = spark.range(2500, numPartitions=1).select("id", F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("t"))
    got = processing.embed(df, "t", lambda texts: [[float(t)] for t in texts], 1).orderBy("id").collect()
    assert [r.embedding for r in got] == [[float(i)] if i % 7 else None for i in range(2500)]
