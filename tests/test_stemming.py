import os
import re

import pyarrow as pa
import pytest
from brainweave.functions import stemming
from brainweave.operators import fulltext, inverted
from pyspark.sql import functions as F

#: The published sample vocabulary of the stemmer: word and stem, word and stem.
SAMPLE = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist
consistent consist consistently consist consisting consist consists consist consolation consol consolations consol consolatory
consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling
consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu
conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring
conspir constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri
knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel
kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly
knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock
knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
""".split()
#: Words for single rules: endings, regions, exceptions.
RULES = {
    "meetings": "meet", "generate": "generat", "general": "general", "communities": "communiti", "ties": "tie", "cries": "cri", "gas": "gas",
    "this": "this", "gaps": "gap", "kiwis": "kiwi", "hopping": "hop", "hoping": "hope", "luxuriated": "luxuri", "by": "by", "say": "say",
    "happy": "happi", "relational": "relat", "skies": "sky", "news": "news", "innings": "inning", "exceeding": "exceed", "agreed": "agre",
    "feed": "feed", "rationality": "ration", "replacement": "replac", "adoption": "adopt", "analogy": "analog", "hopefulness": "hope",
    "sensibility": "sensibl", "radically": "radic", "rate": "rate", "cease": "ceas", "roll": "roll", "controlling": "control",
    "sing": "sing", "sized": "size", "vietnamization": "vietnam", "triplicate": "triplic", "formative": "format", "youth": "youth",
    "a1s": "a1s", "été": "été", "naïves": "naïv", "ab": "ab",
}


def test_published_sample_and_rules():
    assert [stemming.stem(w) for w in SAMPLE[::2]] == SAMPLE[1::2]
    assert {w: stemming.stem(w) for w in RULES} == RULES


def test_lexemes_of_columns(spark):
    rows = [("The Meetings of the Knights", ["meet", "knight"]), ("", []), (None, None), ("the of", []), ("Überläufer 42nd don't", ["überläuf", "42nd"])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").repartition(2)
    got = {r.i: r.x for r in df.select("i", stemming.lexemes(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(rows))] == [w for _, w in rows]


def test_meetings_finds_meeting(spark):
    d = spark.createDataFrame([(1, "the meeting"), (2, "meet me"), (3, "nothing")], "id int, t string")
    assert {r.id for r in fulltext.bm25(d, "id", "t", "Meetings", english=True).collect()} == {1, 2}
    assert fulltext.bm25(d, "id", "t", "Meetings").count() == 0
    assert fulltext.bm25(d, "id", "t", "the of", english=True).count() == 0


WORDS = ["meeting", "meetings", "red", "foxes", "fox", "the", "knights", "night", "été", "x1"]


def docs(spark, numbers, salt=0):
    text = lambda i: " ".join(WORDS[(i * 7 + j * j + salt) % len(WORDS)] for j in range(i % 9))
    return spark.createDataFrame([(i, text(i)) for i in numbers] + ([(1000, None)] if 1 in numbers else []), "id int, body string")


def same(spark, index, df, query, english=True):
    stored = sorted(map(tuple, inverted.search(spark, index, query).collect()))
    plain = fulltext.bm25(df, "id", "body", query, english=english).select("id", "score", "rank")
    assert stored == sorted(map(tuple, plain.collect()))
    return stored


@pytest.mark.parametrize("english", [True, False])
def test_index_agrees_with_texts(spark, tmp_path, english):
    df = docs(spark, range(1, 200))
    inverted.build(df, "id", "body", f"file://{tmp_path}/i", english, slots=2, buckets=5)
    index = inverted.opened(spark, f"file://{tmp_path}/i")
    assert index.english == english and same(spark, index, df, "fox meeting", english)
    for query in ("red", "fox x1 red", "unknown red", "the", "", "night knights"):
        same(spark, index, df, query, english)
    among = df.filter("id % 2 = 0").select(F.col("id").alias("key"))
    got = inverted.search(spark, index, "red", among=among).collect()
    plain = fulltext.bm25(df, "id", "body", "red", where=F.expr("id % 2 = 0"), english=english)
    assert [(r.key, r.score) for r in got] == [(r.id, r.score) for r in plain.orderBy("rank").collect()]


def test_search_reads_its_terms_buckets_only(spark, tmp_path):
    index = inverted.build(docs(spark, range(1, 100)), "id", "body", f"file://{tmp_path}/i", slots=2, buckets=16)
    found = inverted.search(spark, index, "fox red")
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"PartitionFilters: \[[^\]]*bucket[^\]]*\]+", plan)
    assert scans and all("IN" in s or "=" in s for s in scans) and "PushedFilters: [" in plan
    want = sorted(map(tuple, inverted.search(spark, index, "fox red").collect()))
    kept = {f"bucket={index.bucket(t)}" for t in ("fox", "red")}
    for f in files(f"{tmp_path}/i/postings"):
        if f.split("/")[-2] not in kept:
            os.remove(f)  # a search that read it would fail
    assert want and sorted(map(tuple, found.collect())) == want


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_update_rewrites_only_its_partitions(spark, tmp_path):
    df = docs(spark, range(1, 120))
    index = inverted.build(df, "id", "body", f"file://{tmp_path}/i", slots=2, buckets=5)
    before = files(f"{tmp_path}/i/postings")
    changed = spark.createDataFrame([(7, "night fox")], "id int, body string")
    inverted.update(index, changed, "id", "body")
    old = {r.body for r in df.filter("id = 7").collect()}.pop()
    terms = {stemming.stem(w) for w in ("night", "fox", *old.split())}
    slot = changed.select(index.slot_of(F.col("id")).alias("s")).first().s
    after = files(f"{tmp_path}/i/postings")
    touched = {os.path.dirname(f).split("postings/")[1] for f in before.keys() ^ after.keys()}
    assert touched and touched <= {f"slot={slot}/bucket={index.bucket(t)}" for t in terms}
    now = df.filter("id != 7").unionByName(changed)
    for query in ("night fox", "red", "meeting"):
        same(spark, index, now, query)
    inverted.update(index, changed, "id", "body")  # again: nothing changes
    same(spark, index, now, "night fox")
    # added, removed, emptied
    inverted.update(index, spark.createDataFrame([(500, "red red fox"), (8, None)], "id int, body string"), "id", "body", now.filter("id % 3 = 0").select("id"))
    now = now.filter("id % 3 != 0 AND id != 8").unionByName(spark.createDataFrame([(500, "red red fox"), (8, None)], "id int, body string"))
    for query in ("night fox", "red", "meeting", "x1"):
        same(spark, index, now, query)


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "id int, body string")
    index = inverted.build(none, "id", "body", f"file://{tmp_path}/i")
    assert inverted.search(spark, index, "fox").count() == 0
    inverted.update(index, none, "id", "body")
    inverted.update(index, docs(spark, range(1, 20)), "id", "body")
    same(spark, index, docs(spark, range(1, 20)), "red")


def test_batches_are_stemmed_in_portions(spark, monkeypatch):
    """Lists come back whole and in order, nulls and empty ones too, whatever a batch holds; no portion holds more words than allowed or than one list."""
    texts = ["The running dogs", None, "", "cats", "the and of", "a " * 9 + "ponies"] * 40
    lists = pa.array([t.lower().split() if t is not None else None for t in texts], pa.list_(pa.string()))
    monkeypatch.setattr(stemming, "WORDS", 4)
    some = list(stemming.portions(lists))
    assert pa.concat_arrays(some).equals(lists) and all(len(p) == 1 or len(p.flatten()) <= 4 for p in some) and len(some) > 40
    want = [None if t is None else [stemming.stem(w) for w in t.lower().split() if w not in stemming.STOP_WORDS] for t in texts]
    assert pa.concat_arrays([stemming._stemmed_lists(p) for p in some]).to_pylist() == want
    monkeypatch.undo()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", stemming.lexemes(F.col("t")).alias("l"))
    assert [r.l for r in df.orderBy("i").collect()] == want
