import base64
import json

from brainweave.sources import feeds, sinks
from pyspark.sql import functions as F


def land(spark, tmp_path, rows, schema):
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, rows)))
    return feeds.read_json(spark, str(tmp_path / "in.json"), schema)


def test_tasks_and_contacts(spark, tmp_path):
    rows = [{"id": "1", "title": "x", "due": "2024-01-02T00:00:00Z", "listTitle": " HOME "}, {"id": "2"}, {"title": "y"}, {"id": "3", "title": "z", "due": "bad", "status": "completed"}]
    got = feeds.tasks(land(spark, tmp_path, rows, feeds.TASKS), ["home"]).orderBy("external_id").collect()
    assert [(r.external_id, r.status, r.due_at is None, r.scope) for r in got] == [("1", "needsAction", False, "family"), ("3", "completed", True, "personal")]
    rows = [{"resourceName": "a", "names": [{"displayName": "Ann"}]}, {"resourceName": "b", "emailAddresses": [{"value": "b@x.example"}]}, {"resourceName": "c"}]
    assert [r.full_name for r in feeds.contacts(land(spark, tmp_path, rows, feeds.CONTACTS)).orderBy("external_id").collect()] == ["Ann", "b@x.example", "Unknown"]


def test_events(spark, tmp_path):
    rows = [
        {"id": "1", "summary": "s", "calendarId": "fam", "start": {"date": "2024-01-02"}, "end": {"dateTime": "2024-01-02T10:00:00Z"}, "attendees": [{"email": "e", "responseStatus": "yes"}]},
        {"id": "2", "summary": "s", "start": {"date": "2024-01-02"}},
        {"id": "3", "start": {"date": "2024-01-02"}, "end": {"date": "2024-01-03"}},
    ]
    got = feeds.events(land(spark, tmp_path, rows, feeds.EVENTS), ["FAM"]).collect()
    assert [(r.external_id, str(r.start_at), r.attendees[0].response, r.scope) for r in got] == [("1", "2024-01-02 00:00:00", "yes", "family")]


def test_mails(spark, tmp_path):
    b64 = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    part = lambda kind, s: {"mimeType": kind, "body": {"data": b64(s)}}
    head = [{"name": "from", "value": "Ann <a@b.example>"}, {"name": "To", "value": "x@y.example, me@fam.example"}, {"name": "Subject", "value": "Hi"}]
    rows = [
        {"id": "1", "labelIds": ["STARRED", "L1", "L9"], "internalDate": "1704067200000", "payload": {"mimeType": "multipart/mixed", "headers": head, "parts": [part("text/html", "<p>"), {"mimeType": "multipart/alternative", "parts": [part("text/plain", "déep?>")]}, part("text/plain", "later")]}},
        {"id": "3", "payload": {"mimeType": "multipart/mixed", "parts": [{"mimeType": "multipart/related", "parts": [{"mimeType": "multipart/alternative", "parts": [{"mimeType": "x", "parts": [part("text/plain", ""), part("text/plain", "at depth 4")]}, part("text/html", "h")]}]}, part("text/plain", "attached")]}},
        {"id": "4", "payload": {"mimeType": "text/html", "body": {"data": b64("<p>")}}},
        {"id": "2", "payload": {"mimeType": "text/plain", "body": {"data": b64("own")}}},
    ]
    raw = land(spark, tmp_path, rows, feeds.MAILS)
    got = feeds.mails(raw, {"L1": "Work"}, ["fam.example"]).orderBy("external_id").collect()
    assert [(r.subject, r.from_address, r.body_text, r.label_names, r.is_starred, r.scope) for r in got][0] == ("Hi", "a@b.example", "déep?>", ["Work"], True, "family")
    assert [got[2].body_text, got[3].body_text] == ["at depth 4", None]
    assert (got[1].body_text, got[1].scope, got[1].is_starred) == ("own", "personal", False)
    stored = spark.createDataFrame([("1",)], "external_id string")
    assert [r.external_id for r in feeds.new_mails(stored, feeds.mails(raw, {}, [])).orderBy("external_id").collect()] == ["2", "3", "4"]


def test_videos_and_messages(spark, tmp_path):
    rows = [{"video_id": "v", "title": "A Title!", "transcript": "t", "keywords": "A;b", "has_manual_transcript": False, "published_at": "nope", "summary": "s"}, {"video_id": "w", "title": " ", "transcript": "t"}, {"video_id": "x", "title": "X", "transcript": "t"}, {"video_id": "y", "title": "Y", "transcript": "t", "has_manual_transcript": True}]
    got = feeds.videos(land(spark, tmp_path, rows, feeds.VIDEOS)).orderBy("source_external_id").collect()
    assert [(r.source_external_id, r.slug, r.tags, r.published_at) for r in got] == [("v", "a-title", ["a", "b", "auto-transcript"], None), ("x", "x", None, None), ("y", "y", ["manual-transcript"], None)]
    assert (got[0].type, got[0].canonical_url, got[0].source_summary) == ("transcript", "https://youtube.com/watch?v=v", "s")
    rows = [{"message_id": "1", "user_id": "u", "channel": "c", "text": "New note", "date": 1704067200}, {"message_id": "2", "user_id": "u", "channel": "c", "date": 5}]
    assert [(r.message_id, r.is_command, r.is_feedback) for r in feeds.messages(land(spark, tmp_path, rows, feeds.MESSAGES)).collect()] == [("1", True, False)]


def test_sinks(spark, tmp_path):
    parts = sinks.message_parts(spark.createDataFrame([(1, "ab\n" * 4000), (2, "x")], "k int, t string"), "k", "t").orderBy("k", "part").collect()
    assert "\n".join(r.body for r in parts if r.k == 1).replace("\n", "") == "ab" * 4000 and all(len(r.body) <= 3900 for r in parts)
    df = spark.createDataFrame([(2, "b"), (1, "a")], "n int, t string")
    assert json.loads(sinks.json_answer(df, [F.col("n")]).first().body) == {"count": 2, "hits": [{"n": 1, "t": "a"}, {"n": 2, "t": "b"}]}
    path = str(tmp_path / "t")
    sinks.replace_table(spark.createDataFrame([(1, "a"), (2, "b")], "n int, p string"), path, ["p"])
    sinks.replace_table(spark.createDataFrame([(3, "b")], "n int, p string"), path, ["p"])
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [1, 3]
