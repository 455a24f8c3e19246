import datetime as dt

from brainweave.operators import briefing
from pyspark.sql import functions as F

NOW = dt.datetime(2024, 1, 30, 12)
UTC = dt.timezone.utc


def at(day, hour=9):
    return dt.datetime(2024, 1, day, hour)


def line(df, block):
    return [r.x for r in df.select(block.alias("x")).collect()]


def entries(spark, rows):
    return spark.createDataFrame(rows, "created_at timestamp_ntz, channel string, summary string, tags array<string>, primary_type string, primary_type_confidence double, suggested_actions array<struct<kind:string,reason:string>>, full_text string")


ENTRY = [(at(30), "chat", "Sum", ["a", "b"], "idea", 1.0, [("task", "do")], "the text"), (at(20), "chat", None, [], None, None, None, "old")]
TASK = "due_at timestamp_ntz, title string, parent_title string, list_name string, list_type string, notes string"
MAIL = "sent_at timestamp_ntz, from_address string, subject string, snippet string"
EVENT = "start_at timestamp, end_at timestamp, title string, location string, attendees array<struct<email:string,name:string>>, description string"
LINK = "entry_at timestamp_ntz, entry_summary string, target_type string, target_title string, target_date date, link_type string, confidence double, explanation string"


def test_blocks(spark):
    assert line(entries(spark, ENTRY), briefing.entry_block(F.lit(NOW))) == [
        '=== Entry [2024-01-30T09:00] (chat) ===\nSummary: Sum\nTags: a, b\nType: idea (confidence: 1)\nSuggested actions: [{"kind":"task","reason":"do"}]\nFull text:\nthe text\n',
        "=== Entry [2024-01-20T09:00] (chat) ===\n",
    ]
    people = [("a@x", "Ann"), ("b@x", None), (None, None), ("c@x", ""), ("d@x", "Dan"), ("e@x", "Eve")]
    e = spark.createDataFrame([(at(30).replace(tzinfo=UTC), at(30, 10).replace(tzinfo=UTC), "Call", "Room", people, "one\ntwo"), (at(30).replace(tzinfo=UTC), at(30, 10).replace(tzinfo=UTC), "Off", None, None, None)], EVENT)
    assert line(e, briefing.event_block("Asia/Tokyo")) == ["- 18:00–19:00 Call (at Room) — with Ann, b@x, c@x, Dan\n  Description: one two", "- 18:00–19:00 Off"]
    t = spark.createDataFrame([(at(29), "A", "P", "Do", "do", "n\nm"), (at(30, 23), "B", None, None, None, None), (dt.datetime(2024, 2, 2), "C", "", "", "", ""), (None, "D", None, None, None, None)], TASK)
    assert line(t, briefing.task_block(F.lit(NOW))) == ['- [OVERDUE] A (subtask of "P") — list: Do · do\n  Notes: n m', "- [TODAY] B — list: (unfiled)", "- [due 2024-02-02] C — list: (unfiled)", "- D — list: (unfiled)"]
    m = spark.createDataFrame([(at(2), "a@b", "Hi", "s\nt"), (None, "a@b", None, None)], MAIL)
    assert line(m, briefing.mail_block()) == ['- [2024-01-02] From a@b: "Hi"\n  s t', '- [?] From a@b: "(no subject)"']
    k = spark.createDataFrame([(at(3), "S", "task", "T", dt.date(2024, 1, 9), "relates_to_task", 0.6, "why"), (at(3), None, "entity", None, None, "mentions_entity", None, None)], LINK)
    assert line(k, briefing.link_block()) == ['- [2024-01-03] Journal: "S" → task "T" (2024-01-09) (relates_to_task) [confidence 0.60]\n  why', '- [2024-01-03] Journal: "(no summary)" → entity (mentions_entity)\n  ']


def test_sections_take_turns_under_a_budget(spark):
    lines = spark.createDataFrame([("a", i, "x" * 4) for i in range(1, 9)] + [("b", 1, "y" * 8), ("b", 2, "z" * 8)], "section string, place int, line string")
    kept = lambda n: sorted((r.section, r.place) for r in briefing.budgeted(lines, ["a", "b"], n).collect())
    assert kept(0) == [] and kept(1) == [("a", 1)] and kept(3) == [("a", 1), ("b", 1)]
    assert kept(7) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)] and len(kept(100)) == 10


def review(spark, **rows):
    made = {"events": (EVENT, "start_at"), "tasks": (TASK, "title"), "mails": (MAIL, "subject"), "links": (LINK, "entry_at")}
    reads = {n: (spark.createDataFrame(rows.get(n, []), s), [F.col(o)]) for n, (s, o) in made.items()}
    reads["entries"] = (entries(spark, rows.get("entries", [])), [F.desc("created_at")])
    return briefing.morning_review(reads, lambda texts: [{"content": t.upper()} for t in texts], F.lit(NOW), "personal").collect()


def test_morning_review(spark):
    (r,) = review(spark, entries=ENTRY, mails=[(at(2), "a@b", "Hi", None)])
    assert (r.review_date, r.scope, r.entry_count, r.content) == ("2024-01-30", "personal", 2, r.prompt.upper())
    assert r.prompt.startswith("Today is 2024-01-30 (timezone: UTC).\n\n=== CALENDAR OF TODAY ===\n(no events)\n\n=== OPEN TASKS ===\n(no tasks due soon)\n\n=== STARRED MAILS ===\n- [2024-01-02]")
    assert "the text\n\n---\n\n=== Entry [2024-01-20T09:00]" in r.prompt
    assert review(spark) == [] and review(spark, links=[(at(3), "S", "task", "T", None, "x", 0.6, "why")]) == []


def test_ask(spark):
    found = spark.createDataFrame([("A", 2, 0.5), ("A", 1, 0.4), ("B", None, 0.3), ("gone", 9, 0.2)], "artifact string, chunk int, score double")
    chunks = spark.createDataFrame([("A", 1, "one", "TA", "s", dt.date(2024, 1, 2)), ("A", 2, "two" * 900, "TA", "s", dt.date(2024, 1, 2)), ("B", None, None, "TB", "about B", None), ("C", 3, "x", "TC", "", None)], "artifact string, chunk int, body string, title string, summary string, published_at date")
    asked = []

    def model(texts):
        asked.extend(texts)
        return [{"answer": str(len(t))} for t in texts]

    r = briefing.ask_archive(found, chunks, "why?", model).first()
    blocks = ['[1] "TA" (2024-01-02)\n' + ("two" * 900)[:1200], '[2] "TA" (2024-01-02)\none', '[3] "TB" (undated)\nabout B']
    assert r.prompt == "Question: why?\n\nExcerpts from the archive:\n\n" + "\n\n---\n\n".join(blocks) and r.answer == str(len(r.prompt))
    assert [(s.title, s.published_at) for s in r.sources] == [("TA", dt.date(2024, 1, 2)), ("TB", None)]
    none = briefing.ask_archive(found.limit(0), chunks, "why?", model).first()
    assert (none.answer, none.sources, none.prompt) == (briefing.NOTHING_FOUND, [], None)
    assert briefing.ask_archive(found, chunks, "?", lambda texts: [{"answer": None} for _ in texts]).first().answer == briefing.NO_ANSWER
