import datetime as dt

from pyspark.sql import functions as F

from brainweave.functions import text
from brainweave.operators import governance, intake, lifecycle, lookups, upsert, validate

T = dt.datetime(2024, 1, 1)


def at(seconds):
    return T + dt.timedelta(seconds=seconds)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: [(x is not None, x) for x in t])


ART = "source_system string, source_external_id string, user_id string, type string, title string, raw_source string, summary string, processing_status string, last_error string"


def test_artifact_upsert(spark):
    now = [("s", "1", "u", "t", "old", "same", "mine", "processed", "e"), ("s", "2", "u", "t", "old", "was", "mine", "processed", "e"), ("s", "4", "u", "t", "old", "x", "mine", "processed", None)]
    new = [("s", "1", "v", "w", "new", "same", "theirs", "pending", None), ("s", "2", "v", "w", "new", "is", None, "pending", None), ("s", "3", "v", "w", "new", "n", "theirs", "pending", None)]
    c, i = spark.createDataFrame(now, ART), spark.createDataFrame(new, ART)
    got = upsert.upsert_artifacts(c, i)
    assert rows(got, "source_external_id", "type", "title", "summary", "processing_status", "last_error", "created") == [
        ("1", "t", "new", "mine", "processed", "e", False), ("2", "t", "new", None, "pending", None, False), ("3", "w", "new", "theirs", "pending", None, True), ("4", "t", "old", "mine", "processed", None, False),
    ]
    again = upsert.upsert_artifacts(got.drop("created"), i)
    assert rows(again.drop("created"), *got.drop("created").columns[1:2]) == rows(got, "source_external_id")
    assert rows(again, "title", "summary", "processing_status") == rows(got, "title", "summary", "processing_status")


def test_first_write_wins(spark):
    c = spark.createDataFrame([(1, "a", 0.5, 1)], "k int, t string, confidence double, seq int")
    i = spark.createDataFrame([(1, "a", 0.9, 2), (2, "b", 0.7, 3), (2, "b", 0.8, 4)], c.schema)
    assert rows(upsert.insert_new(c, i, ["k", "t"], ["seq"]), "k", "confidence") == [(1, 0.5), (2, 0.7)]


def test_idle_drafts_are_strict(spark):
    e = spark.createDataFrame([(1, "drafting", at(0), at(0)), (2, "drafting", at(1), at(0)), (3, "pending", at(0), at(0))], "entry_id int, status string, updated_at timestamp_ntz, window_end timestamp_ntz")
    assert rows(lifecycle.confirm_idle_drafts(e, F.lit(at(301))), "entry_id", "status") == [(1, "pending"), (2, "drafting"), (3, "pending")]


def test_suggestions_expire_after_a_day_and_resolve_once(spark):
    s = spark.createDataFrame([(1, "pending", at(0), None), (2, "pending", at(1), None), (3, "added", at(0), None), (4, "pending", None, None)], "suggestion_id int, status string, posted_at timestamp_ntz, resolved_at timestamp_ntz")
    got = lifecycle.expire_suggestions(s, F.lit(at(86_401)))
    assert rows(got, "suggestion_id", "status") == [(1, "expired"), (2, "pending"), (3, "added"), (4, "pending")]
    answers = spark.createDataFrame([(2, at(5), "skipped"), (2, at(4), "added"), (3, at(1), "skipped")], "suggestion_id int, ts timestamp_ntz, outcome string")
    assert rows(lifecycle.resolve_suggestions(s, answers), "suggestion_id", "status") == [(1, "pending"), (2, "added"), (3, "added"), (4, "pending")]


def test_cooldown_allows_at_its_end(spark):
    a = spark.createDataFrame([(1, "proposed", at(0)), (2, "committed", at(0))], "amendment_id int, status string, proposed_at timestamp_ntz")
    cooled = lambda s: rows(lifecycle.cooled_down(governance.cooldown(a, hours=72), F.lit(at(s))), "amendment_id", "allowed", "seconds_left")
    assert cooled(72 * 3600) == [(1, True, 0)] and cooled(72 * 3600 - 1) == [(1, False, 1)]


def test_founding_bypass_ends_with_the_fifth(spark):
    a = spark.createDataFrame([(i, "u", "amend" if i == 3 else "new", at(i)) for i in range(8)], "amendment_id int, user_id string, kind string, committed_at timestamp_ntz")
    assert [b for _, b in rows(lifecycle.founding(a), "amendment_id", "bypass")] == [True, True, True, False, True, True, False, False]


def test_cap_of_three(spark):
    g = spark.createDataFrame([("u", 1, "active")] * 3 + [("u", 2, "active"), ("u", 2, "merged")], "user_id string, domain_id int, status string")
    assert rows(lifecycle.over_cap(g), "domain_id", "active", "full") == [(1, 3, True), (2, 1, False)]


def test_cycles(spark):
    u = spark.createDataFrame([(1, "habit_forming", "active"), (2, "habit_forming", "active"), (3, "outcome", "active"), (4, "habit_forming", "active")], "undertaking_id int, kind string, status string")
    c = spark.createDataFrame([(10, 2, 1, "active", "{}", "n", None), (11, 4, 2, "closed", None, None, None)], "cycle_id int, undertaking_id int, cycle_number int, status string, streak_summary string, reformulation_notes string, closed_at timestamp_ntz")
    got = lifecycle.open_cycles(u, c, F.lit("2024-01-30").cast("date"))
    assert rows(got, "undertaking_id", "cycle_number", "end_date") == [(1, 1, dt.date(2024, 2, 27)), (4, 3, dt.date(2024, 2, 27))]
    closing = spark.createDataFrame([(10, at(5), None, "new"), (11, at(5), "x", None)], "cycle_id int, closed_at timestamp_ntz, streak_summary string, reformulation_notes string")
    assert rows(lifecycle.close_cycles(c, closing), "cycle_id", "status", "streak_summary", "reformulation_notes", "closed_at") == [(10, "closed", "{}", "new", at(5)), (11, "closed", None, None, None)]


def test_drafts_settle_and_take_messages_only_while_open(spark):
    e = spark.createDataFrame([(1, "drafting", "a", at(0)), (2, "pending", "b", at(0))], "entry_id int, status string, full_text string, updated_at timestamp_ntz")
    m = spark.createDataFrame([(1, at(2), 2, "y"), (1, at(1), 1, "x"), (2, at(1), 3, "z")], "entry_id int, ts timestamp_ntz, message_id int, body string")
    assert rows(lifecycle.append_to_drafts(e, m), "entry_id", "full_text", "updated_at") == [(1, "a\nx\ny", at(2)), (2, "b", at(0))]
    s = spark.createDataFrame([(1, at(3), "cancel"), (1, at(2), "done"), (2, at(1), "cancel")], "entry_id int, ts timestamp_ntz, signal string")
    assert rows(lifecycle.settle_drafts(e, s), "entry_id", "status") == [(1, "pending"), (2, "pending")]


def test_task_suggestions(spark):
    action = "array<struct<kind:string,reason:string,confidence:double>>"
    e = spark.createDataFrame(
        [
            (1, "task_candidate", 0.6, "family", None, "sum", "text", [("note", "n", 0.1), ("task", "  ", 0.9), ("task", " Buy ", 0.9)]), (2, "task_candidate", 0.59, "personal", None, "s", "t", []),
            (3, "task_candidate", 0.9, "personal", "c9", " ", " text ", None), (4, "task", 0.9, "personal", "c9", "s", "t", None), (5, "task_candidate", None, "personal", "c9", "s", "t", None),
            (6, "task_candidate", 0.9, "personal", "c9", "", " ", None), (7, "task_candidate", 0.9, "family", "own", "s", "t", []),
        ],
        f"entry_id int, primary_type string, primary_type_confidence double, scope string, chat_id string, summary string, clean_text string, suggested_actions {action}",
    )
    chats = spark.createDataFrame([(1, "c1", at(1)), (1, "c2", at(2)), (1, None, at(3)), (7, "c7", at(1))], "entry_id int, chat_id string, received_at timestamp_ntz")
    got = lifecycle.suggest_tasks(e, chats, {"family": "Home", "personal": "Mine"})
    assert rows(got, "entry_id", "suggested_title", "list_name", "chat_id") == [(1, "Buy", "Home", "c2"), (3, "text", "Mine", "c9"), (7, "s", "Home", "own")]


def test_proposals_and_commits(spark):
    targets = spark.createDataFrame([(1, "active", 7), (2, "active", 7), (3, "merged", 7), (4, "active", 8)], "target_id int, status string, group_id int")
    full = '{"label":"l","statement":"s"}'
    p = spark.createDataFrame(
        [(1, "new", None, [], full), (2, "new", None, [], '{"label":"l"}'), (3, "amend", 3, [], full), (4, "amend", 1, [], full), (5, "amend", 9, [], full), (6, "synthesize", None, [1], full),
         (7, "synthesize", None, [1, 1], full), (8, "synthesize", None, [1, 2], full), (9, "synthesize", None, [1, 4], full), (10, "retire", None, None, full), (11, "amend", 2, [], full)],
        "proposal_id int, kind string, target_id int, source_ids array<int>, payload string",
    )
    pending = spark.createDataFrame([(1,)], "target_id int")
    assert rows(governance.check_proposals(p, targets, pending, ["label", "statement"]), "proposal_id", "error") == [
        (1, None), (2, "payload incomplete"), (3, "target not active"), (4, "proposal open"), (5, "target unknown"), (6, "two sources needed"),
        (7, "source unknown or not active"), (8, None), (9, "sources in several domains"), (10, "target missing"), (11, None),
    ]
    goals = spark.createDataFrame([(i, f"g{i}", "active", None, at(0), at(0)) for i in (1, 2, 3, 4)], "goal_id int, statement string, status string, merged_into_id int, created_at timestamp_ntz, last_amended_at timestamp_ntz")
    a = spark.createDataFrame(
        [(1, "amend", 1, None, '{"statement":"better"}', None), (2, "abandon", 2, None, "{}", None), (3, "synthesize", None, [3, 4], '{"statement":"both"}', 5)],
        "amendment_id int, kind string, target_id int, source_ids array<int>, payload string, new_id int",
    )
    assert rows(governance.commit(goals, a, F.lit(at(9)), ["statement"]), "goal_id", "statement", "status", "merged_into_id") == [
        (1, "better", "active", None), (2, "g2", "abandoned", None), (3, "g3", "merged", 5), (4, "g4", "merged", 5), (5, "both", "active", None),
    ]


def test_commits_are_checked_again(spark):
    full, late, soon = '{"label":"l"}', at(10**6), at(0)
    some = [(i, "u", "new", None, [], full, "committed", soon) for i in range(100, 105)] + [(i, "v", "new", None, [], full, "committed", soon) for i in range(200, 204)]
    a = spark.createDataFrame(
        some + [(1, "u", "new", None, [], full, "proposed", late), (2, "v", "new", None, [], full, "proposed", late), (3, "v", "amend", 7, [], "{}", "proposed", late), (4, "v", "amend", 7, [], "{}", "proposed", soon),
                (5, "v", "amend", None, [], "{}", "proposed", soon), (6, "v", "synthesize", None, [1], full, "proposed", soon), (7, "v", "synthesize", None, None, full, "proposed", soon), (8, "v", "new", None, [], '{"label":""}', "proposed", soon),
                (9, "v", "rename", 7, [], full, "proposed", soon), (10, "v", "retire", 7, [], full, None, soon), (11, "v", "retire", 7, [], full, "proposed", None)],
        "amendment_id int, user_id string, kind string, target_id int, source_ids array<int>, payload string, status string, cooldown_until timestamp_ntz",
    )
    got = dict(rows(governance.check_commits(a, F.lit(at(1)), ["label"]).filter("amendment_id < 100"), "amendment_id", "error"))
    assert got == {1: "cooldown not over", 2: None, 3: "cooldown not over", 4: None, 5: "target missing", 6: "two sources needed", 7: "two sources needed", 8: "payload incomplete", 9: "kind unknown", 10: "is unknown", 11: "cooldown not over"}


def test_tri_state_and_rules(spark):
    df = spark.createDataFrame([(1, "a", False, None), (2, "a", True, None), (3, "a", True, "b")], "k int, old string, given boolean, value string")
    assert [r.x for r in df.orderBy("k").select(upsert.tri_state(F.col("old"), F.col("given"), F.col("value")).alias("x")).collect()] == ["a", None, "b"]
    m = spark.createDataFrame([(1, "merged", None), (2, "merged", 1), (3, "active", 1)], "k int, status string, merged_into_id int")
    assert rows(validate.broken(m, {"merged": validate.merged_rule()}), "k") == [(1,), (3,)]
    d = spark.createDataFrame([(1, None), (1, None), (1, 2), (1, 2)], "a int, b int")
    assert rows(validate.duplicates(d, ["a", "b"]), "a", "b", "n") == [(1, 2, 2)]


def test_claims_are_seen_once(spark):
    q = spark.createDataFrame([(1, "pending", at(5), at(5)), (2, "pending", at(1), at(1)), (3, "done", at(0), at(0))], "k int, status string, created_at timestamp_ntz, updated_at timestamp_ntz")
    one = lifecycle.claimed(q, "k", F.lit(at(9)).cast("timestamp_ntz"))
    assert rows(one, "k", "status", "updated_at") == [(1, "pending", at(5)), (2, "processing", at(9)), (3, "done", at(0))]
    assert rows(lifecycle.claim(one, "k", 5), "k") == [(1,)]


def test_last_error_stays(spark):
    r = spark.createDataFrame([(1, "pending", None), (2, "pending", None)], "k int, status string, last_error string")
    e = spark.createDataFrame([(1, at(2), "late"), (1, at(1), "early"), (9, at(1), "unknown")], "k int, ts timestamp_ntz, message string")
    assert rows(lifecycle.mark_errors(r, e, "k"), "k", "status", "last_error") == [(1, "error", "late"), (2, "pending", None)]


def test_daily_runs_once_per_local_date(spark):
    ticks = [dt.datetime(2024, 1, 1, 22, 30, 5), dt.datetime(2024, 1, 1, 22, 30, 50), dt.datetime(2024, 1, 1, 22, 31), dt.datetime(2024, 1, 2, 22, 30)]
    found = lifecycle.daily_runs(spark.createDataFrame([(t,) for t in ticks], "ts timestamp_ntz"), [("family", "06:30", "Asia/Hong_Kong"), ("own", "06:00", "UTC")])
    assert rows(found, "label", "day", "ts") == [("family", dt.date(2024, 1, 2), ticks[0]), ("family", dt.date(2024, 1, 3), ticks[3])]


def test_lookups_tell_what_is_missing(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert rows(lookups.by_ids(d, spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int"), "k"), "k", "v", "found") == [(1, "a", True), (2, None, True), (3, None, False)]
    lists = spark.createDataFrame([(7, "Do"), (5, "DO"), (6, "Family")], "list_id int, title string")
    got = lookups.lists_named(lists, spark.createDataFrame([("do",), ("family",), ("none",)], "name string"))
    assert rows(got, "name", "list_id") == [("do", 5), ("family", 6), ("none", None)]


def test_thresholds(spark):
    given = {"0.7": 0.7, " .5 high": 0.5, "": 0.6, "x": 0.6, "NaN": 0.6, "Infinity": 0.6, "1e999": 0.6, "-1": -1.0, "2.": 2.0, None: 0.6}
    df = spark.createDataFrame([(k,) for k in given], "v string")
    assert {r.v: r.t for r in df.select("v", text.threshold(F.col("v")).alias("t")).collect()} == given


def test_last_episode_stays(spark):
    p = spark.createDataFrame([(1, None, None), (2, "old", at(0))], "pick_id int, episode_url string, episode_linked_at timestamp_ntz")
    n = spark.createDataFrame([(1, at(1), "a"), (1, at(2), "b"), (3, at(1), "c")], "pick_id int, ts timestamp_ntz, episode_url string")
    assert rows(intake.link_episodes(p, n), "pick_id", "episode_url", "episode_linked_at") == [(1, "b", at(2)), (2, "old", at(0))]


def test_children_are_replaced_in_tasks_of_few_rows(spark, monkeypatch):
    """4,000 children in partitions of about 100 rows: Spark alone would put all of them into one or a few tasks."""
    monkeypatch.setattr(upsert, "EACH", 100)
    now = spark.range(4000).select((F.col("id") % 1000).alias("parent"), F.col("id").alias("child")).unionByName(spark.createDataFrame([(None, 5000)], "parent long, child long"))
    new = spark.range(0, 1000, 2).select(F.col("id").alias("parent"), F.lit(-1).cast("long").alias("child"))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        got = upsert.replace_children(now, new, "parent")
        assert got.count() == 2501 and got.filter("child < 0").count() == 500 and got.filter("child >= 0 AND parent % 2 = 0").count() == 0
        kept = upsert.clear_children(now, new, "parent")
        assert kept.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 500
    finally:
        spark.conf.set(threshold, before)
