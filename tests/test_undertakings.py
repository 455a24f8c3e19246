"""Undertakings: what is refused and why, what a change leaves alone, cycles, details; and the small operators around them."""

import datetime as dt
import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from brainweave.functions import vector
from brainweave.operators import lifecycle, lookups, processing, undertakings
from brainweave.sources import feeds

NOW = dt.datetime(2024, 1, 30)
TEXTS = "name string, purpose string, outcome string, test_criteria string"


def as_of():
    return F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")


REQUEST = f"request_id string, user_id string, {TEXTS}, primary_goal_id string, secondary_goal_ids array<string>, kind string, gtasks_parent_id string, target_date string"
TABLE = f"undertaking_id string, user_id string, {TEXTS}, primary_goal_id string, secondary_goal_ids array<string>, kind string, gtasks_parent_id string, status string, started_at timestamp_ntz, target_date date, created_at timestamp_ntz, updated_at timestamp_ntz"
CHANGE = f"request_id string, user_id string, undertaking_id string, given array<string>, {TEXTS}, status string, secondary_goal_ids array<string>, gtasks_parent_id string, target_date string"


@pytest.fixture(scope="module")
def goals(spark):
    rows = [("g1", "u", "active"), ("g2", "u", "active"), ("g3", "u", "retired"), ("g4", "v", "active"), (None, "u", "active")]
    return spark.createDataFrame(rows, "goal_id string, user_id string, status string")


def request(i, user="u", name="n", purpose="why", goal="g1", secondary=(), kind=None, link=None, date=None):
    return (i, user, name, purpose, "out", "test", goal, None if secondary is None else list(secondary), kind, link, date)


def errors(df, key="request_id"):
    return {r[key]: r.error for r in df.collect()}


def test_what_is_refused(spark, goals):
    gone = "secondary goal not found or not active"
    cases = {
        "fine": (request("fine"), None),
        "all": (request("all", secondary=["g2", "g1"], kind="habit_forming", link="t", date="2024-02-29"), None),
        "null secondary": (request("null secondary", secondary=None), None),
        "no name": (request("no name", name=""), "invalid arguments"),
        "null name": (request("null name", name=None), "invalid arguments"),
        "long name": (request("long name", name="x" * 201), "invalid arguments"),
        "short purpose": (request("short purpose", purpose="no"), "invalid arguments"),
        "long purpose": (request("long purpose", purpose="x" * 4001), "invalid arguments"),
        "kind": (request("kind", kind="odd"), "invalid arguments"),
        "date": (request("date", date="29.2.2024"), "invalid arguments"),
        "no such day": (request("no such day", date="2023-02-29"), "invalid arguments"),
        "no goal": (request("no goal", goal=None), "invalid arguments"),
        "unknown": (request("unknown", goal="g9"), "goal not found"),
        "another's": (request("another's", goal="g4"), "goal not found"),
        "retired": (request("retired", goal="g3"), "goal is retired"),
        "secondary retired": (request("secondary retired", secondary=["g2", "g3"]), gone),
        "secondary another's": (request("secondary another's", secondary=["g4"]), gone),
        "repeated": (request("repeated", secondary=["g2", "g2"]), gone),
        "null among them": (request("null among them", secondary=["g2", None]), gone),
    }
    checked = undertakings.check_new(spark.createDataFrame([c[0] for c in cases.values()], REQUEST), goals)
    assert errors(checked) == {k: c[1] for k, c in cases.items()}
    assert undertakings.check_new(spark.createDataFrame([], REQUEST), goals).count() == 0


def test_created_once_with_defaults(spark, goals):
    current = spark.createDataFrame([], f"{TABLE}, further long")
    checked = undertakings.check_new(spark.createDataFrame([request("a", secondary=None, date="2024-02-29"), request("b", kind="habit_forming"), request("c", goal="g9")], REQUEST), goals)
    once = undertakings.create(current, checked, as_of())
    again = undertakings.create(once, checked, as_of())
    rows = {r.undertaking_id: r for r in again.collect()}
    assert again.count() == 2 and set(rows) == {"a", "b"}
    assert (rows["a"].kind, rows["b"].kind, rows["a"].status, rows["a"].secondary_goal_ids, rows["a"].further) == ("outcome", "habit_forming", "active", [], None)
    assert (rows["a"].target_date, rows["b"].target_date, rows["a"].started_at) == (dt.date(2024, 2, 29), None, NOW)


def changed(i, given, undertaking="x", user="u", **values):
    names = ("name", "purpose", "outcome", "test_criteria", "status", "secondary_goal_ids", "gtasks_parent_id", "target_date")
    return (i, user, undertaking, given, *[values.get(n) for n in names])


def test_changes_leave_what_they_do_not_name(spark, goals):
    old = dt.datetime(2023, 1, 1)
    row = lambda i: (i, "u", "old", "why", "out", "test", "g1", ["g1"], "outcome", "t1", "active", old, dt.date(2024, 5, 1), old, old)
    current = spark.createDataFrame([row(i) for i in "xyzw"], TABLE)
    cases = [
        (changed("01", ["name"], name="first"), None),
        (changed("02", ["name", "gtasks_parent_id"], name="second"), None),  # the later of two is made, and clears the link
        (changed("03", ["status", "secondary_goal_ids"], "y", status=None, secondary_goal_ids=[]), None),  # a null state stays, an empty list empties
        (changed("04", ["target_date", "secondary_goal_ids"], "z", target_date="2025-01-01", secondary_goal_ids=["g2"]), None),
        (changed("05", [], "w"), "nothing to change"),
        (changed("06", None, "w"), "nothing to change"),
        (changed("07", ["kind"], "w"), "nothing to change"),
        (changed("08", ["status"], "w", status="odd"), "invalid arguments"),
        (changed("09", ["name"], "w", name=""), "invalid arguments"),
        (changed("10", ["secondary_goal_ids"], "w", secondary_goal_ids=["g3"]), "secondary goal not found or not active"),
        (changed("11", ["name"], "nowhere", name="n"), "undertaking not found"),
        (changed("12", ["name"], "w", user="v", name="n"), "undertaking not found"),
    ]
    checked = undertakings.check_changes(spark.createDataFrame([c[0] for c in cases], CHANGE), current, goals)
    assert errors(checked) == {c[0][0]: c[1] for c in cases}
    rows = {r.undertaking_id: r for r in undertakings.change(current, checked, as_of()).collect()}
    assert (rows["x"].name, rows["x"].gtasks_parent_id, rows["x"].target_date, rows["x"].updated_at) == ("second", None, dt.date(2024, 5, 1), NOW)
    assert (rows["y"].status, rows["y"].secondary_goal_ids, rows["y"].gtasks_parent_id) == ("active", [], "t1")
    assert (rows["z"].target_date, rows["z"].secondary_goal_ids) == (dt.date(2025, 1, 1), ["g2"])
    assert (rows["w"].name, rows["w"].updated_at) == ("old", old)


CYCLE = "cycle_id string, undertaking_id string, cycle_number int, start_date date, end_date date, status string, streak_summary string, reformulation_notes string, closed_at timestamp_ntz"


def cycle(i, undertaking, number, status):
    return (i, undertaking, number, dt.date(2024, 1, 1), dt.date(2024, 1, 29), status, "s", None, None)


def test_cycles_close_once(spark):
    owned = spark.createDataFrame([("x", "u")], "undertaking_id string, user_id string")
    cycles = spark.createDataFrame([cycle("c1", "x", 1, "closed"), cycle("c2", "x", 2, "active"), cycle("c3", "x", 3, "active")], CYCLE)
    asked = [("1", "u", "c1", None, None), ("2", "u", "c2", "good", None), ("3", "u", "c2", "late", "n"), ("4", "v", "c3", None, None), ("5", "u", None, None, None), ("6", "u", "c9", None, None)]
    after, checked = undertakings.close_cycles(cycles, spark.createDataFrame(asked, "request_id string, user_id string, cycle_id string, streak_summary string, reformulation_notes string"), owned, as_of())
    assert errors(checked) == {"1": "cycle is closed", "2": None, "3": "cycle is closed", "4": "cycle not found", "5": "cycle not found", "6": "cycle not found"}
    assert {r.cycle_id: (r.status, r.streak_summary, r.closed_at) for r in after.collect()} == {"c1": ("closed", "s", None), "c2": ("closed", "good", NOW), "c3": ("active", "s", None)}


def test_details_are_ordered_and_limited_before_the_shuffle(spark):
    under = spark.createDataFrame([("x", "u", "g1"), ("y", "u", "g1"), ("z", "u", None)], "undertaking_id string, user_id string, primary_goal_id string")
    cycles = spark.createDataFrame([cycle(f"c{n}", "x", n, "active" if n == 3 else "closed") for n in (1, 2, 3)], CYCLE)
    rows = {r.undertaking_id: r for r in undertakings.with_cycles(under, cycles).collect()}
    assert rows["x"].current_cycle.cycle_number == 3 and [c.cycle_number for c in rows["x"].past_cycles] == [2, 1]
    assert rows["y"].current_cycle is None and rows["y"].past_cycles == []
    goals = spark.createDataFrame([("g1", "hot"), ("g2", "none")], "goal_id string, statement string")
    amendments = spark.range(3000).select(
        F.format_string("a%04d", "id").alias("amendment_id"), F.when(F.col("id") >= 0, "g1").alias("goal_id"), F.lit("amend").alias("kind"), F.lit("proposed").alias("status"),
        (as_of() + F.expr("make_dt_interval(0, 0, cast(id div 2 as int))")).alias("proposed_at"), *[F.lit(None).cast("string").alias(c) for c in ("committed_at", "cooldown_until", "rationale")],
    )
    found = undertakings.goal_details(goals, under.withColumns({"started_at": as_of(), "name": F.lit("n"), "status": F.lit("active"), "kind": F.lit("outcome")}), amendments)
    rows = {r.goal_id: r for r in found.collect()}
    assert [u.undertaking_id for u in rows["g1"].undertakings] == ["x", "y"] and rows["g2"].undertakings == rows["g2"].amendments == []
    assert [a.amendment_id for a in rows["g1"].amendments] == [f"a{n}" for k in range(1499, 1489, -1) for n in (f"{2 * k:04d}", f"{2 * k + 1:04d}")]
    text = io.StringIO()
    with redirect_stdout(text):
        found.explain("formatted")
    assert "WindowGroupLimit" in text.getvalue()


def test_lists_by_state_and_goal(spark):
    rows = [("a", "u", "active", "g1", 1), ("b", "u", "sleeping", "g1", 2), ("c", "u", "active", "g2", 2), ("d", "v", "active", "g1", 3), ("e", "u", "active", "g1", 1)]
    df = spark.createDataFrame(rows, "undertaking_id string, user_id string, status string, primary_goal_id string, started_at int")
    ids = lambda *a: [r.undertaking_id for r in undertakings.listed(df, "u", *a).collect()]
    assert (ids(), ids("all"), ids("active", "g1"), ids("archived")) == (["c", "a", "e"], ["b", "c", "a", "e"], ["a", "e"], [])


def test_first_post_of_a_suggestion_counts(spark):
    now = spark.createDataFrame([(1, None, None), (2, NOW, "m0"), (3, None, None)], "suggestion_id long, posted_at timestamp_ntz, message_id string")
    later = NOW + dt.timedelta(hours=1)
    posts = spark.createDataFrame([(1, later, "m2"), (1, NOW, "m1"), (2, later, "m3"), (9, NOW, "m4")], "suggestion_id long, ts timestamp_ntz, message_id string")
    once = lifecycle.mark_posted(now, posts)
    want = [(1, NOW, "m1"), (2, NOW, "m0"), (3, None, None)]
    assert sorted(map(tuple, once.collect())) == want and sorted(map(tuple, lifecycle.mark_posted(once, posts).collect())) == want


def test_mentions_of_artifacts_that_are_read_anew(spark):
    schema = "artifact string, entity string, salience double"
    current = spark.createDataFrame([("a", "old", 0.1), ("b", "old", 0.2), ("c", "stays", 0.3)], schema)
    done = spark.createDataFrame([("a",), ("b",), (None,)], "artifact string")
    new = spark.createDataFrame([("a", "new", 0.4), ("a", "new", 0.4)], schema)
    assert sorted(map(tuple, processing.replace_mentions(current, done, new).collect())) == [("a", "new", 0.4), ("a", "new", 0.4), ("c", "stays", 0.3)]


def test_ties_round_towards_plus_infinity(spark):
    values = [0.00005, -0.00005, 0.5, -0.12345, 0.12345, -0.123451, float("nan"), 1e300, float("inf"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(vector.round_up(F.col("x"), 4)).collect()]
    assert got[:6] == [0.0001, 0.0, 0.5, -0.1234, 0.1235, -0.1235] and got[6] != got[6] and got[7:] == [1e300, float("inf"), None]
    assert str(got[1]) == "0.0"


def test_resources_by_address(spark, tmp_path):
    (tmp_path / "goal-amendment.md").write_text("intro\n# Goal Interview \n\n## More\n")
    (tmp_path / "plain.txt").write_text("no heading")
    (tmp_path / "blank.md").write_text("#  \n")
    found = feeds.resources(feeds.documents(spark, str(tmp_path)), "notes")
    assert {(r.uri, r.name, r.mime_type) for r in found.collect()} == {("notes://goal-amendment", "Goal Interview", "text/markdown"), ("notes://plain", "plain", "text/plain"), ("notes://blank", "blank", "text/markdown")}
    asked = spark.createDataFrame([("notes://plain",), ("notes://gone",)], "uri string")
    assert {r.uri: (r.body, r.found) for r in lookups.by_ids(found, asked, "uri").collect()} == {"notes://plain": ("no heading", True), "notes://gone": (None, False)}
