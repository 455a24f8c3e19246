"""Undertakings under goals: creating and changing them by whole batches of requests, closing cycles, lists and details.

Every request gets an error, or null where it was carried out. Checks are joins on the keys of goals, so it makes no
difference whether a batch holds one request or all of a year's. Null ids match nothing; further columns of the present
table stay in old rows and are null in new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brainweave.operators import filters, upsert, validate

#: Kinds and states of undertakings.
KINDS, STATES = ("outcome", "habit_forming"), ("active", "completed", "archived", "sleeping")
TEXTS = {"name": (1, 200), "purpose": (3, 4000), "outcome": (3, 4000), "test_criteria": (3, 4000)}
#: Columns a change may clear, against those where null means unchanged.
CLEARED = ("gtasks_parent_id", "target_date")
SETTABLE = (*TEXTS, "status", "secondary_goal_ids", *CLEARED)


def _bad(required: bool) -> Column:
    """Whether any field is out of its bounds; of optional ones only those that are there are looked at."""
    rules = [validate.text_rule(c, low, high) for c, (low, high) in TEXTS.items()]
    ok = [F.coalesce(r, F.lit(not required)) for r in rules]
    ok.append(F.coalesce(F.length("gtasks_parent_id") <= 255, F.lit(True)))
    ok.append(F.col("target_date").isNull() | validate.date_rule("target_date") & F.col("target_date").try_cast("date").isNotNull())
    column, known = ("kind", KINDS) if required else ("status", STATES)
    ok.append(F.coalesce(F.col(column).isin(*known), F.lit(True)))
    found = F.lit(True)
    for o in ok:
        found = found & o
    return ~found


def _known(requests: DataFrame, goals: DataFrame) -> DataFrame:
    """requests with _known: how many different ids among secondary_goal_ids are active goals of the same user."""
    wanted = requests.select("request_id", "user_id", F.explode(F.array_distinct("secondary_goal_ids")).alias("goal_id"))
    active = goals.filter("status = 'active'").select("goal_id", "user_id")
    hits = wanted.join(active, ["goal_id", "user_id"], "left_semi").groupBy("request_id").agg(F.count(F.lit(1)).alias("_known"))
    return requests.join(hits, "request_id", "left").withColumn("_known", F.coalesce("_known", F.lit(0)))


def check_new(requests: DataFrame, goals: DataFrame) -> DataFrame:
    """requests (request_id, user_id, the texts, primary_goal_id, secondary_goal_ids, kind, gtasks_parent_id, target_date) with error.

    goals: goal_id, user_id, status. An id that repeats among the secondary ones counts as missing.
    """
    own = goals.select(F.col("goal_id").alias("primary_goal_id"), "user_id", F.col("status").alias("_status"))
    joined = _known(requests, goals).join(own, ["primary_goal_id", "user_id"], "left")
    error = (
        F.when(_bad(required=True) | F.col("primary_goal_id").isNull(), "invalid arguments")
        .when(F.col("_status").isNull(), "goal not found")
        .when(F.col("_status") != "active", F.concat(F.lit("goal is "), "_status"))
        .when(F.coalesce(F.size("secondary_goal_ids"), F.lit(0)) > F.col("_known"), "secondary goal not found or not active")
    )
    return joined.select(*[joined[c] for c in requests.columns], error.alias("error"))


def create(current: DataFrame, checked: DataFrame, as_of: Column) -> DataFrame:
    """current with the undertakings that ``check_new`` let pass; their id is that of the request, so that a batch that runs again adds nothing."""
    none = F.array().cast(current.schema["secondary_goal_ids"].dataType)
    given = {
        "undertaking_id": F.col("request_id"), "kind": F.coalesce("kind", F.lit("outcome")), "status": F.lit("active"),
        "secondary_goal_ids": F.coalesce("secondary_goal_ids", none), "started_at": as_of, "created_at": as_of, "updated_at": as_of,
    }
    passed = checked.filter("error IS NULL")
    value = lambda f: given.get(f.name, F.col(f.name) if f.name in checked.columns else F.lit(None))
    new = passed.select(*[value(f).cast(f.dataType).alias(f.name) for f in current.schema])
    return current.unionByName(new.join(current.select("undertaking_id"), "undertaking_id", "left_anti"))


def check_changes(changes: DataFrame, current: DataFrame, goals: DataFrame) -> DataFrame:
    """changes (request_id, user_id, undertaking_id, given: names of the columns that a change names, and these columns) with error."""
    own = current.select("undertaking_id", "user_id", F.lit(True).alias("_there"))
    joined = _known(changes, goals).join(own, ["undertaking_id", "user_id"], "left")
    named = F.size(F.array_intersect(F.coalesce("given", F.array().cast("array<string>")), F.array(*map(F.lit, SETTABLE))))
    error = (
        F.when(_bad(required=False), "invalid arguments")
        .when(named == 0, "nothing to change")
        .when(F.coalesce(F.size("secondary_goal_ids"), F.lit(0)) > F.col("_known"), "secondary goal not found or not active")
        .when(F.col("_there").isNull(), "undertaking not found")
    )
    return joined.select(*[joined[c] for c in changes.columns], error.alias("error"))


def change(current: DataFrame, checked: DataFrame, as_of: Column) -> DataFrame:
    """current after the changes that ``check_changes`` let pass; of several changes of one undertaking the one with the largest request_id is made.

    What a change doesn't name stays. A null clears a date or a link to a task, and leaves anything else as it is.
    """
    last = upsert.last_per_key(checked.filter("error IS NULL").drop("error", "user_id"), ["undertaking_id"], ["request_id"])
    joined = current.join(last.select("undertaking_id", F.struct("given", *SETTABLE).alias("_new")), "undertaking_id", "left")
    touched = F.col("_new").isNotNull()
    out = {"updated_at": F.when(touched, as_of).otherwise(F.col("updated_at"))}
    for c in SETTABLE:
        new = F.col("_new")[c].cast(current.schema[c].dataType)
        named = touched & F.array_contains(F.col("_new")["given"], c)
        out[c] = upsert.tri_state(F.col(c), named if c in CLEARED else named & new.isNotNull(), new)
    return joined.select(*[out.get(c, F.col(c)).alias(c) for c in current.columns])


def close_cycles(cycles: DataFrame, requests: DataFrame, undertakings: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(cycles with the requested ones closed, requests with error). requests: request_id, user_id, cycle_id, streak_summary, reformulation_notes.

    Summary and notes replace the old ones where they are given. Of requests for one cycle the first is carried out; the
    others find it closed.
    """
    owners = undertakings.select("undertaking_id", "user_id")
    state = cycles.join(owners, "undertaking_id").select("cycle_id", "user_id", F.col("status").alias("_status"))
    first = requests.groupBy("cycle_id", "user_id").agg(F.min("request_id").alias("_first"))
    joined = requests.join(state, ["cycle_id", "user_id"], "left").join(first, ["cycle_id", "user_id"], "left")
    error = (
        F.when(F.col("_status").isNull(), "cycle not found")
        .when(F.col("_status") != "active", F.concat(F.lit("cycle is "), "_status"))
        .when(F.col("request_id") != F.col("_first"), "cycle is closed")
    )
    checked = joined.select(*[joined[c] for c in requests.columns], error.alias("error"))
    done = checked.filter("error IS NULL").select("cycle_id", F.struct("streak_summary", "reformulation_notes").alias("_new"))
    after = cycles.join(done, "cycle_id", "left")
    closed = F.col("_new").isNotNull()
    values = {
        "status": F.when(closed, "closed").otherwise(F.col("status")),
        "closed_at": F.when(closed, as_of).otherwise(F.col("closed_at")),
        **{c: F.coalesce(F.col("_new")[c], F.col(c)) for c in ("streak_summary", "reformulation_notes")},
    }
    return after.select(*[values.get(c, F.col(c)).alias(c) for c in cycles.columns]), checked


def listed(undertakings: DataFrame, user: str, status: str = "active", goal: object = None) -> DataFrame:
    """A user's undertakings of one state ('all': of any), of one goal if that is given; the latest started first, ties by id."""
    state = filters.one_of(F.col("status"), None if status == "all" else [status])
    under = filters.one_of(F.col("primary_goal_id"), None if goal is None else [goal])
    return undertakings.filter(filters.all_of(F.col("user_id") == user, state, under)).orderBy(F.desc("started_at"), "undertaking_id")


def latest_children(parents: DataFrame, children: DataFrame, key: str, order: list[Column], columns: list[str], name: str, most: int | None = None) -> DataFrame:
    """parents with an array of structs of their children in order, at most ``most`` of them; empty where there are none.

    The limit is taken before the shuffle (tasks pass on ``most`` rows per parent), so a parent with a third of all
    children costs no more than others; without a limit the array holds what the result has to hold.
    """
    numbered = children.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    kept = numbered.filter(F.col("_n") <= most) if most else numbered
    sorted_ = F.sort_array(F.collect_list(F.struct("_n", F.struct(*columns).alias("_c"))))
    arrays = kept.groupBy(key).agg(F.transform(sorted_, lambda x: x["_c"]).alias(name))
    return parents.join(arrays, key, "left").withColumn(name, F.coalesce(name, F.array().cast(arrays.schema[name].dataType)))


def with_cycles(undertakings: DataFrame, cycles: DataFrame) -> DataFrame:
    """undertakings with current_cycle (a struct; null where none is active) and past_cycles (the closed ones, the last first)."""
    shown = ["cycle_id", "cycle_number", "start_date", "end_date", "status", "streak_summary", "reformulation_notes"]
    now = upsert.first_per_key(cycles.filter("status = 'active'").select("undertaking_id", *shown), ["undertaking_id"], ["cycle_number", "cycle_id"])
    current = undertakings.join(now.select("undertaking_id", F.struct(*shown).alias("current_cycle")), "undertaking_id", "left")
    past = cycles.filter("status = 'closed'")
    return latest_children(current, past, "undertaking_id", [F.desc("cycle_number"), F.col("cycle_id")], [*shown, "closed_at"], "past_cycles")


def goal_details(goals: DataFrame, undertakings: DataFrame, amendments: DataFrame, most: int = 20) -> DataFrame:
    """goals with their undertakings, the latest started first, and their ``most`` latest proposed amendments."""
    own = undertakings.withColumnRenamed("primary_goal_id", "goal_id")
    found = latest_children(goals, own, "goal_id", [F.desc("started_at"), F.col("undertaking_id")], ["undertaking_id", "name", "status", "kind"], "undertakings")
    shown = ["amendment_id", "kind", "status", "proposed_at", "committed_at", "cooldown_until", "rationale"]
    return latest_children(found, amendments, "goal_id", [F.desc("proposed_at"), F.col("amendment_id")], shown, "amendments", most)
