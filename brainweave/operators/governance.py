"""Domains, goals, undertakings and their amendments: reads with children, proposals that are checked, commits by kind.

Checks give every proposal an error code, or null where it may go on; they are joins and aggregations over
all proposals at once. A commit takes amendments that touch different rows; order them into rounds where they don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brainweave.functions import time


def with_children(parents: DataFrame, children: DataFrame, key: str, order: list[str], name: str, descending: bool = False, most: int | None = None) -> DataFrame:
    """parents with an array of their children, sorted, at most ``most``; empty where there are none."""
    fields = F.struct(*order, *[c for c in children.columns if c != key and c not in order])
    found = F.sort_array(F.collect_list(fields), asc=not descending)
    kept = children.groupBy(key).agg((F.slice(found, 1, most) if most else found).alias(name))
    kind = kept.schema[name].dataType
    return parents.join(kept, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def filled(payload: Column, fields: list[str]) -> Column:
    """Whether all fields of a JSON payload are strings of one or more characters."""
    found = F.lit(True)
    for f in fields:
        found = found & (F.length(F.coalesce(F.get_json_object(payload, f"$.{f}"), F.lit(""))) >= 1)
    return found


def all_known(rows: DataFrame, key: str, ids: str, known: DataFrame, known_key: str) -> DataFrame:
    """rows with ``found``: whether every id of an array names a known row. An id that repeats counts as missing."""
    hits = (
        rows.select(key, F.explode(F.array_distinct(ids)).alias(known_key))
        .join(known.select(known_key).distinct(), known_key)
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_hits"))
    )
    return rows.join(hits, key, "left").withColumn("found", F.coalesce("_hits", F.lit(0)) == F.size(ids)).drop("_hits")


def check_proposals(proposals: DataFrame, targets: DataFrame, pending: DataFrame, fields: list[str]) -> DataFrame:
    """proposals (proposal_id, kind, target_id, source_ids, payload) with error.

    targets: target_id, status, group_id (the domain of a goal; null where there is none). pending: target_id of open proposals.
    """
    active = targets.filter("status = 'active'")
    state = targets.select("target_id", F.col("status").alias("_status"))
    open_ = pending.select("target_id").filter("target_id IS NOT NULL").distinct().withColumn("_open", F.lit(True))
    checked = _sources_known(proposals, active)
    groups = (
        proposals.select("proposal_id", F.explode("source_ids").alias("target_id"))
        .join(active.select("target_id", "group_id"), "target_id")
        .groupBy("proposal_id")
        .agg(F.count_distinct("group_id").alias("_groups"))
    )
    needs_target = F.col("kind").isin("amend", "retire", "achieve", "abandon")
    error = (
        F.when(needs_target & F.col("target_id").isNull(), "target missing")
        .when(needs_target & F.col("_status").isNull(), "target unknown")
        .when(needs_target & (F.col("_status") != "active"), "target not active")
        .when(needs_target & F.col("_open"), "proposal open")
        .when((F.col("kind") == "synthesize") & (F.size("source_ids") < 2), "two sources needed")
        .when((F.col("kind") == "synthesize") & ~F.col("found"), "source unknown or not active")
        .when((F.col("kind") == "synthesize") & (F.coalesce("_groups", F.lit(0)) > 1), "sources in several domains")
        .when(F.col("kind").isin("new", "synthesize") & ~filled(F.col("payload"), fields), "payload incomplete")
    )
    joined = checked.join(state, "target_id", "left").join(open_, "target_id", "left").join(groups, "proposal_id", "left")
    return joined.select(*proposals.columns, error.alias("error"))


def _sources_known(proposals: DataFrame, active: DataFrame) -> DataFrame:
    sources = F.coalesce("source_ids", F.array().cast(proposals.schema["source_ids"].dataType))
    rows = proposals.withColumn("source_ids", sources)
    known = active.select(F.col("target_id").alias("_source"))
    return all_known(rows, "proposal_id", "source_ids", known, "_source")


def check_commits(amendments: DataFrame, as_of: Column, fields: list[str], founding: int = 5) -> DataFrame:
    """amendments (amendment_id, user_id, kind, target_id, source_ids, payload, status, cooldown_until) with error: what keeps each from being committed.

    All is checked again, whatever was checked when it was proposed. A user's first few new ones need no cooldown: those committed so far are counted.
    """
    settled = amendments.filter("kind = 'new' AND status = 'committed'").groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= founding)
    joined = amendments.join(settled, "user_id", "left")
    free = (F.col("kind") == "new") & F.col("_n").isNull()
    error = (
        F.when(~F.col("status").eqNullSafe("proposed"), F.concat(F.lit("is "), F.coalesce("status", F.lit("unknown"))))
        .when(~free & (F.col("cooldown_until").isNull() | (as_of < F.col("cooldown_until"))), "cooldown not over")
        .when(F.col("kind").isin("new", "synthesize") & ~filled(F.col("payload"), fields), "payload incomplete")
        .when((F.col("kind") == "synthesize") & (F.size(F.coalesce("source_ids", F.array())) < 2), "two sources needed")
        .when(F.col("kind").isin("amend", "retire", "achieve", "abandon") & F.col("target_id").isNull(), "target missing")
        .when(~F.coalesce(F.col("kind").isin("new", "synthesize", "amend", "retire", "achieve", "abandon"), F.lit(False)), "kind unknown")
    )
    return joined.select(*[joined[c] for c in amendments.columns], error.alias("error"))


def commit(goals: DataFrame, amendments: DataFrame, as_of: Column, columns: list[str]) -> DataFrame:
    """goals after amendments (amendment_id, kind, target_id, source_ids, payload, new_id) of disjoint targets that ``check_commits`` has let pass.

    amend replaces what the payload gives; retire, achieve and abandon set the status; synthesize merges its sources into
    the new row; new and synthesize add a row.
    """
    status = {"retire": "retired", "achieve": "achieved", "abandon": "abandoned"}
    own = amendments.filter("target_id IS NOT NULL").select(F.col("target_id").alias("goal_id"), "kind", "payload")
    merged = amendments.filter("kind = 'synthesize'").select(F.explode("source_ids").alias("goal_id"), F.col("new_id").alias("_into"))
    joined = goals.join(own, "goal_id", "left").join(merged, "goal_id", "left")
    touched = F.col("kind").isNotNull() | F.col("_into").isNotNull()
    new_status = F.when(F.col("_into").isNotNull(), "merged")
    for kind, s in status.items():
        new_status = new_status.when(F.col("kind") == kind, s)
    values = {c: F.when(F.col("kind") == "amend", F.coalesce(F.get_json_object("payload", f"$.{c}"), F.col(c))).otherwise(F.col(c)) for c in columns}
    values |= {
        "status": new_status.otherwise(F.col("status")),
        "merged_into_id": F.coalesce("_into", "merged_into_id"),
        "last_amended_at": F.when(touched, as_of).otherwise(F.col("last_amended_at")),
    }
    kept = joined.select(*[values.get(c, F.col(c)).alias(c) for c in goals.columns])
    given = {c: F.get_json_object("payload", f"$.{c}") for c in columns}
    given |= {"goal_id": F.col("new_id"), "status": F.lit("active"), "last_amended_at": as_of, "created_at": as_of}
    added = amendments.filter("kind IN ('new', 'synthesize')").select(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in goals.schema]
    )
    return kept.unionByName(added)


def cooldown(proposals: DataFrame, hours: int = 0, days: int = 0) -> DataFrame:
    """The end of the cooldown follows from the time of the proposal, whatever was given."""
    return proposals.withColumn("cooldown_until", time.after(F.col("proposed_at"), days, hours))
