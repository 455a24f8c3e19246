"""Undertakings under goals, their cycles, and details of both: orders as goals, parts as requests, lines as undertakings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brainweave.operators import lifecycle, processing, undertakings
from brainweave.plans import roles
from brainweave.sources.tables import table

_ID = "l_orderkey * 8 + l_linenumber"


def _goals(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "achieved").otherwise("abandoned")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("goal_id"), (F.col("o_custkey") % 2).alias("user_id"), status.alias("status"), F.col("o_orderpriority").alias("statement"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem, one row per order and line number."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_partkey", "l_returnflag", "l_shipdate")])


def _undertakings(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as undertakings of their orders; some are sleeping, a seventh has no date."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd").cast("date")
    return _lines(spark, sf).select(
        F.expr(_ID).alias("undertaking_id"), (F.col("l_partkey") % 2).alias("user_id"), F.lit("work").alias("name"),
        F.lit("old purpose").alias("purpose"), F.lit("old outcome").alias("outcome"), F.lit("old criteria").alias("test_criteria"), F.col("l_orderkey").alias("primary_goal_id"),
        F.array(F.col("l_orderkey")).alias("secondary_goal_ids"), F.when(F.col("l_linenumber") % 2 == 0, "habit_forming").otherwise("outcome").alias("kind"),
        F.when(F.col("l_linenumber") == 3, "t3").alias("gtasks_parent_id"), F.when(F.col("l_returnflag") == "R", "sleeping").otherwise("active").alias("status"),
        F.when(F.col("l_partkey") % 7 != 0, day).alias("target_date"), F.col("l_shipdate").alias("started_at"), F.col("l_shipdate").alias("created_at"), F.col("l_shipdate").alias("updated_at"),
    )


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every part asks for an undertaking: some with too short a purpose, with a goal of another user, or with a secondary goal that repeats."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("request_id"), (k % 2).alias("user_id"), F.col("p_name").alias("name"), F.when(k % 11 == 0, "x").otherwise("purpose").alias("purpose"), F.lit("outcome").alias("outcome"),
        F.lit("criteria").alias("test_criteria"), (k * 3).alias("primary_goal_id"),
        F.when(k % 5 == 1, F.array(k, k)).when(k % 5 == 2, F.array(k + 1, k + 2)).when(k % 5 == 3, F.array(k)).alias("secondary_goal_ids"),
        F.when(k % 3 == 0, "habit_forming").when(k % 3 == 1, "outcome").alias("kind"), F.lit(None).cast("string").alias("gtasks_parent_id"),
        F.when(k % 13 == 0, "2024-02-31").when(k % 2 == 0, "2024-02-29").alias("target_date"),
    )


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    """Every order changes one of its lines twice over: name and date, or nothing, or secondary goals."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey").withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    named = F.when(k % 4 == 0, F.array(F.lit("name"), F.lit("target_date"))).when(k % 4 == 1, F.array(F.lit("gtasks_parent_id"), F.lit("status"))).when(k % 4 == 2, F.array(F.lit("secondary_goal_ids")))
    return o.select(
        (k * 2 + F.col("again")).alias("request_id"), (F.col("o_custkey") % 2).alias("user_id"), (k * 8 + k % 3 + 1).alias("undertaking_id"), named.alias("given"),
        F.when(k % 4 == 0, F.concat(F.lit("name "), "again")).alias("name"), *[F.lit(None).cast("string").alias(c) for c in ("purpose", "outcome", "test_criteria")],
        F.when(k % 4 == 1, F.when(k % 8 == 1, "completed").when(k % 16 == 5, "odd")).alias("status"), F.when(k % 4 == 2, F.when(k % 8 == 2, F.array(k)).otherwise(F.array().cast("array<bigint>"))).alias("secondary_goal_ids"),
        F.lit(None).cast("string").alias("gtasks_parent_id"), F.when((k % 4 == 0) & (k % 8 == 0), "2024-05-01").alias("target_date"),
    )


def _cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as cycles of the undertaking that is their order's first line."""
    status = F.when(F.col("l_linenumber") == 1, "active").otherwise("closed")
    none = F.lit(None).cast("string")
    return _lines(spark, sf).select(
        F.expr(_ID).alias("cycle_id"), F.expr("l_orderkey * 8 + 1").alias("undertaking_id"), F.col("l_linenumber").alias("cycle_number"), F.col("l_shipdate").alias("start_date"),
        (F.col("l_shipdate") + F.expr("INTERVAL 28 DAYS")).alias("end_date"), status.alias("status"), F.when(F.col("l_linenumber") == 1, "old").alias("streak_summary"), none.alias("reformulation_notes"),
        F.when(F.col("l_linenumber") > 1, F.col("l_shipdate")).alias("closed_at"),
    )


def checked_undertakings(spark: SparkSession, sf: str) -> DataFrame:
    return undertakings.check_new(_requests(spark, sf), _goals(spark, sf)).select("request_id", "error")


def created_undertakings(spark: SparkSession, sf: str) -> DataFrame:
    made = undertakings.create(_undertakings(spark, sf).limit(0), undertakings.check_new(_requests(spark, sf), _goals(spark, sf)), roles.as_of())
    return made.select("undertaking_id", "name", "kind", "status", F.size("secondary_goal_ids").alias("n_secondary"), F.col("target_date").cast("string").alias("target_date"), F.col("started_at").cast("string").alias("started_at"))


def checked_changes(spark: SparkSession, sf: str) -> DataFrame:
    return undertakings.check_changes(_changes(spark, sf), _undertakings(spark, sf), _goals(spark, sf)).select("request_id", "error")


def changed_undertakings(spark: SparkSession, sf: str) -> DataFrame:
    now = _undertakings(spark, sf)
    done = undertakings.change(now, undertakings.check_changes(_changes(spark, sf), now, _goals(spark, sf)), roles.as_of())
    touched = F.col("updated_at") == roles.as_of()
    return done.select("undertaking_id", "purpose", F.when(touched, F.col("name")).alias("new_name"), "status", "gtasks_parent_id", F.size("secondary_goal_ids").alias("n_secondary"), F.col("target_date").cast("string").alias("target_date"), touched.alias("touched"))


def closed_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' orders ask to close the first two cycles; the states after it."""
    asked = table(spark, sf, "orders").select(F.col("o_orderkey"), (F.col("o_custkey") % 2).alias("user_id"), F.explode(F.array(F.lit(1), F.lit(1), F.lit(2))).alias("n"))
    none = F.lit(None).cast("string")
    requests = asked.select((F.col("o_orderkey") * 8 + F.col("n")).alias("cycle_id"), "user_id", F.lit("r").alias("request_id"), F.when(F.col("o_orderkey") % 2 == 0, "new").alias("streak_summary"), none.alias("reformulation_notes")).distinct()
    after, _ = undertakings.close_cycles(_cycles(spark, sf), requests, _undertakings(spark, sf), roles.as_of())
    return after.select("cycle_id", "status", "streak_summary", (F.col("closed_at") == roles.as_of()).alias("just_now"))


def undertakings_with_cycles(spark: SparkSession, sf: str) -> DataFrame:
    found = undertakings.with_cycles(_undertakings(spark, sf), _cycles(spark, sf))
    return found.select("undertaking_id", F.col("current_cycle.cycle_id").alias("current"), F.array_join(F.transform("past_cycles", lambda c: c["cycle_number"].cast("string")), ",").alias("past"))


def goals_in_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Goals with their undertakings and the two latest of their amendments (lines by the day they were received)."""
    none = F.lit(None).cast("string")
    amendments = _lines(spark, sf).select(
        F.expr(_ID).alias("amendment_id"), F.col("l_orderkey").alias("goal_id"), F.lit("amend").alias("kind"), F.lit("proposed").alias("status"), F.col("l_shipdate").alias("proposed_at"),
        F.col("l_shipdate").alias("committed_at"), F.col("l_shipdate").alias("cooldown_until"), none.alias("rationale"),
    )
    found = undertakings.goal_details(_goals(spark, sf), _undertakings(spark, sf), amendments, 2)
    joined = lambda c, k: F.array_join(F.transform(c, lambda x: x[k].cast("string")), ",").alias(c)
    return found.select("goal_id", "status", joined("undertakings", "undertaking_id"), joined("amendments", "amendment_id"))


def listed_undertakings(spark: SparkSession, sf: str) -> DataFrame:
    return undertakings.listed(_undertakings(spark, sf), 1, "sleeping").select("undertaking_id", "primary_goal_id")


def replaced_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Finished orders are read anew and mention one entity each, those of a low priority none at all."""
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    new = o.filter("o_orderpriority != '5-LOW'").select(F.col("o_orderkey").alias("artifact"), F.col("o_custkey").alias("entity"), F.lit(1.0).alias("salience"))
    after = processing.replace_mentions(roles.mentions(spark, sf), o.select(F.col("o_orderkey").alias("artifact")), new)
    return after.groupBy("artifact").agg(F.count(F.lit(1)).alias("n"), F.sum("entity").alias("entities"))


def posted_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as suggestions, errors among them posted already; each is posted twice more."""
    e = table(spark, sf, "events")
    now = e.select(F.col("event_id").alias("suggestion_id"), F.when(F.col("event_type") == "error", F.col("ts")).alias("posted_at"), F.when(F.col("event_type") == "error", -1).cast("long").alias("message_id"))
    again = e.filter("user_id % 3 != 0").select(F.col("event_id").alias("suggestion_id"), F.explode(F.array(F.lit(2), F.lit(1))).alias("h"), "ts")
    posts = again.select("suggestion_id", F.expr("ts + make_dt_interval(0, h)").alias("ts"), F.col("h").cast("long").alias("message_id"))
    return lifecycle.mark_posted(now, posts).select("suggestion_id", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), "message_id")


_GOALS = "g AS (SELECT o_orderkey AS goal, o_custkey % 2 AS u, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'achieved' ELSE 'abandoned' END AS st FROM orders)"
_NEW = f"""{_GOALS}, r AS (SELECT p_partkey AS k, p_partkey % 2 AS u, p_name, CASE p_partkey % 5 WHEN 1 THEN [p_partkey, p_partkey] WHEN 2 THEN [p_partkey + 1, p_partkey + 2] WHEN 3 THEN [p_partkey] ELSE [] END AS sec FROM part),
  c AS (SELECT r.*, g.st, (SELECT count(*) FROM g x WHERE x.u = r.u AND x.st = 'active' AND list_contains(sec, x.goal)) AS hits FROM r LEFT JOIN g ON g.goal = k * 3 AND g.u = r.u),
  e AS (SELECT *, CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN 'invalid arguments' WHEN st IS NULL THEN 'goal not found' WHEN st <> 'active' THEN 'goal is ' || st
    WHEN hits < len(sec) THEN 'secondary goal not found or not active' END AS error FROM c)"""
_UND = """li AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_returnflag) AS l_returnflag, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2), un AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey % 2 AS u, l_orderkey AS goal, CASE WHEN l_linenumber = 3 THEN 't3' END AS task, CASE WHEN l_returnflag = 'R' THEN 'sleeping' ELSE 'active' END AS st,
  CASE WHEN l_partkey % 7 <> 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS day, l_shipdate AS started FROM li)"""
_CHANGED = f"""{_GOALS}, {_UND}, q AS (SELECT o_orderkey AS k, o_custkey % 2 AS u, again FROM orders, (VALUES (0), (1)) t(again)),
  ch AS (SELECT q.*, k * 2 + again AS request_id, un.id IS NOT NULL AS there, CASE WHEN k % 16 = 5 THEN 'invalid arguments' WHEN k % 4 = 3 THEN 'nothing to change'
    WHEN k % 8 = 2 AND NOT EXISTS (SELECT 1 FROM g WHERE g.goal = k AND g.u = q.u AND g.st = 'active') THEN 'secondary goal not found or not active'
    WHEN un.id IS NULL THEN 'undertaking not found' END AS error FROM q LEFT JOIN un ON un.id = k * 8 + k % 3 + 1 AND un.u = q.u)"""

QUERIES = {
    "checked_undertakings": (checked_undertakings, f"WITH {_NEW} SELECT k AS request_id, error FROM e"),
    "created_undertakings": (
        created_undertakings,
        f"""WITH {_NEW} SELECT k AS undertaking_id, p_name AS name, CASE WHEN k % 3 = 0 THEN 'habit_forming' ELSE 'outcome' END AS kind, 'active' AS status, len(sec)::INT AS n_secondary,
          CASE WHEN k % 2 = 0 THEN '2024-02-29' END AS target_date, '{roles.AS_OF}' AS started_at FROM e WHERE error IS NULL""",
    ),
    "checked_changes": (checked_changes, f"WITH {_CHANGED} SELECT request_id, error FROM ch"),
    "changed_undertakings": (
        changed_undertakings,
        f"""WITH {_CHANGED}, l AS (SELECT k, k * 8 + k % 3 + 1 AS id FROM ch WHERE error IS NULL AND again = 1)
        SELECT un.id AS undertaking_id, 'old purpose' AS purpose, CASE WHEN k % 4 = 0 THEN 'name 1' WHEN k IS NOT NULL THEN 'work' END AS new_name, CASE WHEN k % 8 = 1 THEN 'completed' ELSE st END AS status,
          CASE WHEN coalesce(k % 4, 0) <> 1 THEN task END AS gtasks_parent_id, CASE WHEN k % 8 = 6 THEN 0 ELSE 1 END::INT AS n_secondary,
          CASE WHEN k % 8 = 0 THEN '2024-05-01' WHEN k % 4 = 0 THEN NULL ELSE day END AS target_date, k IS NOT NULL AS touched FROM un LEFT JOIN l USING (id)""",
    ),
    "closed_cycles": (
        closed_cycles,
        f"""WITH {_UND}, c AS (SELECT l_orderkey AS k, l_linenumber AS n, un.u = o_custkey % 2 AS own FROM li JOIN orders ON o_orderkey = l_orderkey LEFT JOIN un ON un.id = l_orderkey * 8 + 1)
        SELECT k * 8 + n AS cycle_id, CASE WHEN n = 1 AND NOT coalesce(own, false) THEN 'active' ELSE 'closed' END AS status, CASE WHEN n = 1 THEN CASE WHEN own AND k % 2 = 0 THEN 'new' ELSE 'old' END END AS streak_summary,
          CASE WHEN n > 1 THEN false WHEN own THEN true END AS just_now FROM c""",
    ),
    "undertakings_with_cycles": (
        undertakings_with_cycles,
        f"""WITH {_UND} SELECT id AS undertaking_id, CASE WHEN id % 8 = 1 THEN id END AS current,
          CASE WHEN id % 8 = 1 THEN coalesce((SELECT string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber DESC) FROM li WHERE l_orderkey = goal AND l_linenumber > 1), '') ELSE '' END AS past FROM un""",
    ),
    "goals_in_detail": (
        goals_in_detail,
        f"""WITH {_GOALS}, {_UND}, n AS (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY started DESC, id) AS r FROM un),
          s AS (SELECT goal, string_agg(id::VARCHAR, ',' ORDER BY r) AS us, string_agg(id::VARCHAR, ',' ORDER BY r) FILTER (r <= 2) AS am FROM n GROUP BY goal)
        SELECT goal AS goal_id, st AS status, coalesce(us, '') AS undertakings, coalesce(am, '') AS amendments FROM g LEFT JOIN s USING (goal)""",
    ),
    "listed_undertakings": (listed_undertakings, f"WITH {_UND} SELECT id AS undertaking_id, goal AS primary_goal_id FROM un WHERE u = 1 AND st = 'sleeping'"),
    "replaced_mentions": (
        replaced_mentions,
        """SELECT l_orderkey AS artifact, count(*) AS n, sum(l_partkey)::BIGINT AS entities FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1
           UNION ALL SELECT o_orderkey, 1, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'""",
    ),
    "posted_suggestions": (
        posted_suggestions,
        """SELECT event_id AS suggestion_id, CASE WHEN event_type = 'error' THEN ts WHEN user_id % 3 <> 0 THEN ts + INTERVAL 1 HOUR END AS posted_at,
             CASE WHEN event_type = 'error' THEN -1 WHEN user_id % 3 <> 0 THEN 1 END::BIGINT AS message_id FROM events""",
    ),
}
