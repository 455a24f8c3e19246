"""Upserts, time-driven states, and the rules of domains and goals, on orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brainweave.functions import text, time
from brainweave.operators import governance, intake, lifecycle, lookups, stats, upsert, validate
from brainweave.plans import roles
from brainweave.sources.tables import table

COLUMNS = ["source_system", "source_external_id", "user_id", "type", "title", "raw_source", "summary", "processing_status", "last_error"]


def _artifacts(spark: SparkSession, sf: str, states: list[str], incoming: bool) -> DataFrame:
    o = table(spark, sf, "orders").filter(F.col("o_orderstatus").isin(*states))
    source = F.when(F.col("o_totalprice") > 150_000, F.lit("changed")).otherwise(F.col("o_orderpriority")) if incoming else F.col("o_orderpriority")
    summary = F.when(F.col("o_orderpriority") == "2-HIGH", "new summary") if incoming else F.concat(F.lit("summary "), "o_orderkey")
    return o.select(
        F.lit("feed").alias("source_system"), F.col("o_orderkey").cast("string").alias("source_external_id"), F.lit("default").alias("user_id"),
        F.lit("new" if incoming else "old").alias("type"), F.concat(F.lit("v2 " if incoming else "v1 "), "o_orderpriority").alias("title"), source.alias("raw_source"),
        summary.alias("summary"), F.lit("pending" if incoming else "processed").alias("processing_status"), F.lit(None if incoming else "old error").cast("string").alias("last_error"),
    )


def artifact_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.upsert_artifacts(_artifacts(spark, sf, ["F", "O"], False), _artifacts(spark, sf, ["O", "P"], True)).select(*COLUMNS, "created")


def mirror_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' mirror: the latest order of each customer replaces status and price, but not the day it was first seen."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    now = upsert.first_per_key(o.filter("o_orderstatus = 'F'"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    new = upsert.last_per_key(o.filter("o_orderstatus != 'F'"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return upsert.upsert(now, new, ["o_custkey"], ["o_orderstatus", "o_totalprice", "o_orderkey"])


def replaced_children(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of open orders are replaced by one line each with their sum."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    open_ = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    new = li.join(open_.repartition(upsert.parts(li), "l_orderkey"), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.lit(0).alias("l_linenumber"), F.sum("l_quantity").alias("l_quantity"))
    return upsert.replace_children(li, new, "l_orderkey")


def resolved_parents(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("long")
    t = roles.tasks(spark, sf).select("task_id", F.col("task_id").cast("string").alias("external_id"), F.col("parent_task_id").cast("string").alias("parent_external_id"), none.alias("parent_task_id"))
    return upsert.resolve_parents(t).select("task_id", "parent_task_id")


def reset_errors(spark: SparkSession, sf: str) -> DataFrame:
    d = roles.drafts(spark, sf).withColumn("processing_status", F.when(F.col("user_id") % 7 == 0, "processing").otherwise(F.col("status")))
    return upsert.reset_errors(d).groupBy("processing_status").agg(F.count(F.lit(1)).alias("n"))


def idle_drafts(spark: SparkSession, sf: str) -> DataFrame:
    found = lifecycle.confirm_idle_drafts(roles.drafts(spark, sf), roles.as_of("2024-01-15 00:00:00"))
    return found.select("entry_id", "status", "updated_at", "window_end")


def settled_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Every draft is answered by its user's events: purchases say done, errors cancel; the first answer counts."""
    d = roles.drafts(spark, sf)
    said = table(spark, sf, "events").filter("event_type IN ('purchase', 'error')").select("user_id", "ts", F.when(F.col("event_type") == "purchase", "done").otherwise("cancel").alias("signal"))
    first = d.groupBy("user_id").agg(F.min("entry_id").alias("entry_id"))
    return lifecycle.settle_drafts(d, said.join(first, "user_id")).select("entry_id", "status", "updated_at")


def latest_drafts(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.latest_draft(roles.drafts(spark, sf)).select("user_id", "entry_id", "updated_at")


def _suggestions(spark: SparkSession, sf: str) -> DataFrame:
    posted = F.when(F.col("value") > 20, F.col("updated_at"))
    state = F.when(F.col("status") == "drafting", "pending").otherwise("added")
    none = F.lit(None).cast("timestamp_ntz")
    return roles.drafts(spark, sf).select(F.col("entry_id").alias("suggestion_id"), "user_id", "created_at", posted.alias("posted_at"), state.alias("status"), none.alias("resolved_at"))


def expired_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.expire_suggestions(_suggestions(spark, sf), roles.as_of()).select("suggestion_id", "status", "resolved_at")


def resolved_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    s = _suggestions(spark, sf)
    first = s.filter("status = 'pending'").groupBy("user_id").agg(F.min("suggestion_id").alias("suggestion_id"))
    answers = table(spark, sf, "events").filter("event_type IN ('purchase', 'view')").select("user_id", "ts", F.when(F.col("event_type") == "purchase", "added").otherwise("skipped").alias("outcome"))
    return lifecycle.resolve_suggestions(s, answers.join(first, "user_id")).select("suggestion_id", "status", "resolved_at")


def next_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.next_to_post(_suggestions(spark, sf)).select("suggestion_id", "created_at")


def queue_head(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.claim(roles.drafts(spark, sf), "entry_id", 5).select("entry_id", "created_at")


def _amendments(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "new").when(F.col("event_type") == "click", "amend").when(F.col("event_type") == "view", "synthesize").otherwise("abandon")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("amendment_id"), "user_id", kind.alias("kind"), F.col("ts").alias("proposed_at"), F.col("ts").alias("committed_at"),
        F.when(F.col("event_type") == "error", "committed").otherwise("proposed").alias("status"),
    )


def pending_amendments(spark: SparkSession, sf: str) -> DataFrame:
    cooled = lifecycle.cooled_down(governance.cooldown(_amendments(spark, sf), hours=72), roles.as_of())
    return cooled.select("amendment_id", "kind", "cooldown_until", "allowed", "seconds_left")


def founding_bypass(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.founding(_amendments(spark, sf)).select("amendment_id", "user_id", "bypass")


def active_goal_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as goals of their customers, per region as domain; open ones are active."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    goals = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("n_regionkey").alias("domain_id"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("achieved").alias("status")
    )
    return lifecycle.over_cap(goals)


def next_cycles(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "customer").select(F.col("c_custkey").alias("undertaking_id"), F.when(F.col("c_mktsegment") == "MACHINERY", "outcome").otherwise("habit_forming").alias("kind"), F.lit("active").alias("status"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("undertaking_id"), "o_orderkey", F.when(F.col("o_orderstatus") == "P", "active").otherwise("closed").alias("status"))
    numbers = o.groupBy("undertaking_id", "status").agg(F.count(F.lit(1)).cast("int").alias("cycle_number"))
    found = lifecycle.open_cycles(u, numbers, F.lit("2024-01-30").cast("date"))
    return found.withColumns({c: F.col(c).cast("string") for c in ("start_date", "end_date")})


def next_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return stats.next_number(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


def checked_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier proposes something about parts: kinds by nation, sources by neighbouring keys."""
    kind = F.element_at(F.array(*map(F.lit, ("new", "amend", "synthesize", "retire"))), (F.col("s_nationkey") % 4 + 1).cast("int"))
    k = F.col("s_suppkey")
    payload = F.when(F.col("s_acctbal") > 0, F.to_json(F.struct(F.col("s_name").alias("label"), F.lit("x").alias("statement")))).otherwise('{"label":""}')
    proposals = table(spark, sf, "supplier").select(
        k.alias("proposal_id"), kind.alias("kind"), F.when(F.col("s_nationkey") % 4 != 0, k * 3).alias("target_id"),
        F.when(F.col("s_nationkey") % 8 == 2, F.array(k, k + 1)).when(F.col("s_nationkey") % 8 == 6, F.array(k, k)).otherwise(F.array().cast("array<bigint>")).alias("source_ids"), payload.alias("payload"),
    )
    targets = table(spark, sf, "part").select(F.col("p_partkey").alias("target_id"), F.when(F.col("p_size") > 5, "active").otherwise("merged").alias("status"), F.col("p_brand").alias("group_id"))
    pending = table(spark, sf, "part").filter("p_size > 45").select(F.col("p_partkey").alias("target_id"))
    return governance.check_proposals(proposals, targets, pending, ["label", "statement"]).select("proposal_id", "kind", "error")


def checked_commits(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as amendments of several states and kinds, checked again at the present."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("new", "amend", "synthesize", "retire", "odd", "new"))), (k % 6 + 1).cast("int"))
    rows = table(spark, sf, "orders").select(
        k.alias("amendment_id"), (F.col("o_custkey") % 50).alias("user_id"), kind.alias("kind"), F.when(k % 4 != 0, k).alias("target_id"),
        F.when(k % 7 == 0, F.array(k)).when(k % 7 > 1, F.array(k, k + 1)).alias("source_ids"), F.col("o_orderdate").alias("cooldown_until"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.to_json(F.struct(F.col("o_orderpriority").alias("label"), F.lit("x").alias("statement")))).otherwise('{"label":""}').alias("payload"),
        F.when(F.col("o_orderstatus") == "F", "committed").when(F.col("o_orderstatus") == "O", "proposed").otherwise("withdrawn").alias("status"),
    )
    rows = rows.withColumn("status", F.when((F.col("status") == "committed") & (F.col("user_id") % 5 == 0), "proposed").otherwise(F.col("status")))
    return governance.check_commits(rows, roles.as_of("1997-01-01 00:00:00"), ["label", "statement"]).select("amendment_id", "kind", "error")


def domains_with_goals(spark: SparkSession, sf: str) -> DataFrame:
    """Regions with their nations as children, the last three by key."""
    r = table(spark, sf, "region")
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey", "n_name")
    found = governance.with_children(r, n, "r_regionkey", ["n_nationkey"], "nations", descending=True, most=3)
    return found.select("r_regionkey", "r_name", F.array_join(F.transform("nations", lambda x: x["n_name"]), ",").alias("nations"))


def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return validate.duplicates(roles.mentions(spark, sf), ["artifact", "entity"])


def broken_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"price": F.col("o_totalprice") >= 1000, "state": F.col("o_orderstatus").isin("F", "O"), "day": validate.date_rule("d"), "text": validate.text_rule("o_orderpriority", 5, 10)}
    found = validate.broken(table(spark, sf, "orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd")), rules)
    return found.select("o_orderkey", F.array_join("errors", ",").alias("errors"))


def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.status_counts(roles.drafts(spark, sf).withColumn("status", F.when(F.col("status") == "drafting", "processing").otherwise(F.col("status"))))


def counts_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return stats.count_by(table(spark, sf, "events"), "event_type")


def slow_entries(spark: SparkSession, sf: str) -> DataFrame:
    return stats.slow(roles.drafts(spark, sf), 60)


def oldest_pending(spark: SparkSession, sf: str) -> DataFrame:
    return stats.oldest_pending(roles.drafts(spark, sf), roles.as_of(), "entry_id")


def newest_processed(spark: SparkSession, sf: str) -> DataFrame:
    return stats.newest_processed(roles.drafts(spark, sf), "entry_id")


def tag_concentration(spark: SparkSession, sf: str) -> DataFrame:
    found = stats.tag_concentration(table(spark, sf, "documents").withColumn("tags", F.array("lang", "source")), "tags", "n_chars")
    return found.select("tag", "n", F.round("share", 6).alias("share"), F.round("mean_weight", 4).alias("mean_weight"))


def due_buckets(spark: SparkSession, sf: str) -> DataFrame:
    label = time.due_label(F.col("due_at"), roles.as_of(roles.ORDERS_AS_OF))
    return roles.tasks(spark, sf).groupBy(label.alias("due")).agg(F.count(F.lit(1)).alias("n"))


def claimed_queue(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.claimed(roles.drafts(spark, sf), "entry_id", roles.as_of(), 5).select("entry_id", "status", "updated_at")


def marked_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's first entry fails with each of their errors; the last message stays."""
    d = roles.drafts(spark, sf).withColumn("last_error", F.lit(None).cast("string"))
    first = d.groupBy("user_id").agg(F.min("entry_id").alias("entry_id"))
    said = table(spark, sf, "events").filter("event_type = 'error'").select("user_id", "ts", F.concat(F.lit("failed "), "event_id").alias("message"))
    return lifecycle.mark_errors(d, said.join(first, "user_id"), "entry_id").select("entry_id", "status", "last_error")


def daily_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = lifecycle.daily_runs(table(spark, sf, "events").select("ts"), [("personal", "06:00", "UTC"), ("family", "06:30", "Asia/Hong_Kong")])
    return found.select("label", "day", "ts")


def linked_picks(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases as picks; their user's views link the first of them to an episode."""
    e = table(spark, sf, "events")
    none = F.lit(None)
    picks = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("pick_id"), "user_id", none.cast("string").alias("episode_url"), none.cast("timestamp_ntz").alias("episode_linked_at"))
    first = picks.groupBy("user_id").agg(F.min("pick_id").alias("pick_id"))
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.concat(F.lit("https://example.org/"), "event_id").alias("episode_url"))
    return intake.link_episodes(picks, views.join(first, "user_id")).select("pick_id", "episode_url", "episode_linked_at")


def looked_up(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by id, half of which there are not."""
    wanted = table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("c_custkey"))
    return lookups.by_ids(table(spark, sf, "customer").select("c_custkey", "c_name"), wanted, "c_custkey").select("c_custkey", "c_name", "found")


def lists_by_name(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    wanted = n.filter("n_regionkey IN (1, 2)").select(F.lower("n_name").alias("name")).union(r.select(F.lower("r_name")))
    return lookups.lists_named(n.select(F.col("n_nationkey").alias("list_id"), F.col("n_name").alias("title")), wanted).select("name", "list_id")


def thresholds(spark: SparkSession, sf: str) -> DataFrame:
    raw = "CASE o_orderkey % 4 WHEN 0 THEN concat('0.', o_orderkey % 100) WHEN 1 THEN 'x' WHEN 2 THEN '' ELSE ' .5 high' END"
    return table(spark, sf, "orders").select("o_orderkey", text.threshold(F.expr(raw)).alias("threshold"))


_DRAFTS = """d AS (SELECT event_id AS entry_id, user_id, ts AS created_at, ts + to_microseconds((round(value) * 1000000)::BIGINT) AS updated_at, ts AS window_end,
  CASE event_type WHEN 'click' THEN 'drafting' WHEN 'view' THEN 'pending' WHEN 'error' THEN 'error' ELSE 'processed' END AS status, value FROM events)"""
_SUG = f"""{_DRAFTS}, s AS (SELECT entry_id AS suggestion_id, user_id, created_at, CASE WHEN value > 20 THEN updated_at END AS posted_at,
  CASE WHEN status = 'drafting' THEN 'pending' ELSE 'added' END AS status FROM d)"""
_NOW = f"TIMESTAMP '{roles.AS_OF}'"

QUERIES = {
    "artifact_upsert": (
        artifact_upsert,
        """WITH c AS (SELECT o_orderkey AS k, o_orderpriority AS p FROM orders WHERE o_orderstatus IN ('F', 'O')),
        i AS (SELECT o_orderkey AS k, o_orderpriority AS p, CASE WHEN o_totalprice > 150000 THEN 'changed' ELSE o_orderpriority END AS raw, CASE WHEN o_orderpriority = '2-HIGH' THEN 'new summary' END AS s
          FROM orders WHERE o_orderstatus IN ('O', 'P'))
        SELECT 'feed' AS source_system, coalesce(c.k, i.k)::VARCHAR AS source_external_id, 'default' AS user_id, CASE WHEN c.k IS NULL THEN 'new' ELSE 'old' END AS type,
          CASE WHEN i.k IS NULL THEN 'v1 ' || c.p ELSE 'v2 ' || i.p END AS title, CASE WHEN i.k IS NULL THEN c.p ELSE i.raw END AS raw_source,
          CASE WHEN i.k IS NULL OR i.raw = c.p THEN 'summary ' || c.k ELSE i.s END AS summary,
          CASE WHEN i.k IS NULL OR i.raw = c.p THEN 'processed' ELSE 'pending' END AS processing_status,
          CASE WHEN i.k IS NULL OR i.raw = c.p THEN 'old error' END AS last_error, c.k IS NULL AS created
        FROM c FULL JOIN i ON c.k = i.k""",
    ),
    "mirror_upsert": (
        mirror_upsert,
        """WITH n AS (SELECT * FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1),
        i AS (SELECT * FROM orders WHERE o_orderstatus <> 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
        SELECT coalesce(n.o_custkey, i.o_custkey) AS o_custkey, coalesce(i.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(i.o_orderstatus, n.o_orderstatus) AS o_orderstatus,
          coalesce(i.o_totalprice, n.o_totalprice) AS o_totalprice, coalesce(n.o_orderdate, i.o_orderdate) AS o_orderdate, n.o_custkey IS NULL AS created
        FROM n FULL JOIN i ON n.o_custkey = i.o_custkey""",
    ),
    "replaced_children": (
        replaced_children,
        """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')
           UNION ALL SELECT l_orderkey, 0, sum(l_quantity) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' GROUP BY l_orderkey""",
    ),
    "resolved_parents": (resolved_parents, "SELECT o_orderkey AS task_id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS parent_task_id FROM orders"),
    "reset_errors": (
        reset_errors,
        f"WITH {_DRAFTS} SELECT CASE WHEN user_id % 7 = 0 OR status = 'error' THEN 'pending' ELSE status END AS processing_status, count(*) AS n FROM d GROUP BY 1",
    ),
    "idle_drafts": (
        idle_drafts,
        f"""WITH {_DRAFTS}, x AS (SELECT *, status = 'drafting' AND updated_at + INTERVAL 300 SECOND < TIMESTAMP '2024-01-15' AS old FROM d)
        SELECT entry_id, CASE WHEN old THEN 'pending' ELSE status END AS status, CASE WHEN old THEN TIMESTAMP '2024-01-15' ELSE updated_at END AS updated_at,
          CASE WHEN old THEN TIMESTAMP '2024-01-15' - INTERVAL 11 MINUTE ELSE window_end END AS window_end FROM x""",
    ),
    "settled_drafts": (
        settled_drafts,
        f"""WITH {_DRAFTS}, f AS (SELECT user_id, min(entry_id) AS entry_id FROM d GROUP BY 1),
        a AS (SELECT user_id, min(ts) AS ts, arg_min(event_type, (ts, event_type = 'purchase')) AS t FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1)
        SELECT d.entry_id, CASE WHEN status = 'drafting' AND f.entry_id IS NOT NULL AND a.t = 'purchase' THEN 'pending' WHEN status = 'drafting' AND f.entry_id IS NOT NULL AND a.t IS NOT NULL THEN 'cancelled' ELSE status END AS status,
          CASE WHEN status = 'drafting' AND f.entry_id IS NOT NULL AND a.t IS NOT NULL THEN a.ts ELSE updated_at END AS updated_at
        FROM d LEFT JOIN f ON f.entry_id = d.entry_id LEFT JOIN a ON a.user_id = d.user_id""",
    ),
    "latest_drafts": (
        latest_drafts,
        f"WITH {_DRAFTS} SELECT user_id, entry_id, updated_at FROM d WHERE status = 'drafting' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, entry_id) = 1",
    ),
    "expired_suggestions": (
        expired_suggestions,
        f"""WITH {_SUG}, x AS (SELECT *, coalesce(status = 'pending' AND posted_at + INTERVAL 86400 SECOND < {_NOW}, FALSE) AS old FROM s)
        SELECT suggestion_id, CASE WHEN old THEN 'expired' ELSE status END AS status, CASE WHEN old THEN {_NOW} END AS resolved_at FROM x""",
    ),
    "resolved_suggestions": (
        resolved_suggestions,
        f"""WITH {_SUG}, f AS (SELECT user_id, min(suggestion_id) AS suggestion_id FROM s WHERE status = 'pending' GROUP BY 1),
        a AS (SELECT user_id, min(ts) AS ts, arg_min(event_type, (ts, event_type = 'view')) AS t FROM events WHERE event_type IN ('purchase', 'view') GROUP BY 1)
        SELECT s.suggestion_id, CASE WHEN f.suggestion_id IS NULL OR a.t IS NULL THEN status WHEN a.t = 'purchase' THEN 'added' ELSE 'skipped' END AS status,
          CASE WHEN f.suggestion_id IS NOT NULL THEN a.ts END AS resolved_at
        FROM s LEFT JOIN f ON f.suggestion_id = s.suggestion_id LEFT JOIN a ON a.user_id = s.user_id""",
    ),
    "next_suggestions": (next_suggestions, f"WITH {_SUG} SELECT suggestion_id, created_at FROM s WHERE status = 'pending' AND posted_at IS NULL ORDER BY created_at, suggestion_id LIMIT 10"),
    "queue_head": (queue_head, f"WITH {_DRAFTS} SELECT entry_id, created_at FROM d WHERE status = 'pending' ORDER BY created_at, entry_id LIMIT 5"),
    "pending_amendments": (
        pending_amendments,
        f"""WITH a AS (SELECT event_id AS amendment_id, CASE event_type WHEN 'purchase' THEN 'new' WHEN 'click' THEN 'amend' WHEN 'view' THEN 'synthesize' ELSE 'abandon' END AS kind, ts + INTERVAL 72 HOUR AS cooldown_until
          FROM events WHERE event_type <> 'error')
        SELECT amendment_id, kind, cooldown_until, {_NOW} >= cooldown_until AS allowed, greatest(0, round((epoch_us(cooldown_until) - epoch_us({_NOW})) / 1e6)::BIGINT) AS seconds_left FROM a""",
    ),
    "founding_bypass": (
        founding_bypass,
        """SELECT event_id AS amendment_id, user_id, event_type = 'purchase' AND
             count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 5 AS bypass FROM events""",
    ),
    "active_goal_cap": (
        active_goal_cap,
        """SELECT o_custkey AS user_id, n_regionkey AS domain_id, count(*) FILTER (o_orderstatus = 'O') AS active, count(*) FILTER (o_orderstatus = 'O') >= 3 AS "full"
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    ),
    "next_cycles": (
        next_cycles,
        """WITH n AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'active' ELSE 'closed' END AS st, count(*) AS n FROM orders GROUP BY 1, 2),
        p AS (SELECT o_custkey, max(n) AS last, count(*) FILTER (st = 'active') AS act FROM n GROUP BY 1)
        SELECT c_custkey AS undertaking_id, (coalesce(last, 0) + 1)::INT AS cycle_number, '2024-01-30' AS start_date, '2024-02-27' AS end_date, 'active' AS status
        FROM customer LEFT JOIN p ON o_custkey = c_custkey WHERE c_mktsegment <> 'MACHINERY' AND coalesce(act, 0) = 0""",
    ),
    "next_numbers": (next_numbers, "SELECT l_orderkey, max(l_linenumber) + 1 AS next FROM lineitem GROUP BY 1"),
    "checked_proposals": (
        checked_proposals,
        """WITH pr AS (SELECT s_suppkey AS id, ['new', 'amend', 'synthesize', 'retire'][s_nationkey % 4 + 1] AS kind, CASE WHEN s_nationkey % 4 <> 0 THEN s_suppkey * 3 END AS target,
            CASE WHEN s_nationkey % 8 = 2 THEN [s_suppkey, s_suppkey + 1] WHEN s_nationkey % 8 = 6 THEN [s_suppkey, s_suppkey] ELSE [] END AS src, s_acctbal > 0 AS filled FROM supplier),
          x AS (SELECT pr.*, t.p_size AS tsize, (SELECT count(*) FROM part p WHERE p.p_size > 5 AND list_contains(src, p.p_partkey)) AS hits,
            (SELECT count(DISTINCT p_brand) FROM part p WHERE p.p_size > 5 AND list_contains(src, p.p_partkey)) AS groups FROM pr LEFT JOIN part t ON t.p_partkey = target)
        SELECT id AS proposal_id, kind, CASE
          WHEN kind IN ('amend', 'retire') AND target IS NULL THEN 'target missing' WHEN kind IN ('amend', 'retire') AND tsize IS NULL THEN 'target unknown'
          WHEN kind IN ('amend', 'retire') AND tsize <= 5 THEN 'target not active' WHEN kind IN ('amend', 'retire') AND tsize > 45 THEN 'proposal open'
          WHEN kind = 'synthesize' AND len(src) < 2 THEN 'two sources needed' WHEN kind = 'synthesize' AND hits <> len(src) THEN 'source unknown or not active'
          WHEN kind = 'synthesize' AND groups > 1 THEN 'sources in several domains' WHEN kind IN ('new', 'synthesize') AND NOT filled THEN 'payload incomplete' END AS error FROM x""",
    ),
    "checked_commits": (
        checked_commits,
        """WITH a AS (SELECT o_orderkey AS k, o_custkey % 50 AS u, ['new', 'amend', 'synthesize', 'retire', 'odd', 'new'][o_orderkey % 6 + 1] AS kind, o_orderdate AS cool, o_orderpriority <> '5-LOW' AS filled,
            CASE WHEN o_orderstatus = 'O' OR o_orderstatus = 'F' AND o_custkey % 50 % 5 = 0 THEN 'proposed' WHEN o_orderstatus = 'F' THEN 'committed' ELSE 'withdrawn' END AS status FROM orders),
          n AS (SELECT u, count(*) AS n FROM a WHERE kind = 'new' AND status = 'committed' GROUP BY u)
        SELECT k AS amendment_id, kind, CASE WHEN status <> 'proposed' THEN 'is ' || status
          WHEN NOT (kind = 'new' AND coalesce(n, 0) < 5) AND TIMESTAMP '1997-01-01' < cool THEN 'cooldown not over'
          WHEN kind IN ('new', 'synthesize') AND NOT filled THEN 'payload incomplete'
          WHEN kind = 'synthesize' AND k % 7 <= 1 THEN 'two sources needed'
          WHEN kind IN ('amend', 'retire') AND k % 4 = 0 THEN 'target missing'
          WHEN kind = 'odd' THEN 'kind unknown' END AS error FROM a LEFT JOIN n USING (u)""",
    ),
    "domains_with_goals": (
        domains_with_goals,
        """SELECT r_regionkey, r_name, (SELECT coalesce(string_agg(n_name, ',' ORDER BY n_nationkey DESC), '') FROM (SELECT * FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_nationkey DESC LIMIT 3)) AS nations FROM region""",
    ),
    "duplicate_keys": (duplicate_keys, "SELECT l_orderkey AS artifact, l_partkey AS entity, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
    "broken_rules": (
        broken_rules,
        """WITH e AS (SELECT o_orderkey, list_filter([CASE WHEN o_totalprice < 1000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'state' END,
             CASE WHEN length(o_orderpriority) NOT BETWEEN 5 AND 10 THEN 'text' END], lambda x: x IS NOT NULL) AS l FROM orders)
           SELECT o_orderkey, array_to_string(l, ',') AS errors FROM e WHERE len(l) > 0""",
    ),
    "status_counts": (
        status_counts,
        f"""WITH {_DRAFTS} SELECT count(*) AS total, count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'pending') AS pending,
          count(*) FILTER (status = 'drafting') AS processing, count(*) FILTER (status = 'error') AS error FROM d""",
    ),
    "counts_by_type": (counts_by_type, "SELECT event_type, count(*) AS n FROM events GROUP BY 1"),
    "slow_entries": (slow_entries, f"WITH {_DRAFTS} SELECT count(*) FILTER (round((epoch_us(updated_at) - epoch_us(created_at)) / 1e6) > 60) AS slow FROM d"),
    "oldest_pending": (
        oldest_pending,
        f"WITH {_DRAFTS} SELECT entry_id, created_at, round((epoch_us({_NOW}) - epoch_us(created_at)) / 1e6)::BIGINT AS age_seconds FROM d WHERE status = 'pending' ORDER BY created_at, entry_id LIMIT 10",
    ),
    "newest_processed": (
        newest_processed,
        f"WITH {_DRAFTS} SELECT entry_id, updated_at, round((epoch_us(updated_at) - epoch_us(created_at)) / 1e6)::BIGINT AS seconds FROM d WHERE status = 'processed' ORDER BY updated_at DESC, entry_id LIMIT 10",
    ),
    "tag_concentration": (
        tag_concentration,
        """WITH t AS (SELECT unnest([lang, source]) AS tag, n_chars FROM documents)
           SELECT tag, count(*) AS n, round(count(*) / (SELECT count(*) FROM t)::DOUBLE, 6) AS share, round(avg(n_chars), 4) AS mean_weight FROM t GROUP BY tag""",
    ),
    "due_buckets": (
        due_buckets,
        f"""WITH t AS (SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate::DATE END AS d FROM orders)
        SELECT CASE WHEN d IS NULL THEN 'no date' WHEN d < DATE '{roles.ORDERS_AS_OF[:10]}' THEN 'OVERDUE' WHEN d = DATE '{roles.ORDERS_AS_OF[:10]}' THEN 'TODAY' ELSE strftime(d, '%Y-%m-%d') END AS due, count(*) AS n FROM t GROUP BY 1""",
    ),
    "claimed_queue": (
        claimed_queue,
        f"""WITH {_DRAFTS}, h AS (SELECT entry_id AS head FROM d WHERE status = 'pending' ORDER BY created_at, entry_id LIMIT 5)
        SELECT entry_id, CASE WHEN head IS NULL THEN status ELSE 'processing' END AS status, CASE WHEN head IS NULL THEN updated_at ELSE {_NOW} END AS updated_at
        FROM d LEFT JOIN h ON entry_id = head""",
    ),
    "marked_errors": (
        marked_errors,
        f"""WITH {_DRAFTS}, f AS (SELECT user_id, min(entry_id) AS hit FROM d GROUP BY user_id),
        m AS (SELECT hit, 'failed ' || event_id AS message, row_number() OVER (PARTITION BY hit ORDER BY ts DESC, 'failed ' || event_id DESC) AS n FROM events JOIN f USING (user_id) WHERE event_type = 'error')
        SELECT entry_id, CASE WHEN hit IS NULL THEN status ELSE 'error' END AS status, message AS last_error FROM d LEFT JOIN m ON entry_id = hit AND n = 1""",
    ),
    "daily_runs": (
        daily_runs,
        """WITH t AS (SELECT 'personal' AS label, ts, ts AS own FROM events WHERE strftime(ts, '%H:%M') = '06:00'
          UNION ALL SELECT 'family', ts, ts + INTERVAL 8 HOUR FROM events WHERE strftime(ts + INTERVAL 8 HOUR, '%H:%M') = '06:30')
        SELECT label, own::DATE AS day, min(ts) AS ts FROM t GROUP BY 1, 2""",
    ),
    "linked_picks": (
        linked_picks,
        """WITH p AS (SELECT event_id AS pick_id, user_id FROM events WHERE event_type = 'purchase'), f AS (SELECT user_id, min(pick_id) AS hit FROM p GROUP BY user_id),
        v AS (SELECT hit, ts, 'https://example.org/' || event_id AS url, row_number() OVER (PARTITION BY hit ORDER BY ts DESC, 'https://example.org/' || event_id DESC) AS n
          FROM events JOIN f USING (user_id) WHERE event_type = 'view')
        SELECT pick_id, url AS episode_url, ts AS episode_linked_at FROM p LEFT JOIN v ON pick_id = hit AND n = 1""",
    ),
    "looked_up": (looked_up, "SELECT w.k AS c_custkey, c_name, c_name IS NOT NULL AS found FROM (SELECT DISTINCT o_custkey * 2 AS k FROM orders) w LEFT JOIN customer ON c_custkey = w.k"),
    "lists_by_name": (
        lists_by_name,
        """WITH w AS (SELECT lower(n_name) AS name FROM nation WHERE n_regionkey IN (1, 2) UNION ALL SELECT lower(r_name) FROM region)
        SELECT name, min(n_nationkey) AS list_id FROM w LEFT JOIN nation ON lower(n_name) = name GROUP BY name""",
    ),
    "thresholds": (
        thresholds,
        """WITH o AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '0.' || (o_orderkey % 100) WHEN 1 THEN 'x' WHEN 2 THEN '' ELSE ' .5 high' END AS raw FROM orders)
        SELECT o_orderkey, coalesce(try_cast(regexp_extract(raw, '^ *([0-9]*[.][0-9]+)', 1) AS DOUBLE), 0.6::DOUBLE) AS threshold FROM o""",
    ),
}
