"""The roles that the driver's tables play for the archive's operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brainweave.sources.tables import table

#: The present of all time-driven queries, and the terms of the registered searches.
AS_OF, ORDERS_AS_OF = "2024-01-30 00:00:00", "1998-06-15 12:00:00"
TERMS = "er re"


def as_of(value: str = AS_OF) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def captures(spark: SparkSession, sf: str, feedback: bool = False) -> DataFrame:
    """events as messages: a signup is a command; errors are feedback if asked for."""
    fb = F.col("event_type") == "error" if feedback else F.lit(False)
    return table(spark, sf, "events").select(
        "user_id", F.lit("chat").alias("channel"), "ts", F.col("event_id").alias("message_id"),
        (F.col("event_type") == "signup").alias("is_command"), fb.alias("is_feedback"), "event_type",
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """documents as chunks of artifacts (their sources), some with a vector."""
    v = vectors(spark, sf).select(F.col("vec_id").alias("chunk"), "embedding")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk"), F.col("source").alias("artifact"), F.col("text").alias("body"), "lang")
    return d.join(v, "chunk", "left")


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as mentions of entities (parts) in artifacts (orders); salience is quantity / 50."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("artifact"), F.col("l_partkey").alias("entity"), (F.col("l_quantity") / 50).alias("salience")
    )


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """orders as entries: the family's are the urgent ones."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("entry_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("summary"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "family").otherwise("personal").alias("scope"),
        F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "O", "pending").otherwise("error").alias("status"),
        F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("custkey"),
    )


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Typed links of orders to customers, parts and suppliers, with confidence; small quantities have none."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    none = F.lit(None).cast("double")
    row = lambda kind, key, conf, name: [
        F.lit("entry").alias("source_type"), F.lit(kind).alias("target_type"), F.col(key).alias("target_id"), F.lit(name).alias("link_type"), conf.alias("confidence"),
    ]
    conf = F.when(F.col("l_quantity") <= 5, none).otherwise(F.col("l_quantity") / 50)
    own = o.select(F.col("o_orderkey").alias("source_id"), *row("customer", "o_custkey", F.lit(0.9), "bought_by"))
    parts = li.select(F.col("l_orderkey").alias("source_id"), *row("part", "l_partkey", conf, "holds"))
    supplied = li.select(F.col("l_orderkey").alias("source_id"), *row("supplier", "l_suppkey", conf, "from"))
    return own.unionByName(parts).unionByName(supplied)


def targets(spark: SparkSession, sf: str) -> DataFrame:
    """What links point at, in one table; parts have no scope of their own."""
    c, p, s = (table(spark, sf, n) for n in ("customer", "part", "supplier"))
    row = lambda kind, key, title, scope: [F.lit(kind).alias("target_type"), F.col(key).alias("target_id"), F.col(title).alias("target_title"), scope.alias("target_scope")]
    family = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "family").otherwise("personal")
    return (
        c.select(*row("customer", "c_custkey", "c_name", family))
        .unionByName(p.select(*row("part", "p_partkey", "p_name", F.lit(None).cast("string"))))
        .unionByName(s.select(*row("supplier", "s_suppkey", "s_name", F.lit("family"))))
    )


def drafts(spark: SparkSession, sf: str) -> DataFrame:
    """events as entries of several states."""
    state = F.when(F.col("event_type") == "click", "drafting").when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "error", "error").otherwise("processed")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("entry_id"), "user_id", F.col("user_id").cast("string").alias("chat_id"), F.col("ts").alias("created_at"),
        (F.col("ts") + F.expr("make_dt_interval(0, 0, 0, round(value, 0))")).alias("updated_at"),
        F.col("ts").alias("window_end"), state.alias("status"), "value",
    )


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    """orders as tasks: low ones have no due date; a customer's first order is the parent of the others."""
    o = table(spark, sf, "orders")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("parent_task_id"))
    return o.join(first, "o_custkey").select(
        F.col("o_orderkey").alias("task_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("title"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("needsAction").alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("due_at"), F.col("parent_task_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "family").otherwise("personal").alias("scope"),
    )
