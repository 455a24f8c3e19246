"""Lookups, and the processing stages with deterministic stand-ins for the models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brainweave.functions import vector
from brainweave.operators import knn, lookups, processing
from brainweave.plans import roles
from brainweave.plans.searching import QV, _query_vector
from brainweave.sources.tables import table


def people_by_name(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("person_id"), F.col("p_name").alias("full_name"), F.col("p_type").alias("primary_email"))
    return lookups.find_people(p, "pla", 25).select("person_id", "full_name", "match")


def events_overlapping(spark: SparkSession, sf: str) -> DataFrame:
    days = F.expr("make_dt_interval(cast(o_totalprice / 50000 as int))")
    scope = F.when(F.col("o_orderpriority") == "1-URGENT", "family").otherwise("personal")
    e = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("start_at"), (F.col("o_orderdate") + days).alias("end_at"), scope.alias("scope"))
    return lookups.events_between(e, roles.as_of("1998-06-15 00:00:00"), roles.as_of("1998-06-18 00:00:00"), "personal")


def listed_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.list_tasks(roles.tasks(spark, sf), "needsAction", roles.as_of("1998-01-01 00:00:00"), ["family"]).select("task_id", "due_at", "title")


def mails_by_words(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "documents").select(
        F.col("doc_id").alias("mail_id"), F.col("source").alias("subject"), F.col("lang").alias("snippet"), F.col("text").alias("body_text"), F.col("source").alias("from_address"), F.col("n_chars").alias("sent_at")
    )
    return lookups.search_mails(m, ["licensed", "src1", "fr"], "src1", 500).select("mail_id", "subject", "sent_at", "score")


def artifacts_by_best_chunk(spark: SparkSession, sf: str) -> DataFrame:
    v = roles.vectors(spark, sf).select(F.col("vec_id").alias("chunk"), F.expr("vec_id div 8").alias("artifact"), "embedding")
    sim = vector.similarity(F.col("embedding"), F.array(*map(F.lit, _query_vector(spark, sf))), 6)
    return lookups.search_artifacts(v.select("artifact", "chunk", sim.alias("similarity")))


def _embed(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count(" ")), 1.0, float(t.count("e"))] for t in texts]


def _classify(texts: list[str]) -> list[dict]:
    kind = lambda t: "task" if "er" in t else "note"
    return [
        {"clean_text": t.strip(), "summary": t[:40], "language": "en", "tags": sorted(set(t.lower().split()))[:3], "primary_type": kind(t), "primary_type_confidence": 0.5, "suggested_actions": [{"kind": kind(t), "reason": t[:10], "confidence": 0.5}]}
        for t in texts
    ]


def processed_turns(spark: SparkSession, sf: str) -> DataFrame:
    """conversations' turns as pending entries, classified and embedded by stand-ins for the models."""
    e = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn", F.monotonically_increasing_id()).alias("entry_id"), "conv_id", "turn", F.col("text").alias("full_text"), F.lit("pending").alias("status"))
    done = processing.process_entries(e, _classify, _embed, 4)
    return done.select("conv_id", "turn", "primary_type", "summary", F.col("embedding")[0].cast("int").alias("size"), "status")


def nearest_to_processed(spark: SparkSession, sf: str) -> DataFrame:
    """Processed pages (embedded by a stand-in) and the page nearest to each."""
    p = table(spark, sf, "pages").select("page_id", F.col("html").alias("body"))
    v = processing.embed(p, "body", _embed, 4).select("page_id", "embedding")
    asked = v.select(F.col("page_id").alias("query_id"), F.col("embedding").alias("q"))
    return knn.knn_join(v, "page_id", "embedding", asked, "query_id", "q", 1, exclude_self=True)


QUERIES = {
    "people_by_name": (
        people_by_name,
        """WITH m AS (SELECT p_partkey AS person_id, p_name AS full_name, CASE WHEN lower(p_name) = 'pla' THEN 1 WHEN starts_with(lower(p_name), 'pla') THEN 2
             WHEN contains(lower(p_name), 'pla') THEN 3 WHEN contains(lower(p_type), 'pla') THEN 4 END AS match FROM part)
           SELECT * FROM m WHERE match IS NOT NULL ORDER BY match, full_name, person_id LIMIT 25""",
    ),
    "events_overlapping": (
        events_overlapping,
        """WITH e AS (SELECT o_orderkey AS event_id, o_orderdate AS start_at, o_orderdate + to_days(floor(o_totalprice / 50000)::INT) AS end_at,
             CASE WHEN o_orderpriority = '1-URGENT' THEN 'family' ELSE 'personal' END AS scope FROM orders)
           SELECT * FROM e WHERE start_at < TIMESTAMP '1998-06-18' AND end_at >= TIMESTAMP '1998-06-15'""",
    ),
    "listed_tasks": (
        listed_tasks,
        """SELECT o_orderkey AS task_id, o_orderdate AS due_at, o_orderpriority || ' ' || o_orderstatus AS title FROM orders
           WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT' AND o_orderdate <= TIMESTAMP '1998-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 50""",
    ),
    "mails_by_words": (
        mails_by_words,
        """WITH s AS (SELECT doc_id AS mail_id, source AS subject, n_chars AS sent_at, (SELECT count(*) FROM (VALUES ('licensed'), ('src1'), ('fr')) k(w)
             WHERE contains(lower(source), w) OR contains(lower(lang), w) OR contains(lower(text), w))::INT AS score FROM documents WHERE contains(source, 'src1') AND n_chars >= 500)
           SELECT * FROM s WHERE score > 0 ORDER BY score DESC, sent_at DESC, mail_id LIMIT 20""",
    ),
    "artifacts_by_best_chunk": (
        artifacts_by_best_chunk,
        f"""WITH s AS (SELECT vec_id // 8 AS artifact, vec_id AS chunk, round(list_cosine_similarity(embedding::DOUBLE[], {QV}), 6) + 0.0 AS similarity FROM embeddings),
        p AS (SELECT * FROM s ORDER BY similarity DESC, chunk LIMIT 30)
        SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY artifact ORDER BY similarity DESC, chunk) = 1 ORDER BY similarity DESC, artifact LIMIT 10""",
    ),
    "processed_turns": (
        processed_turns,
        """SELECT conv_id, turn, CASE WHEN contains(text, 'er') THEN 'task' ELSE 'note' END AS primary_type, left(text, 40) AS summary, length(trim(text, ' ' || chr(10) || chr(9)))::INT AS size, 'processed' AS status FROM conversations""",
    ),
    "nearest_to_processed": (
        nearest_to_processed,
        """WITH v AS (SELECT page_id, [length(html), length(html) - length(replace(html, ' ', '')), 1, length(html) - length(replace(html, 'e', ''))]::DOUBLE[] AS e FROM pages),
             s AS (SELECT a.page_id AS query_id, b.page_id, round(list_cosine_similarity(a.e, b.e), 6) + 0.0 AS similarity FROM v a JOIN v b ON a.page_id <> b.page_id)
           SELECT *, 1 AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, page_id) = 1""",
    ),
}
