"""Reads of the entity graph and of the typed link table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brainweave.operators import filters, similar_sets


def shared_entities(mentions: DataFrame, artifact, least: int = 2, k: int = 20, min_salience: float = 0.5) -> DataFrame:
    """Artifacts that share ``least`` or more mentions with one artifact: (artifact, shared), best first.

    mentions: artifact, entity, salience. A missing salience passes; repeated mentions count once per pair of rows.
    """
    strong = mentions.filter(filters.at_least_or_null(F.col("salience"), min_salience))
    own = strong.filter(F.col("artifact") == artifact).groupBy("entity").agg(F.count(F.lit(1)).alias("times"))
    return (
        strong.filter(F.col("artifact") != artifact)
        .join(own, "entity")
        .groupBy("artifact")
        .agg(F.sum("times").cast("long").alias("shared"))
        .filter(F.col("shared") >= least)
        .orderBy(F.desc("shared"), "artifact")
        .limit(k)
    )


def shared_entity_pairs(mentions: DataFrame, least: int = 2, min_salience: float = 0.5) -> DataFrame:
    """(artifact, other, shared) for all artifacts, each pair both ways. Mentions are counted per (artifact, entity) before they are joined."""
    strong = mentions.filter(filters.at_least_or_null(F.col("salience"), min_salience))
    counts = strong.filter("artifact IS NOT NULL AND entity IS NOT NULL").groupBy(F.col("artifact").alias("id"), F.col("entity").alias("token"))
    found = similar_sets.overlaps(counts.agg(F.count(F.lit(1)).alias("n")), least)
    ways = F.explode(F.array(F.struct(F.col("a").alias("artifact"), F.col("b").alias("other")), F.struct(F.col("b").alias("artifact"), F.col("a").alias("other"))))
    return found.select(ways.alias("p"), "shared").select("p.artifact", "p.other", "shared")


def artifacts_by_entities(mentions: DataFrame, entities: DataFrame, k: int = 30) -> DataFrame:
    """Artifacts by how many distinct ones of the entities (entity) they mention: (artifact, entity_count, rank)."""
    counts = mentions.join(entities.select("entity").distinct(), "entity", "left_semi").groupBy("artifact").agg(F.count_distinct("entity").cast("long").alias("entity_count"))
    best = counts.orderBy(F.desc("entity_count"), "artifact").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("entity_count"), "artifact")))


def entities_by_name(entities: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Entities whose normalized name or any alias matches the lower-cased query as a LIKE pattern inside; by id."""
    pattern = f"%{query.lower().strip()}%"
    found = F.col("normalized_name").like(pattern) | F.coalesce(
        F.exists("aliases", lambda a: F.lower(a).like(pattern)), F.lit(False)
    )
    return entities.filter(found).orderBy("entity").limit(k)


def resolve_targets(links: DataFrame, targets: DataFrame) -> DataFrame:
    """links with what they point at: targets (target_type, target_id, title, date, scope) of all types in one table,
    so that one join does for any number of types."""
    return links.join(targets, ["target_type", "target_id"], "left")


def links_of_recent(links: DataFrame, entries: DataFrame, targets: DataFrame, since, reader: str, k: int = 25) -> DataFrame:
    """Links of entries since a time, as a reader may see them: missing confidence passes, best first.

    Targets of types without a scope of their own count as personal; those of entities take the entry's.
    """
    own = entries.filter(F.col("created_at") >= since).filter(filters.visible(F.col("scope"), reader))
    own = own.select(F.col("entry_id").alias("source_id"), F.col("scope").alias("entry_scope"), "summary", F.col("created_at").alias("entry_at"))
    scope = F.when(F.col("target_type") == "entity", F.col("entry_scope")).otherwise(F.coalesce("target_scope", F.lit("personal")))
    return (
        resolve_targets(links.filter("source_type = 'entry'").filter(filters.at_least_or_null(F.col("confidence"), 0.5)).join(own, "source_id"), targets)
        .filter(filters.visible(scope, reader))
        .orderBy(F.col("confidence").desc_nulls_last(), F.desc("entry_at"), "source_id", "target_type", "target_id", "link_type")
        .limit(k)
    )


def links_of_entry(links: DataFrame, entry_id, targets: DataFrame, reader: str, min_confidence: float = 0.5) -> DataFrame:
    """Links of one entry, one per target: missing confidence is dropped, the most confident link of a target stays."""
    scope = F.coalesce("target_scope", F.lit("personal"))
    own = links.filter((F.col("source_id") == entry_id) & (F.col("source_type") == "entry") & (F.col("confidence") >= min_confidence))
    return first_per(resolve_targets(own, targets).filter(filters.visible(scope, reader)), ["target_id"], [F.desc("confidence"), F.col("link_type")])


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
