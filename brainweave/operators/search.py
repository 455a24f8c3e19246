"""Hybrid search: vector, full-text and graph results, fused by reciprocal rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brainweave.operators import fulltext, graph, knn

RRF_K = 60


def reciprocal_ranks(rankings: dict[str, DataFrame], key: str, digits: int = 9) -> DataFrame:
    """(key, score, sources): the sum over rankings (key, rank) of 1 / (60 + rank). The order of rankings doesn't matter."""
    parts = [df.select(key, "rank", F.lit(name).alias("source")) for name, df in rankings.items()]
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy(key)
        .agg(
            F.round(F.sum(1.0 / (F.lit(float(RRF_K)) + F.col("rank"))), digits).alias("score"),
            F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"),
        )
    )


def hybrid_search(chunks: DataFrame, mentions: DataFrame, entities: DataFrame, query: str, query_vector: list[float], k: int = 10, depth: int = 30, where: Column | None = None) -> DataFrame:
    """(artifact, chunk, score, sources), best first.

    chunks: chunk, artifact, body, embedding, and whatever ``where`` filters by. mentions: artifact, entity. entities: the
    query's (entity). Graph results aren't filtered. They enter as candidates without a chunk, and their rank also
    counts for every chunk candidate of the same artifact. Ties: artifact, then chunk, the one without chunk first.
    A k of 0 means 10.
    """
    near = knn.knn(chunks, "chunk", "embedding", query_vector, depth, where).select("artifact", "chunk", "rank")
    text = fulltext.bm25(chunks, "chunk", "body", query, depth, where).select("artifact", "chunk", "rank")
    linked = graph.artifacts_by_entities(mentions, entities, depth).select("artifact", F.lit(None).cast(chunks.schema["chunk"].dataType).alias("chunk"), "rank")
    found = near.select("artifact", "chunk").union(text.select("artifact", "chunk")).distinct()
    by_chunk = found.join(linked.select("artifact", "rank"), "artifact").select("artifact", "chunk", "rank")
    parts = {"vector": near, "bm25": text, "graph": by_chunk.unionByName(linked)}
    key = {n: df.select(F.struct("artifact", "chunk").alias("at"), "rank") for n, df in parts.items()}
    return (
        reciprocal_ranks(key, "at")
        .select("at.artifact", "at.chunk", "score", "sources")
        .orderBy(F.desc("score"), "artifact", F.col("chunk").asc_nulls_first())
        .limit(k or 10)
    )


def one_per_artifact(found: DataFrame, k: int = 5) -> DataFrame:
    """The best candidate of each artifact, for a list of sources."""
    best = graph.first_per(found, ["artifact"], [F.desc("score"), F.col("chunk").asc_nulls_first()])
    return best.orderBy(F.desc("score"), "artifact").limit(k)


def numbered_blocks(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Excerpts of several retrievers (kind, key, body), one under the other, with their numbers."""
    union = reduce(DataFrame.unionByName, parts)
    return union.withColumn("number", F.row_number().over(Window.orderBy(*order)))  # a few rows of each retriever
