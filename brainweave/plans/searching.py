"""Search queries: vectors, full text, graph, and their fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brainweave.functions import vector
from brainweave.operators import cells, fulltext, graph, knn, search, topics
from brainweave.plans import roles
from brainweave.sources import sinks
from brainweave.sources.tables import table


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    """The vector of the item with the smallest id: one row."""
    row = roles.vectors(spark, sf).filter("embedding IS NOT NULL").orderBy("vec_id").first()
    return list(row["embedding"]) if row else [1.0]


def knn_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return knn.knn(roles.vectors(spark, sf), "vec_id", "embedding", _query_vector(spark, sf), 10).select("vec_id", "label", "similarity", "rank")


def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    found = knn.knn(roles.vectors(spark, sf), "vec_id", "embedding", _query_vector(spark, sf), 10, F.col("label").isin(1, 3, 5))
    return found.select("vec_id", "label", "similarity", "rank", F.round(1 - F.col("similarity"), 4).alias("distance"))


def knn_similarity_join(spark: SparkSession, sf: str) -> DataFrame:
    v = roles.vectors(spark, sf)
    asked = v.filter("label = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return knn.knn_join(v.filter("label != 0"), "vec_id", "embedding", asked, "query_id", "q", 3)


def similar_items(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest to the item of smallest id, without itself."""
    v = roles.vectors(spark, sf)
    first = v.select(F.min("vec_id").alias("m"))
    asked = v.join(F.broadcast(first), v["vec_id"] == F.col("m")).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return knn.knn_join(v, "vec_id", "embedding", asked, "query_id", "q", 5, exclude_self=True)


def _cells(spark: SparkSession, sf: str) -> cells.Index:
    """A stored index of the first items, to which the others were added."""
    v = roles.vectors(spark, sf)
    index = cells.build(v.filter("vec_id % 3 != 0"), "vec_id", "embedding", sinks.scratch(spark, "cells"), dim=64)
    return cells.update(index, v.filter("vec_id % 3 = 0"), "vec_id", "embedding")


def stored_knn(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest by the stored index, probing until no cell left can hold a nearer one."""
    found = cells.search(spark, _cells(spark, sf), _query_vector(spark, sf), 10, exact=True)
    return found.select(F.col("key").alias("vec_id"), "similarity", "rank")


def stored_knn_join(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest to every item of label 0 by the stored index, itself included, with all cells probed."""
    asked = roles.vectors(spark, sf).filter("label = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = cells.search_join(_cells(spark, sf), asked, "query_id", "q", 3, probes=cells.CELLS)
    return found.select("query_id", F.col("key").alias("vec_id"), "similarity", "rank")


def _topics(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Items as topics, seen day after day, and the five nearest of each."""
    v = roles.vectors(spark, sf)
    day = F.make_timestamp_ntz(F.lit(2024), F.lit(1), (F.col("vec_id") % 28 + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0))
    rows = v.select(F.col("vec_id").alias("topic"), day.alias("seen_at"), ((F.col("vec_id") % 10) / 10).alias("relevance"), F.col("label").alias("cluster"))
    near = knn.knn_join(v, "vec_id", "embedding", v.select(F.col("vec_id").alias("q"), F.col("embedding").alias("w")), "q", "w", 5, exclude_self=True)
    return rows, near.select(F.col("q").alias("topic"), F.col("vec_id").alias("other"), "similarity")


def topic_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of topics, given clusters (labels)."""
    rows, near = _topics(spark, sf)
    return topics.scores(rows, rows.select("topic", "cluster"), near, roles.as_of())


def topic_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters by label propagation; no SQL, tested against propagation over all links."""
    rows, near = _topics(spark, sf)
    return topics.clusters(rows, topics.mutual(near, 0.3))


def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    return roles.vectors(spark, sf).select(
        "vec_id", F.size(e).alias("dims"), F.round(vector.norm(e), 5).alias("norm"), F.round(vector.cosine_distance(e, F.reverse(e)), 5).alias("to_reversed")
    )


def bm25_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.bm25(table(spark, sf, "documents"), "doc_id", "text", roles.TERMS).select("doc_id", "score", "rank")


def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    where = (F.col("lang") == "en") & F.col("source").isin("src0", "src1", "src2")
    return fulltext.bm25(table(spark, sf, "documents"), "doc_id", "text", roles.TERMS, where=where).select("doc_id", "lang", "source", "score", "rank")


def term_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Postings, summed by term: what a stored index holds."""
    rows = fulltext.postings(table(spark, sf, "documents"), "doc_id", "text")
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").cast("long").alias("occurrences"))


def shared_entities(spark: SparkSession, sf: str) -> DataFrame:
    m = roles.mentions(spark, sf)
    busiest = m.filter("salience >= 0.5").groupBy("artifact").count().orderBy(F.desc("count"), "artifact").first()
    return graph.shared_entities(m, busiest["artifact"] if busiest else -1, least=1)


def shared_entity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return graph.shared_entity_pairs(roles.mentions(spark, sf))


def artifacts_by_entities(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("entity"))
    return graph.artifacts_by_entities(roles.mentions(spark, sf), known)


def entities_by_name(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.lower("p_name").alias("normalized_name"), F.array("p_brand", "p_type").alias("aliases"))
    return graph.entities_by_name(parts, "Brand#1").select("entity", "normalized_name")


def _hybrid(spark: SparkSession, sf: str) -> DataFrame:
    c = roles.chunks(spark, sf)
    mentions = c.select("artifact", F.col("lang").alias("entity"))
    asked = c.filter(F.col("lang").isin("fr", "es")).select(F.col("lang").alias("entity"))
    return search.hybrid_search(c, mentions, asked, roles.TERMS, _query_vector(spark, sf), k=20)


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf)


def hybrid_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The list of sources under an answer: the best hit per artifact, five of them."""
    return search.one_per_artifact(_hybrid(spark, sf))


def artifact_search(spark: SparkSession, sf: str) -> DataFrame:
    """Summary vectors of published, processed artifacts (here labels 0 to 4), as the archive's search shows them."""
    v = roles.vectors(spark, sf).withColumn("kind", F.when(F.col("label") == 0, "episode").otherwise("essay"))
    found = knn.knn(v, "vec_id", "embedding", _query_vector(spark, sf), 10, F.col("label") <= 4)
    return found.select("vec_id", "kind", (F.round("similarity", 4) + 0.0).alias("similarity"))


QV = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1)"
SIM = f"round(list_cosine_similarity(embedding::DOUBLE[], {QV}), 6) + 0.0"


def _knn_sql(columns: str, where: str = "TRUE", k: int = 10) -> str:
    return f"""
WITH s AS (SELECT *, {SIM} AS similarity FROM embeddings WHERE {where}),
t AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, vec_id)::INT AS rank FROM s)
SELECT {columns} FROM t WHERE rank <= {k}"""


def _tokens(where: str = "TRUE") -> str:
    return rf"""
t AS (SELECT *, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS toks FROM documents),
f AS (SELECT *, len(toks)::DOUBLE AS n, len(list_filter(toks, lambda x: x = 'er'))::DOUBLE AS f0, len(list_filter(toks, lambda x: x = 're'))::DOUBLE AS f1 FROM t),
st AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean, count(*) FILTER (f0 > 0)::DOUBLE AS d0, count(*) FILTER (f1 > 0)::DOUBLE AS d1 FROM f),
sc AS (SELECT f.*, round(
  ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (1 - 0.75 + 0.75 * n / mean)) +
  ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (1 - 0.75 + 0.75 * n / mean)), 6) AS score
  FROM f, st WHERE f0 > 0 AND f1 > 0 AND {where}),
bm AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM sc)"""


_HYBRID = rf"""WITH {_tokens()},
kn AS (SELECT doc_id, source, row_number() OVER (ORDER BY {SIM} DESC, doc_id)::INT AS rank
  FROM documents JOIN embeddings ON vec_id = doc_id WHERE embedding IS NOT NULL),
g AS (SELECT source, count(DISTINCT lang) AS n FROM documents WHERE lang IN ('fr', 'es') GROUP BY source),
gr AS (SELECT source, row_number() OVER (ORDER BY n DESC, source)::INT AS rank FROM g),
cand AS (
  SELECT source AS artifact, doc_id AS chunk, 'vector' AS src, rank FROM kn WHERE rank <= 30
  UNION ALL SELECT source, doc_id, 'bm25', rank FROM bm WHERE rank <= 30
  UNION ALL SELECT source, NULL, 'graph', rank FROM gr WHERE rank <= 30),
found AS (SELECT DISTINCT artifact, chunk FROM cand WHERE chunk IS NOT NULL),
every AS (SELECT * FROM cand UNION ALL SELECT artifact, chunk, 'graph', gr.rank FROM found JOIN gr ON gr.source = artifact WHERE gr.rank <= 30),
fused AS (SELECT artifact, chunk, round(sum(1 / (60e0 + rank)), 9) AS score, string_agg(DISTINCT src, ',' ORDER BY src) AS sources FROM every GROUP BY artifact, chunk),
top AS (SELECT * FROM fused ORDER BY score DESC, artifact, chunk NULLS FIRST LIMIT 20)"""

_PAIRS = """WITH s AS (SELECT l_orderkey AS artifact, l_partkey AS entity FROM lineitem WHERE l_quantity / 50 >= 0.5)"""

QUERIES = {
    "knn_top_k": (knn_top_k, _knn_sql("vec_id, label, similarity, rank")),
    "knn_filtered": (knn_filtered, _knn_sql("vec_id, label, similarity, rank, round(1 - similarity, 4) AS distance", "label IN (1, 3, 5)")),
    "knn_similarity_join": (
        knn_similarity_join,
        """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS similarity
             FROM embeddings a, embeddings b WHERE a.label = 0 AND b.label <> 0)
           SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 3""",
    ),
    "stored_knn": (stored_knn, _knn_sql("vec_id, similarity, rank")),
    "stored_knn_join": (
        stored_knn_join,
        """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS similarity
             FROM embeddings a, embeddings b WHERE a.label = 0)
           SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 3""",
    ),
    "similar_items": (
        similar_items,
        """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS similarity
             FROM embeddings a, embeddings b WHERE a.vec_id = (SELECT min(vec_id) FROM embeddings) AND b.vec_id <> a.vec_id)
           SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 5""",
    ),
    "topic_clusters": (topic_clusters, None),
    "topic_scores": (
        topic_scores,
        f"""WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS e, label AS cluster, TIMESTAMP '2024-01-01' + to_days((vec_id % 28)::INT) AS seen, (vec_id % 10) / 10 AS relevance FROM embeddings),
        s AS (SELECT a.vec_id, a.cluster, a.seen, b.vec_id AS other, b.cluster AS oc, b.seen AS os, round(list_cosine_similarity(a.e, b.e), 6) + 0.0 AS sim FROM t a, t b WHERE a.vec_id <> b.vec_id
          QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY sim DESC, b.vec_id) <= 5),
        g AS (SELECT vec_id, max(sim) FILTER (oc <> cluster AND os < seen) AS near, avg((oc = cluster)::INT::DOUBLE) AS share FROM s GROUP BY vec_id),
        f AS (SELECT vec_id AS topic, cluster, round(1 - coalesce(near, 0), 6) AS novelty,
          round(pow(0.5::DOUBLE, greatest((epoch_us(TIMESTAMP '{roles.AS_OF}') - epoch_us(seen)) / 86400e6::DOUBLE, 0) / 7), 6) AS timeliness, round(share, 6) AS support, relevance FROM t JOIN g USING (vec_id))
        SELECT topic, cluster, novelty, timeliness, support, round((novelty + timeliness + support + relevance) / 4, 8) AS score FROM f""",
    ),
    "vector_norms": (
        vector_norms,
        """SELECT vec_id, len(embedding)::INT AS dims, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm,
                  round(1 - list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 5) AS to_reversed FROM embeddings""",
    ),
    "bm25_top_k": (bm25_top_k, f"WITH {_tokens()} SELECT doc_id, score, rank FROM bm WHERE rank <= 30"),
    "bm25_filtered": (bm25_filtered, f"WITH {_tokens("lang = 'en' AND source IN ('src0', 'src1', 'src2')")} SELECT doc_id, lang, source, score, rank FROM bm WHERE rank <= 30"),
    "term_statistics": (
        term_statistics,
        """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)
           SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM w GROUP BY term""",
    ),
    "shared_entities": (
        shared_entities,
        _PAIRS + """, b AS (SELECT artifact FROM s GROUP BY artifact ORDER BY count(*) DESC, artifact LIMIT 1)
           SELECT o.artifact, count(*) AS shared FROM s o JOIN s m USING (entity) WHERE m.artifact = (SELECT artifact FROM b) AND o.artifact <> m.artifact
           GROUP BY o.artifact HAVING count(*) >= 1 ORDER BY shared DESC, o.artifact LIMIT 20""",
    ),
    "shared_entity_pairs": (
        shared_entity_pairs,
        _PAIRS + """ SELECT a.artifact, b.artifact AS other, count(*) AS shared FROM s a JOIN s b USING (entity)
           WHERE a.artifact <> b.artifact GROUP BY a.artifact, b.artifact HAVING count(*) >= 2""",
    ),
    "artifacts_by_entities": (
        artifacts_by_entities,
        """WITH c AS (SELECT l_orderkey AS artifact, count(DISTINCT l_partkey) AS entity_count FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 10 GROUP BY 1)
           SELECT *, row_number() OVER (ORDER BY entity_count DESC, artifact)::INT AS rank FROM c QUALIFY rank <= 30""",
    ),
    "entities_by_name": (
        entities_by_name,
        """SELECT p_partkey AS entity, lower(p_name) AS normalized_name FROM part
           WHERE lower(p_name) LIKE '%brand#1%' OR lower(p_brand) LIKE '%brand#1%' OR lower(p_type) LIKE '%brand#1%' ORDER BY p_partkey LIMIT 10""",
    ),
    "hybrid_search": (hybrid_search, _HYBRID + " SELECT artifact, chunk, score, sources FROM top"),
    "hybrid_sources": (
        hybrid_sources,
        _HYBRID + """, o AS (SELECT *, row_number() OVER (PARTITION BY artifact ORDER BY score DESC, chunk NULLS FIRST) AS n FROM top)
           SELECT artifact, chunk, score, sources FROM o WHERE n = 1 ORDER BY score DESC, artifact LIMIT 5""",
    ),
    "artifact_search": (artifact_search, _knn_sql("vec_id, CASE WHEN label = 0 THEN 'episode' ELSE 'essay' END AS kind, round(similarity, 4) + 0.0 AS similarity", "label <= 4")),
}
