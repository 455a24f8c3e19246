"""Full-text search: documents that hold all terms of a query, ranked by Okapi BM25.

Statistics are taken over the whole table in one pass. Only the query's terms are looked up in a document: it is not exploded
into all of its words, so nothing is shuffled but one row of statistics per term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brainweave.functions import stemming, text

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(term, key, tf, size): for a stored index; partition by term when it is written."""
    tokens = docs.select(F.col(key), text.words(F.col(body)).alias("t")).withColumn("size", F.size("t"))
    return tokens.select(key, "size", F.explode("t").alias("term")).groupBy("term", key, "size").agg(F.count(F.lit(1)).alias("tf"))


def score_of(tf: list[Column], df: list[Column], docs: Column, size: Column, mean: Column, digits: int) -> Column:
    """Okapi BM25 of a document that holds terms tf times, each held by df of all documents."""
    score = F.lit(0.0)
    for f, d in zip(tf, df):
        idf = F.log(1 + (docs - d + 0.5) / (d + 0.5))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean))
    return F.round(score, digits)


def bm25(docs: DataFrame, key: str, body: str, query: str, k: int = 30, where: Column | None = None, digits: int = 6, english: bool = False) -> DataFrame:
    """The k best documents that hold all terms, with score and rank; none if the query has no terms.

    Statistics are those of all documents; ``where`` filters what is returned. english: words are compared by their stems, without
    stop words, as English full-text search does.
    """
    terms = stemming.search_terms(query) if english else text.search_terms(query)
    whole = F.coalesce(F.col(body), F.lit(""))
    tokens = docs.withColumn("_t", stemming.lexemes(whole) if english else text.words(whole))
    times = lambda term: F.size(F.filter("_t", lambda x: x == F.lit(term)))
    counts = [times(t).alias(f"_tf{i}") for i, t in enumerate(terms)]
    rows = tokens.select(*[F.col(f"`{c}`") for c in docs.columns], F.size("_t").alias("_n"), *counts)
    if not terms:
        return docs.limit(0).withColumns({"score": F.lit(0.0), "rank": F.lit(0)})
    stats = rows.agg(
        F.count(F.lit(1)).cast("double").alias("_docs"),
        F.avg("_n").alias("_avg"),
        *[F.count_if(F.col(f"_tf{i}") > 0).cast("double").alias(f"_df{i}") for i in range(len(terms))],
    )
    hits = rows.filter(" AND ".join(f"_tf{i} > 0" for i in range(len(terms))))
    if where is not None:
        hits = hits.filter(where)
    each = range(len(terms))
    tf, df = [F.col(f"_tf{i}").cast("double") for i in each], [F.col(f"_df{i}") for i in each]
    best = (
        hits.crossJoin(F.broadcast(stats))  # one row
        .withColumn("score", score_of(tf, df, F.col("_docs"), F.col("_n"), F.col("_avg"), digits))
        .select(*[F.col(f"`{c}`") for c in docs.columns], "score")
        .orderBy(F.desc("score"), key)
        .limit(k)
    )
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))
