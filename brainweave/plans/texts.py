"""Text, scalar and predicate queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brainweave.functions import text, vector
from brainweave.operators import chunking, filters, graph
from brainweave.sources import sinks
from brainweave.sources.tables import table


def normalized_pages(spark: SparkSession, sf: str) -> DataFrame:
    clean = text.normalize_markdown(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.md5(clean).alias("digest"), text.estimate_tokens(clean).alias("tokens"), text.word_count(clean).alias("words"))


def document_measures(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", text.estimate_tokens(t).alias("tokens"), text.word_count(t).alias("words"), text.slugify(t).alias("slug"),
        text.truncate(t, 200).alias("short"), F.substring(t, 1, 400).alias("preview"),
    )


def document_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.keywords(F.col("text")), " ").alias("keywords"))


def document_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.excerpt(F.col("text"), 120).alias("excerpt"))


def chunked_documents(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: the chunker is tested against goldens and properties."""
    return chunking.chunk_documents(table(spark, sf, "documents"), "doc_id", "text")


def chunked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with their headings turned into markdown, in chunks with heading paths."""
    marked = F.regexp_replace(F.regexp_replace("html", "(?i)<h1[^>]*>", "\n\n# "), "(?i)</(h1|p|div|li)>", "\n\n")
    pages = table(spark, sf, "pages").select("page_id", text.normalize_markdown(marked).alias("body"))
    return chunking.chunk_documents(pages, "page_id", "body")


def conversation_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The turns of each conversation as one text, in order."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("t"), F.count(F.lit(1)).alias("turns"))
    return rows.select("conv_id", "turns", F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n")).alias("digest"))


def first_user_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The first turn of each role in each conversation."""
    own = table(spark, sf, "conversations").filter(F.col("role").isin("user", "assistant"))
    return graph.first_per(own, ["conv_id", "role"], [F.col("turn"), F.col("text")]).select("conv_id", "role", "turn", F.length("text").alias("n_chars"))


def keyword_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by how many of three words stand in name, type or brand; the best 15."""
    columns, words = [F.col("p_name"), F.col("p_type"), F.col("p_brand")], ["green", "brass", "#1"]
    rows = table(spark, sf, "part").filter(filters.contains_any(columns, words))
    return rows.select("p_partkey", "p_name", filters.keyword_score(columns, words).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(15)


def tag_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Tags (language and source) under any-of, all-of and exclusion, over all documents."""
    tags = F.array("lang", "source")
    return table(spark, sf, "documents").select(
        "doc_id", filters.any_tag(tags, ["en", "src3"]).alias("any_of"), filters.all_tags(tags, ["en", "src3"]).alias("all_of"),
        F.array_contains(tags, "fr").alias("has_fr"), filters.between(F.col("n_chars"), 500, 2000).alias("middling"),
    )


def name_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of distinct part names that share a word, by their tokens' Jaccard similarity."""
    names = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct().withColumn("t", text.name_tokens(F.col("name")))
    words = names.select("name", F.explode("t").alias("w"))
    near = words.join(words.select(F.col("name").alias("other"), "w"), "w").filter("name < other").select("name", "other").distinct()
    sets = names.join(near, "name").join(names.select(F.col("name").alias("other"), F.col("t").alias("u")), "other")
    return sets.select("name", "other", F.round(text.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"))


def event_properties(spark: SparkSession, sf: str) -> DataFrame:
    """JSON properties of events, read with a declared schema."""
    k = F.from_json("props", "k double")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.round(F.sum(k), 3).alias("total"), F.max(k).alias("most"))


def vector_literals(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors to literals and back: sizes and whether nothing changed."""
    parsed = vector.parse_literal(vector.to_literal(F.col("embedding")))
    same = F.forall(F.zip_with(parsed, "embedding", lambda a, b: a.cast("float") == b), lambda x: x)
    return table(spark, sf, "embeddings").select("vec_id", F.size(parsed).alias("n"), same.alias("same"))


def escaped_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(text.escape_xml(F.col("html"))).alias("digest"))


def message_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Long documents in parts of 3,900 characters at most."""
    return sinks.message_parts(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "part", F.length("body").alias("n_chars"))


def json_answer(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(5).select("p_partkey", "p_name")
    return sinks.json_answer(hits.withColumn("n", F.row_number().over(Window.orderBy("p_partkey"))), [F.col("p_partkey")])


_NORMAL = r"""array_to_string(list_transform(string_split(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)),
  lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), chr(10))"""

QUERIES = {
    "normalized_pages": (
        normalized_pages,
        rf"""WITH n AS (SELECT page_id, trim({_NORMAL}, chr(10) || ' ') AS c FROM pages)
            SELECT page_id, md5(c) AS digest, ceil(length(c) / 4.0)::INT AS tokens, len(regexp_extract_all(c, '\S+'))::INT AS words FROM n""",
    ),
    "document_measures": (
        document_measures,
        r"""SELECT doc_id, ceil(length(text) / 4.0)::INT AS tokens, len(regexp_extract_all(text, '\S+'))::INT AS words,
              left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 120) AS slug,
              CASE WHEN length(text) > 200 THEN left(text, 199) || '…' ELSE text END AS short, left(text, 400) AS preview FROM documents""",
    ),
    "document_keywords": (
        document_keywords,
        r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]{4,}')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]{4,}'), 1) AS i FROM documents),
            f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY doc_id, w),
            r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
            SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (n <= 6), '') AS keywords FROM documents LEFT JOIN r USING (doc_id) GROUP BY doc_id""",
    ),
    "document_excerpts": (
        document_excerpts,
        r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 20 AND NOT starts_with(x, '#'))[1] AS l FROM documents)
            SELECT doc_id, CASE WHEN length(l) <= 120 THEN l ELSE regexp_replace(left(l, 120), '\s+\S*$', '') || '…' END AS excerpt FROM l""",
    ),
    "chunked_documents": (chunked_documents, None),
    "chunked_pages": (chunked_pages, None),
    "conversation_texts": (
        conversation_texts,
        "SELECT conv_id, count(*) AS turns, md5(string_agg(text, chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id",
    ),
    "first_user_turns": (
        first_user_turns,
        """SELECT conv_id, role, turn, length(text)::INT AS n_chars FROM conversations WHERE role IN ('user', 'assistant')
           QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) = 1""",
    ),
    "keyword_scores": (
        keyword_scores,
        """WITH s AS (SELECT p_partkey, p_name, (SELECT count(*) FROM (VALUES ('green'), ('brass'), ('#1')) k(w)
             WHERE contains(lower(p_name), w) OR contains(lower(p_type), w) OR contains(lower(p_brand), w))::INT AS score FROM part)
           SELECT * FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 15""",
    ),
    "tag_predicates": (
        tag_predicates,
        """SELECT doc_id, list_has_any([lang, source], ['en', 'src3']) AS any_of, list_has_all([lang, source], ['en', 'src3']) AS all_of,
                  list_contains([lang, source], 'fr') AS has_fr, n_chars BETWEEN 500 AND 2000 AS middling FROM documents""",
    ),
    "name_jaccard": (
        name_jaccard,
        """WITH n AS (SELECT DISTINCT p_name AS name, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS t FROM part)
           SELECT a.name, b.name AS other, round(len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard
           FROM n a JOIN n b ON a.name < b.name AND list_has_any(a.t, b.t)""",
    ),
    "event_properties": (
        event_properties,
        """SELECT event_type, count(json_extract(props, '$.k')) AS n, round(sum(json_extract(props, '$.k')::DOUBLE), 3) AS total, max(json_extract(props, '$.k')::DOUBLE) AS most
           FROM events GROUP BY event_type""",
    ),
    "vector_literals": (vector_literals, "SELECT vec_id, len(embedding)::INT AS n, TRUE AS same FROM embeddings"),
    "escaped_texts": (
        escaped_texts,
        "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS digest FROM pages",
    ),
    "message_parts": (
        message_parts,
        """WITH RECURSIVE r AS (
             SELECT doc_id, -1 AS part, text AS rest, 0::BIGINT AS n FROM documents WHERE length(text) > 3900
             UNION ALL
             SELECT doc_id, part + 1, substr(s, n + 1), n FROM (
               SELECT doc_id, part, s, CASE WHEN length(s) <= 3900 THEN length(s) WHEN brk BETWEEN 1951 AND 3901 THEN brk - 1 ELSE 3900 END AS n FROM (
                 SELECT *, 3902 - coalesce(nullif(instr(reverse(substr(s, 1, 3901)), chr(10)), 0), 9999) AS brk FROM (
                   SELECT doc_id, part, CASE WHEN length(rest) > 1 AND rest[1] = chr(10) THEN substr(rest, 2) ELSE rest END AS s FROM r WHERE rest <> ''))))
           SELECT doc_id, part::INT AS part, n::INT AS n_chars FROM r WHERE part >= 0
           UNION ALL SELECT doc_id, 0, length(text)::INT FROM documents WHERE length(text) <= 3900""",
    ),
    "json_answer": (
        json_answer,
        """WITH h AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) AS n FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5))
           SELECT '{"count":' || count(*) || ',"hits":[' || string_agg('{"p_partkey":' || p_partkey || ',"p_name":' || to_json(p_name) || ',"n":' || n || '}', ',' ORDER BY p_partkey) || ']}' AS body FROM h""",
    ),
}
