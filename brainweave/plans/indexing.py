"""Queries by stems, from texts and from a stored index, with the English stemmer written out in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brainweave.functions import stemming
from brainweave.operators import fulltext, inverted
from brainweave.sources import sinks
from brainweave.sources.tables import table

#: The registered search: its stems are ``tion`` and ``erin``.
QUERY = "The tioned, erines"


def stemmed_words(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct word of the documents with its stem (null for a stop word) and the number of documents that hold it."""
    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(stemming.words(F.col("text")))).alias("word"))
    counted = rows.groupBy("word").agg(F.count(F.lit(1)).alias("documents"))
    return counted.select("word", F.get(stemming.lexemes(F.col("word")), F.lit(0)).alias("stem"), "documents")


def bm25_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return fulltext.bm25(docs, "doc_id", "text", QUERY, english=True).select("doc_id", "score", "rank")


def bm25_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The search on a stored index that was built from half of the documents and updated with the others."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    early, late = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 != 0 OR doc_id IS NULL").na.drop(subset=["doc_id"])
    index = inverted.build(early, "doc_id", "text", sinks.scratch(spark, "index"), buckets=8)
    inverted.update(index, late, "doc_id", "text")
    return inverted.search(spark, index, QUERY).select(F.col("key").alias("doc_id"), "score", "rank")


def _cases(column: str, ending: str, table_: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{e}' THEN '{to}'" for e, to in table_.items())
    return f"left({column}, length({column}) - length({ending})) || CASE {ending} {whens} END"


def _ends(column: str, endings) -> str:
    """The longest of the endings that a column has, else the empty string."""
    return f"regexp_extract({column}, '({'|'.join(sorted(endings, key=len, reverse=True))})$', 1)"


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


_R1, _R2 = f"^({stemming.BEGINNINGS}|.*?[aeiouy][^aeiouy])", "^.*?[aeiouy][^aeiouy]"
_SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def stems_sql(words: str) -> str:
    """CTEs that end in ``stems`` (word, stem) for a table of distinct lower-case words."""
    special = " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in stemming.SPECIAL.items())
    return rf"""
st0 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\1Y', 'g') AS x FROM {words}),
st1 AS (SELECT *, CASE WHEN regexp_matches(x, '{_R1}') THEN length(regexp_extract(x, '{_R1}')) ELSE length(x) END AS r1 FROM st0),
st2 AS (SELECT *, r1 + CASE WHEN regexp_matches(x[r1 + 1:], '{_R2}') THEN length(regexp_extract(x[r1 + 1:], '{_R2}')) ELSE length(x) - r1 END AS r2 FROM st1),
st3 AS (SELECT *, CASE WHEN x LIKE '%sses' THEN left(x, length(x) - 2)
    WHEN x LIKE '%ied' OR x LIKE '%ies' THEN left(x, length(x) - CASE WHEN length(x) > 4 THEN 2 ELSE 1 END)
    WHEN x LIKE '%s' AND x NOT LIKE '%us' AND x NOT LIKE '%ss' AND regexp_matches(x, '[aeiouy].+s$') THEN left(x, length(x) - 1) ELSE x END AS y FROM st2),
st4 AS (SELECT *, {_ends("y", ("eed", "eedly", "ed", "edly", "ing", "ingly"))} AS e FROM st3),
st5 AS (SELECT *, left(y, length(y) - length(e)) AS b FROM st4),
st6 AS (SELECT *, CASE WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE y END
    WHEN e <> '' AND regexp_matches(b, '[aeiouy]') THEN CASE WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e'
      WHEN regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(b, length(b) - 1)
      WHEN length(b) <= r1 AND regexp_matches(b, '{_SHORT}') THEN b || 'e' ELSE b END
    ELSE y END AS z FROM st5),
st7 AS (SELECT *, CASE WHEN regexp_matches(z, '.[^aeiouy][yY]$') THEN left(z, length(z) - 1) || 'i' ELSE z END AS a FROM st6),
st8 AS (SELECT *, {_ends("a", stemming.STEP_2)} AS e2 FROM st7),
st9 AS (SELECT *, CASE WHEN e2 <> '' AND length(a) - length(e2) >= r1 AND NOT (e2 = 'ogi' AND NOT regexp_matches(a, 'logi$'))
    AND NOT (e2 = 'li' AND NOT regexp_matches(a, '[cdeghkmnrt]li$')) THEN {_cases("a", "e2", stemming.STEP_2)} ELSE a END AS c FROM st8),
st10 AS (SELECT *, {_ends("c", stemming.STEP_3)} AS e3 FROM st9),
st11 AS (SELECT *, CASE WHEN e3 <> '' AND length(c) - length(e3) >= CASE WHEN e3 = 'ative' THEN r2 ELSE r1 END THEN {_cases("c", "e3", stemming.STEP_3)} ELSE c END AS d FROM st10),
st12 AS (SELECT *, {_ends("d", stemming.STEP_4)} AS e4 FROM st11),
st13 AS (SELECT *, CASE WHEN e4 <> '' AND length(d) - length(e4) >= r2 AND (e4 <> 'ion' OR regexp_matches(d, '[st]ion$')) THEN left(d, length(d) - length(e4)) ELSE d END AS f FROM st12),
st14 AS (SELECT *, CASE WHEN f LIKE '%e' AND (length(f) > r2 OR length(f) > r1 AND NOT regexp_matches(left(f, length(f) - 1), '{_SHORT}')) THEN left(f, length(f) - 1)
    WHEN f LIKE '%ll' AND length(f) > r2 THEN left(f, length(f) - 1) ELSE f END AS g FROM st13),
stems AS (SELECT word, CASE WHEN word IN ({_quoted(stemming.STOP_WORDS)}) THEN NULL
    WHEN length(word) <= 2 OR NOT regexp_matches(word, '^\p{{L}}+$') THEN word
    WHEN word IN ({_quoted(stemming.SPECIAL)}) THEN CASE word {special} END
    ELSE replace(CASE WHEN y IN ({_quoted(stemming.FINISHED)}) THEN y ELSE g END, 'Y', 'y') END AS stem FROM st14)"""


_WORDS = r"""all_words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents),
words AS (SELECT word, count(DISTINCT doc_id) AS documents FROM all_words GROUP BY word)"""

_BM25 = rf"""WITH {_WORDS},{stems_sql("words")},
size AS (SELECT doc_id, count(stem)::DOUBLE AS n FROM documents LEFT JOIN all_words USING (doc_id) LEFT JOIN stems USING (word) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) FILTER (stem = 'tion')::DOUBLE AS f0, count(*) FILTER (stem = 'erin')::DOUBLE AS f1
  FROM all_words JOIN stems USING (word) GROUP BY doc_id),
st AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean, count(*) FILTER (f0 > 0)::DOUBLE AS d0, count(*) FILTER (f1 > 0)::DOUBLE AS d1 FROM size LEFT JOIN held USING (doc_id)),
sc AS (SELECT doc_id, round(
  ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (1 - 0.75 + 0.75 * n / mean)) +
  ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (1 - 0.75 + 0.75 * n / mean)), 6) AS score
  FROM size JOIN held USING (doc_id), st WHERE f0 > 0 AND f1 > 0)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM sc QUALIFY rank <= 30"""

QUERIES = {
    "stemmed_words": (stemmed_words, f"WITH {_WORDS},{stems_sql('words')} SELECT word, stem, documents FROM words JOIN stems USING (word)"),
    "bm25_stemmed": (bm25_stemmed, _BM25),
    "bm25_indexed": (bm25_indexed, _BM25),
}
