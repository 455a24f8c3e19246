"""A stored inverted index: postings by slot of the document and bucket of the term, searched by partition pruning.

Layout under one folder: ``postings/slot=s/bucket=b`` (term, key, tf, size; sorted by term, so a file's statistics skip what isn't
asked for), ``documents/slot=s`` (key, size), ``totals/slot=s`` (docs, tokens: a row per slot) and ``settings`` (one row).
A search reads the buckets of its terms and the totals. An update of documents rewrites their slots' partitions only, of these the
buckets whose terms the old or the new texts hold.

A key names one document; null keys and rows that repeat a key may not be given. Null texts are empty. An update that is cut off may
leave some partitions new and some old; the same update, run again, puts that right. One update runs at a time.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brainweave.functions import stemming, text
from brainweave.operators import fulltext
from brainweave.sources import sinks

#: Documents of a slot, about; buckets of terms in each.
SLOT, BUCKETS = 100_000, 32


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())])))
def _counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
    for lists in (some for batch in batches for some in stemming.portions(batch)):
        yield pa.array([[{"term": t, "tf": n} for t, n in Counter(words).items()] for words in lists.to_pylist()], kind)


@dataclass(frozen=True)
class Index:
    """A stored index: where it is, and how it was built."""

    path: str
    slots: int
    buckets: int
    english: bool
    kind: str  # type of the keys

    def terms(self, query: str) -> list[str]:
        return stemming.search_terms(query) if self.english else text.search_terms(query)

    def bucket(self, term: str) -> int:
        return zlib.crc32(term.encode()) % self.buckets

    def slot_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.slots)).cast("int")

    def read(self, spark: SparkSession, table: str, slots: list[int] | None = None) -> DataFrame:
        columns = {"postings": "term string, key {}, tf int, size int, slot int, bucket int", "documents": "key {}, size int, slot int", "totals": "docs long, tokens long, slot int"}
        rows = spark.read.schema(columns[table].format(self.kind)).parquet(f"{self.path}/{table}")
        return rows if slots is None else rows.filter(F.col("slot").isin(slots))


def _sized(index: Index, docs: DataFrame, key: str, body: str) -> DataFrame:
    """key, slot, size, counts of every document: a pass without a shuffle."""
    whole = F.coalesce(F.col(body), F.lit(""))
    tokens = stemming.lexemes(whole) if index.english else text.words(whole)
    rows = docs.select(F.col(key).alias("key"), tokens.alias("t"))
    return rows.select("key", index.slot_of(F.col("key")).alias("slot"), F.size("t").alias("size"), _counted("t").alias("counts"))


def _postings(index: Index, sized: DataFrame) -> DataFrame:
    rows = sized.select("key", "slot", "size", F.inline("counts"))
    return rows.select("term", "key", "tf", "size", "slot", (F.crc32(F.col("term").cast("binary")) % index.buckets).cast("int").alias("bucket"))


def _write_postings(rows: DataFrame, path: str) -> None:
    dealt = rows.repartition("slot", "bucket").sortWithinPartitions("slot", "bucket", "term", "key")
    sinks.replace_table(dealt, f"{path}/postings", ["slot", "bucket"])


def _write_documents(index: Index, sizes: DataFrame, old: DataFrame | None = None) -> None:
    """sizes: (key, slot, size) of all documents of the slots that are written; old: the slots' numbers, so that emptied ones are written too."""
    spark = sizes.sparkSession
    kept = sinks.scratch(spark, "sizes")
    sizes.write.parquet(kept)
    sizes = spark.read.schema(sizes.schema).parquet(kept)
    marks = sizes.limit(0) if old is None else old.select(F.lit(None).cast(sizes.schema["key"].dataType).alias("key"), "slot", F.lit(0).alias("size"))
    sinks.replace_table(sizes.select("key", "slot", "size").unionByName(marks).repartition("slot"), f"{index.path}/documents", ["slot"])
    totals = sizes.select("key", "slot", "size").unionByName(marks).groupBy("slot").agg(F.count("key").alias("docs"), F.sum("size").alias("tokens"))
    sinks.replace_table(totals.coalesce(1), f"{index.path}/totals", ["slot"])


def build(docs: DataFrame, key: str, body: str, path: str, english: bool = True, slots: int | None = None, buckets: int = BUCKETS) -> Index:
    """Writes the index of docs to an empty folder; slots: one per SLOT documents unless given."""
    spark = docs.sparkSession
    index = Index(path.rstrip("/"), slots or -(-max(1, docs.count()) // SLOT), buckets, english, docs.schema[key].dataType.simpleString())
    sized = _sized(index, docs, key, body)
    _write_postings(_postings(index, sized), index.path)
    _write_documents(index, sized.drop("counts"))
    settings = [(index.slots, buckets, english, index.kind)]
    spark.createDataFrame(settings, "slots int, buckets int, english boolean, kind string").coalesce(1).write.parquet(f"{index.path}/settings")
    return index


def opened(spark: SparkSession, path: str) -> Index:
    """The index that was built in a folder."""
    s = spark.read.parquet(f"{path.rstrip('/')}/settings").first()
    return Index(path.rstrip("/"), s["slots"], s["buckets"], s["english"], s["kind"])


def update(index: Index, docs: DataFrame, key: str, body: str, removed: DataFrame | None = None) -> None:
    """Puts docs in the place of the documents of their keys, or adds them; takes out those of the keys of ``removed``."""
    spark = docs.sparkSession
    path = sinks.scratch(spark, "changed")
    _sized(index, docs, key, body).write.parquet(path)
    new = spark.read.parquet(path)
    keys = new.select("key", "slot")
    if removed is not None:
        gone = removed.select(F.col(key).alias("key"))
        keys = keys.unionByName(gone.withColumn("slot", index.slot_of(F.col("key")))).distinct()
    slots = sorted(r["slot"] for r in keys.select("slot").distinct().collect())  # at most index.slots numbers
    if not slots:
        return
    old, rows = index.read(spark, "postings", slots), _postings(index, new)
    touched = old.join(keys, ["key", "slot"], "left_semi").select("slot", "bucket").union(rows.select("slot", "bucket")).distinct()
    kept = old.join(keys, ["key", "slot"], "left_anti").join(touched, ["slot", "bucket"], "left_semi").filter("term IS NOT NULL")
    # a partition that loses its last row is written too: with a row that names no term
    marks = touched.select(F.lit(None).cast("string").alias("term"), F.lit(None).cast(rows.schema["key"].dataType).alias("key"), F.lit(0).alias("tf"), F.lit(0).alias("size"), "slot", "bucket")
    _write_postings(kept.unionByName(rows).unionByName(marks), index.path)
    sizes = index.read(spark, "documents", slots).filter("key IS NOT NULL").join(keys, ["key", "slot"], "left_anti").unionByName(new.drop("counts"))
    _write_documents(index, sizes, keys.select("slot").distinct())


def search(spark: SparkSession, index: Index, query: str, k: int = 30, digits: int = 6, among: DataFrame | None = None) -> DataFrame:
    """(key, score, rank) of the k best documents that hold all terms, scored by the statistics of all documents.

    among: the keys (column ``key``) that may be returned.
    """
    terms = index.terms(query)
    rows = index.read(spark, "postings").filter(F.col("bucket").isin(sorted({index.bucket(t) for t in terms})) & F.col("term").isin(terms))
    times = [F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(terms)]
    counts = [F.count_if(F.col("term") == t).cast("double").alias(f"df{i}") for i, t in enumerate(terms)]
    empty = rows.select("key", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    if not terms:
        return empty
    held = rows.groupBy("key", "size").agg(*times).na.drop()
    if among is not None:
        held = held.join(among.select("key"), "key", "left_semi")
    totals = index.read(spark, "totals").agg(F.sum("docs").cast("double").alias("docs"), (F.sum("tokens") / F.sum("docs")).alias("mean"))
    each = range(len(terms))
    score = fulltext.score_of([F.col(f"tf{i}").cast("double") for i in each], [F.col(f"df{i}") for i in each], F.col("docs"), F.col("size"), F.col("mean"), digits)
    stats = rows.agg(*counts).crossJoin(totals)  # one row each
    best = held.crossJoin(F.broadcast(stats)).select("key", score.alias("score")).orderBy(F.desc("score"), "key").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "key")))
