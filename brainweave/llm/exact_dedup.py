"""Operator 8, exact dedup: streaming keyed state on disk, without expiry; full bytes are checked on every hit.

Two texts are equal when they are identical after lower-casing A-Z only (null counts as empty). Of equal texts the row
with the largest doc_id stays.

How: each row becomes a fingerprint - digest, doc_id, content locator (the file that holds it) - in a table that a stream then reads. The
stream's state (RocksDB, one entry per digest, never expired) keeps the largest doc_id, its locator and the number of
rows. It is an aggregation, so each task combines its rows before the shuffle and a group of a third of all rows sends one row
per task. Its updates go to a table keyed by micro-batch, so a repeated batch overwrites itself. Rows whose digest has been seen
more than once are hits: their full text, found by locator and id, is compared with that of the row that stays, found the same
way; a group of any size is split over salts for this. That is done once, when the stream has caught up: the row that stays is
known then, and the texts are read once however many micro-batches there were. Digests whose texts turn out to differ are regrouped by the full text.

Defined cases: rows with null doc_id belong to their group, stay only if no row of it has an id, and all of them then;
a doc_id that occurs on several equal rows stays on each of them; an empty table gives an empty result; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brainweave.llm import common

STATE = T.StructType(
    [
        T.StructField("digest", T.StringType()),
        T.StructField("keep_id", T.LongType()),
        T.StructField("locator", T.StringType()),
        T.StructField("group_size", T.LongType()),
    ]
)
#: So many large groups are broadcast; more are shuffled.
BOUND = 1_000_000
#: State on disk. Without preallocation a store of few keys takes what it holds, not some 4 MB for its manifest.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def digest_of(text):
    return F.sha2(text, 256)


def stream_state(prints: DataFrame, checkpoint: str, updates: str) -> DataFrame:
    """Runs the fingerprints in the table at prints' path through keyed state; returns one row per digest.

    prints must be a streaming DataFrame of (digest, doc_id, locator).
    """
    spark = prints.sparkSession
    state = prints.groupBy("digest").agg(
        F.max(F.struct("doc_id", "locator")).alias("best"), F.count(F.lit(1)).alias("group_size")
    )

    def keep(batch: DataFrame, n: int) -> None:
        batch.select("digest", "best.doc_id", "best.locator", "group_size").toDF(*STATE.names).write.mode(
            "overwrite"
        ).parquet(f"{updates}/batch={n}")

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(keep)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # state only grows, so of several updates of a digest the one with the largest count is the last
    return (
        spark.read.schema(STATE)
        .parquet(updates)
        .groupBy("digest")
        .agg(F.max(F.struct("group_size", "keep_id", "locator")).alias("s"))
        .select("digest", "s.group_size", "s.keep_id", "s.locator")
    )


def at_locators(docs: DataFrame, hits: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """Rows of docs (doc_id, text, locator) at the locators and ids of hits: by broadcast up to bound of them, else by a shuffle."""
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("locator").alias("_at")).distinct()
    side = F.broadcast(hits) if hits.count() <= bound else hits
    return docs.join(side, (F.col("locator") == F.col("_at")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def exact_dedup(docs: DataFrame, digest=digest_of, salts: int = 64, batch_bytes: int = 8 << 30, heavy: int = 200_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs.

    digest: the key of the state; a weak one still gives right results (bytes are compared), only more slowly.
    salts: parts that a large group's comparisons are split into. batch_bytes: fingerprints per micro-batch.
    heavy: groups of more rows than this are broadcast to their rows at the end (there are rows / heavy of them at most).
    """
    spark = docs.sparkSession
    path = common.scratch(spark, "fingerprints")
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.input_file_name().alias("locator"))
    normal = lambda df: df.select("doc_id", "locator", common.lower_ascii(F.coalesce("text", F.lit(""))).alias("_t"))
    schema = "digest string, doc_id long, locator string, text_sha256 string"
    normal(raw).select(
        digest(F.col("_t")).alias("digest"),
        "doc_id",
        "locator",
        F.sha2("_t", 256).alias("text_sha256"),
    ).write.parquet(path)
    prints = spark.read.schema(schema).parquet(path)
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(path)
    work = common.scratch(spark, "dedup-state")
    spark.range(0).selectExpr(*[f"CAST(NULL AS {f.dataType.simpleString()}) {f.name}" for f in STATE]).write.parquet(
        f"{work}/updates/batch=-1"
    )
    state = common.materialise(
        stream_state(stream.select("digest", "doc_id", "locator"), f"{work}/checkpoint", f"{work}/updates"), "state"
    )

    # hits: fetch the content of every row of a repeated digest, and compare all bytes with those of the row that stays
    repeated = state.filter("group_size > 1").withColumnRenamed("locator", "keep_at")
    hits = prints.join(repeated.select("digest"), "digest", "left_semi").select("doc_id", "locator")
    texts = normal(at_locators(raw, hits)).withColumn("digest", digest(F.col("_t"))).join(repeated, "digest")
    large = F.col("group_size") > 4 * salts
    members = texts.select(
        "digest",
        "_t",
        F.when(large, F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(0).cast("int").alias("salt"),
    )
    parts = F.when(large, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    kept = (
        texts.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("locator") == F.col("keep_at")))
        .dropDuplicates(["digest"])
        .select("digest", F.col("_t").alias("keep_t"), F.explode(parts).alias("salt"))
    )
    differ = common.materialise(
        members.join(kept, ["digest", "salt"]).filter("_t != keep_t").select("digest").distinct(), "digest-clashes"
    )
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")]
    of = state.drop("locator")
    large = of.filter(F.col("group_size") > heavy)
    if 0 < large.count() <= BOUND:
        rows = prints.join(F.broadcast(large.select("digest")), "digest", "left_anti").join(of, "digest")
        rows = rows.unionByName(prints.join(F.broadcast(large), "digest").select(*rows.columns))
    else:
        rows = prints.join(of, "digest")
    if differ.isEmpty():
        return rows.select(*columns, "text_sha256")
    # several texts under one digest: group these rows by the text itself
    clashed = normal(raw).withColumn("digest", digest(F.col("_t"))).join(differ, "digest", "left_semi")
    groups = clashed.groupBy("_t").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    again = clashed.join(groups, "_t").select(*columns, F.sha2("_t", 256).alias("text_sha256"))
    return rows.join(differ, "digest", "left_anti").select(*columns, "text_sha256").unionByName(again)
