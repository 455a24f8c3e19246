"""The sync round: external feeds into mirror tables, feed by feed, safe to run again.

A mirror is a folder of versions, ``<mirror>/version=<batch>``; a round of number b reads the newest version before b and writes b, so that a round
or micro-batch that is run again gives the same tables. Feeds go in order, parents before children; a feed that fails keeps the
mirror it had and is reported, and the others go on, as in the archive's round.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brainweave.operators import upsert
from brainweave.sources import paged


@dataclass(frozen=True)
class Mirror:
    """How a feed becomes a table: schema of its payload, rows of the table, their key, what an upsert replaces, what comes after it."""

    feed: str
    schema: str
    rows: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...] = ("external_id",)
    fixed: tuple[str, ...] = ()  # columns that stay as they first were
    finish: Callable[[DataFrame], DataFrame] | None = None
    removes: bool = False  # whether a row that a full listing lacks is removed; a row that is marked as deleted always is


def last_of_each(raw: DataFrame) -> DataFrame:
    """Of the rows of a feed with one id the last to change: an aggregation, whatever pages and units repeat."""
    best = raw.groupBy("id").agg(F.max_by(F.struct("unit", "updated", "deleted", "payload"), F.struct("updated", "deleted", "unit", "payload")).alias("r"))
    return best.select("id", "r.*")


def newest(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """The last version of a mirror before a number; None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return None
    done = [s.getPath() for s in files.listStatus(at) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    numbers = [int(p.getName().split("=")[1]) for p in done if p.getName().startswith("version=")]
    older = [n for n in numbers if n < before]
    return spark.read.parquet(f"{path}/version={max(older)}") if older else None


def apply(spark: SparkSession, mirror: Mirror, raw: DataFrame, path: str, number: int, full: bool) -> None:
    """Writes version ``number`` of a mirror: the version before it with what was fetched. full: raw lists all there is."""
    known = last_of_each(raw.filter("id IS NOT NULL"))
    rows = known.filter("NOT deleted").select(F.from_json("payload", mirror.schema).alias("p")).select("p.*").transform(mirror.rows)
    current = newest(spark, path, number)
    if current is None:
        table = rows
    else:
        replaced = [c for c in current.columns if c not in (*mirror.keys, *mirror.fixed)]
        table = upsert.upsert(current, rows, list(mirror.keys), replaced).select(*current.columns)
        if full and mirror.removes:
            table = table.join(rows.select(*mirror.keys), list(mirror.keys), "left_semi")
    key = mirror.keys[0]  # the one that the feed's id becomes
    gone = known.filter("deleted").select(F.col("id").alias(key))
    table = table.join(gone, key, "left_anti").select(*table.columns)
    if mirror.finish is not None:
        table = mirror.finish(table)
    table.write.mode("overwrite").parquet(f"{path}/version={number}")


def sync_round(spark: SparkSession, mirrors: list[Mirror], transport: str, folder: str, number: int, **options: str) -> dict[str, str | None]:
    """One round over all feeds: {feed: None, or why it failed}."""
    report: dict[str, str | None] = {}
    for mirror in mirrors:
        try:
            raw = paged.read(spark, transport, mirror.feed, **options)
            apply(spark, mirror, raw, f"{folder}/{mirror.feed}", number, full=True)
            report[mirror.feed] = None
        except Exception as failure:  # one feed's failure doesn't end the round; it is in the report
            report[mirror.feed] = next((line for line in str(failure).splitlines() if line.strip()), type(failure).__name__)
    return report


def follow(spark: SparkSession, mirror: Mirror, transport: str, folder: str, checkpoint: str, **options: str) -> None:
    """Takes in all changes of a feed so far, a version per micro-batch."""
    changes = paged.read(spark, transport, mirror.feed, streaming=True, **options)

    def write(batch: DataFrame, number: int) -> None:
        apply(spark, mirror, batch, f"{folder}/{mirror.feed}", number, full=False)

    changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
