"""Writers: JSON answers, the RSS feed, message parts, and tables that are replaced or appended to by batch."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brainweave.functions import text


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share: that of spark.checkpoint.dir, or a temporary one where it is unset and Spark has one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brainweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/brainweave/{name}-{uuid.uuid4().hex}"


def json_answer(hits: DataFrame, order: list[Column]) -> DataFrame:
    """One row: {"count": n, "hits": [...]} of a limited read, in order."""
    numbered = F.sort_array(F.collect_list(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*hits.columns).alias("hit"))))
    rows = F.transform(numbered, lambda x: x["hit"])
    return hits.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("count"), rows.alias("hits"))).alias("body"))


def rss(reviews: DataFrame, title: str, link: str, k: int = 20) -> DataFrame:
    """One row: the feed of the latest reviews (review_date, scope, content_html)."""
    item = F.concat(
        F.lit("<item><title>"), text.escape_xml(F.concat(F.lit(f"{title} "), F.col("review_date").cast("string"))),
        F.lit(f"</title><guid>{link}/"), F.col("review_date").cast("string"), F.lit("</guid><description><![CDATA["),
        F.col("content_html"), F.lit("]]></description></item>"),
    )
    latest = reviews.orderBy(F.desc("review_date"), "scope").limit(k)
    items = F.reverse(F.sort_array(F.collect_list(F.struct("review_date", "scope", item.alias("x")))))
    body = F.array_join(F.transform(items, lambda i: i["x"]), "")
    head = text.escape_xml(F.lit(title))
    return latest.agg(F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>'), head, F.lit(f"</title><link>{link}</link>"), body, F.lit("</channel></rss>")).alias("xml"))


def message_parts(messages: DataFrame, key: str, body: str, size: int = 3900) -> DataFrame:
    """(key, part, body): messages that are too long for one, in parts."""
    return messages.select(key, F.posexplode(text.split_message(F.col(body), size)).alias("part", "body"))


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replaces the partitions that df has rows for, or the whole table if it has no partitions."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_batch(path: str):
    """For foreachBatch: each micro-batch is a partition of its own, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
