"""Calls of models that are paid for once: a stored table of answers by model and content, filled in rounds, with a quarantine.

A table holds, per model, ``answers`` (key, answer) and ``failures`` (key, error, attempts); a key is the SHA-256 of a text. Texts that are asked
about are made distinct, those with an answer are left out, and the rest goes to the model in rounds of at most ``ROUND`` texts. A round is
written when it has ended, before the next begins: whatever fails later, no stored call is made again, and a lost task repeats its own texts of
one round at most. In a task, texts are sent in batches that are bounded by number and by tokens; a batch that fails is sent again with
growing pauses, then text by text, so that one bad text doesn't keep the others from an answer. What fails even so is quarantined and not asked
again unless that is wished.

Answers are kept as JSON and read with the schema that the caller gives. Null texts have none. Rows with equal texts share one call.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Model = Callable[[list[str]], list[Any]]

#: Texts that are asked about before what has been answered is stored.
ROUND = 100_000
STORED = "key string, answer string, error string, round string"


def key_of(text: Column) -> Column:
    return F.sha2(text, 256)


def batches(texts: list[str], size: int, tokens: int) -> Iterator[list[int]]:
    """Numbers of texts, in batches of at most ``size`` texts and about ``tokens`` tokens (four characters each); a longer text goes alone."""
    held: list[int] = []
    used = 0
    for i, text in enumerate(texts):
        cost = -(-len(text) // 4)
        if held and (len(held) >= size or used + cost > tokens):
            yield held
            held, used = [], 0
        held.append(i)
        used += cost
    if held:
        yield held


def answered(model: Model, texts: list[str], retries: int, pause: float) -> list[tuple[Any, str | None]]:
    """(answer, None) or (None, error) for every text."""
    error = ""
    for attempt in range(retries + 1):
        try:
            got = model(texts)
            if len(got) != len(texts):
                raise ValueError(f"the model returned {len(got)} results for {len(texts)} texts")
            return [(g, None) for g in got]
        except Exception as failure:
            error = f"{type(failure).__name__}: {failure}"
            if attempt < retries:
                time.sleep(pause * 2**attempt)
    if len(texts) == 1:
        return [(None, error)]
    return [answered(model, [t], retries, pause)[0] for t in texts]


@dataclass(frozen=True)
class Memo:
    """A stored table of answers, and how models are called."""

    path: str
    size: int = 100
    tokens: int = 8000
    retries: int = 3
    pause: float = 1.0

    def stored(self, spark: SparkSession, name: str) -> DataFrame:
        """(key, answer, error, round) of a model: all that was ever returned."""
        folder = f"{self.path}/{name}"
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.createDataFrame([], STORED)
        return spark.read.schema(STORED).parquet(folder)

    def answers(self, spark: SparkSession, name: str) -> DataFrame:
        found = self.stored(spark, name).filter("error IS NULL")
        return found.groupBy("key").agg(F.max_by("answer", "round").alias("answer"))

    def failures(self, spark: SparkSession, name: str) -> DataFrame:
        """(key, error, attempts) of texts without an answer: the last error and how many rounds tried."""
        every = self.stored(spark, name)
        tried = every.filter("error IS NOT NULL").groupBy("key").agg(F.max_by("error", "round").alias("error"), F.count(F.lit(1)).alias("attempts"))
        return tried.join(every.filter("error IS NULL").select("key"), "key", "left_anti")

    def fill(self, texts: DataFrame, name: str, model: Model, again: bool = False) -> None:
        """Asks the model about the texts (column ``text``) that it hasn't answered yet. again: also about those that failed."""
        spark = texts.sparkSession
        known = self.answers(spark, name).select("key")
        if not again:
            known = known.unionByName(self.failures(spark, name).select("key"))
        open_ = texts.filter("text IS NOT NULL").select(key_of(F.col("text")).alias("key"), "text").dropDuplicates(["key"]).join(known, "key", "left_anti")
        n = open_.count()
        rounds = -(-n // ROUND)
        size, tokens, retries, pause = self.size, self.tokens, self.retries, self.pause

        def run(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in arriving:
                keys, said = batch.column("key").to_pylist(), batch.column("text").to_pylist()
                for part in batches(said, size, tokens):
                    got = answered(model, [said[i] for i in part], retries, pause)
                    told = [None if e else json.dumps(a, ensure_ascii=False, default=list) for a, e in got]
                    yield pa.record_batch([pa.array([keys[i] for i in part]), pa.array(told, pa.string()), pa.array([e for _, e in got], pa.string())], ["key", "answer", "error"])

        for r in range(rounds):
            stamp = f"{time.time_ns():020d}"
            some = open_.filter(F.pmod(F.xxhash64("key"), F.lit(rounds)) == r)  # the open ones of now: what the rounds before stored isn't asked for
            told = some.mapInArrow(run, "key string, answer string, error string").withColumn("round", F.lit(stamp))
            told.write.mode("append").parquet(f"{self.path}/{name}")

    def ask(self, df: DataFrame, column: Column | str, model: Model, schema: str, into: str, name: str, again: bool = False) -> DataFrame:
        """df with what a model says about a text, of the schema's type; null for null texts and for those that failed."""
        spark = df.sparkSession
        text = F.col(column) if isinstance(column, str) else column
        self.fill(df.select(text.alias("text")), name, model, again)
        told = self.answers(spark, name).select(F.col("key").alias("_key"), F.from_json("answer", schema).alias(into))
        return df.withColumn("_key", key_of(text)).join(told, "_key", "left").drop("_key")

    def embed(self, df: DataFrame, column: Column | str, model: Model, dim: int, into: str, name: str, again: bool = False) -> DataFrame:
        """df with vectors of a text; a vector of another size than ``dim`` is a failure of its text."""

        def sized(texts: list[str]) -> list[list[float]]:
            got = [[float(x) for x in v] for v in model(texts)]
            if any(len(v) != dim for v in got):
                raise ValueError(f"a vector of {next(len(v) for v in got if len(v) != dim)} numbers; {dim} were expected")
            return got

        return self.ask(df, column, sized, "array<float>", into, name, again)

    def failed(self, df: DataFrame, column: Column | str, name: str) -> DataFrame:
        """Rows of df whose text is in quarantine, with ``error`` and ``attempts``: what ``mark_errors`` takes."""
        text = F.col(column) if isinstance(column, str) else column
        bad = self.failures(df.sparkSession, name).withColumnRenamed("key", "_key")
        return df.withColumn("_key", key_of(text)).join(bad, "_key").drop("_key")
