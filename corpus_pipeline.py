"""The corpus pipeline: documents in, packed training sequences out.

Each stage gets what the one before has written, and returns documents with the columns it got (the last: the pieces
of the packed sequences). Nulls, empty texts, repeated rows, empty tables and further columns are treated as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brainweave.llm import common, line_dedup, mixing, near_join, packing, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, learned from labels, rejects."""
    return quality.drop_rejected(docs, common.table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated runs of lines but for their first copy; documents of which nothing is left go."""
    return line_dedup.without_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return near_join.one_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by the budgets of domains, languages and sources; some twice."""
    mixed = mixing.take_mixed(mixing.with_domain(docs, "_domain"), ("_domain", "lang", "source"), weights=MIX_WEIGHTS)
    return mixed.select(*[f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 1024."""
    return packing.pack_documents(docs.select("doc_id", "text"), capacity=1024)


MIX_WEIGHTS = {"_domain": mixing.WEIGHTS["domain"], "lang": mixing.WEIGHTS["lang"]}
STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]
#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that come through all stages."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
