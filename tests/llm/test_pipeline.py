import numpy as np
import public_tokenizers

import __spark_entry__ as contract
import corpus_pipeline
from brainweave.llm import common, packing
from brainweave.llm.queries import queries

from .test_near_join import shingles

SF = "/root/testdata/sf0.001"


def _ids(text):
    return packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))([text or ""])[0]


def test_stages_follow_one_another_and_take_effect(spark):
    docs = common.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialise(stage(spark, docs, SF), f"test-{name}")
        assert after.columns == docs.columns
        before_ids, rows = {r.doc_id for r in docs.collect()}, after.collect()
        assert {r.doc_id for r in rows} <= before_ids and rows
        if name == "ngram_jaccard_join":
            sets = [shingles(r.text) for r in rows]
            assert not any(s and t and 100 * len(s & t) >= 80 * len(s | t) for i, s in enumerate(sets) for t in sets[:i])
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    want = sum(-(-(len(_ids(r.text)) // 4 + 1) // 1024) for r in docs.collect())
    assert len(packed) == want


def test_quality_stage_keeps_what_is_labelled_good(spark):
    docs = common.table(spark, SF, "documents")
    good = {r.doc_id for r in common.table(spark, SF, "labels").filter("quality = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()}
    assert len(good - kept) <= 0.05 * len(good)


def test_run_is_registered_and_gives_pieces(spark):
    assert contract.queries()["pipeline"] is corpus_pipeline.run and set(queries()) <= set(contract.queries())
    rows = corpus_pipeline.run(spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        v.sort()
        assert [o for o, _ in v] == [0, *np.cumsum([n for _, n in v])[:-1]] and sum(n for _, n in v) <= 1024


def test_empty_and_odd_documents_come_through(spark, tmp_path):
    docs = common.table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "src1", 0), (2, None, "en", "src1", None), (3, "x", None, None, 1)], docs.schema)
    for table in ("labels",):
        common.table(spark, SF, table).write.parquet(str(tmp_path / f"{table}.parquet"))
    few = docs.filter("doc_id < 5")
    frame = odd.unionByName(few).unionByName(few).selectExpr("*", "1 AS score", "2 AS length", "3 AS component_id", "4 AS copies", "5 AS domain")
    for now in (frame, frame.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = common.materialise(stage(spark, now, str(tmp_path)), "odd")
            assert now.columns == frame.columns
        corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
