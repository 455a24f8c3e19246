import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brainweave.llm import common, quality

SF = "/root/testdata/sf0.01"


def brute_margin(m, idx, val, bins):
    """All pairs, one by one."""
    feats = [(int(i), float(v)) for i, v in zip(idx, val)] + [(int(b), 1 / np.sqrt(len(bins))) for b in bins]
    out = m.bias + sum(float(m.linear[i]) * x for i, x in feats)
    for a in range(len(feats)):
        for b in range(a):
            out += float(m.factors[feats[a][0]].astype(float) @ m.factors[feats[b][0]].astype(float)) * feats[a][1] * feats[b][1]
    return out


def test_sum_of_squares_identity():
    texts = pa.array(["some words and SOME numbers 12, 13!", "", None, "one", "a | b | c a a a", "é ü 日本"])
    (idx, val, at, stats), = quality.features(texts)
    rng = np.random.default_rng(0)
    m = quality.fit(idx, val, at, stats, np.array([1.0, 0, 1, 0, 0, 1]), epochs=2)
    m.factors = rng.normal(0, 0.3, m.factors.shape).astype(np.float32)
    bins = m.binned(stats)
    got = m.margin(idx, val, at, bins)
    for k in range(6):
        assert abs(got[k] - brute_margin(m, idx[at[k] : at[k + 1]], val[at[k] : at[k + 1]], bins[k])) < 1e-3


def test_held_out_accuracy_and_folds(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    rows = quality.quality_scores(docs.select("doc_id", "text", "n_chars"), labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    own = [r for r in rows if r.held_out and r.quality is not None]
    assert np.mean([r.predicted == r.quality for r in own]) >= 0.95
    assert [r.predicted for r in own if r.quality == 1].count(0) <= 0.02 * len(own)


def test_labels_of_the_held_out_fold_are_not_learned_from(spark):
    docs, labels = common.table(spark, SF, "documents").select("doc_id", "text", "n_chars"), common.table(spark, SF, "labels")
    other = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    pick = lambda l: sorted((r.doc_id, r.score) for r in quality.quality_scores(docs, l).collect())
    assert pick(labels) == pick(other)


def test_nulls_empty_and_long_texts_repeated_rows_and_clashing_columns(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (None, 1), (50, 7), (51, None)], "doc_id long, quality int")
    good, bad = "plain words in a row, as they are. ", "!!! ||| $$$ "
    rows = [(i, (good if i % 2 else bad) * 20, None, "s") for i in range(40)] + [(None, None, 3, "s"), (60, "", 0, "s"), (61, good * 20_000, 1, "s"), (62, good, 1, "s"), (62, good, 1, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score string")
    got = quality.quality_scores(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 62}) == 1
    assert quality.drop_rejected(df, labels).columns == df.columns
    assert quality.quality_scores(df.limit(0), labels).count() == 0
    none = quality.quality_scores(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
