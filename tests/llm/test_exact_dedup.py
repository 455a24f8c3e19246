import hashlib
import random

from pyspark.sql import functions as F

from brainweave.llm import exact_dedup

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    out = []
    for d, t in rows:
        n = (t or "").translate(LOWER)
        ids = [x for x in groups[n] if x is not None]
        keep = max(ids) if ids else None
        out.append((d or 0, keep or 0, len(groups[n]), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


def pick(df):
    return sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def rows_of(seed):
    r = random.Random(seed)
    texts = ["Same Text", "same text", "SAME TEXT", "", None, "É", "é", "x" * 200_000, "other"]
    rows = [(i, r.choice(texts)) for i in range(1, 200)] + [(i, "hot") for i in range(1000, 1400)]
    return rows + [(None, "Same text"), (None, "only null"), (5, rows[4][1])]


def test_matches_brute_force(spark):
    rows = rows_of(1)
    assert pick(exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_weak_digests_are_caught_by_comparing_bytes(spark):
    rows = rows_of(2)
    weak = lambda t: (F.length(t) % 3).cast("string")
    assert pick(exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=weak)) == brute(rows)


def test_several_micro_batches_and_files_share_one_state(spark, tmp_path):
    rows = rows_of(3)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    ran = []

    def counted(prints, checkpoint, updates, own=exact_dedup.stream_state):
        out = own(prints, checkpoint, updates)
        ran.append(len({f.split("batch=")[1].split("/")[0] for f in spark.read.parquet(updates).inputFiles()} - {"-1"}))
        return out

    exact_dedup.stream_state, own = counted, exact_dedup.stream_state
    try:
        assert pick(exact_dedup.exact_dedup(docs, batch_bytes=1, heavy=100)) == brute(rows)
    finally:
        exact_dedup.stream_state = own
    assert ran[0] > 1


def test_empty_table_and_clashing_columns(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a", "k", 3), (2, "A", "k", 3)], "doc_id long, text string, digest string, keep_id int")
    assert pick(exact_dedup.exact_dedup(df)) == brute([(1, "a"), (2, "A")])
