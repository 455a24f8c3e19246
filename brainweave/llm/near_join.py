"""Operator 2, n-gram Jaccard join: a grouped prefix join over five-word shingles, at a similarity of 0.8 or more.

Documents whose shingle sets have the same size and the same prefix are one group. Groups are paired through the shingles
of their prefixes and filtered by their sizes, by the places of what they share (which must be early enough for sets of these two
sizes) and by sketches; only what is left is expanded to members, whose full sets are compared. Equal sets are collapsed
before anything else.

Order of shingles: rare ones first, so that what many documents share seldom stands in a prefix. Document frequencies
are counted over all shingles of all documents. Of the counts, the ``table`` largest (a fixed number, so the table
can be broadcast) decide the order; all other shingles are ordered by hash. Any order gives the same links.

Large groups of near copies: a list of documents that share a shingle is first joined only to its pivots (its smallest
member of about that size, and each member's two neighbours), which takes as many pairs as the list has members. What that
links is one component; afterwards only pairs of different components are still looked at, all of them. So no link
between components is lost, and a group of copies costs pairs in proportion to its size. Lists of more than ``hot`` documents
are split for the first pass, and the pivots of their parts joined to the list's.

Result: one row per row of the input, with n_shingles (0 for no words) and component_id, the smallest doc_id reachable
by links, itself included. Null texts have no words. Repeated rows, and different texts under one doc_id, are one node
of that id. Rows with null doc_id take the component of the equal sets that have an id, else null. Extra columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brainweave.llm import common, graph, shingles

#: Shingles whose frequency is broadcast, and the least frequency that counts as frequent.
TABLE, FREQUENT = 1 << 20, 6
#: Words of 64 bits in a set's sketch.
SKETCH = 4
SKETCHED = [f"k{i}" for i in range(SKETCH)]
#: Shingles that a task counts before it hands them on.
FLUSH = 2_000_000
#: A shingle in more documents than this has its list split, so that no task holds it whole.
HOT = 200_000


# ---- document frequencies


def _pack(values: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted values as differences in the smallest type that holds them; counts where they aren't 1."""
    steps = np.diff(values, prepend=np.uint64(0))
    kind = next(k for k in (np.uint16, np.uint32, np.uint64) if int(steps.max()) <= np.iinfo(k).max)
    many = np.flatnonzero(counts > 1).astype(np.uint32)
    head = np.array([np.dtype(kind).itemsize], dtype=np.uint8).tobytes()
    return head + steps.astype(kind).tobytes(), many.tobytes() + counts[many].astype(np.uint32).tobytes()


def _unpack(data: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray]:
    kind = {2: np.uint16, 4: np.uint32, 8: np.uint64}[data[0]]
    values = np.cumsum(np.frombuffer(data, dtype=kind, offset=1), dtype=np.uint64)
    counts = np.ones(len(values), dtype=np.int64)
    many = np.frombuffer(more, dtype=np.uint32)
    counts[many[: len(many) // 2]] = many[len(many) // 2 :]
    return values, counts


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(parts), return_counts=True)


def frequencies(docs: DataFrame, bits: int, bucket_bits: int, least: int) -> DataFrame:
    """(key, df): the top ``bits`` bits of shingles that stand in at least ``least`` documents, and in how many."""
    low = bits - bucket_bits

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0

        def out() -> pa.RecordBatch:
            keys, counts = _counted(parts)
            cuts = np.searchsorted(keys, np.arange(1 << bucket_bits, dtype=np.uint64) << np.uint64(low))
            rows = []
            for b, (i, j) in enumerate(zip(cuts, [*cuts[1:], len(keys)], strict=True)):
                if i < j:
                    rows.append((b, *_pack(keys[i:j] & np.uint64((1 << low) - 1), counts[i:j])))
            bucket, data, more = zip(*rows, strict=True)
            return pa.record_batch(
                [pa.array(bucket, pa.int32()), pa.array(data, pa.binary()), pa.array(more, pa.binary())],
                ["bucket", "data", "more"],
            )

        for batch in batches:
            for s in shingles.shingle_hashes(batch.column(0)):
                if len(s):
                    parts.append(s >> np.uint64(64 - bits))
                    n += len(s)
                    if n >= FLUSH:
                        yield out()
                        parts, n = [], 0
        if n:
            yield out()

    def total(t: pa.Table) -> pa.Table:
        got = [_unpack(d, m) for d, m in zip(t["data"].to_pylist(), t["more"].to_pylist(), strict=True)]
        values, counts = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        sums = np.add.reduceat(counts, at)
        keep = sums >= least
        keys = values[at][keep] + (np.uint64(t["bucket"][0].as_py()) << np.uint64(low))
        del values, counts, order, got
        common.give_back()
        return pa.table({"key": keys.astype(np.int64), "df": sums[keep].astype(np.int64)})

    blobs = docs.select("text").mapInArrow(common.lean(gather), "bucket int, data binary, more binary")
    return blobs.groupBy("bucket").applyInArrow(total, "key long, df long")


def order_table(docs: DataFrame, table: int, least: int, hot: int):
    """A broadcast of (bits, sorted keys, their classes, filter): the ``table`` most frequent shingles' order.

    Then, as rows (tok_key, salts), those of more than ``hot`` documents, and the bits in a key."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(60, max(32, math.ceil(math.log2(size + 1)) + 2))
    bucket_bits = max(5, math.ceil(math.log2(size / (8 << 20) + 1)))
    top = frequencies(docs, bits, bucket_bits, least).orderBy(F.desc("df"), "key").limit(table).toArrow()
    keys = top["key"].to_numpy().astype(np.uint64)
    order = np.argsort(keys)
    classes = np.minimum(63, np.log2(np.maximum(1, top["df"].to_numpy())) * 2).astype(np.uint8)[order]
    seen = np.zeros(1 << 22, dtype=bool)
    seen[(keys >> np.uint64(bits - 22)).astype(np.int64)] = True
    df = top["df"].to_numpy()
    many = [(int(k), -(-int(d) // hot)) for k, d in zip(keys[df > hot], df[df > hot], strict=True)]
    sent = spark.sparkContext.broadcast((bits, keys[order], classes, seen))
    del top, df, seen, keys, order, classes
    common.give_back()
    return sent, many, bits


# ---- sets and prefixes


def needed(n: int, num: int, den: int) -> int:
    """Shingles that a set of n must share with any set similar to it."""
    return -(-n * num // den)


def prefixes(docs: DataFrame, order, num: int, den: int) -> DataFrame:
    """Per row: doc_id, n, two hashes of the set, two of its prefix, the set's sketch, the prefix in its order.

    A sketch has a bit per 1 / 256 of all hashes: whether the set has an odd number of shingles there. Where two sketches
    differ, the sets differ in a shingle at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, keys, classes, seen = order.value
        for batch in batches:
            cols: list[list] = [[] for _ in range(6 + SKETCH)]
            for s in shingles.shingle_hashes(batch.column(1)):
                n = len(s)
                h1 = int(s.sum(dtype=np.uint64))
                h2 = int(shingles.mix(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64))
                prefix = s[: n - needed(n, num, den) + 1] if n else s
                if n:
                    maybe = np.flatnonzero(seen[(s >> np.uint64(42)).astype(np.int64)])
                    if len(maybe) and len(keys):
                        k = s[maybe] >> np.uint64(64 - bits)
                        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                        hit = keys[at] == k
                        if hit.any():
                            cls = np.zeros(n, dtype=np.uint8)
                            cls[maybe[hit]] = classes[at[hit]]
                            prefix = s[np.argsort(cls, kind="stable")[: len(prefix)]]
                p1 = int((prefix * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))
                p2 = int(shingles.mix(prefix).sum(dtype=np.uint64))
                odd = np.bincount((s & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
                sketch = np.packbits(odd.astype(np.uint8)).view(np.uint64)
                for c, v in zip(cols, (n, h1, h2, p1, p2, *sketch, prefix.view(np.int64)), strict=True):
                    c.append(v)
            longs = [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in cols[1:-1]]
            ends = np.cumsum([0, *map(len, cols[-1])])
            flat = np.concatenate(cols[-1]) if cols[-1] else np.zeros(0, np.int64)
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(cols[0], pa.int64()),
                    *longs,
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                ["doc_id", "n", "h1", "h2", "p1", "p2", *SKETCHED, "prefix"],
            )

    schema = ", ".join(f"{c} long" for c in ("doc_id", "n", "h1", "h2", "p1", "p2", *SKETCHED)) + ", prefix array<long>"
    return docs.select("doc_id", "text").mapInArrow(common.lean(run), schema)


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id, h1, and the sorted set as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(shingles.shingle_hashes(batch.column(1)))
            h1 = np.array([int(s.sum(dtype=np.uint64)) for s in got], dtype=np.uint64).view(np.int64)
            yield pa.record_batch(
                [batch.column(0), pa.array(h1), pa.array([s.tobytes() for s in got], pa.binary())],
                ["doc_id", "h1", "shingles"],
            )

    return docs.select("doc_id", "text").mapInArrow(common.lean(run), "doc_id long, h1 long, shingles binary")


def similar(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of (a, b, sa, sb), with full sets, the pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(den * shared >= num * (len(both) - shared))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(common.lean(run), "a long, b long")


def sketches_allow(num: int, den: int):
    """Whether sets of sizes n and n_b may be similar by their sketches; unknown sketches allow everything.

    Sets of similarity num / den differ in (den - num) / (den + num) of their sizes' sum at most.
    """
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in SKETCHED), F.lit(0))
    return F.coalesce(differ * (num + den) <= (den - num) * (F.col("n") + F.col("n_b")), F.lit(True))


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, num: int, den: int, files: int, bound: int = 1_000_000) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar. nodes: (vid, h1).

    Pairs whose sketches differ too much are dropped; the texts of the others' nodes are read again. Up to ``bound`` ids
    are broadcast to find them, else they are shuffled.
    """
    a = nodes.select(F.col("vid").alias("a"), "n", *SKETCHED)
    b = nodes.select(F.col("vid").alias("b"), F.col("n").alias("n_b"), *[F.col(c).alias(f"{c}_b") for c in SKETCHED])
    pairs = pairs.select("a", "b").distinct()
    pairs = pairs.join(a, "a").join(b, (pairs["b"] == b["b"]) & sketches_allow(num, den)).select("a", pairs["b"])
    pairs = common.materialise(pairs, "pairs", files)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("vid")).distinct()
    ids = common.materialise(ids.join(nodes.select("vid", F.col("h1").alias("_h1")), "vid"), "pair-ids", files)
    side = F.broadcast(ids.select("vid")) if ids.count() <= bound else ids.select("vid")
    texts = docs.join(side, F.col("doc_id") == F.col("vid"), "left_semi")
    sets = full_sets(texts).join(ids, (F.col("doc_id") == F.col("vid")) & (F.col("h1") == F.col("_h1")))
    sets = common.materialise(sets.select("vid", "shingles"), "sets", 8 * files)
    if sets.count() > ids.count():  # repeated rows: a set counts once
        sets, every = common.materialise(sets.dropDuplicates(["vid"]), "sets", 8 * files), sets
        common.remove(every)
    both = pairs.join(sets.select(F.col("vid").alias("b"), F.col("shingles").alias("sb")), "b").join(
        sets.select(F.col("vid").alias("a"), F.col("shingles").alias("sa")), "a"
    )
    links = common.materialise(similar(both, num, den), "links", files)
    common.remove(pairs, ids, sets)
    return links


# ---- the join


def near_components(docs: DataFrame, num: int = 80, den: int = 100, table: int = TABLE, least: int = FREQUENT, bound: int = 500_000, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id per row of docs (doc_id, text). num / den: the least similarity.

    bound: so many groups are broadcast to find their prefixes; more are shuffled. hot: the longest list that stays whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    common.small_batches(docs.sparkSession)
    order, many, bits = order_table(docs, table, least, hot)
    rows = common.materialise(prefixes(docs, order, num, den).withColumn("rid", F.monotonically_increasing_id()), "prefixes")
    order.destroy()
    files = common.files_for(docs.sparkSession, rows.count())

    # nodes: distinct sets; groups: nodes of one size and prefix
    key = ["n", "p1", "p2"]
    sets = rows.filter("n > 0").groupBy(*key, "h1", "h2").agg(F.min("doc_id").alias("vid"), F.min_by("rid", "doc_id").alias("rid"), *[F.first(c).alias(c) for c in SKETCHED]).filter("vid IS NOT NULL")
    groups = sets.groupBy(*key).agg(F.min("vid").alias("gid"), F.count(F.lit(1)).alias("members"))
    nodes = common.materialise(sets.join(groups, key), "nodes", files)
    slim = common.materialise(rows.select("doc_id", "n", "h1", "h2"), "rows", files)

    ratio = lambda a, b: den * F.least(a, b) >= num * F.greatest(a, b)  # noqa: E731  the sizes allow a link
    need = lambda n: F.ceil(n * num / den)
    firsts = nodes.filter("vid = gid").select("rid", "gid")
    few = firsts.count() <= bound  # then the prefixes needn't be shuffled to be found
    postings = (
        rows.select("rid", "n", "prefix")
        .join(F.broadcast(firsts) if few else firsts, "rid")
        .select("gid", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "tok"))
        .withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) if num < den else F.col("n")).cast("int"))
    )
    part = F.lit(0)
    if many:  # at most as many as the table has entries
        salts = docs.sparkSession.createDataFrame(many, "tok_key long, salts int")
        at = F.shiftrightunsigned("tok", 64 - bits)
        postings = postings.join(F.broadcast(salts), at == F.col("tok_key"), "left")
        part = F.coalesce(F.pmod(F.xxhash64("gid"), F.col("salts")), F.lit(0)).cast("int")
    postings = postings.withColumn("part", part)
    in_list = Window.partitionBy("tok", "part").orderBy("band", "n", "gid")
    in_band = Window.partitionBy("tok", "part", "band").orderBy("n", "gid")
    me = F.struct("gid", "n")
    shared = (
        postings.withColumn("prev", F.lag(me).over(in_list))
        .withColumn("before", F.lag(me, 2).over(in_list))
        .withColumn("next", F.lead("gid").over(in_list))
        .filter("prev IS NOT NULL OR next IS NOT NULL" + (" OR salts IS NOT NULL" if many else ""))
        .withColumn("pivot", F.first(me).over(in_band))
    )
    kept = ["tok", "gid", "n", "pos", "prev", "before", "pivot"]
    shared = common.materialise(shared.select(*kept, *(["band"] if many else [])), "shared-postings", 2 * files)
    common.remove(rows)

    # 1: members to pivots, where some of the prefixes' shingles say so; members of a group to its first
    others = F.array_distinct(F.array("prev", "before", "pivot"))
    toward = shared.select("gid", "n", F.explode(others).alias("o"))
    if many:  # the pivots of the parts of a list to the list's own
        pivots = shared.filter(F.col("pivot.gid") == F.col("gid"))
        own = pivots.groupBy("tok", "band").agg(F.min(F.struct("n", "gid")).alias("p"))
        toward = toward.union(pivots.join(own, ["tok", "band"]).select("gid", "n", F.struct("p.gid", "p.n")))
    likely = (
        toward.filter(F.col("o.gid").isNotNull() & (F.col("o.gid") != F.col("gid")) & ratio(F.col("n"), F.col("o.n")))
        .groupBy(F.col("o.gid").alias("a"), F.col("gid").alias("b"), F.least("n", "o.n").alias("n"))
        .count()
        .filter(F.col("count") >= 0.02 * (F.col("n") - need(F.col("n")) + 1))
        .select("a", "b")
    )
    inside = nodes.filter("members > 1 AND vid != gid").select(F.col("gid").alias("a"), F.col("vid").alias("b"))
    links = verified(docs, likely.union(inside), nodes, num, den, files)
    found = graph.connected_components(links)

    # 2: all pairs of groups that are not of one component
    state = nodes.join(found, F.col("vid") == F.col("id"), "left").select(
        "vid", "gid", "n", "members", *SKETCHED, F.coalesce("component", "vid").alias("comp")
    )
    state = common.materialise(state, "states", files)
    # a sketch for the groups of one member; others may hold anything
    only = lambda c: F.when(F.count(F.lit(1)) == 1, F.first(c)).alias(c)
    one = state.groupBy("gid").agg(
        F.min("comp").alias("comp"), (F.min("comp") != F.max("comp")).alias("mixed"), *map(only, SKETCHED)
    )
    lists = shared.select("tok", "gid", "n", "pos").join(one, "gid")
    still = lists.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("mixed").alias("mix")).filter("lo != hi OR mix").select("tok")
    lists = common.materialise(lists.join(still, "tok"), "open-lists", files)
    common.remove(shared)
    fields = ("gid", "n", "pos", "comp", "mixed", *SKETCHED)
    other = lists.select(*[F.col(c).alias(f"{c}_b") for c in ("tok", *fields)])
    # sets of sizes n and n_b that link share so many; so the first of them stands this early in both
    both = F.ceil((F.col("n") + F.col("n_b")) * num / (num + den))
    pairs = (
        lists.join(
            other,
            (F.col("tok") == F.col("tok_b"))
            & (F.col("gid") < F.col("gid_b"))
            & ratio(F.col("n"), F.col("n_b"))
            & (F.col("mixed") | F.col("mixed_b") | (F.col("comp") != F.col("comp_b")))
            & (F.col("pos") <= F.col("n") - both)
            & (F.col("pos_b") <= F.col("n_b") - both)
            & sketches_allow(num, den),
        )
        .select("gid", "gid_b")
        .distinct()
    )
    sides = [F.col("vid").alias("a"), F.col("comp").alias("ca"), F.col("n"), *SKETCHED]
    sides_b = [F.col("vid").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("n_b"), *[F.col(c).alias(f"{c}_b") for c in SKETCHED]]
    left, right = state.select("gid", *sides), state.select(F.col("gid").alias("gid_b"), *sides_b)
    apart = (F.col("ca") != F.col("cb")) & sketches_allow(num, den)
    across = pairs.join(left, "gid").join(right, (pairs["gid_b"] == right["gid_b"]) & apart).select("a", "b")
    mixed = state.filter("members > 1").join(one.filter("mixed").select("gid"), "gid", "left_semi")
    within_a, within_b = mixed.select(F.col("gid").alias("g"), *sides), mixed.select(F.col("gid").alias("g_b"), *sides_b)
    within = within_a.join(within_b, (F.col("g") == F.col("g_b")) & (F.col("a") < F.col("b")) & apart).select("a", "b")
    more = verified(docs, across.union(within), nodes, num, den, files)
    common.remove(lists, state)
    stars = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
    final = graph.connected_components(stars.union(more))

    of_set = nodes.join(final, F.col("vid") == F.col("id"), "left").select(
        "n", "h1", "h2", F.coalesce("component", "vid").alias("component_id")
    )
    return (
        slim.join(of_set, ["n", "h1", "h2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id"))
    )


def one_of_each_group(docs: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """docs without near copies: of each component the document with the smallest doc_id stays, once.

    Different texts under one doc_id are documents of their own; of those that are near copies of each other (or have no words at
    all) the one with the smallest text hash stays. Of rows that agree in doc_id and text the one with the smallest row hash stays.
    Rows without doc_id stay: no row can be named to stay for them. Columns are those of docs. Up to ``bound`` ids (8 bytes each)
    are broadcast, so that texts aren't shuffled; more are joined by a shuffle. Only rows whose id repeats are compared.
    """
    d, th = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    side = lambda ids: F.broadcast(ids) if ids.count() <= bound else ids
    twice = docs.filter("doc_id IS NOT NULL").groupBy(d.alias("_twice")).count().filter("count > 1").select("_twice")
    twice = common.materialise(twice, "twice", 1)
    if twice.isEmpty():
        gone = near_components(docs.select("doc_id", "text")).filter("component_id != doc_id").select(F.col("doc_id").alias("_gone")).distinct()
        return docs.join(side(common.materialise(gone, "gone", 1)), d == F.col("_gone"), "left_anti")

    # all but the first text of an id get ids that no row has
    of_twice = docs.join(side(twice), d == F.col("_twice"), "left_semi").select(d.alias("_d"), th.alias("_th")).distinct()
    others = of_twice.join(of_twice.groupBy("_d").agg(F.min("_th").alias("_first")), "_d").filter("_th != _first")
    others = common.materialise(others.select("_d", "_th", F.monotonically_increasing_id().alias("_nth")), "other-texts")
    low, high = docs.agg(F.min(d), F.max(d)).first()
    most = others.agg(F.max("_nth")).first()[0] or 0
    start = high + 1 if high + 1 + most < 1 << 63 else low - 1 - most
    if start < -(1 << 63):
        raise ValueError("doc_id leaves no free numbers at either end of its range")
    others = others.select("_d", "_th", (F.col("_nth") + F.lit(start)).alias("_node"))
    own = docs.join(side(others), (d == F.col("_d")) & (th == F.col("_th")), "left")
    own = own.select(*[docs[f"`{c}`"] for c in docs.columns], F.coalesce("_node", d).alias("_node"))

    nodes = near_components(own.select(F.col("_node").alias("doc_id"), "text")).filter("doc_id IS NOT NULL").distinct()
    no_words, of = (F.col("n_shingles") == 0).alias("_none"), F.coalesce("_d", "doc_id")
    nodes = nodes.join(others, F.col("doc_id") == F.col("_node"), "left").select(
        no_words, F.when(no_words, of).otherwise(F.col("component_id")).alias("_group"), F.col("doc_id").alias("_gone"),
        F.struct(of, F.coalesce("_th", F.lit(-(1 << 63))), F.col("doc_id").alias("node")).alias("_rank"),
    )
    nodes = common.materialise(nodes, "group-nodes", common.files_for(docs.sparkSession, nodes.count(), 1_000_000, 1))
    stay = nodes.groupBy("_none", "_group").agg(F.min("_rank")["node"].alias("_stay"))
    gone = nodes.join(stay, ["_none", "_group"]).filter("_gone != _stay").select("_gone")
    left = own.join(side(common.materialise(gone, "gone", 1)), F.col("_node") == F.col("_gone"), "left_anti")
    by_row = Window.partitionBy("_node").orderBy(F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
    again = left.join(side(twice), d == F.col("_twice"), "left_semi").withColumn("_row", F.row_number().over(by_row)).filter("_row = 1").drop("_row")
    return left.join(side(twice), d == F.col("_twice"), "left_anti").unionByName(again).drop("_node")
