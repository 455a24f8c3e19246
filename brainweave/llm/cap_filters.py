"""Operator 13, near-duplicate vectors, by spherical-cap filters of structured random product codes.

A filter is a direction; it takes in the vectors of a cap around it. Filters are all the words of a product code: a seeded rotation
cuts the space into a few blocks, each block has random unit words, and a filter joins one word of each block. List decoding finds
all filters whose dot product with a vector exceeds ``alpha``, block by block, dropping what the best of the blocks to come can't
lift over it; words by the million are never listed. A vector that fewer than ``least`` filters exceed takes its ``least`` best. Vectors
that share a filter are compared, in double precision; a link is a cosine of ``cosine`` or more.

The code grows with the table, so that filters stay small: 4 random vectors in each are expected at 100,000 rows, 40 at 10^9. ``least``
follows from the chance that a filter over one of two vectors at just ``cosine`` is over the other.

How it is spread: equal vectors are one, with a count. Filters go by ranges of their numbers (mostly those
with all words but the last in common); a vector travels once per range, with the list of its filters, and such a bucket is compared
in a task. A pair that shares several buckets
counts in the one that has the pair's smallest common filter, so only counts per vector and a spanning tree per bucket
leave a task, never pairs. Buckets of over ``chunk`` vectors are cut into chunks, and each pair of chunks is a task of its own.
Hot clusters would make that quadratic: vectors within half the angle of one of at most 1000 centres are a cell; all of a
cell are linked, by the triangle inequality, so their links are one count and no two chunks of a cell meet. Centres are means of
bounded samples of hot filters' vectors; they decide what work is saved, not what is linked.

Recall at a cosine of exactly 0.9 in 64 dimensions is 0.99 or more from 50,000 rows to 10^9 (tests hold it over 0.985, 0.97 and 0.9),
and nearly 1 from 0.95 on. The price grows with the table: a vector travels about 14 times at 50,000 rows, 40 at 10^6, 160 at 10^9.

Defined cases: vectors that are null, empty, zero, or that hold null or non-finite components link with nothing, nor do
vectors of different sizes. Every row is a vector of its own: rows that repeat an id with equal vectors are linked with each other, and
each counts; with different vectors each has its own links. A null id is never the smallest; a component of null ids has a null
component_id and its rows are not kept. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brainweave.llm import ann, common
from brainweave.llm.graph import connected_components

COSINE, CHUNK = 0.9, 4096
#: Filters that two vectors at the least cosine are expected to share, times the number of blocks less one: joined words of more
#: blocks are less alike to random directions.
SHARED = 14
#: Words of a block at most: few blocks give better filters. Vectors in a bucket, about: filters that travel together are so many.
WORDS, BUCKET = 1024, 4096
#: Stands for a null id, so that it is never the smallest.
NO_ID = (1 << 63) - 1
CENTRES = 1000
NORMAL = NormalDist()


@dataclass(frozen=True)
class Code:
    """A product code: a rotation, words per block, and the threshold that filters must exceed."""

    rotation: np.ndarray
    books: tuple[np.ndarray, ...]
    alpha: float
    least: int
    span: int  # filters that travel together

    def dots(self, x: np.ndarray) -> list[np.ndarray]:
        y, at, out = x @ self.rotation, 0, []
        for book in self.books:
            out.append(y[:, at : at + book.shape[1]] @ book.T)
            at += book.shape[1]
        return out

    def _exceeding(self, dots: list[np.ndarray], alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, filter, dot product) of all filters that reach each row's alpha, by row and filter."""
        top = np.stack([d.max(1) for d in dots], 1)
        rest = np.cumsum(top[:, ::-1], 1)[:, ::-1]  # the most that blocks from here on can add
        row, code, total = np.arange(len(alpha)), np.zeros(len(alpha), np.int64), np.zeros(len(alpha))
        for b, d in enumerate(dots):
            after = rest[:, b + 1] if b + 1 < len(dots) else np.zeros(len(alpha))
            others = rest[:, 0] - top[:, b]
            near_row, word = np.nonzero(d >= (alpha - others)[:, None])  # words that can be part of any filter of the row
            first = np.searchsorted(near_row, np.arange(len(alpha) + 1))
            count = (first[1:] - first[:-1])[row]
            old = np.repeat(np.arange(len(row)), count)
            pick = np.arange(len(old)) - np.repeat(np.cumsum(count) - count, count) + first[row[old]]
            row, code, total = row[old], code[old] * d.shape[1] + word[pick], total[old] + d[row[old], word[pick]]
            good = total + after[row] >= alpha[row]
            row, code, total = row[good], code[good], total[good]
        return row, code, total

    def decode(self, x: np.ndarray, rows: int = 512) -> list[np.ndarray]:
        """The filters of each row of x (unit vectors), sorted."""
        out: list[np.ndarray] = []
        for at in range(0, len(x), rows):
            dots = self.dots(x[at : at + rows])
            n = len(dots[0])
            found: list[np.ndarray | None] = [None] * n
            open_, alpha, last = np.arange(n), np.full(n, self.alpha), False
            while len(open_):
                row, code, total = self._exceeding([d[open_] for d in dots], alpha[open_])
                ends = np.searchsorted(row, np.arange(len(open_) + 1))
                short = []
                for i, r in enumerate(open_):
                    mine, dot = code[ends[i] : ends[i + 1]], total[ends[i] : ends[i + 1]]
                    if len(mine) < self.least and not last:
                        short.append(r)
                        continue
                    if alpha[r] < self.alpha and len(mine) > self.least:  # the least best, ties included
                        mine = mine[dot >= np.partition(dot, -self.least)[-self.least]]
                    found[r] = np.sort(mine)
                open_ = np.array(short, np.int64)
                alpha[open_] -= 0.06
                last = bool(len(open_)) and alpha[open_].min() < -2  # fewer filters than ``least``: all are taken
            out.extend(found)
        return out


def shared_share(share: float, cosine: float) -> float:
    """Of the filters over one of two vectors at this cosine, the part over the other, for random directions."""
    z, side = NORMAL.inv_cdf(1 - share), math.sqrt(max(1e-12, 1 - cosine * cosine))
    at = np.linspace(z, z + 6, 400)
    weight = np.exp((z * z - at * at) / 2)
    return float(sum(w * (1 - NORMAL.cdf((z - cosine * x) / side)) for x, w in zip(at, weight)) / weight.sum())


@lru_cache(64)
def code_for(dim: int, rows: int, cosine: float, seed: int) -> Code:
    """The code for a table of so many vectors of a size."""
    target = 4 * max(1.0, rows / 100_000) ** 0.25
    share = min(0.25, target / max(1, rows))
    each = SHARED / shared_share(share, cosine)
    for blocks in range(1, dim + 1):
        least = math.ceil(each * max(1, blocks - 1))
        words = max(2, math.ceil((least / share) ** (1 / blocks)))
        if words <= WORDS and (blocks > 1 or dim == 1):
            break
    rng = np.random.default_rng([seed, dim])
    rotation, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    cuts = np.linspace(0, dim, blocks + 1).astype(int)
    books = [rng.normal(size=(words, b - a)) for a, b in zip(cuts, cuts[1:])]
    # a filter is the joined words over the root of the number of blocks; the root is left out here and in alpha
    books = [b / np.linalg.norm(b, axis=1, keepdims=True) for b in books]
    alpha = NORMAL.inv_cdf(1 - least / max(2 * least, words**blocks)) / math.sqrt(dim) * math.sqrt(blocks)
    return Code(rotation, tuple(books), alpha, least, max(1, min(words, int(BUCKET // target))))


# ---- the tasks


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, rows, unit vectors) of a batch, by size of the vectors; rows that can't take part are left out."""
    sizes = batch.column("v")
    for dim in {len(v) for v in sizes if v.is_valid} - {0}:
        rows, x = ann.matrix(sizes, dim)
        if len(rows):
            yield dim, rows, ann.unit(x)


def assigner(counts: dict[int, int], cosine: float, seed: int, with_vectors: bool):
    """A function for mapInArrow: a row per vector and range of filters that has any of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                for dim, rows, x in _grouped(batch):
                    code = code_for(dim, counts[dim], cosine, seed)
                    lists = code.decode(x)
                    leads = [np.unique(f // code.span) for f in lists]
                    each = np.array([len(p) for p in leads])
                    lead, of = np.concatenate(leads), np.repeat(np.arange(len(rows)), each)
                    columns = [pa.array(np.full(len(lead), dim, np.int32)), pa.array(lead)]
                    if with_vectors:
                        take = pa.array(rows[of])
                        ends = np.concatenate([[0], np.cumsum([len(f) for f in lists])]).astype(np.int32)
                        filters = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
                        columns += [batch.column(c).take(take) for c in ("node", "copies", "cell", "v")] + [filters.take(pa.array(of))]
                    yield pa.record_batch(columns, ["dim", "lead", *(["node", "copies", "cell", "v", "filters"] if with_vectors else [])])

    return run


def links_within(x: np.ndarray, filters: list[np.ndarray], lead: int, span: int, cells: np.ndarray, side: np.ndarray, cosine: float) -> np.ndarray:
    """The links of a bucket that count here, as a symmetric matrix.

    Compared are rows that share a filter of the bucket, of different cells, and, in a pair of chunks (side 1 and 2), of different
    sides. A pair counts here if the smallest filter that it shares is one of the bucket's.
    """
    n, links = len(x), np.zeros((len(x), len(x)), bool)
    own = [f[np.searchsorted(f, lead * span) : np.searchsorted(f, (lead + 1) * span)] for f in filters]
    row = np.repeat(np.arange(n), [len(f) for f in own])
    order = np.argsort(word := np.concatenate(own), kind="stable")
    starts = np.flatnonzero(np.diff(word[order], prepend=-1))
    for members in np.split(row[order], starts[1:]):  # a filter's
        if len(members) > 1:
            links[np.ix_(members, members)] |= (x[members] @ x[members].T) >= cosine
    links &= side[:, None] != side if side.any() else ~np.eye(n, dtype=bool)
    links &= (cells[:, None] != cells) | (cells[:, None] < 0)
    near = np.flatnonzero(links.any(1))
    if len(near):
        smaller = [filters[i][filters[i] < lead * span] for i in near]
        seen, at, times = np.unique(np.concatenate(smaller), return_inverse=True, return_counts=True)
        shared = np.zeros((len(near), len(seen)), np.float32)
        shared[np.repeat(np.arange(len(near)), [len(f) for f in smaller]), at] = 1
        shared = shared[:, times > 1]
        links[np.ix_(near, near)] &= (shared @ shared.T) == 0
    return links


def roots(links: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches."""
    label = np.arange(len(links), dtype=np.int32)
    while True:
        new = np.minimum(label, np.where(links, label, np.int32(len(links))).min(1, initial=len(links)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def comparer(counts: dict[int, int], cosine: float, seed: int, kinds: pa.Schema):
    """A function for mapInArrow over rows sorted by (dim, lead, a, b): (node, n, root) per linked row of each bucket."""

    def compared(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        if rows.num_rows < 2:
            return None
        dim, lead = rows.column("dim")[0].as_py(), rows.column("lead")[0].as_py()
        _, x = ann.matrix(rows.column("v"), dim)
        filters = rows.column("filters")
        ends, flat = filters.offsets.to_numpy(), filters.values.to_numpy()
        lists = [flat[a:b] for a, b in zip(ends, ends[1:])]
        cells, side = rows.column("cell").to_numpy(), rows.column("side").to_numpy()
        span = code_for(dim, counts[dim], cosine, seed).span
        links = links_within(ann.unit(x), lists, lead, span, cells, side, cosine)
        if not links.any():
            return None
        near = np.flatnonzero(links.any(1))
        n = links[near] @ rows.column("copies").to_numpy().astype(float)
        root = near[roots(links[np.ix_(near, near)])]
        node = rows.column("node")
        return pa.record_batch([node.take(pa.array(near)), pa.array(n.astype(np.int64)), node.take(pa.array(root))], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("dim", "lead", "a", "b")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    if held and key != tuple(keys[i]):
                        if (out := compared(held)) is not None:
                            yield out
                        held = []
                    key = tuple(keys[i])
                    held.append(batch.slice(i, j - i))
        if held and (out := compared(held)) is not None:
            yield out

    return run


# ---- hot clusters


def _centres(vectors: DataFrame, hot: DataFrame, counts: dict[int, int], cosine: float, seed: int) -> list[np.ndarray]:
    """At most CENTRES mean directions of samples (about 256 vectors each) of hot buckets, none in another's cap."""
    assigned = vectors.mapInArrow(assigner(counts, cosine, seed, True), _assigned_schema(vectors))
    share = F.least(F.lit(1.0), F.lit(256.0) / F.col("n"))
    drawn = assigned.join(hot.orderBy(F.desc("n"), "dim", "lead").limit(CENTRES), ["dim", "lead"]).filter(
        F.pmod(F.xxhash64("node", "lead"), F.lit(1 << 20)) < share * (1 << 20)
    )

    def mean(table: pa.Table) -> pa.Table:
        _, x = ann.matrix(table["v"].combine_chunks(), table["dim"][0].as_py())
        x = ann.unit(x)
        middle = x[(x @ x.T).sum(1).argmax()]  # the densest spot, then the mean around it
        near = x[x @ middle >= cosine]
        return pa.table({"n": [table["n"][0].as_py()], "dim": pa.array([len(middle)], pa.int32()), "centre": [ann.unit(near.sum(0)[None])[0].tolist()]})

    found = drawn.groupBy("dim", "lead").applyInArrow(mean, "n long, dim int, centre array<double>").orderBy(F.desc("n"), "centre").collect()
    kept: list[np.ndarray] = []
    for r in found:
        c = np.array(r["centre"])
        if not any(len(k) == len(c) and k @ c >= math.cos(math.acos(cosine) / 2) for k in kept):
            kept.append(c)
    return kept


def in_cells(vectors: DataFrame, centres: list[np.ndarray], cosine: float) -> DataFrame:
    """vectors with the cell of each: the nearest centre's number if it is within half the angle of ``cosine``, else -1."""
    kept = vectors.sparkSession.sparkContext.broadcast(centres)  # at most CENTRES vectors
    bound = math.cos(math.acos(cosine) / 2) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.full(batch.num_rows, -1, np.int32)
            for dim, rows, x in _grouped(batch):
                own = [i for i, c in enumerate(kept.value) if len(c) == dim]
                if own:
                    dots = x @ np.stack([kept.value[i] for i in own]).T
                    best = dots.argmax(1)
                    cell[rows] = np.where(dots[np.arange(len(rows)), best] >= bound, np.array(own, np.int32)[best], -1)
            at = batch.schema.get_field_index("cell")
            yield batch.set_column(at, batch.schema.field(at), pa.array(cell))

    return vectors.mapInArrow(run, vectors.schema)


def _assigned_schema(vectors: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return f"dim int, lead long, node {kinds['node']}, copies long, cell int, v {kinds['v']}, filters array<long>"


def _dealt(assigned: DataFrame, hot: DataFrame, chunk: int, vectors: DataFrame) -> DataFrame:
    """Rows of hot buckets, once per pair of chunks that they are compared in."""
    sizes = assigned.join(hot.select("dim", "lead"), ["dim", "lead"]).groupBy("dim", "lead", "cell").count()
    parts = sizes.withColumn("parts", F.ceil(F.col("count") / chunk).cast("int"))
    chunks = parts.select("dim", "lead", "cell", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).withColumn(
        "number", F.row_number().over(Window.partitionBy("dim", "lead").orderBy("cell", "part"))
    )
    one, two = chunks.alias("one"), chunks.alias("two")
    apart = (F.col("one.cell") != F.col("two.cell")) | (F.col("one.cell") < 0)
    pairs = one.join(two, ["dim", "lead"]).filter((F.col("one.number") <= F.col("two.number")) & apart)
    pairs = pairs.select("dim", "lead", F.col("one.number").alias("a"), F.col("two.number").alias("b"))
    sides = pairs.select("*", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2)))).alias("side"))
    goes = sides.withColumn("number", F.when(F.col("side") == 2, F.col("b")).otherwise(F.col("a"))).join(chunks, ["dim", "lead", "number"])
    part = F.pmod(F.xxhash64("node", "lead"), F.col("parts").cast("long")).cast("int")
    placed = assigned.join(parts.select("dim", "lead", "cell", "parts"), ["dim", "lead", "cell"]).withColumn("part", part).drop("parts")
    return placed.join(goes.drop("parts", "number"), ["dim", "lead", "cell", "part"]).drop("part")


# ---- the operator


def near_vectors(
    embeddings: DataFrame,
    cosine: float = COSINE,
    chunk: int = CHUNK,
    seed: int = 13,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row per row of embeddings."""
    spark = embeddings.sparkSession
    rows = embeddings.select(
        F.coalesce(F.col(f"`{vec_id}`").cast("long"), F.lit(NO_ID)).alias("id"), F.col(f"`{vector}`").alias("v")
    ).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(5), "v")})
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    good = rows.filter(F.col("v").isNotNull() & ~bad)
    once = good.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"))
    vectors = common.materialise(
        once.select(F.struct("id", "h1", "h2").alias("node"), "copies", F.lit(-1).alias("cell"), "v"), "distinct-vectors"
    )
    counts = {r["d"]: r["n"] for r in vectors.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per size
    own = (counts, cosine, seed)

    sizes = vectors.mapInArrow(assigner(*own, False), "dim int, lead long").groupBy("dim", "lead").agg(F.count(F.lit(1)).alias("n"))
    hot = common.materialise(sizes.filter(F.col("n") > chunk), "hot-buckets", 1)
    is_hot = not hot.isEmpty()
    if is_hot:
        centres = _centres(vectors, hot, *own)
        vectors = common.materialise(in_cells(vectors, centres, cosine), "vectors-in-cells")
    assigned = vectors.mapInArrow(assigner(*own, True), _assigned_schema(vectors))
    if is_hot:
        assigned = common.materialise(assigned, "assigned-vectors")
        plain = assigned.join(hot, ["dim", "lead"], "left_anti").withColumns({"a": F.lit(0), "b": F.lit(0), "side": F.lit(0)})
        tasks = plain.unionByName(_dealt(assigned, hot, chunk, vectors))
    else:
        tasks = assigned.withColumns({"a": F.lit(0), "b": F.lit(0), "side": F.lit(0)})
    common.small_batches(spark)
    key = ["dim", "lead", "a", "b"]
    node = vectors.schema["node"].dataType.simpleString()
    kinds = pa.schema([("node", pa.struct([(n, pa.int64()) for n in ("id", "h1", "h2")])), ("n", pa.int64()), ("root", pa.struct([(n, pa.int64()) for n in ("id", "h1", "h2")]))])
    compared = common.materialise(
        tasks.repartition(*key).sortWithinPartitions(*key).mapInArrow(common.lean(comparer(*own, kinds)), f"node {node}, n long, root {node}"),
        "vector-links",
    )
    links = compared.groupBy("node").agg(F.sum("n").alias("n"))
    edges = compared.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    if is_hot:
        cells = vectors.filter("cell >= 0").groupBy("cell").agg(F.sum("copies").alias("all"), F.min("node").alias("first"))
        linked = vectors.filter("cell >= 0").join(F.broadcast(cells), "cell")  # at most CENTRES rows
        links = links.unionByName(linked.select("node", (F.col("all") - F.col("copies")).alias("n"))).groupBy("node").agg(F.sum("n").alias("n"))
        edges = edges.unionByName(linked.select(F.col("node").alias("a"), F.col("first").alias("b")).filter("a != b"))
    component = connected_components(edges)
    found = (
        vectors.select("node", "copies")
        .join(links, "node", "left")
        .join(component.select(F.col("id").alias("node"), F.col("component.id").alias("least")), "node", "left")
        .select(
            F.col("node.h1").alias("h1"),
            F.col("node.h2").alias("h2"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("least", F.col("node.id")).alias("component_id"),
        )
    )
    return _expanded(rows.select("id", "h1", "h2"), found)


def _expanded(rows: DataFrame, found: DataFrame) -> DataFrame:
    """A row per row of the table: what was found for its vector, if that takes part."""
    component = F.coalesce(F.col("component_id"), F.col("id"))
    return rows.join(found, ["h1", "h2"], "left").select(
        F.nullif("id", F.lit(NO_ID)).alias("vec_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.nullif(component, F.lit(NO_ID)).alias("component_id"),
        (F.col("id").eqNullSafe(component) & (F.col("id") != NO_ID)).alias("kept"),
    )
