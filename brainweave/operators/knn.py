"""Nearest neighbours with exact semantics: cosine, best first, ties to the smaller id.

The query side is broadcast when its size has been checked; the table side is scanned once, with filters pushed into
the scan, and shuffled as a whole only for many queries, where comparing costs far more: only each partition's best k per query go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brainweave.functions import vector

#: Queries of more bytes than this go in several broadcasts.
BLOCK = 1 << 24
#: Queries from which on items are dealt out evenly before they are compared: their files may be few.
MANY = 5_000
#: Queries and items of a tile, and pairs that are multiplied one by one at once.
QUERIES, ITEMS, PAIRS = 512, 2048, 1 << 15


def knn(items: DataFrame, key: str, embedding: str, query: list[float], k: int, where: Column | None = None, digits: int = 6) -> DataFrame:
    """The k items nearest to one query, with similarity and rank. Items without a finite vector of the query's size are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    near = items if where is None else items.filter(where)
    near = near.withColumn("similarity", vector.similarity(F.col(embedding), q, digits)).filter("similarity IS NOT NULL AND NOT isnan(similarity)")
    best = near.orderBy(F.desc("similarity"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), key)))


class Tile(NamedTuple):
    """Some queries against some items: all similarities in single precision, those of pairs and of whole queries, and the terms of a product."""

    rough: np.ndarray
    pairs: Callable[[np.ndarray, np.ndarray], np.ndarray]
    products: Callable[[np.ndarray], np.ndarray]
    terms: int


class Best:
    """The k best items of each query among those added so far: similarity (rounded) first, then the smaller id.

    They are compared tile by tile, so memory has a bound whatever the numbers of queries and items, and copies. A tile's similarities are first
    taken in single precision; only those within its error of a query's k-th best so far, or of the tile's own, are taken in double precision.
    """

    def __init__(self, k: int, digits: int) -> None:
        self.k, self.digits, self.held = k, digits, None
        self.queries, self.edge = None, None

    def add(self, queries: pa.Array, items: pa.Array, similarity: np.ndarray) -> None:
        """similarity: a row per query and a column per item. Queries that come again should be in the same order."""
        self._tiles(queries, items, lambda some, others: Tile(similarity[some, others], lambda r, c: similarity[some, others][r, c], lambda d: similarity[some, others][d], 0))

    def add_vectors(self, queries: pa.Array, items: pa.Array, y: np.ndarray, x: np.ndarray) -> None:
        """y: a unit vector per query, x: one per item."""
        y32, x32 = y.astype(np.float32), x.astype(np.float32)

        def tile(some: slice, others: np.ndarray) -> Tile:
            left, right = y[some], x[others]
            return Tile(y32[some] @ x32[others].T, lambda r, c: np.einsum("ij,ij->i", left[r], right[c]), lambda d: left[d] @ right.T, x.shape[1])

        self._tiles(queries, items, tile)

    def _tiles(self, queries: pa.Array, items: pa.Array, tile: Callable[[slice, np.ndarray], Tile]) -> None:
        if self.queries is None or not self.queries.equals(queries):
            self._start(queries)
        order = pc.sort_indices(items).to_numpy()  # a smaller place is a smaller id
        for j in range(0, len(items), ITEMS):
            others = order[j : j + ITEMS]
            found = [self._best(i, len(others), tile(slice(i, i + QUERIES), others)) for i in range(0, len(queries), QUERIES)]
            row, col, similarity = (np.concatenate(f) for f in zip(*found))
            if len(row):
                self._merge(row, items.take(pa.array(others[col])), similarity)

    def _start(self, queries: pa.Array) -> None:
        """A list of queries, with what is known of them already."""
        self.queries = queries
        known = self.edge_of() if self.held is not None else {}
        self.edge = np.array([known.get(q, -2.0) for q in queries.to_pylist()])

    def edge_of(self) -> dict:
        """Queries with k items, and the similarity of their last."""
        last = self.held.group_by("q").aggregate([("similarity", "min"), ("similarity", "count")])
        full = last.filter(pc.equal(last["similarity_count"], self.k))
        return dict(zip(full["q"].to_pylist(), full["similarity_min"].to_pylist()))

    def _best(self, i: int, size: int, tile: Tile) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, similarity) of the tile's rows that may be among the k best, at most k a query; i: the tile's first query."""
        rough, scale, top = tile.rough, 10.0**self.digits, min(self.k, size)
        margin = 6.4e-8 * (tile.terms + 8) + 10.0**-self.digits  # the error of a product in single precision, and of rounding
        edge = self.edge[i : i + len(rough)].copy()
        new = np.flatnonzero(edge < -1)  # queries with less than k items: the tile's own k-th best
        edge[new] = np.partition(rough[new], size - top, axis=1)[:, size - top]
        near = rough >= (edge - margin).astype(rough.dtype)[:, None]
        many = near.sum(1, dtype=np.int32) > max(64, size // 8)
        dense = np.flatnonzero(many)
        near[dense] = False
        row, col = _where(near)
        score = np.empty(len(row))
        for s in range(0, len(row), PAIRS):
            score[s : s + PAIRS] = tile.pairs(row[s : s + PAIRS], col[s : s + PAIRS])
        score = np.floor(score * scale + 0.5)
        if len(dense):  # copies, say: by the matrix product, a number per pair that tells its place
            product = np.floor(tile.products(dense) * scale + 0.5)
            place = product.astype(np.int64) * size - np.arange(size)
            best = np.argpartition(place, size - top, axis=1)[:, size - top :]
            row, col = np.append(row, np.repeat(dense, top)), np.append(col, best.ravel())
            score = np.append(score, np.take_along_axis(product, best, axis=1).ravel())
        similarity = score / scale
        keep = similarity >= self.edge[i + row]
        row, col, similarity = row[keep], col[keep], similarity[keep]
        best = np.lexsort((col, -similarity, row))
        row, col, similarity = row[best], col[best], similarity[best]
        keep = _place(row) < self.k
        return row[keep] + i, col[keep], similarity[keep]

    def _merge(self, row: np.ndarray, items: pa.Array, similarity: np.ndarray) -> None:
        new = pa.table({"q": self.queries.take(pa.array(row)), "i": items, "similarity": pa.array(similarity)})
        rest = None
        if self.held is not None:
            met = pc.is_in(self.held["q"], value_set=new["q"].combine_chunks())
            rest, new = self.held.filter(pc.invert(met)), pa.concat_tables([self.held.filter(met), new])
        every = new.sort_by([("q", "ascending"), ("similarity", "descending"), ("i", "ascending")])
        place = _place(every["q"].combine_chunks().dictionary_encode().indices.to_numpy())
        kept = every.filter(pa.array(place < self.k))
        self.held = (kept if rest is None else pa.concat_tables([rest, kept])).combine_chunks()
        last = every.filter(pa.array(place == self.k - 1))
        at = pc.index_in(last["q"].combine_chunks(), self.queries)
        self.edge[at.to_numpy(zero_copy_only=False)] = last["similarity"].to_numpy()

    @property
    def rows(self) -> pa.Table | None:
        """q, i, similarity, in order; none before the first items."""
        return None if self.held is None else self.held.sort_by([("q", "ascending"), ("similarity", "descending"), ("i", "ascending")])

    def table(self, query_type: pa.DataType, item_type: pa.DataType) -> pa.Table:
        if self.held is not None:
            return self.rows
        return pa.table({"q": pa.array([], query_type), "i": pa.array([], item_type), "similarity": pa.array([], pa.float64())})


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a mask in which little is set: eight at a time."""
    flat = np.ascontiguousarray(mask).ravel()
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    at = np.append((8 * words[:, None] + np.arange(8)).ravel(), np.arange(whole, len(flat)))
    at = at[flat[at]]
    return at // mask.shape[1], at % mask.shape[1]


def _place(keys: np.ndarray) -> np.ndarray:
    """The place of each row, from 0, among those of its key; rows of a key are next to each other."""
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))


def _by_size(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """size: (rows, their unit vectors); vectors that are zero or hold nulls or non-finite numbers are left out."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    found = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), size)
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        if good.any():
            found[size] = at[good], x[good] / np.linalg.norm(x[good], axis=1, keepdims=True)
    return found


def knn_join(items: DataFrame, key: str, embedding: str, queries: DataFrame, query_key: str, query_embedding: str, k: int, digits: int = 6, exclude_self: bool = False) -> DataFrame:
    """(query_key, key, similarity, rank): the k items nearest to every query row.

    Queries go in blocks of about BLOCK bytes; each block is one broadcast and one pass over the items, in which every task multiplies
    matrices and keeps its k best per query, batch by batch, so no more than k rows per query leave a task. Vectors that are null, zero, or
    of another size than the query's take no part. For many queries over many items, use a stored index (``cells``).
    """
    spark = items.sparkSession
    asked = queries.select(F.col(query_key).alias("q"), F.col(query_embedding).cast("array<double>").alias("v")).filter("q IS NOT NULL AND v IS NOT NULL")
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    blocks = max(1, -(-n * 8 * max(1, size) // BLOCK))
    q_type, i_type = asked.schema["q"].dataType.simpleString(), items.schema[key].dataType.simpleString()
    rows = items.select(F.col(key).alias("i"), F.col(embedding).cast("array<double>").alias("v")).filter("i IS NOT NULL AND v IS NOT NULL")
    if n >= MANY:
        rows = rows.repartition(spark.sparkContext.defaultParallelism, "i")
    found = None
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toArrow()
        kept = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], kept=kept) -> Iterator[pa.RecordBatch]:
            ids = kept.value["q"].combine_chunks()
            asked_by_size = _by_size(kept.value["v"].combine_chunks())
            best = Best(k + exclude_self, digits)
            for batch in batches:
                for size, (at, x) in _by_size(batch.column("v")).items():
                    if size in asked_by_size:
                        mine, y = asked_by_size[size]
                        best.add_vectors(ids.take(pa.array(mine)), batch.column("i").take(pa.array(at)), y, x)
            if best.held is not None:
                yield from best.held.to_batches()

        got = rows.mapInArrow(run, f"q {q_type}, i {i_type}, similarity double")
        found = got if found is None else found.unionByName(got)
    if exclude_self:
        found = found.filter("q != i")
    found = found.withColumn("similarity", F.round("similarity", digits) + 0.0)
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), "i")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(F.col("q").alias(query_key), F.col("i").alias(key if key != query_key else f"{key}_found"), "similarity", "rank")
    )
