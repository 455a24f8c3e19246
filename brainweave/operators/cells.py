"""A stored vector index: vectors by coarse cell, searched by probing the cells whose centres are nearest, reranked exactly.

Centres come from spherical k-means in rounds of Spark jobs over a sample of about ``FIT`` rows per cell (each task sums its rows by cell; only
sums, at most CELLS vectors, come to the driver). Every vector is stored under its nearest centre, ``vectors/cell=c`` (key, v), in files of bounded size,
so a cell with a third of all rows is many files. ``cells`` has a row per cell: its centre, its number of rows, and the widest angle of a row to
the centre. By that angle no row of a cell can be nearer to a query than a known bound, so a search may go on probing until the k-th
hit is nearer than any cell left could offer: then the result is exact.

Vectors that are null, zero, of another size than the index, or that hold null or non-finite components are not stored, nor asked. A key names
one row. One update runs at a time; one that was cut off is put right by running it again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brainweave.operators import knn
from brainweave.sources import sinks

#: Cells at most (their centres are broadcast), rows of the sample per cell, rows of a stored file, queries that meet a file at once.
CELLS, FIT, FILE, ASKED = 4096, 256, 50_000, 2048
#: Numbers of a matrix that a task makes at once.
NUMBERS = 1 << 21


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the valid rows, their vectors scaled to length 1)."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(fits), dim)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    x = x[good]
    if len(x):
        x = x / np.abs(x).max(1, keepdims=True)
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
    return fits[good], x


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, cosine) of each row's nearest centre."""
    cell, near, step = np.zeros(len(x), np.int32), np.zeros(len(x)), max(1, NUMBERS // len(centres))
    for s in range(0, len(x), step):
        dots = x[s : s + step] @ centres.T
        cell[s : s + step] = dots.argmax(1)
        near[s : s + step] = dots[np.arange(len(dots)), cell[s : s + step]]
    return cell, near


@dataclass(frozen=True)
class Index:
    """A stored index: where it is, its centres (unit rows), the widest angle of each cell, its rows, and the types of its columns."""

    path: str
    centres: np.ndarray
    angles: np.ndarray
    rows: np.ndarray
    kinds: tuple[str, str]

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The largest cosine that a row of each cell can have with a query."""
        away = np.arccos(np.clip(self.centres @ query, -1, 1)) - self.angles - 1e-9
        return np.where(self.rows > 0, np.cos(np.maximum(away, 0)), -2)

    def nearest(self, query: np.ndarray) -> np.ndarray:
        """Numbers of the cells that hold rows, the nearest centre first."""
        order = np.argsort(-(self.centres @ query), kind="stable")
        return order[self.rows[order] > 0]

    def read(self, spark: SparkSession, cells: list[int] | None = None) -> DataFrame:
        rows = spark.read.schema(f"key {self.kinds[0]}, v {self.kinds[1]}, cell int").parquet(f"{self.path}/vectors")
        return rows.filter("key IS NOT NULL") if cells is None else rows.filter(F.col("cell").isin(cells) & F.col("key").isNotNull())


def _assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows (key, v) with cell and the cosine to its centre; rows without a valid vector go."""
    kept = rows.sparkSession.sparkContext.broadcast(centres)  # at most CELLS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = unit_rows(batch.column("v"), kept.value.shape[1])
            cell, near = nearest_centres(x, kept.value)
            valid = batch.take(pa.array(at))
            yield pa.record_batch([*valid.columns, pa.array(cell), pa.array(near)], [*valid.schema.names, "cell", "near"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, v {rows.schema['v'].dataType.simpleString()}, cell int, near double")


def fit(rows: DataFrame, dim: int, cells: int, rounds: int) -> np.ndarray:
    """Centres of unit length by spherical k-means over rows (v)."""
    n = rows.count()
    share = min(1.0, FIT * cells / max(1, n))
    path = sinks.scratch(rows.sparkSession, "cell-sample")
    rows.select("v").withColumn("h", F.pmod(F.xxhash64("v"), F.lit(1 << 30))).filter(F.col("h") < math.ceil(share * (1 << 30))).write.parquet(path)
    sample = rows.sparkSession.read.parquet(path)
    _, centres = unit_rows(sample.dropDuplicates(["v"]).orderBy(F.xxhash64(F.lit(3), "v")).limit(cells).toArrow()["v"].combine_chunks(), dim)
    if not len(centres):
        return np.eye(1, dim)
    for _ in range(rounds):
        kept = rows.sparkSession.sparkContext.broadcast(centres)

        def run(batches: Iterator[pa.RecordBatch], kept=kept) -> Iterator[pa.RecordBatch]:
            sums = np.zeros_like(kept.value)
            for batch in batches:
                _, x = unit_rows(batch.column("v"), dim)
                if len(x):
                    np.add.at(sums, nearest_centres(x, kept.value)[0], x)
            used = np.flatnonzero((sums != 0).any(1))
            yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(list(sums[used]), pa.list_(pa.float64()))], ["cell", "s"])

        by_place = sample.mapInArrow(run, "cell int, s array<double>").select("cell", F.posexplode("s").alias("i", "x"))
        added = by_place.groupBy("cell", "i").agg(F.sum("x").alias("x")).toArrow()  # at most CELLS vectors
        sums = np.zeros_like(centres)
        sums[added["cell"].to_numpy(), added["i"].to_numpy()] = added["x"].to_numpy()
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def _write(rows: DataFrame, path: str, counts: dict[int, int]) -> None:
    """rows (key, v, cell): a cell of n rows goes to n / FILE files."""
    files = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, -(-n // FILE))]) if counts else None
    part = F.pmod(F.xxhash64("key"), F.coalesce(F.element_at(files, F.col("cell")), F.lit(1)).cast("long")) if counts else F.lit(0)
    dealt = rows.withColumn("_part", part).repartition("cell", "_part").sortWithinPartitions("cell", "key").drop("_part")
    sinks.replace_table(dealt, f"{path}/vectors", ["cell"])


def _write_cells(spark: SparkSession, index: Index) -> None:
    rows = [(i, c.tolist(), float(a), int(n)) for i, (c, a, n) in enumerate(zip(index.centres, index.angles, index.rows))]
    path, kinds = f"{index.path}/cells", "cell int, centre array<double>, angle double, rows long"
    table = spark.createDataFrame(rows, kinds).withColumns({"key_kind": F.lit(index.kinds[0]), "vector_kind": F.lit(index.kinds[1])})
    table.coalesce(1).write.mode("overwrite").parquet(path)


def build(items: DataFrame, key: str, embedding: str, path: str, dim: int, cells: int | None = None, rounds: int = 6) -> Index:
    """Writes the index of items with vectors of size dim to an empty folder; cells: the root of the number of rows unless given."""
    spark = items.sparkSession
    rows = items.select(F.col(key).alias("key"), F.col(embedding).alias("v")).filter("key IS NOT NULL")
    valid = rows.filter(F.size("v") == dim)
    cells = min(CELLS, cells or max(1, round(math.sqrt(valid.count()))))
    centres = fit(valid, dim, cells, rounds)
    placed_at = sinks.scratch(spark, "cell-rows")
    _assigned(rows, centres).write.parquet(placed_at)
    placed = spark.read.parquet(placed_at)
    kinds = (rows.schema["key"].dataType.simpleString(), rows.schema["v"].dataType.simpleString())
    found = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near")).collect()}  # a row per cell
    size = np.array([found[i]["n"] if i in found else 0 for i in range(len(centres))])
    angle = np.array([math.acos(max(-1.0, min(1.0, found[i]["near"]))) if i in found else 0.0 for i in range(len(centres))])
    index = Index(path.rstrip("/"), centres, angle, size, kinds)
    _write(placed.drop("near"), index.path, {c: r["n"] for c, r in found.items()})
    _write_cells(spark, index)
    return index


def opened(spark: SparkSession, path: str) -> Index:
    """The index that was built in a folder."""
    rows = spark.read.parquet(f"{path.rstrip('/')}/cells").orderBy("cell").collect()  # at most CELLS
    numbers = lambda c: np.array([r[c] for r in rows])
    return Index(path.rstrip("/"), np.array([r["centre"] for r in rows]), numbers("angle"), numbers("rows"), (rows[0]["key_kind"], rows[0]["vector_kind"]))


def update(index: Index, items: DataFrame, key: str, embedding: str, removed: DataFrame | None = None) -> Index:
    """Puts items in the place of the rows of their keys, or adds them, and takes out the keys of ``removed``; centres stay.

    Only the cells that lose or gain rows are written again. A cell's widest angle may be wider than it needs to be afterwards, never narrower.
    """
    spark = items.sparkSession
    rows = items.select(F.col(key).alias("key"), F.col(embedding).alias("v")).filter("key IS NOT NULL")
    path = sinks.scratch(spark, "changed")
    _assigned(rows, index.centres).write.parquet(path)
    new = spark.read.parquet(path)
    keys = rows.select("key") if removed is None else rows.select("key").union(removed.select(F.col(key))).distinct()
    old = index.read(spark)
    touched = [r["cell"] for r in old.join(keys, "key", "left_semi").select("cell").union(new.select("cell")).distinct().collect()]  # at most CELLS
    if not touched:
        return index
    kept = index.read(spark, touched).join(keys, "key", "left_anti").unionByName(new.drop("near"))
    staged = sinks.scratch(spark, "cells-changed")
    kept.write.parquet(staged)
    kept = spark.read.schema(f"key {index.kinds[0]}, v {index.kinds[1]}, cell int").parquet(staged)
    size, angle = index.rows.copy(), index.angles.copy()
    size[touched] = 0
    for r in kept.groupBy("cell").count().collect():
        size[r["cell"]] = r["count"]
    for r in new.groupBy("cell").agg(F.min("near").alias("near")).collect():
        angle[r["cell"]] = max(angle[r["cell"]], math.acos(max(-1.0, min(1.0, r["near"]))))
    marks = spark.createDataFrame([(c,) for c in touched], "cell int").select(  # an emptied cell is written too
        F.lit(None).cast(index.kinds[0]).alias("key"), F.lit(None).cast(index.kinds[1]).alias("v"), "cell"
    )
    _write(kept.unionByName(marks), index.path, {int(c): int(size[c]) for c in touched})
    now = Index(index.path, index.centres, angle, size, index.kinds)
    _write_cells(spark, now)
    return now


def search(spark: SparkSession, index: Index, query: list[float], k: int, probes: int = 8, exact: bool = False, where: Column | None = None, digits: int = 6) -> DataFrame:
    """(key, similarity, rank) of the k nearest rows of the ``probes`` nearest cells.

    exact: then also of every cell that could hold a row as near as the k-th of these, so that no row of the index is nearer than those found.
    """
    q = np.asarray(query, float)
    if q.shape != (index.centres.shape[1],) or not np.isfinite(q).all() or not q.any():
        return knn.knn(index.read(spark, []), "key", "v", list(query), k).select("key", "similarity", "rank")
    q = q / np.abs(q).max()
    q = q / np.sqrt((q * q).sum())
    cells = index.nearest(q)[:probes]
    found = knn.knn(index.read(spark, [int(c) for c in cells]), "key", "v", list(query), k, where, digits)
    if exact:
        hits = [r["similarity"] for r in found.select("similarity").collect()]  # k rows
        least = min(hits) - 10.0**-digits if len(hits) == k else -2.0
        more = [int(c) for c in np.flatnonzero((index.bounds(q) >= least) & (index.rows > 0))]
        found = knn.knn(index.read(spark, sorted({*more, *map(int, cells)})), "key", "v", list(query), k, where, digits)
    return found.select("key", "similarity", "rank")


def shelves(rows: np.ndarray) -> np.ndarray:
    """The shelf of each cell: cells of FILE rows and more have their own, the others share one as long as they fit."""
    out, shelf, full = np.zeros(len(rows), np.int32), 0, 0
    for i, n in enumerate(rows.tolist()):
        if full and full + n > FILE:
            shelf, full = shelf + 1, 0
        out[i], full = shelf, full + n
    return out


def search_join(index: Index, queries: DataFrame, query_key: str, query_embedding: str, k: int, probes: int = 8, digits: int = 6) -> DataFrame:
    """(query_key, key, similarity, rank): the k nearest rows found for every query row, each in its ``probes`` nearest cells.

    Small cells share a shelf of about FILE rows, so that a query is sent once per shelf it probes and not once per cell. Queries and stored rows meet by
    (shelf, file, block of queries): groups of some FILE rows and ASKED queries, however hot a cell is.
    """
    spark = queries.sparkSession
    shelf_of = shelves(index.rows)
    sent = spark.sparkContext.broadcast((index.centres, index.rows, shelf_of))
    asked = queries.select(F.col(query_key).alias("q"), F.col(query_embedding).cast("array<double>").alias("w")).filter("q IS NOT NULL AND w IS NOT NULL")
    q_kind = asked.schema["q"].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, rows, shelf_of = sent.value
        held = np.flatnonzero(rows > 0)
        top, of_held = min(probes, len(held)), np.unique(shelf_of[held])
        step = max(1, NUMBERS // max(1, len(held), len(of_held) * centres.shape[1]))
        for batch in batches:
            at, x = unit_rows(batch.column("w"), centres.shape[1])
            for s in range(0, len(x) if top else 0, step):
                some = at[s : s + step]
                if top == len(held):  # all cells: a null stands for them
                    row, shelf, cells = np.repeat(some, len(of_held)), np.tile(of_held, len(some)), pa.nulls(len(some) * len(of_held), pa.list_(pa.int32()))
                else:
                    best = held[np.argsort(-(x[s : s + step] @ centres[held].T), axis=1, kind="stable")[:, :top]]
                    n, cell = np.repeat(np.arange(len(some)), top), best.ravel()
                    order = np.lexsort((cell, shelf_of[cell], n))
                    n, cell = n[order], cell[order]
                    first = np.flatnonzero((np.diff(n, prepend=-1) != 0) | (np.diff(shelf_of[cell], prepend=-1) != 0))
                    row, shelf = some[n[first]], shelf_of[cell[first]]
                    cells = pa.ListArray.from_arrays(pa.array(np.append(first, len(n)).astype(np.int32)), pa.array(cell.astype(np.int32)))
                take = pa.array(row)
                yield pa.record_batch([batch.column("q").take(take), batch.column("w").take(take), pa.array(shelf.astype(np.int32)), cells], ["q", "w", "shelf", "cells"])

    goes = asked.mapInArrow(probe, f"q {q_kind}, w array<double>, shelf int, cells array<int>")
    held = [(i, int(shelf_of[i]), -(-int(n) // FILE)) for i, n in enumerate(index.rows) if n]  # at most CELLS; a shelf of several files has one cell
    rows = spark.createDataFrame(held, "cell int, shelf int, parts int")
    sizes = goes.groupBy("shelf").count().select("shelf", F.ceil(F.col("count") / ASKED).cast("int").alias("blocks"))  # at most CELLS
    grid = F.broadcast(rows.join(F.broadcast(sizes), "shelf"))
    files = F.broadcast(rows.groupBy("shelf").agg(F.max("parts").alias("parts")).join(F.broadcast(sizes), "shelf"))
    left = goes.join(files, "shelf").select("q", "w", "cells", "shelf", F.pmod(F.xxhash64("q"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    stored = index.read(spark).withColumn("v", F.col("v").cast("array<double>"))
    right = stored.join(grid, "cell").select("key", "v", "cell", "shelf", F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dim, kind = index.centres.shape[1], index.kinds[0]
    schema = f"q {q_kind}, i {kind}, similarity double"

    def meet(ask: pa.Table, items: pa.Table) -> pa.Table:
        best = knn.Best(k, digits)
        at, y = unit_rows(ask["w"].combine_chunks(), dim)
        on, x = unit_rows(items["v"].combine_chunks(), dim)
        if len(at) and len(on):
            q, i = ask["q"].combine_chunks().take(pa.array(at)), items["key"].combine_chunks().take(pa.array(on))
            lists = ask["cells"].combine_chunks().take(pa.array(at))
            if lists.null_count == len(lists):
                best.add_vectors(q, i, y, x)
            else:
                whose, probed = lists.value_parent_indices().to_numpy(), lists.flatten().to_numpy()
                cell = items["cell"].combine_chunks().take(pa.array(on)).to_numpy()
                for c in np.unique(cell):
                    mine, here = np.sort(whose[probed == c]), np.flatnonzero(cell == c)
                    if len(mine):
                        best.add_vectors(q.take(pa.array(mine)), i.take(pa.array(here)), y[mine], x[here])
        return best.table(ask.schema.field("q").type, items.schema.field("key").type)

    by = ["shelf", "part", "block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, schema)
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), "i")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_key), F.col("i").alias("key"), "similarity", "rank")
