"""Operator 7, approximate nearest neighbours by additive quantisation, reranked exactly. Nearness is the cosine.

A vector of length 1 is encoded as a sum of ``BOOKS`` full-dimensional words, one of each codebook. The codebooks come from
k-means on residuals, refitted together by least squares to the codes of the sample; encoding keeps the ``BEAM`` best
partial sums per step. The index holds, for every row, its codes and the norm of their sum: ``BOOKS`` + 4 bytes.
Queries are scored against all codes by lookup tables (one product per query and word, then one addition per codebook and
candidate), divided by the stored norm. Each query's ``shortlist`` best are scored again on the original vectors, in doubles.

How it is spread: encoding is a map over all rows. Rows with identical vectors are one entry with their smallest ids, so
copies of any number can't fill a shortlist; the copies of a hot vector are cut to those ids before they are shuffled.
Queries go in blocks of bounded size, each broadcast to all partitions of the index and written as a table; a
partition returns its best per query. Only the winners are joined with the original vectors.

The codebooks are fitted on at most about ``fit_rows`` rows (a documented parameter); every row is encoded.

Vectors of different sizes have no cosine: each size has codebooks, an index and searches of its own.

Defined cases: vectors that are null, empty, zero, or that hold null or non-finite components
take no part, neither as candidate nor as query; null ids take none either. Rows that repeat an id count once, with
their best score. Ties go to the smaller id. With fewer candidates than k, all are returned. An empty table gives an empty
result. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brainweave.llm import common

BOOKS, WORDS, BEAM = 24, 256, 4
RESULT = "query_id long, rank int, vec_id long, score double"
#: Bytes of query vectors that are broadcast at once.
QUERY_BYTES = 8 << 20


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the valid rows, their vectors as doubles)."""
    sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(float), nan=-1)
    fits = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(fits), dim)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return fits[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component first, so no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@dataclass
class Quantiser:
    books: np.ndarray  # (codebook, word, dimension), single precision

    def encode(self, x: np.ndarray, beam: int = BEAM, rows: int = 2048) -> np.ndarray:
        """Codes of each row of x, by beam search."""
        x = x.astype(np.float32)
        out = [self._encode(x[i : i + rows], beam) for i in range(0, len(x), rows)]
        return np.concatenate(out) if out else np.zeros((0, len(self.books)), np.uint8)

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        n, d = x.shape
        residual, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
        cost = (x * x).sum(1)[:, None]
        for book in self.books:
            width = residual.shape[1]
            dots = (residual.reshape(-1, d) @ book.T).reshape(n, width, -1)
            costs = (cost[:, :, None] - 2 * dots + (book * book).sum(1)).reshape(n, -1)
            best = np.argpartition(costs, beam - 1, axis=1)[:, :beam] if costs.shape[1] > beam else np.tile(np.arange(costs.shape[1]), (n, 1))
            cost = np.take_along_axis(costs, best, 1)
            parent, word = best // len(book), best % len(book)
            residual = np.take_along_axis(residual, parent[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
        return codes[np.arange(n), cost.argmin(1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.books))

    def norms(self, codes: np.ndarray) -> np.ndarray:
        return np.sqrt((self.decode(codes) ** 2).sum(1)).astype(np.float32)


def _words(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """n centres of x by k-means."""
    centres = x[rng.permutation(len(x))[:n]]
    if len(centres) < n:
        centres = np.concatenate([centres, np.zeros((n - len(centres), x.shape[1]), x.dtype)])
    for _ in range(rounds):
        near = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
        order = np.argsort(near, kind="stable")
        used, first, count = np.unique(near[order], return_index=True, return_counts=True)
        centres = centres.copy()
        centres[used] = np.add.reduceat(x[order], first, axis=0) / count[:, None]
    return centres


def _refit(x: np.ndarray, codes: np.ndarray, books: np.ndarray, rounds: int = 12, ridge: float = 1.0) -> np.ndarray:
    """Codebooks nearer to least squares for these codes, by conjugate gradients from the present ones."""
    m, k, d = books.shape
    slot = codes.astype(np.int64) + np.arange(m) * k
    order = [np.argsort(slot[:, j], kind="stable") for j in range(m)]

    def gather(c: np.ndarray) -> np.ndarray:
        return sum(c[slot[:, j]] for j in range(m))

    def scatter(r: np.ndarray) -> np.ndarray:
        out = np.zeros((m * k, d), np.float32)
        for j in range(m):
            used, first = np.unique(slot[order[j], j], return_index=True)
            out[used] = np.add.reduceat(r[order[j]], first, axis=0)
        return out

    c = books.reshape(m * k, d).copy()
    start = c.copy()
    r = scatter(x - gather(c))
    p, rr = r.copy(), (r * r).sum()
    for _ in range(rounds):
        ap = scatter(gather(p)) + ridge * p
        a = rr / max(1e-12, (p * ap).sum())
        c += a * p
        r -= a * ap
        now = (r * r).sum()
        if now < 1e-9:
            break
        p, rr = r + now / rr * p, now
    used = np.zeros(m * k, bool)
    used[slot.ravel()] = True
    c[~used] = start[~used]
    return c.reshape(m, k, d)


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 3) -> Quantiser:
    """A quantiser for rows of length 1."""
    rng = np.random.default_rng(seed)
    x = np.unique(x.astype(np.float32), axis=0)
    found, residual = [], x
    for _ in range(books):
        found.append(_words(residual, words, rng))
        near = ((found[-1] ** 2).sum(1) - 2 * residual @ found[-1].T).argmin(1)
        residual = residual - found[-1][near]
    quantiser = Quantiser(np.stack(found))
    return Quantiser(_refit(x, quantiser.encode(x), quantiser.books))


def sizes(vectors: DataFrame) -> list[tuple[int, int]]:
    """(size, rows) of the vectors' sizes, the smallest first: one row per size comes to the driver."""
    found = vectors.filter("size(v) > 0").groupBy(F.size("v").alias("d")).count().collect()
    return sorted((r["d"], r["count"]) for r in found)


def build_index(vectors: DataFrame, quantiser: Quantiser, dim: int) -> DataFrame:
    """id, h1, h2 (the vector's hash), codes, norm: a row per valid row of vectors (id, v)."""
    kept = vectors.sparkSession.sparkContext.broadcast(quantiser)  # BOOKS * WORDS * dim * 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = kept.value
        for batch in batches:
            rows, x = matrix(batch.column("v"), dim)
            codes = q.encode(unit(x))
            of = batch.take(pa.array(rows))
            yield pa.record_batch(
                [of.column("id"), of.column("h1"), of.column("h2"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(q.norms(codes))],
                ["id", "h1", "h2", "codes", "norm"],
            )

    hashed = vectors.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(5), "v")})
    return hashed.mapInArrow(run, "id long, h1 long, h2 long, codes binary, norm float")


def collapse(index: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector: members (its ``keep`` smallest ids), codes, norm."""
    once = index.groupBy("h1", "h2", "id").agg(F.first("codes").alias("codes"), F.first("norm").alias("norm"))
    by = Window.partitionBy("h1", "h2").orderBy("id")
    return (
        once.withColumn("n", F.row_number().over(by))
        .filter(F.col("n") <= keep)
        .groupBy("h1", "h2")
        .agg(F.sort_array(F.collect_list("id")).alias("members"), F.first("codes").alias("codes"), F.first("norm").alias("norm"))
        .select("members", "codes", "norm")
    )


def best_by_tables(index: DataFrame, ids: np.ndarray, queries: np.ndarray, quantiser: Quantiser, shortlist: int) -> DataFrame:
    """query_id, members, approx: of each partition of the index, the shortlist per query by lookup tables."""
    kept = index.sparkSession.sparkContext.broadcast((ids, queries.astype(np.float32), quantiser))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, q = kept.value
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()  # a partition's codes: some tens of bytes a row
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(-1, len(q.books))
        norm = np.maximum(table["norm"].to_numpy(), 1e-9)
        members = table["members"].combine_chunks()
        top = min(shortlist, len(codes))
        for a in range(0, len(queries), 128):
            part = queries[a : a + 128]
            tables = np.einsum("mkd,qd->mkq", q.books, part, optimize=True)
            best_s, best_i = np.zeros((len(part), 0), np.float32), np.zeros((len(part), 0), np.int64)
            for b in range(0, len(codes), 16384):
                block = codes[b : b + 16384]
                scores = tables[0][block[:, 0]]
                for m in range(1, len(q.books)):
                    scores += tables[m][block[:, m]]
                scores = (scores / norm[b : b + 16384, None]).T
                s = np.concatenate([best_s, scores], 1)
                i = np.concatenate([best_i, np.broadcast_to(np.arange(b, b + len(block)), scores.shape)], 1)
                pick = np.argpartition(-s, top - 1, axis=1)[:, :top] if s.shape[1] > top else np.tile(np.arange(s.shape[1]), (len(part), 1))
                best_s, best_i = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
            yield pa.record_batch(
                [
                    pa.array(np.repeat(ids[a : a + 128], best_i.shape[1])),
                    members.take(pa.array(best_i.ravel())),
                    pa.array(best_s.ravel()),
                ],
                ["query_id", "members", "approx"],
            )

    return index.mapInArrow(run, "query_id long, members array<long>, approx float")


def cosine_udf(dim: int):
    @F.arrow_udf("double")
    def cosine(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for one, two in batches:
            (i, x), (j, y) = matrix(one, dim), matrix(two, dim)
            out = np.full(len(one), np.nan)
            both = np.intersect1d(i, j)
            x, y = x[np.searchsorted(i, both)], y[np.searchsorted(j, both)]
            out[both] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
            yield pa.array(out, pa.float64(), from_pandas=True)

    return cosine


def candidates(vectors: DataFrame, dim: int, n: int, is_query: Column | str, k: int, shortlist: int, fit_rows: int, query_bytes: int) -> DataFrame | None:
    """query_id, vec_id, score: each query's shortlist among the n vectors (id, v), all of size dim, scored exactly.

    None if no vector is valid.
    """
    spark = vectors.sparkSession
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, fit_rows / n))
    _, sample = matrix(vectors.filter(share).select("v").limit(2 * fit_rows).toArrow()["v"].combine_chunks(), dim)
    if not len(sample):  # no valid row was drawn: take valid ones wherever they are
        _, sample = matrix(vectors.filter(F.exists("v", lambda x: x != 0)).select("v").limit(fit_rows).toArrow()["v"].combine_chunks(), dim)
    if not len(sample):
        return None
    quantiser = fit(unit(sample))
    index = common.materialise(collapse(build_index(vectors, quantiser, dim), k + 1), "codes")
    rows = index.count()
    parts = max(min(common.parallelism(spark), math.ceil(rows / 16_384)), math.ceil(rows / (1 << 20)), 1)
    index = common.materialise(index.repartition(parts), "codes")

    # queries in blocks that fit a broadcast, however many there are
    asked = vectors.filter(is_query)
    blocks = max(1, math.ceil(asked.count() * dim * 8 / query_bytes))
    out = common.scratch(spark, "shortlists")
    schema = "query_id long, members array<long>, approx float"
    spark.createDataFrame([], schema).write.parquet(f"{out}/block=none")
    for b in range(blocks):
        got = asked.filter(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(blocks)) == b).toArrow()
        valid, x = matrix(got["v"].combine_chunks(), dim)
        if len(valid):
            ids = got["id"].combine_chunks().to_numpy()[valid]
            best_by_tables(index, ids, unit(x), quantiser, shortlist).write.parquet(f"{out}/block={b}")
    best = Window.partitionBy("query_id").orderBy(F.desc("approx"), "members")
    short = (
        spark.read.schema(schema)
        .parquet(out)
        .withColumn("n", F.row_number().over(best))
        .filter(F.col("n") <= shortlist)
        .select("query_id", F.explode("members").alias("id"))
        .filter("id != query_id")
    )
    score = cosine_udf(dim)
    return (
        short.join(vectors, "id")
        .join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("w")), "query_id")
        .select("query_id", F.col("id").alias("vec_id"), score("v", "w").alias("score"))
        .filter("score IS NOT NULL")
    )


def nearest(
    embeddings: DataFrame,
    is_query: Column | str,
    k: int = 5,
    shortlist: int = 128,
    fit_rows: int = 16_384,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row for which is_query (of ``id``) holds."""
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    found = None
    for dim, n in sizes(vectors):
        scored = candidates(vectors.filter(F.size("v") == dim), dim, n, is_query, k, shortlist, fit_rows, query_bytes)
        if scored is not None:
            found = scored if found is None else found.unionByName(scored)
    if found is None:
        return spark.createDataFrame([], RESULT)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        once.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )
