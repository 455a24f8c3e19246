"""Operator 4, quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its hashed words (log counts, scaled to length 1), and its structure statistics and metadata, each
put into one of ``BINS`` bins by its quantiles in the training sample. The machine's score is

    w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

which has all pairwise interactions at a cost linear in the features: the sum-of-squares identity. A logistic makes it
a probability. Scoring runs where the texts are, in Arrow batches, over whole texts; the broadcast model has a fixed size.

Training uses a bounded sample: the ``max_rows`` labelled documents of the smallest hashes of doc_id (a documented
parameter; all of them, if fewer). Their features (not texts) come to the driver, about 2 KB each.

Defined cases: null and empty texts have no words and all statistics 0, and get a score too; null metadata is a bin of
its own; rows whose label is not 0 or 1, and doc_ids with labels that contradict each other, are not learned from;
a training sample without labels gives 0.5 everywhere. Repeated rows get the same score; empty tables give empty results;
extra columns stay and are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brainweave.llm import common, shingles

WORD_BITS, RANK, BINS = 14, 8, 12
#: Words repeat at these distances in texts that go round in circles.
LAGS = (1, 2, 3, 4)

# byte classes of the structure statistics
_CLASSES = ("space", "line", "lower", "upper", "digit", "stop", "comma", "bang", "bar", "symbol", "bracket", "wide", "other")
_KIND = np.full(256, _CLASSES.index("other"), dtype=np.int64)
for _name, _bytes in {
    "space": b" \t\r\x0b\x0c", "line": b"\n", "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)),
    "digit": b"0123456789", "stop": b".?", "comma": b",;:", "bang": b"!", "bar": b"|", "symbol": b"#$%&*@^~+=<>\\_/`",
    "bracket": b"()[]{}\"'-", "wide": bytes(range(128, 256)),
}.items():
    _KIND[list(_bytes)] = _CLASSES.index(_name)
STATISTICS = [f"share_{c}" for c in _CLASSES] + ["words", "bytes", "word_bytes", "distinct", "most_common", "stops_per_word", "words_per_line"] + [f"lag_{k}" for k in LAGS]


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per run of texts: (word features, their values, where each text's features start, statistics)."""
    for _, data, bounds in shingles.chunks(texts):
        n = len(bounds) - 1
        h, _, first = shingles.words(data, bounds)
        count = np.diff(first)
        text_of = np.repeat(np.arange(n), count)
        key = (text_of << WORD_BITS) | (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        key, times = np.unique(key, return_counts=True)
        owner = key >> WORD_BITS
        value = np.log1p(times)
        square = np.bincount(owner, value * value, n)
        value = (value / np.sqrt(square)[owner]).astype(np.float32)
        at = np.searchsorted(owner, np.arange(n + 1))

        size = np.diff(bounds)
        classes = np.bincount(np.repeat(np.arange(n) * len(_CLASSES), size) + _KIND[data], minlength=n * len(_CLASSES))
        classes = classes.reshape(n, len(_CLASSES))
        some = np.maximum(1, count)
        most = np.zeros(n, dtype=np.int64)
        np.maximum.at(most, owner, times)
        stats = [
            *(classes / np.maximum(1, size)[:, None]).T,
            np.log1p(count),
            np.log1p(size),
            (size - classes[:, :2].sum(1)) / some,
            np.diff(at) / some,
            most / some,
            classes[:, _CLASSES.index("stop")] / some,
            count / (1 + classes[:, 1]),
        ]
        for k in LAGS:
            same = (h[k:] == h[:-k]) & (text_of[k:] == text_of[:-k]) if len(h) > k else np.zeros(0, bool)
            stats.append(np.bincount(text_of[k:][same], minlength=n)[:n] / some)
        yield (key & ((1 << WORD_BITS) - 1)).astype(np.int32), value, at, np.stack(stats, 1)


@dataclass
class Model:
    """Edges of the bins, and the machine's weights."""

    edges: list[np.ndarray]
    bias: float = 0.0
    linear: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, RANK), np.float32))

    def binned(self, stats: np.ndarray) -> np.ndarray:
        """A feature per statistic; a missing value (NaN) has the first bin."""
        out = np.empty(stats.shape, dtype=np.int32)
        for j, edge in enumerate(self.edges):
            bin_ = np.where(np.isnan(stats[:, j]), 0, 1 + np.searchsorted(edge, stats[:, j], side="right"))
            out[:, j] = (1 << WORD_BITS) + j * (BINS + 1) + bin_
        return out

    def margin(self, idx: np.ndarray, val: np.ndarray, at: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """Scores before the logistic, by the sum-of-squares identity."""
        n = len(at) - 1
        scale = np.float32(1 / np.sqrt(max(1, bins.shape[1])))
        owner = np.repeat(np.arange(n), np.diff(at))
        linear = np.bincount(owner, self.linear[idx] * val, n) + scale * self.linear[bins].sum(1)
        vx = self.factors[idx] * val[:, None]
        vb = self.factors[bins] * scale
        total = self.bias + linear
        for f in range(RANK):
            s = np.bincount(owner, vx[:, f], n) + vb[:, :, f].sum(1)
            q = np.bincount(owner, vx[:, f] ** 2, n) + (vb[:, :, f] ** 2).sum(1)
            total += 0.5 * (s * s - q)
        return total


def logistic(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def fit(idx: np.ndarray, val: np.ndarray, at: np.ndarray, stats: np.ndarray, y: np.ndarray, epochs: int = 25, rate: float = 0.02, decay: float = 2e-4, seed: int = 7) -> Model:
    """Fits a machine by Adam on the logistic loss; rows of the rarer label weigh no more than the others."""
    edges = []
    for j in range(stats.shape[1]):
        known = stats[:, j][~np.isnan(stats[:, j])]
        edges.append(np.unique(np.quantile(known, np.linspace(0, 1, BINS)[1:-1])) if len(known) else np.zeros(0))
    model = Model(edges)
    size = (1 << WORD_BITS) + stats.shape[1] * (BINS + 1)
    rng = np.random.default_rng(seed)
    model.linear = np.zeros(size, np.float32)
    model.factors = rng.normal(0, 0.05, (size, RANK)).astype(np.float32)
    if not len(y) or y.min() == y.max():
        if len(y):
            model.bias = 5.0 if y[0] else -5.0
        model.factors[:] = 0
        return model
    model.bias = float(np.log(y.mean() / (1 - y.mean())))
    bins = model.binned(stats)
    width = bins.shape[1]
    scale = np.float32(1 / np.sqrt(width))
    moments = [np.zeros((size, RANK + 1), np.float32) for _ in range(2)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for batch in np.array_split(order, max(1, len(y) // 256)):
            lens = at[batch + 1] - at[batch]
            take = np.repeat(at[batch] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
            m = len(batch)
            feat = np.concatenate([idx[take], bins[batch].ravel()])
            x = np.concatenate([val[take], np.full(m * width, scale, np.float32)])
            owner = np.concatenate([np.repeat(np.arange(m), lens), np.repeat(np.arange(m), width)])
            v = model.factors[feat]
            vx = v * x[:, None]
            s = np.stack([np.bincount(owner, vx[:, f], m) for f in range(RANK)], 1)
            q = np.bincount(owner, (vx * vx).sum(1), m)
            margin = model.bias + np.bincount(owner, model.linear[feat] * x, m) + 0.5 * ((s * s).sum(1) - q)
            err = (logistic(margin) - y[batch]) / m
            e = err[owner] * x
            used, slot = np.unique(feat, return_inverse=True)
            grad = np.empty((len(used), RANK + 1), np.float32)
            grad[:, RANK] = np.bincount(slot, e, len(used))
            sv = s[owner] - vx
            for f in range(RANK):
                grad[:, f] = np.bincount(slot, e * sv[:, f], len(used))
            now = np.concatenate([model.factors[used], model.linear[used, None]], 1)
            grad += decay * now
            step += 1
            one, two = moments[0][used], moments[1][used]
            moments[0][used] = one = 0.9 * one + 0.1 * grad
            moments[1][used] = two = 0.99 * two + 0.01 * grad * grad
            now -= rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-6)
            model.factors[used], model.linear[used] = now[:, :RANK], now[:, RANK]
            model.bias -= rate * float(err.sum())
    return model


def _with_metadata(stats: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([stats, np.stack(columns, 1)], 1) if columns else stats


def _numbers(column: pa.Array) -> np.ndarray:
    """Doubles, NaN where null or not finite."""
    got = column.to_numpy(zero_copy_only=False).astype(np.float64)
    return np.where(np.isfinite(got), got, np.nan)


def _scaled(metadata: tuple[str, ...]) -> list[Column]:
    """Metadata columns as signed logarithms."""
    number = lambda c: F.col(f"`{c}`").cast("double")
    return [F.signum(number(c)) * F.log1p(F.abs(number(c))) for c in metadata]


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of doc_id as text leaves ``fold`` modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", metadata: tuple[str, ...] = (), max_rows: int = 12_000) -> Model:
    """A model of labels (doc_id, label 0 or 1) on at most ``max_rows`` of the documents labelled."""
    common.small_batches(docs.sparkSession)
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .filter("doc_id IS NOT NULL AND y IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("z"))
        .filter("y = z")
        .select("doc_id", "y")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c.alias(f"m{i}") for i, c in enumerate(_scaled(metadata))])
        .join(F.broadcast(known), "doc_id")  # at most max_rows rows of 12 bytes
        .groupBy("doc_id", "y")
        .agg(F.max(F.struct("text", *[f"m{i}" for i in range(len(metadata))])).alias("r"))
        .select("doc_id", "y", "r.*")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for idx, val, at, stats in features(batch.column("text")):
                n = len(at) - 1
                meta = [_numbers(batch.column(f"m{i}")[row : row + n]) for i in range(len(metadata))]
                stats = _with_metadata(stats, meta)
                yield pa.record_batch(
                    [
                        batch.column("doc_id")[row : row + n],
                        batch.column("y")[row : row + n],
                        pa.array([idx[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                        pa.array([val[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                        pa.array([s.tobytes() for s in stats.astype("<f8")], pa.binary()),
                    ],
                    ["doc_id", "y", "idx", "val", "stats"],
                )
                row += n

    got = rows.mapInArrow(common.lean(run), "doc_id long, y int, idx binary, val binary, stats binary").toArrow()
    got = got.sort_by("doc_id")
    each = [np.frombuffer(b, "<i4") for b in got["idx"].to_pylist()]
    at = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    flat = lambda c, kind: np.frombuffer(b"".join(got[c].to_pylist()), kind)
    width = len(STATISTICS) + len(metadata)
    model = fit(flat("idx", "<i4"), flat("val", "<f4"), at, flat("stats", "<f8").reshape(-1, width), got["y"].to_numpy().astype(np.float64))
    del got, each
    common.give_back()
    return model


def score(docs: DataFrame, model: Model, metadata: tuple[str, ...] = (), into: str = "score") -> DataFrame:
    """docs with a column ``into``, the probability of label 1; a column of that name is replaced."""
    common.small_batches(docs.sparkSession)
    kept = docs.sparkSession.sparkContext.broadcast(model)  # about 0.7 MB, whatever the data

    @F.arrow_udf("double")
    def scores(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        m = kept.value
        for text, *meta in batches:
            out, row = [np.zeros(0)], 0
            for idx, val, at, stats in features(text):
                n = len(at) - 1
                stats = _with_metadata(stats, [_numbers(c[row : row + n]) for c in meta])
                out.append(logistic(m.margin(idx, val, at, m.binned(stats))))
                row += n
            yield pa.array(np.concatenate(out), pa.float64())
        common.give_back()

    return docs.withColumn(into, scores(F.col("text").cast("string"), *_scaled(metadata)))


def quality_scores(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ("n_chars",), max_rows: int = 12_000) -> DataFrame:
    """docs with held_out, score and predicted: learned only from rows that aren't held out."""
    model = train(docs, labels.filter(~held_out()), metadata=metadata, max_rows=max_rows)
    return (
        score(docs, model, metadata)
        .withColumn("held_out", held_out())
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def drop_rejected(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ("n_chars",), max_rows: int = 12_000) -> DataFrame:
    """The rows of docs, with their columns as they are, whose score is 0.5 or more."""
    model = train(docs, labels.filter(~held_out()), metadata=metadata, max_rows=max_rows)
    return score(docs, model, metadata, into="_quality").filter("_quality >= 0.5").select(*[F.col(f"`{c}`") for c in docs.columns])
