"""Operator 3, best-fit packing: bulk-synchronous best-fit of token pieces into sequences of a fixed capacity.

Every document (null text: empty) becomes the ids of its text and one end id. A document of more than ``capacity`` ids
is cut into pieces of ``capacity``; only its first piece may be shorter. Pieces of full length are sequences of their
own; the others are packed best-fit.

How: pieces of one length are alike, so they are a run (length, ranks from-to), and sequences with one gap are runs, too: both
tables have at most ``capacity`` values however large the corpus is. Pieces longer than half the capacity open a sequence each.
Then rounds follow, each a job over both tables: they are dealt into ranges of values, and every range is swept
in a task of its own, the longest pieces first: each run looks up its successor, the smallest gap that is long enough, and takes
as many sequences of it as it needs. Pieces that compete for a gap are served by rank, the lowest first; who loses sweeps
on to the next gap. Gaps are then updated, which may move them to another range, and the next round has fewer and wider
ranges, down to one; what has no gap even then opens sequences. The narrow ranges of the first rounds match pieces and gaps
of nearly the same size. What rounds leave is a list of rank ranges per length, with which one join puts every
piece in its place; ranks are counted in parts, so no task sees a whole run.

Ids come from the ``tokenizers`` library with its defaults, so the text of a special token is that token.

Defined cases: an empty text has the end id alone; rows that repeat a doc_id are packed each, and their pieces are
told apart by sequence and offset only; null doc_ids are packed too; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brainweave.llm import common

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
END_ID = 2
#: Pieces of text whose ids a task keeps, twice: when there are more, those that were kept but not met again go.
CACHE = 250_000
#: Longer ones aren't kept.
LONG = 64
#: Characters of texts that are encoded at once (and one text at least).
CHARS = 1 << 20
#: Ranges that documents and gaps are dealt into, round by round.
RANGES = (64, 16, 4, 1)
#: So many steps are broadcast; more are shuffled.
BOUND = 1_000_000
#: White space for both Arrow's and Python's expressions; a blank before any other character always begins a new token.
BLANK = r"\s\v\x{1C}-\x{1F}\x{85}\p{Z}"
#: Between one of these letters or digits and ASCII punctuation or a line's end there always is a cut, too.
LETTER = r"A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"
MARK = r"!-/:-@\[-`{-~"
#: Between pieces, and before a piece that no blank leads.
CUT, BARE = "\x01", "\x00"

_LOADED: dict = {}


def tokenizer(path: str):
    """(the tokenizer, bytes per id, its special tokens), loaded once per process."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        size = np.zeros(own.get_vocab_size(), dtype=np.int64)
        for token, i in own.get_vocab().items():
            size[i] = len(token)  # a byte-level vocabulary writes every byte as one character
        _LOADED[path] = own, size, [t.content for t in own.get_added_tokens_decoder().values()]
        common.give_back()
    return _LOADED[path]


def split(texts: pa.Array) -> pa.Array:
    """The pieces of texts without CUT and BARE: cut only where a token ends whatever stands around. A piece stands for itself after a
    blank, or without one if it begins with BARE."""
    odd = pc.match_substring_regex(texts, f" (?:[{BLANK}]|\\z)")  # blanks that don't begin a token
    found = pc.replace_substring(texts, " ", CUT)
    if pc.any(odd).as_py():
        found = pc.replace_with_mask(found, odd, pc.replace_substring_regex(texts.filter(odd), f" ([^{BLANK}])", CUT + "\\1"))
    found = pc.replace_substring_regex(found, f"([{LETTER}])([{MARK}\n])", rf"\1{CUT}{BARE}\2")
    found = pc.replace_substring_regex(found, f"([{MARK}]|{BARE})\n([{LETTER}])", f"\\1{CUT}{BARE}\n{CUT}{BARE}\\2")
    found = pc.replace_substring(found, BARE + CUT, "")  # the line's end was cut off already
    empty = pa.scalar("", found.type)
    return pc.split_pattern(pc.binary_join_element_wise(pa.scalar(BARE, found.type), found, empty), CUT)


def encoder(path: str) -> Callable[[list[str] | pa.Array], list[bytes]]:
    """texts -> little-endian unsigned 32-bit ids of each, for a byte-level BPE vocabulary.

    Texts are encoded piece by piece (words, punctuation, lines' ends), and a piece once. New pieces are encoded together, as the text
    that they make, and told apart by the bytes that each id stands for. Texts that hold a special token are encoded whole.
    """
    own, size, special = tokenizer(path)
    known: dict[str, bytes] = {}
    older: dict[str, bytes] = {}
    uncut = "|".join(map(re.escape, (*special, CUT, BARE)))
    ids_of = lambda texts: [np.array(e.ids, dtype="<u4") for e in own.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(names: list[str], texts: list[str], between: str) -> None:
        for k in range(0, len(names), 2000):
            some = texts[k : k + 2000]
            ids = ids_of([between.join(some)])[0]
            last = np.cumsum([len(w.encode()) + len(between) for w in some]) - len(between)
            ends = np.searchsorted(np.cumsum(size[ids]), last) + 1
            begins = np.append(0, ends[:-1] + len(between))
            data = ids.tobytes()
            known.update(zip(names[k : k + 2000], map(data.__getitem__, map(slice, (4 * begins).tolist(), (4 * ends).tolist())), strict=True))

    def encode(texts: list[str] | pa.Array) -> list[bytes]:
        nonlocal known, older
        if len(known) > CACHE:
            known, older = {}, known
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        whole = pc.match_substring_regex(texts, uncut)
        every = split(pc.if_else(whole, "", texts))
        coded = every.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in names if w not in known]
        led, bare, alone = ([], []), ([], []), ([], [])
        for w in new:
            if w in older:
                known[w] = older[w]
                continue
            x = w[1:] if w.startswith(BARE) else " " + w
            kind = alone if not x or x[-1].isspace() or x[0] != " " and x[0].isspace() else led if x[0] == " " else bare
            kind[0].append(w)
            kind[1].append(x)
        learn(*led, "")
        learn(*bare, "\n")
        known.update(zip(alone[0], map(np.ndarray.tobytes, ids_of(alone[1])), strict=True))
        ids = list(map(known.__getitem__, names))
        for w in new:
            if len(w) > LONG:
                del known[w]
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        each = coded.indices.to_numpy()
        to = np.append(0, np.cumsum(n[each]))
        flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat((np.cumsum(n) - n)[each] - to[:-1], n[each]) + np.arange(to[-1])]
        ends = to[every.offsets.to_numpy() - every.offsets[0].as_py()].tolist()
        found = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:])]
        at = np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()
        for i, some in zip(at, ids_of([texts[i].as_py() for i in at]), strict=True):
            found[i] = some.tobytes()
        return found

    return encode


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of each piece; only the first may be shorter than capacity, if there are several."""
    n = len(ids) // 4
    at, size = 0, (n - 1) % capacity + 1
    while at < n:
        yield at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])
        at, size = at + size, capacity


def pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""
    names = ["piece", "start", "length", "ids_crc32"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, CHARS + (size[at - 1] if at else 0), side="right")))
                part, at = batch.slice(at, to - at), to
                found = [list(cut(ids + end, capacity)) for ids in encode(part.column(1).fill_null(""))]
                row = np.repeat(np.arange(len(found)), [len(f) for f in found])
                values = [(k, *piece) for f in found for k, piece in enumerate(f)]
                columns = [pa.array(v, t) for v, t in zip(zip(*values, strict=True), kinds, strict=True)]
                yield pa.record_batch([part.column(0).take(pa.array(row)), *columns], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(common.lean(run), PIECES)


# ---- rounds over runs

#: What a round leaves: pieces without a place (value: length, first: rank), gaps (value: gap, first: sequence), and steps: the
#: pieces of that length (value) and of ranks first..first + n go, ``each`` at a time, to sequences from ``to`` on, from offset ``at`` on.
RUNS = "kind string, value long, first long, n long, each long, to long, at long"


def sweep(docs: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int, fresh: int | None) -> list[tuple]:
    """One range's sweep: rows of RUNS. fresh: the first free sequence, if pieces without a gap may open sequences."""
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, count)
    order: list[int] = []  # the gaps, sorted
    found = []

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                bisect.insort(order, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    def place(length: int, rank: int, left: int, gap: int, first: int, n: int) -> int:
        """Places up to left pieces into n sequences with this gap; returns how many."""
        each = gap // length
        took = min(left, each * n)
        full, some = divmod(took, each)
        found.append(("step", length, rank, took, each, first, capacity - gap))
        put(gap - each * length, first, full)
        put(gap - some * length, first + full, 1 if some else 0)
        rest = n - full - (1 if some else 0)
        put(gap, first + n - rest, rest)
        return took

    for gap, first, n in sorted(gaps):
        put(gap, first, n)
    for length, rank, left in sorted(docs, key=lambda r: (-r[0], r[1])):
        while left and (at := bisect.bisect_left(order, length)) < len(order):
            gap = order.pop(at)
            same = runs.pop(gap)
            for k, (first, n) in enumerate(same):
                if not left:
                    for run in same[k:]:
                        put(gap, *run)
                    break
                took = place(length, rank, left, gap, first, n)
                rank, left = rank + took, left - took
        if left and fresh is not None:
            n = -(-left // (capacity // length))
            place(length, rank, left, capacity, fresh, n)
            fresh, left = fresh + n, 0
        if left:
            found.append(("doc", length, rank, left, None, None, None))
    found += [("gap", gap, first, n, None, None, None) for gap in order for first, n in runs[gap]]
    return found


def one_round(state: DataFrame, ranges: int, capacity: int, fresh: int | None = None) -> DataFrame:
    """Sweeps every range of values in a task of its own."""

    def run(t: pa.Table) -> pa.Table:
        rows = list(zip(*(t[c].to_pylist() for c in ("kind", "value", "first", "n")), strict=True))
        done = sweep([r[1:] for r in rows if r[0] == "doc"], [r[1:] for r in rows if r[0] == "gap"], capacity, fresh)
        kinds = [pa.string()] + [pa.int64()] * 6
        names = ["kind", "value", "first", "n", "each", "to", "at"]
        return pa.table([pa.array(v, k) for v, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    dealt = state.withColumn("range", F.expr(f"(value - 1) * {ranges} div {capacity}"))
    return dealt.groupBy("range").applyInArrow(run, RUNS)


def plan(counts: DataFrame, capacity: int, ranges: tuple[int, ...] = RANGES) -> DataFrame:
    """The steps that place the pieces of counts (length, count); at most ``capacity`` lengths."""
    fill = [F.lit(None).cast("long").alias(c) for c in ("each", "to", "at")]
    longest_first = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    long = counts.filter(F.col("length") * 2 > capacity)  # no two of them share a sequence
    long = long.withColumn("to", F.coalesce(F.sum("count").over(longest_first), F.lit(0)))
    zero = F.lit(0).cast("long")
    opened = long.select(F.lit("step").alias("kind"), F.col("length").alias("value"), zero.alias("first"), F.col("count").alias("n"),
                         F.lit(1).cast("long").alias("each"), "to", zero.alias("at"))
    gaps = long.filter(F.col("length") < capacity).select(F.lit("gap").alias("kind"), (F.lit(capacity) - F.col("length")).alias("value"),
                                                          F.col("to").alias("first"), F.col("count").alias("n"), *fill)
    short = counts.filter(F.col("length") * 2 <= capacity).select(F.lit("doc").alias("kind"), F.col("length").alias("value"), zero.alias("first"), F.col("count").alias("n"), *fill)
    state = common.materialise(opened.unionByName(gaps).unionByName(short), "packing-round", 1)
    fresh = state.filter("kind = 'step'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    steps = [state.filter("kind = 'step'")]
    for k in ranges:
        left = state.filter("kind != 'step'")
        state = common.materialise(one_round(left, k, capacity, fresh if k == 1 else None), "packing-round", 1)
        steps.append(state.filter("kind = 'step'"))
    every = steps[0]
    for s in steps[1:]:
        every = every.unionByName(s)
    return every


def ranked(short: DataFrame, salts: int) -> DataFrame:
    """short with rank: 0, 1, ... inside each length, in any order that a rerun repeats.

    Ranks are given inside (length, salt) and shifted by the counts of the salts before; no task sees a whole run.
    """
    salted = short.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    return (
        salted.withColumn("inside", F.row_number().over(inside) - 1)
        .join(shift, ["length", "salt"])  # both sides are dealt by (length, salt) already
        .withColumn("rank", F.col("inside") + F.col("shift"))
        .drop("salt", "inside", "shift")
    )


def best_fit(cut_pieces: DataFrame, capacity: int, rows_per_salt: int = 1_000_000, ranges: tuple[int, ...] = RANGES) -> DataFrame:
    """Adds sequence_id and offset to pieces (length 1..capacity).

    A length with many rows is ranked in parts of about rows_per_salt, and in 32 parts at least.
    """
    spark: SparkSession = cut_pieces.sparkSession
    counts = common.materialise(cut_pieces.groupBy("length").count(), "lengths", 1)
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    steps = plan(counts, capacity, ranges)
    steps = steps.select(F.col("value").alias("of"), F.col("first").alias("lo"), (F.col("first") + F.col("n")).alias("hi"), "each", "to", "at")
    steps = common.materialise(steps, "packing-steps", 1)
    rank = ranked(cut_pieces, 32 + total // rows_per_salt)
    mine = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return (
        rank.join(F.broadcast(steps) if steps.count() <= BOUND else steps, mine)
        .withColumn("k", F.col("rank") - F.col("lo"))
        .select(
            *cut_pieces.columns,
            F.expr("to + k div each").alias("sequence_id"),
            F.expr("at + (k % each) * length").alias("offset"),
        )
    )


def pack_documents(docs: DataFrame, capacity: int = 1024, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    import public_tokenizers as vocabularies

    common.small_batches(docs.sparkSession)
    cut_pieces = common.materialise(pieces(docs, path or vocabularies.path("byte_bpe_50k.json"), capacity), "pieces")
    return best_fit(cut_pieces, capacity)
