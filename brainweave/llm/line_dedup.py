"""Operator 1, line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

Every text is the sequence of its lines (split at \\n), every line an ID (two 64-bit hashes). Positions are ordered by
(doc_id, text hash, line number). A repeated run is a sequence of whole lines that also stands at an earlier position;
the longest at a position is its maximal repeated run. Runs of ``min_lines`` lines or ``min_words`` words (blanks plus
one, line by line) and more count: every line that such a run covers is deleted, so the earliest copy of each run stays.

Equal texts are collapsed first: all but the first copy are one run as a whole, and aren't ranked.

Prefix doubling: level k ranks all positions by their next 2^k lines. A rank is the number of positions that sort
before, so with its count it is an interval of the suffix array, all of whose suffixes share 2^k lines. A level is the
join of the last one with itself at a distance of 2^k; ranks come from the distinct pairs (range-sorted, with one sum
per range on the driver), so no line, however common, is sorted or ranked more than once. Positions that are alone in
their interval are dropped. The longest-common-prefix intervals between two levels are then opened from the
longest level down: inside an interval, positions are grouped by the rank of what follows; all but the first of a
group go down into the longer interval, the first goes there as a target and also stays. Where a position ends is
its longest prefix that an earlier position has, too.

Hot lines: keys that very many positions hold are broadcast and their rows stay spread over all tasks (``heavy``).

Defined cases: null and empty texts have one empty line and stay as they are; rows that agree in doc_id and text are one document
and get the same result; null doc_ids come first; a text that is deleted wholly becomes empty; other columns stay,
and columns that start with ``_`` are free for use by the caller. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brainweave.llm import common

AT = ["d", "th", "i"]
NO_ID = -(1 << 63)
#: So many keys, or ranges, are broadcast; more are shuffled.
BOUND = 1_000_000
#: A key of more rows than this (a blank or boilerplate line) isn't shuffled to one task. There are rows / HEAVY of them at most.
HEAVY = 200_000


def _place(docs: DataFrame) -> DataFrame:
    """docs with the document's key (_d, _th)."""
    return docs.withColumns(
        {
            "_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
            "_th": F.xxhash64(F.coalesce("text", F.lit(""))),
        }
    )


def lines_of(docs: DataFrame) -> DataFrame:
    """d, th, i, two hashes of the line, w (its words)."""
    split = _place(docs).select(
        F.col("_d").alias("d"), F.col("_th").alias("th"), F.posexplode(F.split("text", "\n")).alias("i", "line")
    )
    return split.select(
        *AT,
        F.xxhash64("line").alias("r"),
        F.xxhash64(F.lit(17), "line").alias("r2"),
        (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("w"),
    )


def joined(rows: DataFrame, few: DataFrame, keys: list[str], heavy: int) -> DataFrame:
    """rows left-joined to few (keys, n, and what they bring; n: the rows of rows that a key has) without n.

    Keys of more than ``heavy`` rows are broadcast, up to BOUND of them, and their rows spread over all tasks by their position.
    """
    large, light = few.filter(F.col("n") > heavy).drop("n"), few.drop("n")
    brought = [c for c in light.columns if c not in keys]
    count = large.count()
    if not 0 < count <= BOUND:
        return rows.join(light, keys, "left")
    large = large.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*brought).alias("_brought"))
    told = rows.join(F.broadcast(large), [rows[k].eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    last = keys[-1]
    told = told.withColumn("_to", F.when(F.col("_brought").isNull(), F.col(last)).otherwise(F.xxhash64(*AT)))
    light = light.join(F.broadcast(large), [light[k].eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
    light = light.select(*[F.col(k).alias(f"l_{k}") for k in keys], *[F.col(c).alias(f"l_{c}") for c in brought])
    same = [F.col(k if k != last else "_to") == F.col(f"l_{k}") for k in keys]
    got = told.join(light, [F.col("_brought").isNull() & same[0], *same[1:]], "left")
    return got.select(*rows.columns, *[F.coalesce(f"_brought.{c}", f"l_{c}").alias(c) for c in brought])


def ranks(keys: DataFrame, files: int) -> tuple[DataFrame, DataFrame]:
    """keys (r, r2, n) with rank, the number of positions under smaller keys; and the table that this reads."""
    spark = keys.sparkSession
    parts = common.parallelism(spark)
    dealt = common.materialise(
        keys.repartitionByRange(parts, "r", "r2").withColumn("part", F.spark_partition_id()), "ranges", files
    )
    sums = dict(dealt.groupBy("part").agg(F.sum("n")).collect())  # a row per range
    before, shift = 0, []
    for p in sorted(sums):
        shift.append((p, before))
        before += sums[p]
    shifts = spark.createDataFrame(shift, "part int, shift long")
    inside = Window.partitionBy("part").orderBy("r", "r2").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        dealt.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(F.broadcast(shifts), "part")
        .select("r", "r2", "n", (F.col("shift") + F.col("inside")).alias("rank"))
    )
    return ranked, dealt


def levels(lines: DataFrame, heavy: int = HEAVY) -> list[DataFrame]:
    """Per level k: d, th, i, rank (and w, at level 0) of the positions whose next 2^k lines stand elsewhere, too."""
    spark = lines.sparkSession
    found, pairs, k, rows = [], lines, 0, lines.count()
    while True:
        files = common.files_for(spark, rows, 1_000_000, 1 if rows < 100_000 else None)
        keys = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        extra = ["w"] if not found else []
        ranked, dealt = ranks(keys, files)
        known = joined(pairs, ranked, ["r", "r2"], heavy).filter("rank IS NOT NULL")
        level = common.materialise(known.select(*AT, "rank", *extra), f"level-{k}", files)
        common.remove(dealt)
        rows = level.count()
        if not rows:
            return found
        found.append(level)
        ahead = level.select("d", "th", (F.col("i") - (1 << k)).alias("i"), F.col("rank").alias("r2"))
        pairs = level.select(*AT, F.col("rank").alias("r")).join(ahead, AT)
        k += 1


def longest_repeats(ranked: list[DataFrame], heavy: int = HEAVY) -> DataFrame:
    """d, th, i, len: the most lines that position shares with an earlier one, where that is at least one."""
    node = ["nd", "nt", "ni", "len"]
    spark, old = ranked[0].sparkSession, None
    files = common.files_for(spark, ranked[0].count(), 1_000_000)
    zero = F.lit(0).cast("long")
    roles = ranked[0].select(
        *[zero.alias(c) for c in ("nd", "nt")], *[F.lit(0).alias(c) for c in ("ni", "len")], *AT, F.lit(True).alias("asks")
    )
    for k in reversed(range(len(ranked))):
        ahead = ranked[k].select("d", "th", F.col("i").alias("at"), "rank")
        here = roles.withColumn("at", F.col("i") + F.col("len")).join(ahead, ["d", "th", "at"], "left").drop("at")
        groups = (
            here.filter("rank IS NOT NULL")
            .groupBy(*node, "rank")
            .agg(F.min(F.struct(*AT)).alias("f"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1")
        )
        groups = common.materialise(groups, f"groups-{k}", files)
        stay = F.struct(*node, "asks")
        down = lambda asks: F.struct(
            F.col("f.d").alias("nd"), F.col("f.th").alias("nt"), F.col("f.i").alias("ni"),
            (F.col("len") + (1 << k)).alias("len"), asks.alias("asks"),
        )
        moves = (
            F.when(F.col("f").isNull(), F.array(stay))
            .when(F.col("f") == F.struct(*AT), F.array(stay, down(F.lit(False))))
            .otherwise(F.array(down(F.col("asks"))))
        )
        roles = common.materialise(
            joined(here, groups, [*node, "rank"], heavy).select(*AT, F.explode(moves).alias("to")).select(*AT, "to.*"),
            f"roles-{k}",
            files,
        )
        common.remove(groups, *([] if old is None else [old]))
        old = roles
    return roles.filter("asks AND len > 0").select(*AT, "len")


def whole_copies(docs: DataFrame, min_lines: int, min_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """d, th of all but the first of the documents of equal text; of those that qualify the range of all lines; and d, th
    of documents that several rows hold.

    A later copy holds nothing that its first one doesn't, so it is no one's earlier position: it needn't be ranked. It is one
    run as a whole, and where that is too short, so are all its parts.
    """
    size = _place(docs).select(
        F.col("_d").alias("d"), F.col("_th").alias("th"), F.xxhash64(F.lit(29), F.coalesce("text", F.lit(""))).alias("th2"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n"),
        (F.length("text") - F.length(F.translate("text", " \n", "")) + 1).alias("w"),
    )
    size = size.groupBy("d", "th", "th2").agg(F.first("n").alias("n"), F.first("w").alias("w"), F.count(F.lit(1)).alias("rows"))
    size = common.materialise(size, "sizes")
    twice = size.filter("rows > 1").select("d", "th").distinct()
    first = size.groupBy("th", "th2").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.first("n").alias("n"), F.first("w").alias("w"))
    several = common.materialise(first.filter("first < last").drop("last"), "several")
    rest = size.select("d", "th", "th2").join(several, ["th", "th2"]).filter("d != first")
    rest = common.materialise(rest.select("d", "th", "n", "w"), "copies", common.files_for(docs.sparkSession, several.count(), 1_000_000, 1))
    long = rest.filter((F.col("n") >= min_lines) | (F.col("w") >= min_words))
    whole = long.select("d", "th", F.array(F.struct(F.lit(0).alias("lo"), F.col("n").cast("int").alias("hi"))).alias("ranges"))
    twice = common.materialise(twice.join(rest, ["d", "th"], "left_anti"), "twice", 1)
    common.remove(size, several)
    return rest.select("d", "th"), whole, twice


def repeated_ranges(docs: DataFrame, min_lines: int = 3, min_words: int = 50, heavy: int = HEAVY) -> DataFrame:
    """d, th, ranges: per document with deletions, the sorted line ranges (lo, hi; hi exclusive) to delete."""
    copies, whole, twice = whole_copies(docs, min_lines, min_words)
    side = lambda few: F.broadcast(few) if few.count() <= BOUND else few
    own = lines_of(docs)
    own = own.join(side(copies), ["d", "th"], "left_anti")
    if not twice.isEmpty():  # a position counts once, however many rows hold it
        again = own.join(side(twice), ["d", "th"], "left_semi").distinct()
        own = own.join(side(twice), ["d", "th"], "left_anti").unionByName(again)
    lines = common.materialise(own, "lines")
    ranked = levels(lines, heavy)
    common.remove(lines, twice)
    if not ranked:
        return whole
    in_doc = Window.partitionBy("d", "th").orderBy("i")
    words = F.col("w")
    for k in range(1, min_lines - 1):
        words = words + F.when(F.col("len") > k, F.coalesce(F.lead("w", k).over(in_doc), F.lit(0))).otherwise(0)
    runs = (
        ranked[0].join(longest_repeats(ranked, heavy), AT, "left")
        .withColumn("words", words)
        .filter((F.col("len") >= min_lines) | (F.col("words") >= min_words))
        .filter("len > 0")
        .withColumn("hi", F.col("i") + F.col("len"))
    )
    before = in_doc.rowsBetween(Window.unboundedPreceding, -1)
    return (
        runs.withColumn("new", (F.col("i") > F.coalesce(F.max("hi").over(before), F.lit(-1))).cast("int"))
        .withColumn("range", F.sum("new").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("d", "th", "range")
        .agg(F.min("i").alias("lo"), F.max("hi").alias("hi"))
        .groupBy("d", "th")
        .agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("ranges"))
        .unionByName(whole)
    )


def drop_repeated_lines(docs: DataFrame, min_lines: int = 3, min_words: int = 50, heavy: int = HEAVY) -> DataFrame:
    """docs with text cleaned, and _ranges (null where nothing is deleted) and _n_lines."""
    ranges = common.materialise(repeated_ranges(docs.select("doc_id", "text"), min_lines, min_words, heavy), "line-ranges")
    ranges = ranges.select(F.col("d").alias("_d"), F.col("th").alias("_th"), F.col("ranges").alias("_ranges"))
    held = ranges.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("_ranges")), F.lit(0))).first()[0]
    # up to a bound (about 16 bytes each) they go to the texts, else the texts go to them
    joined = _place(docs).join(F.broadcast(ranges) if held <= BOUND else ranges, ["_d", "_th"], "left")
    rows = joined.withColumn("_lines", F.split("text", "\n"))
    kept = F.filter("_lines", lambda x, i: ~F.exists("_ranges", lambda r: (r["lo"] <= i) & (i < r["hi"])))
    return rows.select(
        *[
            F.when(F.col("_ranges").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")
            if c == "text"
            else F.col(f"`{c}`")
            for c in docs.columns
        ],
        "_ranges",
        F.coalesce(F.size("_lines"), F.lit(0)).alias("_n_lines"),
    )


def deletions(docs: DataFrame, min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """doc_id, n_lines, n_deleted, deleted ('lo-hi,...', hi exclusive) and text_sha256 of the cleaned text."""
    done = drop_repeated_lines(docs, min_lines, min_words)
    as_text = lambda r: F.concat_ws("-", r["lo"].cast("string"), r["hi"].cast("string"))
    n = F.aggregate("_ranges", F.lit(0), lambda a, r: a + r["hi"] - r["lo"])
    return done.select(
        "doc_id",
        F.col("_n_lines").cast("long").alias("n_lines"),
        F.coalesce(n, F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce(F.array_join(F.transform("_ranges", as_text), ","), F.lit("")).alias("deleted"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def without_repeated_lines(docs: DataFrame, min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """docs with text cleaned and n_chars, if there is one, set anew; texts of which nothing is left are dropped."""
    done = drop_repeated_lines(docs, min_lines, min_words).filter("_ranges IS NULL OR text != ''")
    if "n_chars" in docs.columns:
        new = F.length("text").cast(docs.schema["n_chars"].dataType)
        done = done.withColumn("n_chars", F.when(F.col("_ranges").isNull(), F.col("n_chars")).otherwise(new))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])
