"""Operator 12, fill-in-the-middle transformation, by escaped marker injection.

A text is cut into units (lines). A delimiter is escaped in the text, a regular expression's replacement appends it after every
unit, and counting delimiters counts units. Two seeded hashes of the document's id pick the ranks of two cuts; ``substring_index``
takes the parts before, between and after the delimiters of these ranks. The parts are unescaped and assembled around
three sentinels, prefix first (psm) or suffix first (spm). ``restore`` takes an output apart again, exactly.

How it is spread: every row by itself, in one pass of built-in functions: no shuffle, no Python. A text is held a few times over.

Defined cases: a null text is empty. Empty texts, and texts that hold a sentinel, stay plain, whatever the hashes say. A null id hashes as
the empty string. Rows that repeat an id get the same hashes; each is cut by its own units. Any character may occur in a text,
the delimiter and the escape too. Other columns are neither read nor returned. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units: lines with their newline, and a last line without one.
LINES = r"[^\n]*\n|[^\n]+"
DELIMITER, ESCAPE = "\x1e", "\x1f"


def check_sentinels(*sentinels: str) -> None:
    """Whether outputs can be taken apart: no sentinel may begin as any other (or itself) ends, or lie in another."""
    for one in sentinels:
        for other in sentinels:
            ends = any(one.endswith(other[:k]) for k in range(1, len(other))) or (one is not other and other in one)
            if not one or ends:
                raise ValueError(f"sentinels {one!r} and {other!r} can't be told apart")


def escape(text: Column) -> Column:
    """text without the delimiter; ``unescape`` gives it back."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))


def unescape(text: Column) -> Column:
    plain = F.replace(text, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(plain, F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def mark_units(text: Column, units: str = LINES) -> Column:
    """The escaped text with a delimiter after each unit."""
    return F.regexp_replace(escape(text), F.lit(f"({units})"), F.lit("$1" + DELIMITER))


def count_units(marked: Column) -> Column:
    return F.length(marked) - F.length(F.replace(marked, F.lit(DELIMITER), F.lit("")))


def before(marked: Column, rank: Column) -> Column:
    """What stands before the delimiter of this rank (from 1); nothing for rank 0."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), rank.cast("int"))


def after(marked: Column, rank: Column, n: Column) -> Column:
    """What follows the delimiter of this rank; all for rank 0."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), (rank - n - 1).cast("int"))


def hashes(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a key."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 7,
    percent: int = 100,
    spm_percent: int = 50,
    sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
    units: str = LINES,
) -> DataFrame:
    """(key, text, n, form, prefix, middle, suffix, output) for every row; the parts are null where the form is plain.

    percent: so many of a hundred documents are transformed; spm_percent: so many of these with the suffix first.
    The units' expression must match whole texts without gaps, and must not tell the delimiter or the escape from other characters.
    """
    check_sentinels(*sentinels)
    p, s, m = (F.lit(x) for x in sentinels)
    h = hashes(F.col("_key"), seed)
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    marked = rows.withColumn("_marked", mark_units(F.col("_text"), units)).withColumn("_n", count_units(F.col("_marked")).cast("long"))
    n = F.col("_n")
    holds = F.lit(False)
    for x in sentinels:
        holds = holds | F.contains(F.col("_text"), F.lit(x))
    plain = (F.col("_text") == "") | holds | (h[2] % 100 >= percent)
    drawn = marked.select(
        "*",
        F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm").alias("_form"),
        F.least(h[0] % (n + 1), h[1] % (n + 1)).alias("_low"),
        F.greatest(h[0] % (n + 1), h[1] % (n + 1)).alias("_high"),
    )
    low, high, whole = F.col("_low"), F.col("_high"), F.col("_marked")
    middle = F.call_function("substring_index", before(whole, high), F.lit(DELIMITER), (low - high).cast("int"))
    cut = lambda part: F.when(F.col("_form") != "plain", unescape(part))
    parts = drawn.select(
        "_key", "_text", "_n", "_form", cut(before(whole, low)).alias("_p"), cut(middle).alias("_m"), cut(after(whole, high, n)).alias("_s")
    )
    a, b, c = F.col("_p"), F.col("_m"), F.col("_s")
    output = F.when(F.col("_form") == "psm", F.concat(p, a, s, c, m, b)).when(F.col("_form") == "spm", F.concat(s, c, p, a, m, b))
    return parts.select(
        F.col("_key").alias(key),
        F.col("_text").alias("text"),
        F.col("_n").alias("n"),
        F.col("_form").alias("form"),
        a.alias("prefix"),
        b.alias("middle"),
        c.alias("suffix"),
        F.coalesce(output, F.col("_text")).alias("output"),
    )


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that was transformed into output: the parts between sentinels, put back in order."""
    p, s, m = sentinels
    body = lambda first: F.substr(output, F.lit(len(first) + 1))
    up_to = lambda c, mark: F.substring_index(c, mark, 1)
    rest = lambda c, mark: F.substr(c, F.length(up_to(c, mark)) + len(mark) + 1)
    psm = F.concat(up_to(body(p), s), rest(rest(body(p), s), m), up_to(rest(body(p), s), m))
    spm = F.concat(up_to(rest(body(s), p), m), rest(rest(body(s), p), m), up_to(body(s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(transformed: DataFrame, key: str = "doc_id", sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    return transformed.select(
        F.col(f"`{key}`"),
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form"), sentinels), 256).alias("restored_sha256"),
    )
