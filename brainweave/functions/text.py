"""Text functions of the note archive, as Column expressions that stay inside code generation where Spark allows it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases that open a new note, and the prefix that marks feedback messages.
NEW_NOTE_COMMANDS = ("new note", "another note", "separate note", "different note", "different thought")
FEEDBACK_PREFIX = "#aifeedback"
#: English words that full-text search leaves out.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it "
    "its itself they them their theirs themselves what which who whom this that these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such no nor not only own same so "
    "than too very s t can will just don should now"
).split()


def estimate_tokens(text: Column) -> Column:
    """A quarter of the UTF-16 length, rounded up."""
    return F.ceil(F.length(F.encode(text, "UTF-16BE")) / F.lit(8)).cast("int")


def normalize_markdown(text: Column) -> Column:
    """Tags out, three and more newlines to two, runs of white space in a line to one blank, lines and text trimmed.

    The order is part of the meaning: lines of blanks are emptied after newlines were collapsed, so that three newlines can remain.
    """
    plain = F.regexp_replace(text, "<[^>]+>", "")
    two = F.regexp_replace(plain, "\n{3,}", "\n\n")
    lines = F.transform(F.split(two, "\n"), lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " ")))
    return strip(F.array_join(lines, "\n"))


def strip(text: Column) -> Column:
    """Trims white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def excerpt(text: Column, size: int = 300) -> Column:
    """The first line of 20 or more characters that is no heading, cut at a word to ``size`` with an ellipsis."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (F.length(x) >= 20) & ~x.startswith("#"))
    line = F.get(lines, F.lit(0))
    cut = F.regexp_replace(F.substring(line, 1, size), r"\s+\S*$", "")
    return F.when(F.length(line) <= size, line).otherwise(F.concat(cut, F.lit("…")))


def slugify(text: Column, size: int = 120) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, size)


def parse_list(text: Column, separators: str = "[,;\n]") -> Column:
    """Parts between separators: trimmed, lower-cased, empty ones dropped."""
    return F.filter(F.transform(F.split(text, separators), lambda x: F.lower(strip(x))), lambda x: x != "")


def split_addresses(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def word_count(text: Column) -> Column:
    """Runs of characters that aren't white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def search_terms(query: str) -> list[str]:
    """Terms of a query: characters other than ASCII letters and digits are taken out of words, stop words are left out."""
    found = ("".join(c for c in w if c.isascii() and c.isalnum()).lower() for w in query.split())
    return [w for w in dict.fromkeys(found) if w and w not in STOP_WORDS]


def keywords(text: Column, size: int = 6) -> Column:
    """The first distinct words of four or more letters or digits of any script."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{4,}"), F.lit(0))), 1, size)


def name_tokens(text: Column) -> Column:
    """The set of lower-case ASCII words and numbers of a name."""
    return F.array_distinct(words(text))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def truncate(text: Column, size: int = 200) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 1), F.lit("…"))).otherwise(text)


def is_feedback(text: Column) -> Column:
    return F.lower(strip(text)).startswith(FEEDBACK_PREFIX)


def is_new_note(text: Column) -> Column:
    return F.lower(strip(text)).isin(*NEW_NOTE_COMMANDS)


def first_line_hashtags(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.get(F.split(text, "\n"), F.lit(0))), F.lit(r"#(\w+)"), F.lit(1))


def address_of(text: Column) -> Column:
    """What stands in angle brackets, else the whole; lower-cased."""
    inner = F.regexp_extract(text, "<([^>]+)>", 1)
    return F.lower(strip(F.when(inner != "", inner).otherwise(text)))


def in_domains(address: Column, domains: list[str]) -> Column:
    """Whether an address ends with one of the domains (configuration)."""
    found = F.lit(False)
    for d in domains:
        found = found | address.endswith("@" + d.lower())
    return found


def mail_scope(labels: Column, sender: Column, receivers: Column, domains: list[str], label: str = "family") -> Column:
    """family by label, then by sender, then by any receiver; else personal."""
    by_label = F.exists(labels, lambda x: F.lower(x) == label)
    by_receiver = F.exists(receivers, lambda x: in_domains(address_of(x), domains))
    family = F.coalesce(by_label, F.lit(False)) | F.coalesce(in_domains(address_of(sender), domains), F.lit(False))
    return F.when(family | F.coalesce(by_receiver, F.lit(False)), "family").otherwise("personal")


@F.arrow_udf(T.StringType())
def _outside(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, spans in batches:
        out = []
        for text, cuts in zip(texts.to_pylist(), spans.to_pylist()):
            if text is not None:
                units = text.encode("utf-16-le", "surrogatepass")
                for cut in sorted((c for c in cuts or [] if c["size"] > 0), key=lambda c: -c["start"]):
                    units = units[: 2 * cut["start"]] + units[2 * (cut["start"] + cut["size"]) :]
                text = units.decode("utf-16-le", "ignore")
            out.append(text)
        yield pa.array(out, pa.string())


def without_spans(text: Column, spans: Column) -> Column:
    """text without the spans (array of structs start, size; in UTF-16 units, as chats count), runs of white space as one blank, trimmed.

    Where spans is null the text stays as it is. Half a character that a span leaves goes too.
    """
    rest = F.regexp_replace(_outside(text, spans), r"(?U)[\s\x{FEFF}]+", " ")
    return F.when(spans.isNull(), text).otherwise(F.trim(rest))


def is_signal(text: Column, phrases: list[str], closing: bool = True) -> Column:
    """Whether a message is one of the phrases, with at most one closing mark if that is allowed."""
    said = F.lower(strip(text))
    return (F.regexp_replace(said, r"[.!?]\z", "") if closing else said).isin(*phrases)


def is_done(text: Column) -> Column:
    return is_signal(text, ["done", "/done"])


def is_cancel(text: Column) -> Column:
    return is_signal(text, ["cancel", "/cancel"], closing=False)


def escape_xml(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def session_text(title: Column, summary: Column, labels: Column) -> Column:
    """A title in brackets, a summary and a line of labels, each paragraph only if there is one."""
    head = F.when(title.isNotNull() & (title != ""), F.concat(F.lit("["), title, F.lit("]")))
    tail = F.when(F.size(labels) > 0, F.concat(F.lit("(via "), F.array_join(labels, " · "), F.lit(")")))
    return F.concat_ws("\n\n", head, summary, tail)


def suggested_title(actions: Column, summary: Column, text: Column) -> Column:
    """The first reason that a task among actions has, else the summary, else the text: trimmed, 200 characters at most; may be empty."""
    task = F.get(F.filter(actions, lambda a: (a["kind"] == "task") & (strip(a["reason"]) != "")), F.lit(0))["reason"]
    some = lambda c: F.when(strip(c) != "", strip(c))
    return truncate(F.coalesce(some(task), some(summary), strip(text)))


def split_message(text: Column, size: int = 3900) -> Column:
    """Parts of at most ``size`` characters, cut at the last newline in a part's second half if there is one."""
    half = size // 2
    part = rf"(?s)\G\n?(.{{1,{size}}}\z|.{{{half},{size}}}(?=\n)|.{{1,{size}}})"
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(part), F.lit(1)))


def threshold(value: Column, default: float = 0.6) -> Column:
    """The finite number that a setting begins with, else the default."""
    number = F.regexp_extract(value, r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)", 1).try_cast("double")
    return F.coalesce(F.when(F.abs(number) < float("inf"), number), F.lit(default))
