"""Markdown chunks: sections by heading path, large ones split into overlapping parts. A Python table function.

Offsets and lengths are UTF-16 units, as the archive's are. A section of up to 800 tokens (a quarter of its units) is
one chunk; a larger one is cut at white space where the next word would make more than 500, and each part but the first
starts with the last 400 units of the part before. A text without any section text is one chunk as a whole; an empty one has none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET, MOST, OVERLAP = 500, 800, 400
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
SCHEMA = "chunk_index int, chunk_text string, chunk_tokens int, heading_path array<string>, start_offset int, end_offset int"


def units(s: str) -> int:
    return len(s) if s.isascii() else len(s.encode("utf-16-le", "surrogatepass")) // 2


def tokens(s: str) -> int:
    return -(-units(s) // 4)


def tail(s: str, n: int) -> str:
    """The last n UTF-16 units."""
    if s.isascii():
        return s[-n:]
    return s.encode("utf-16-le", "surrogatepass")[-2 * n :].decode("utf-16-le", "replace")


def sections(text: str) -> Iterator[tuple[list[str], str, int, int]]:
    """(heading path, trimmed text, start, end) of each stretch between headings that has text."""
    path: list[str] = []
    held: list[str] = []
    start = at = 0
    fence = ""

    def flush():
        body = "".join(held).strip()
        if body:
            yield list(path), body, start, at

    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        mark = FENCE.match(line)
        head = None if fence else HEADING.match(line.rstrip("\n"))
        if mark and (not fence or line.strip().startswith(fence)):
            fence = "" if fence else mark[1]
        if head:
            yield from flush()
            held.clear()
            del path[len(head[1]) - 1 :]
            path.append((head[2] or "").strip())
            start = at
        else:
            held.append(line)
        at += units(line)
    yield from flush()


def split_section(path: list[str], text: str, start: int, end: int) -> Iterator[tuple[str, int, list[str], int, int]]:
    now, size, first = "", 0, start
    for word in re.split(r"(\s+)", text):
        n = units(word)
        if -(-(size + n) // 4) > TARGET and now.strip():
            body = now.strip()
            yield body, tokens(body), path, first, first + size
            first += max(0, size - OVERLAP)
            now = tail(now, OVERLAP) + word
            size = units(now)
        else:
            now, size = now + word, size + n
    if now.strip():
        body = now.strip()
        yield body, tokens(body), path, first, end


def chunks(text: str | None) -> list[tuple[int, str, int, list[str], int, int]]:
    if not text or not text.strip():
        return []
    found = []
    for path, body, start, end in sections(text):
        if tokens(body) <= MOST:
            found.append((body, tokens(body), path, start, end))
        else:
            found += split_section(path, body, start, end)
    if not found:
        found = [(text.strip(), tokens(text.strip()), [], 0, units(text))]
    return [(i, *c) for i, c in enumerate(found)]


def chunk_documents(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, chunk_index, chunk_text, chunk_tokens, heading_path, start_offset, end_offset); a map without shuffle."""
    kind = docs.schema[key].dataType.simpleString()
    out_type = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = [(i, c) for i, t in enumerate(part.column(1).to_pylist()) for c in chunks(t)]
                cols = list(zip(*[c for _, c in rows], strict=True)) or [[]] * 6
                kinds = [pa.int32(), pa.string(), pa.int32(), out_type, pa.int32(), pa.int32()]
                yield pa.record_batch(
                    [part.column(0).take(pa.array([i for i, _ in rows], pa.int64())), *[pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)]],
                    [key, "chunk_index", "chunk_text", "chunk_tokens", "heading_path", "start_offset", "end_offset"],
                )

    return docs.select(key, F.col(body).cast("string")).mapInArrow(run, f"{key} {kind}, {SCHEMA}")
